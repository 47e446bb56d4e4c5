"""Running values along contigs without a task for each contig.

A window over a contig sorts all its rows in one task. Here a contig is cut
into spans; a window runs inside each span only, and what the spans before (or
after) it come to is a row per span, small enough for a window of its own, that
is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 20
_BEFORE, _TO, _AFTER = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0), (1, Window.unboundedFollowing)


def running(df: DataFrame, key: str, at: str, order: list, asked: dict[str, tuple[str, Column]], span: int = SPAN) -> DataFrame:
    """``df`` with a column for each of ``asked`` (name -> kind, value), along
    the rows of equal ``key`` in the order of ``at``, then ``order``:

    ``max_before``, ``max_to``  greatest value of the rows before, or up to here
    ``sum_to``                  their sum up to here
    ``prev``, ``next``          the value of the row before or after

    Null where there is no such row. Rows with a null ``at`` come first.
    """
    keys = [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"), F.coalesce(F.floor(F.col(at) / span).cast("bigint"), F.lit(-(1 << 62))).alias("__span")]
    rows = df.select("*", *keys, *[v.alias(f"__v_{n}") for n, (_, v) in asked.items()])
    place = F.struct(F.col(at).alias("at"), *[(F.col(c) if isinstance(c, str) else c).alias(f"o{k}") for k, c in enumerate(order)])
    rows = rows.withColumn("__at", place)
    v = lambda n: F.col(f"__v_{n}")
    folds = {"max_before": lambda n: F.max(v(n)), "max_to": lambda n: F.max(v(n)), "sum_to": lambda n: F.sum(v(n)), "prev": lambda n: F.max_by(F.struct(v(n).alias("x")), F.col("__at"))["x"], "next": lambda n: F.min_by(F.struct(v(n).alias("x")), F.col("__at"))["x"]}
    spans = rows.groupBy("__key", "__span").agg(*[folds[kind](n).alias(f"__v_{n}") for n, (kind, _) in asked.items()])
    over = Window.partitionBy("__key").orderBy("__span")
    carried = {
        "max_before": lambda n: F.max(v(n)).over(over.rowsBetween(*_BEFORE)), "max_to": lambda n: F.max(v(n)).over(over.rowsBetween(*_BEFORE)), "sum_to": lambda n: F.sum(v(n)).over(over.rowsBetween(*_BEFORE)),
        "prev": lambda n: F.lag(v(n)).over(over), "next": lambda n: F.lead(v(n)).over(over),
    }
    spans = spans.select(F.col("__key").alias("__k"), F.col("__span").alias("__s"), *[carried[kind](n).alias(f"__c_{n}") for n, (kind, _) in asked.items()])
    rows = rows.join(spans, (F.col("__key") == F.col("__k")) & (F.col("__span") == F.col("__s")))
    own = Window.partitionBy("__key", "__span").orderBy("__at")
    out = {}
    for n, (kind, _) in asked.items():
        c = F.col(f"__c_{n}")
        if kind in ("max_before", "max_to"):
            out[n] = F.greatest(F.max(v(n)).over(own.rowsBetween(*(_BEFORE if kind == "max_before" else _TO))), c)
        elif kind == "sum_to":
            out[n] = F.sum(v(n)).over(own.rowsBetween(*_TO)) + F.coalesce(c, F.lit(0))
        else:
            first = (F.row_number().over(own) == 1) if kind == "prev" else F.lead(F.lit(1)).over(own).isNull()
            out[n] = F.when(first, c).otherwise((F.lag if kind == "prev" else F.lead)(v(n)).over(own))
    named = rows.withColumns({f"__o_{n}": e for n, e in out.items()})
    return named.select(*[F.col(c) for c in df.columns if c not in asked], *[F.col(f"__o_{n}").alias(n) for n in asked])
