"""Interval overlap joins as equi-joins on bins.

A plain overlap predicate would leave chrom as the only equi-key: some 25
skewed partitions of quadratic work. Here every interval of the right side is
filed at a level whose bin is wider than it, so under at most two bins of one
level, however long it is; a left interval looks up the bins it touches at each
level. The join key is (chrom, level, bin), the overlap itself is a residual
predicate, and a pair is kept in its first common bin only, so nothing has to
be deduplicated. The join strategy is Spark's choice: a small right side is
broadcast, a large one shuffled, hot bins are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bin widths: powers of two, so that a division is exact and cheap.
_BASE, _STEP, _LEVELS = 7, 4, 5


def _widths(base: int = _BASE) -> list[int]:
    return [1 << (base + _STEP * k) for k in range(_LEVELS)]


def _level(begin: Column, end: Column, widths: list[int]) -> Column:
    out = F.lit(len(widths) - 1)
    for k in range(len(widths) - 2, -1, -1):
        out = F.when(end - begin < widths[k], F.lit(k)).otherwise(out)
    return out


def _width(level: Column, widths: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in widths]), level + 1).cast("bigint")


def bin_right(df: DataFrame, chrom: str, begin: str, end: str, base: int = _BASE) -> DataFrame:
    """``df`` with its join key: one row per bin, nearly always one or two."""
    w = _widths(base)
    lv = _level(F.col(begin), F.col(end), w)
    width = _width(F.col("__level"), w)
    return df.withColumn("__level", lv).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(begin) / width).cast("bigint"), F.floor(F.col(end) / width).cast("bigint")))).withColumn("__chrom", F.col(chrom))


def bin_left(df: DataFrame, chrom: str, begin: str, end: str, base: int = _BASE) -> DataFrame:
    w = _widths(base)

    def touched(level: int, width: int) -> Column:
        bins = F.sequence(F.floor(F.col(begin) / width).cast("bigint"), F.floor(F.col(end) / width).cast("bigint"))
        return F.transform(bins, lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))

    per_level = [touched(k, x) for k, x in enumerate(w)]
    return df.withColumn("__key", F.explode(F.concat(*per_level))).withColumns({"__level": F.col("__key.level"), "__bin": F.col("__key.bin"), "__chrom": F.col(chrom)}).drop("__key")


def overlap_join(left: DataFrame, right: DataFrame, left_cols: tuple[str, str, str], right_cols: tuple[str, str, str], condition: Column | None = None, base: int = _BASE) -> DataFrame:
    """Inner join of overlapping closed intervals on one chrom, each pair once.

    Column names of the sides must differ. Rows with a null chrom, begin or end,
    or an end before the begin, overlap nothing. ``condition`` further narrows
    pairs inside the join.
    """
    (lc, lb, le), (rc, rb, re_) = left_cols, right_cols
    ok = lambda b, e: F.col(b).isNotNull() & F.col(e).isNotNull() & (F.col(e) >= F.col(b))
    a = bin_left(left.where(ok(lb, le) & F.col(lc).isNotNull()), lc, lb, le, base)
    b = bin_right(right.where(ok(rb, re_) & F.col(rc).isNotNull()), rc, rb, re_, base)
    b = b.withColumnsRenamed({"__level": "__rlevel", "__bin": "__rbin", "__chrom": "__rchrom"})
    width = _width(F.col("__level"), _widths(base))
    first = F.col("__bin") == F.greatest(F.floor(F.col(lb) / width), F.floor(F.col(rb) / width)).cast("bigint")
    on = (F.col("__chrom") == F.col("__rchrom")) & (F.col("__level") == F.col("__rlevel")) & (F.col("__bin") == F.col("__rbin")) & (F.col(lb) <= F.col(re_)) & (F.col(le) >= F.col(rb)) & first
    if condition is not None:
        on = on & condition
    return a.join(b, on).drop("__level", "__bin", "__chrom", "__rlevel", "__rbin", "__rchrom")


#: Width of the bins in which counts are added up.
_COUNTED = 1 << 14


def overlap_counts(left: DataFrame, right: DataFrame, left_cols: tuple[str, str, str], right_cols: tuple[str, str, str], name: str, width: int = _COUNTED) -> DataFrame:
    """``left``'s columns with the number of ``right`` intervals that each
    overlaps (0 for none), without making the pairs: those that begin no later
    than its end, less those that end before its begin. Both numbers are running
    counts over (chrom, bin), each bin in order by itself, plus the counts of
    the bins before. Rows of ``left`` must differ; empty or null intervals of
    ``right`` count for nothing, of ``left`` they have 0.
    """
    (lc, lb, le), (rc, rb, re_) = left_cols, right_cols
    r = right.where(F.col(rb).isNotNull() & F.col(re_).isNotNull() & (F.col(re_) >= F.col(rb)) & F.col(rc).isNotNull())
    # (chrom, at, begins, ends): a begin counts from its base on, an end from the base after it.
    steps = r.select(F.col(rc).alias("__c"), F.explode(F.array(F.struct(F.col(rb).alias("at"), F.lit(1).alias("b"), F.lit(0).alias("e")), F.struct((F.col(re_) + 1).alias("at"), F.lit(0).alias("b"), F.lit(1).alias("e")))).alias("x"))
    steps = steps.groupBy("__c", F.col("x.at").alias("__at")).agg(F.sum("x.b").alias("__nb"), F.sum("x.e").alias("__ne"))
    steps = steps.withColumn("__bin", F.floor(F.col("__at") / width).cast("bigint"))
    # Counts of the bins before: a row per bin, and so few that a window over a contig's bins is small.
    before = Window.partitionBy("__c").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = steps.groupBy("__c", "__bin").agg(F.sum("__nb").alias("__tb"), F.sum("__ne").alias("__te"))
    row = F.struct(*[F.col(c) for c in left.columns])
    ok = F.col(lb).isNotNull() & F.col(le).isNotNull() & (F.col(le) >= F.col(lb)) & F.col(lc).isNotNull()
    asks = left.where(ok).select(row.alias("__row"), F.col(lc).alias("__c"), F.explode(F.array(F.struct(F.col(le).alias("at"), F.lit(True).alias("last")), F.struct(F.col(lb).alias("at"), F.lit(False).alias("last")))).alias("x"))
    asks = asks.select("__row", "__c", F.col("x.at").alias("__at"), F.col("x.last").alias("__last"), F.floor(F.col("x.at") / width).cast("bigint").alias("__bin"))
    # Every asked bin gets its base, also one without steps of its own.
    known = bins.unionByName(asks.select("__c", "__bin").distinct().withColumns({"__tb": F.lit(0).cast("bigint"), "__te": F.lit(0).cast("bigint")})).groupBy("__c", "__bin").agg(F.sum("__tb").alias("__tb"), F.sum("__te").alias("__te"))
    base = known.select("__c", "__bin", F.coalesce(F.sum("__tb").over(before), F.lit(0)).alias("__nb"), F.coalesce(F.sum("__te").over(before), F.lit(0)).alias("__ne"))
    none = F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType)
    events = base.select("__c", "__bin", F.lit(None).cast("bigint").alias("__at"), "__nb", "__ne", none.alias("__row"), F.lit(None).cast("boolean").alias("__last"))
    events = events.unionByName(steps.select("__c", "__bin", "__at", "__nb", "__ne", none.alias("__row"), F.lit(None).cast("boolean").alias("__last")))
    zero = F.lit(0).cast("bigint")
    events = events.unionByName(asks.select("__c", "__bin", "__at", zero.alias("__nb"), zero.alias("__ne"), "__row", "__last"))
    run = Window.partitionBy("__c", "__bin").orderBy(F.col("__at").asc_nulls_first(), F.col("__last").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = events.select("__row", "__last", F.sum("__nb").over(run).alias("__cb"), F.sum("__ne").over(run).alias("__ce")).where("__last is not null")
    counts = told.groupBy("__row").agg((F.sum(F.when(F.col("__last"), F.col("__cb"))) - F.sum(F.when(~F.col("__last"), F.col("__ce")))).alias(name))
    return counts.select("__row.*", name).unionByName(left.where(~ok | ok.isNull()).withColumn(name, zero))


def overlap_width(lb: str, le: str, rb: str, re_: str) -> Column:
    """Bases that two overlapping closed intervals share."""
    return F.least(F.col(le), F.col(re_)) - F.greatest(F.col(lb), F.col(rb)) + 1
