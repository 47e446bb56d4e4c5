"""Annotation of streams: stateless, append mode, one row out per row in.

A join followed by ``groupBy`` needs state in a stream. Here a dimension is laid
out as one array of records per (chrom, bin), a stream row joins the few bins it
touches as columns, not rows, and its region aggregate is worked out inside the
row by higher-order functions. So the query keeps no state, and its result is
that of the batch operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scores import REGION_LIMIT, Attribute, Score

#: Bin widths. A row looks into the level whose bins are as long as its span, so
#: it touches one bin or two neighbouring ones, and short rows meet short arrays.
BINS = (1 << 7, 1 << 10, 1 << 14, 1 << 19)


def binned(score: Score, sources: list[str], widths: tuple[int, ...] = BINS) -> DataFrame:
    """(b_chrom, b_level, b_bin, records): at every level, each record in every
    bin it touches, in order."""
    r = score.record(sources)

    def touched(level: int, width: int) -> Column:
        bins = F.sequence(F.floor(F.col("__r_begin") / width).cast("bigint"), F.floor(F.col("__r_end") / width).cast("bigint"))
        return F.transform(bins, lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))

    one = r.withColumn("__b", F.explode(F.concat(*[touched(k, w) for k, w in enumerate(widths)])))
    rec = F.struct("__r_order", F.col("__r_begin").alias("b"), F.col("__r_end").alias("e"), *[F.col(f"__v_{s}").alias(f"v{k}") for k, s in enumerate(sources)])
    return one.groupBy(F.col("__r_chrom").alias("b_chrom"), F.col("__b.level").alias("b_level"), F.col("__b.bin").alias("b_bin")).agg(F.array_sort(F.collect_list(rec)).alias("records"))


def _fold(records: Column, k: int, name: str, lo: Column, hi: Column) -> Column:
    v = lambda x: x[f"v{k}"].cast("double")
    w = lambda x: (F.least(x["e"], hi) - F.greatest(x["b"], lo) + 1).cast("double")
    known = F.filter(records, lambda x: x[f"v{k}"].isNotNull())
    if name == "max":
        return F.array_max(F.transform(known, v))
    if name == "min":
        return F.array_min(F.transform(known, v))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + w(x))
    if name == "count":
        return F.nullif(total.cast("bigint"), F.lit(0).cast("bigint"))
    if name == "bool":
        return F.when(F.size(records) > 0, F.size(known) > 0)
    if name == "mean":
        return F.aggregate(known, F.lit(0.0), lambda a, x: a + v(x) * w(x)) / F.nullif(total, F.lit(0.0))
    raise ValueError(f"{name} is not worked out inside a row of a stream")


def annotate_stream(df: DataFrame, score: Score, attributes: list[Attribute], ann: str = "ann", widths: tuple[int, ...] = BINS, limit: int = REGION_LIMIT) -> DataFrame:
    """Position scores for a streaming (or batch) DataFrame: aggregators max, min,
    mean, count and bool; substitutions read their first record. Spans longer
    than ``limit`` (at most the widest bin) give null, as in the batch operator."""
    if limit > widths[-1]:
        raise ValueError("a span must not be longer than the widest bin")
    sources = list(dict.fromkeys(a.source for a in attributes))
    dim = binned(score, sources, widths)
    a = F.col(ann)
    level = F.lit(len(widths) - 1)
    for k in range(len(widths) - 2, -1, -1):
        level = F.when(a["pos_end"] - a["pos"] < widths[k], F.lit(k)).otherwise(level)
    width = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("__l") + 1)
    out = df.withColumn("__l", level).withColumns({"__c": a["chrom"], "__b0": F.floor(a["pos"] / width).cast("bigint"), "__b1": F.floor(a["pos_end"] / width).cast("bigint")})
    for k in (0, 1):
        d = dim.select(F.col("b_chrom").alias(f"__bc{k}"), F.col("b_level").alias(f"__bl{k}"), F.col("b_bin").alias(f"__bb{k}"), F.col("records").alias(f"__rec{k}"))
        on = (F.col("__c") == F.col(f"__bc{k}")) & (F.col("__l") == F.col(f"__bl{k}")) & (F.col(f"__b{k}") == F.col(f"__bb{k}"))
        if k:
            on = on & (F.col("__b1") != F.col("__b0"))
        out = out.join(d, on, "left")
    empty = F.filter(F.coalesce("__rec0", "__rec1"), lambda x: F.lit(False))
    # A record in both bins is taken from the first; of the second, those that begin in it.
    later = F.filter(F.coalesce("__rec1", empty), lambda x: x["b"] >= F.col("__b1") * width)
    both = F.concat(F.coalesce("__rec0", empty), later)
    lo, hi = a["pos"], a["pos_end"]
    met = F.filter(both, lambda x: (x["b"] <= hi) & (x["e"] >= lo))
    fits = hi - lo + 1 <= limit
    out = out.withColumn("__met", F.when(fits, met))
    for at in attributes:
        k = sources.index(at.source)
        agg = score.aggregator(at)
        folded = _fold(F.col("__met"), k, agg.name, lo, hi)
        kind = agg.kind(score.values[at.source])
        first = F.get(F.col("__met"), F.lit(0))[f"v{k}"].cast(kind)
        out = out.withColumn(at.column, F.when(F.size("__met") > 0, F.when(a["type"] == "SUBSTITUTION", first).otherwise(folded.cast(kind))))
    return out.drop("__c", "__l", "__b0", "__b1", "__bc0", "__bl0", "__bb0", "__rec0", "__bc1", "__bl1", "__bb1", "__rec1", "__met")


def to_files(stream: DataFrame, path: str, checkpoint: str):
    """An annotated stream into Parquet files, up to what is there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_batches(stream: DataFrame, annotate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, partition_by: list[str] | None = None):
    """A stream through any batch pipeline, micro-batch by micro-batch. Batches are
    written under their number, so one that is repeated replaces itself."""

    def one(df: DataFrame, number: int) -> None:
        w = annotate(df).write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).trigger(availableNow=True).start()
