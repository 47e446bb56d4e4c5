"""Weighted histograms and other whole-table statistics."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATEGORIES = 100  # more distinct values than this make no histogram


@dataclass(frozen=True)
class NumberHistogram:
    """``bins`` equal bins over [low, high], the last closed; with ``log_from``
    bin 0 holds what is below it and the others are equal in log10."""

    low: float
    high: float
    bins: int = 100
    log_from: float | None = None

    def __post_init__(self):
        if self.bins < 1 or not self.high > self.low:
            raise ValueError("a histogram needs bins and low < high")
        if self.log_from is not None and not 0 < self.log_from < self.high:
            raise ValueError("a log scale begins above zero and below high")

    @staticmethod
    def over(low: float, high: float, bins: int = 100) -> NumberHistogram:
        """From the data's range; a range of one value is widened by 1."""
        return NumberHistogram(low, high if high > low else low + 1.0, bins)

    def index(self, v: Column) -> Column:
        """Bin of a value; -1 below the range, ``bins`` above, null for null and NaN."""
        if self.log_from is None:
            step = self.bins / (self.high - self.low)
            k = ((v - self.low) * step).cast("int")
        else:
            lo = math.log10(self.log_from)
            step = (self.bins - 1) / (math.log10(self.high) - lo)
            k = F.when(v < self.log_from, 0).otherwise(((F.log10(F.greatest(v, F.lit(self.log_from))) - lo) * step).cast("int") + 1)
        inside = F.least(F.greatest(k, F.lit(0)), F.lit(self.bins - 1))
        return F.when(v.isNull() | F.isnan(v), F.lit(None)).when(v < self.low, -1).when(v > self.high, self.bins).otherwise(inside)

    def edges(self) -> list[float]:
        if self.log_from is None:
            return [self.low + (self.high - self.low) * k / self.bins for k in range(self.bins + 1)]
        a, b = math.log10(self.log_from), math.log10(self.high)
        return [self.low, *(10 ** (a + (b - a) * k / (self.bins - 1)) for k in range(self.bins))]


def number_histogram(df: DataFrame, value: str, hist: NumberHistogram, weight: Column | None = None) -> DataFrame:
    """(bin, n): one row per bin that is not empty, -1 and ``bins`` out of range."""
    v = F.col(value).cast("double")
    return df.select(hist.index(v).alias("bin"), (weight if weight is not None else F.lit(1)).cast("bigint").alias("w")).where("bin is not null").groupBy("bin").agg(F.sum("w").alias("n"))


@dataclass(frozen=True)
class Saved:
    """A number histogram as it is kept: counts of all bins, what lay below and
    above the range, and the data's least and greatest value."""

    hist: NumberHistogram
    bars: list[int]
    out_of_range: tuple[int, int]
    least: float | None
    greatest: float | None

    def to_json(self) -> str:
        h = self.hist
        return json.dumps({"config": {"low": h.low, "high": h.high, "bins": h.bins, "log_from": h.log_from}, "bins": h.edges(), "bars": self.bars, "out_of_range_bins": list(self.out_of_range), "min_value": self.least, "max_value": self.greatest})

    @staticmethod
    def from_json(text: str) -> Saved:
        d = json.loads(text)
        return Saved(NumberHistogram(**d["config"]), d["bars"], tuple(d["out_of_range_bins"]), d["min_value"], d["max_value"])

    def rows(self, spark: SparkSession) -> DataFrame:
        """(bin, n) as ``number_histogram`` gives it."""
        every = [(-1, self.out_of_range[0]), *enumerate(self.bars), (self.hist.bins, self.out_of_range[1])]
        return spark.createDataFrame([r for r in every if r[1]], "bin int, n bigint")


def measure(df: DataFrame, value: str, hist: NumberHistogram, weight: Column | None = None) -> Saved:
    """The whole histogram of a column: two rows more than it has bins reach the driver."""
    got = {r.bin: r.n for r in number_histogram(df, value, hist, weight).collect()}
    ends = min_max(df, value).first()
    return Saved(hist, [got.get(k, 0) for k in range(hist.bins)], (got.get(-1, 0), got.get(hist.bins, 0)), ends and ends["min"], ends and ends["max"])


def save(spark: SparkSession, saved: Saved, path: str) -> None:
    """One JSON document, under a path of any file system that Spark writes to."""
    spark.createDataFrame([(saved.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Saved:
    return Saved.from_json(spark.read.text(path, wholetext=True).where("value <> ''").first().value)


def categorical_histogram(df: DataFrame, value: str, weight: Column | None = None, enforce: bool = False) -> DataFrame:
    """(value, n). More than 100 distinct values give no rows unless enforced:
    the histogram is null then, and ``null_reason`` says why."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.sum(weight if weight is not None else F.lit(1)).cast("bigint").alias("n"))
    if enforce:
        return counts
    gate = counts.limit(CATEGORIES + 1).agg(F.count("*").alias("__kinds"))
    return counts.join(F.broadcast(gate), F.col("__kinds") <= CATEGORIES).drop("__kinds")


def null_reason(df: DataFrame, value: str) -> DataFrame:
    n = df.where(F.col(value).isNotNull()).select(value).distinct().limit(CATEGORIES + 1).agg(F.count("*").alias("n"))
    return n.where(F.col("n") > CATEGORIES).select(F.lit(f"more than {CATEGORIES} distinct values").alias("reason"))


def top_categories(hist: DataFrame, k: int, other: str = "Other Values") -> DataFrame:
    """The k largest categories in order and the rest as one. Only the k meet in
    one task, however many categories there are."""
    head = hist.orderBy(F.desc("n"), F.asc("value")).limit(k)
    ranked = head.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), F.asc("value")))).select(F.col("value").alias("__v"), "rank")
    told = hist.join(ranked, F.col("value") == F.col("__v"), "left")
    return told.groupBy(F.when(F.col("rank").isNotNull(), F.col("value").cast("string")).otherwise(F.lit(other)).alias("value"), F.coalesce("rank", F.lit(k + 1)).alias("rank")).agg(F.sum("n").alias("n"))


def categories_by_percent(hist: DataFrame, percent: float, other: str = "Other Values") -> DataFrame:
    """The largest categories that together make up ``percent`` of the weight."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), F.asc("value"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = before * 100.0 < F.lit(percent) * total
    marked = hist.withColumn("__head", head)
    return marked.groupBy(F.when(F.col("__head"), F.col("value").cast("string")).otherwise(F.lit(other)).alias("value")).agg(F.sum("n").alias("n"))


def min_max(df: DataFrame, *values: str) -> DataFrame:
    """(score, min, max, n) with NaN and null left out, in one pass for all columns."""
    rows = F.array(*[F.struct(F.lit(v).alias("score"), F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")).alias("v")) for v in values])
    return df.select(F.explode(rows).alias("x")).groupBy("x.score").agg(F.min("x.v").alias("min"), F.max("x.v").alias("max"), F.count("x.v").alias("n"))


def genome_statistics(chunks: DataFrame, alphabet: str = "ACGTN") -> DataFrame:
    """(chrom, kind, n, percent) of bases and neighbouring pairs, per contig and
    in total (chrom null). ``chunks``: (chrom, chunk, seq); a pair that lies
    over two chunks is counted through the next chunk's first base."""
    after = chunks.select(F.col("chrom").alias("__c"), (F.col("chunk") - 1).alias("__k"), F.upper(F.substring("seq", 1, 1)).alias("__first"))
    c = chunks.join(after, (F.col("chrom") == F.col("__c")) & (F.col("chunk") == F.col("__k")), "left")
    c = c.select("chrom", F.upper("seq").alias("seq"), F.coalesce("__first", F.lit("")).alias("__next"))
    both = F.concat("seq", "__next")
    pairs = [a + b for a in alphabet for b in alphabet]

    def pair_count(p: str) -> Column:
        # Overlapping occurrences: of "AA", every A that an A follows.
        if p[0] == p[1]:
            gone = F.regexp_replace(both, f"{p[0]}(?={p[0]})", "")
            return F.length(both) - F.length(gone)
        return (F.length(both) - F.length(F.replace(both, F.lit(p), F.lit("")))) / 2

    rows = [F.struct(F.lit("base").alias("what"), F.lit(b).alias("kind"), (F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(b), F.lit("")))).cast("bigint").alias("n")) for b in alphabet]
    rows += [F.struct(F.lit("pair").alias("what"), F.lit(p).alias("kind"), pair_count(p).cast("bigint").alias("n")) for p in pairs]
    one = c.select("chrom", F.explode(F.array(*rows)).alias("x")).select("chrom", "x.what", "x.kind", "x.n")
    counts = one.groupBy("what", "kind", "chrom").agg(F.sum("n").alias("n"))
    every = counts.unionByName(counts.groupBy("what", "kind").agg(F.sum("n").alias("n")).withColumn("chrom", F.lit(None).cast("string")))
    share = Window.partitionBy("chrom", "what")
    return every.withColumn("percent", F.col("n") * 100.0 / F.nullif(F.sum("n").over(share), F.lit(0)))


def describe(df: DataFrame) -> DataFrame:
    """One row per column: count, distinct values, most frequent value, and for
    numbers mean, deviation, least, quartiles, greatest."""
    out = None
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double")
        d = c.cast("double") if number else F.lit(None).cast("double")
        one = df.agg(
            F.lit(name).alias("column"), F.count(c).alias("count"), F.countDistinct(c).alias("unique"), F.mode(c.cast("string"), True).alias("top"), F.avg(d).alias("mean"), F.stddev(d).alias("std"), F.min(d).alias("min"),
            F.percentile(d, 0.25).alias("q1"), F.percentile(d, 0.5).alias("median"), F.percentile(d, 0.75).alias("q3"), F.max(d).alias("max"),
        )
        out = one if out is None else out.unionByName(one)
    return out
