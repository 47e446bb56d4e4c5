"""Set algebra over closed regions (chrom, start, stop); a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .running import running

_LOW, _HIGH = -(1 << 60), 1 << 60


def _closed(df: DataFrame) -> DataFrame:
    return df.select("chrom", F.coalesce(F.col("start").cast("bigint"), F.lit(_LOW)).alias("start"), F.coalesce(F.col("stop").cast("bigint"), F.lit(_HIGH)).alias("stop"))


def _opened(df: DataFrame) -> DataFrame:
    return df.select("chrom", F.when(F.col("start") != _LOW, F.col("start")).alias("start"), F.when(F.col("stop") != _HIGH, F.col("stop")).alias("stop"))


def _islands(df: DataFrame, name: str) -> DataFrame:
    """``df`` (chrom, start, stop; closed) with the start of the island that each
    region lies in."""
    reach = running(df, "chrom", "start", ["stop"], {"__reach": ("max_before", F.col("stop"))})
    new = F.col("__reach").isNull() | (F.col("start") > F.col("__reach"))
    # Starts rise, so the latest start of an island is the greatest so far.
    return running(reach, "chrom", "start", ["stop"], {name: ("max_to", F.when(new, F.col("start")))}).drop("__reach")


def collapse(df: DataFrame) -> DataFrame:
    """Union as disjoint regions. Regions that share a base become one; regions
    that only touch (1-2 and 3-4) stay two."""
    named = _islands(_closed(df), "island")
    return _opened(named.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")))


def components(df: DataFrame) -> DataFrame:
    """Each region with its connected group on its chrom, known by the group's start."""
    return _opened_component(_islands(_closed(df), "component"))


def _opened_component(df: DataFrame) -> DataFrame:
    return df.select("chrom", F.when(F.col("start") != _LOW, F.col("start")).alias("start"), F.when(F.col("stop") != _HIGH, F.col("stop")).alias("stop"), "component")


def union(*dfs: DataFrame) -> DataFrame:
    out = dfs[0].select("chrom", "start", "stop")
    for d in dfs[1:]:
        out = out.unionByName(d.select("chrom", "start", "stop"))
    return collapse(out)


def _sweep(a: DataFrame, b: DataFrame, keep) -> DataFrame:
    """Bases by whether a and b cover them, from their boundaries in order; both
    collapsed first. Pieces that touch are one piece only within one region."""
    events = None
    for k, d in enumerate((collapse(a), collapse(b))):
        d = _closed(d)
        for at, step in ((F.col("start"), 1), (F.col("stop") + 1, -1)):
            e = d.select("chrom", at.alias("at"), F.lit(step if k == 0 else 0).alias("da"), F.lit(step if k == 1 else 0).alias("db"))
            events = e if events is None else events.unionByName(e)
    points = events.groupBy("chrom", "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"), F.max(F.abs("da")).alias("ea"), F.max(F.abs("db")).alias("eb"))
    spans = running(points, "chrom", "at", [], {"ca": ("sum_to", F.col("da")), "cb": ("sum_to", F.col("db")), "next": ("next", F.col("at"))})
    spans = spans.where(F.col("next").isNotNull()).withColumns({"ca": F.col("ca") > 0, "cb": F.col("cb") > 0})
    held = spans.where(keep(F.col("ca"), F.col("cb")))
    return _opened(held.select("chrom", F.col("at").alias("start"), (F.col("next") - 1).alias("stop")))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sweep(a, b, lambda x, y: x & y)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sweep(a, b, lambda x, y: x & ~y)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sweep(a, b, lambda x, y: x != y)


def total_length(df: DataFrame) -> DataFrame:
    """Bases per chrom of the collapsed regions."""
    return collapse(df).groupBy("chrom").agg(F.sum(F.col("stop") - F.col("start") + 1).cast("bigint").alias("length"))


def unique(df: DataFrame) -> DataFrame:
    return df.select("chrom", "start", "stop").distinct()


def intersect_pair(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct(start, stop) of two regions on one chrom, null if they share nothing."""
    s, e = F.greatest(s1, s2), F.least(e1, e2)  # nulls are skipped: an open end yields
    return F.when(s.isNull() | e.isNull() | (s <= e), F.struct(s.alias("start"), e.alias("stop")))


def contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether the first region holds the second; open ends are unbounded."""
    lo = s1.isNull() | F.coalesce(s2 >= s1, F.lit(False))
    hi = e1.isNull() | F.coalesce(e2 <= e1, F.lit(False))
    return lo & hi


def intersects(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.coalesce(s1 <= e2, F.lit(True)) & F.coalesce(s2 <= e1, F.lit(True))


def isin(chrom: Column, pos: Column, region_chrom: Column, start: Column, stop: Column) -> Column:
    return (chrom == region_chrom) & F.coalesce(pos >= start, F.lit(True)) & F.coalesce(pos <= stop, F.lit(True))


def split(contigs: DataFrame, size: int) -> DataFrame:
    """(chrom, length) -> regions of ``size`` bases on a fixed grid, the last shorter."""
    n = F.ceil(F.col("length") / size).cast("bigint")
    out = contigs.select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("k"))
    return out.select("chrom", (F.col("k") * size + 1).alias("start"), F.least((F.col("k") + 1) * size, F.col("length")).alias("stop"))


def pseudo_autosomal(chrom: Column, pos: Column, pars: list[tuple[str, int, int]]) -> Column:
    out = F.lit(False)
    for c, b, e in pars:
        out = out | ((chrom == c) & pos.between(b, e))
    return out


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED is 0-based, half-open: begin + 1 .. end."""
    raw = spark.read.text(path).where("value not like '#%' and value not like 'track%' and value not like 'browser%' and trim(value) <> ''")
    p = F.split("value", "\t")
    return raw.select(p[0].alias("chrom"), (p[1].cast("bigint") + 1).alias("start"), p[2].cast("bigint").alias("stop"))


def write_bed(df: DataFrame, path: str) -> None:
    df.select("chrom", F.col("start") - 1, "stop").write.option("sep", "\t").csv(path)
