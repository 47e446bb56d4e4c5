"""Position, allele and fragment scores: lookups and region aggregates.

A score is a DataFrame with typed value columns. Every read is a left join that
gives each annotatable one row back. Three answers mean "nothing": null where no
record is met (the aggregator does not run), the aggregator's own empty value
where records are met but all values are missing or filtered out, and 0 for a
fragment count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.filters import compile_filter
from . import aggregators, spans
from .overlap import overlap_counts, overlap_join, overlap_width
from .running import running

REGION_LIMIT = 500_000  # a longer region is not read

DEFAULTS = {
    "position": {"double": "mean", "bigint": "mean", "string": "list"},
    "allele": {"double": "max", "bigint": "max", "string": "list"},
    "fragment": {"double": "max", "bigint": "max", "string": "join(,)"},
}


@dataclass(frozen=True)
class Attribute:
    """An output column: ``source`` score, ``name``, and how several values become one."""

    source: str
    name: str | None = None
    aggregator: str | None = None

    @property
    def column(self) -> str:
        return self.name or self.source


@dataclass(frozen=True)
class Score:
    """``kind``: position, allele or fragment. ``values``: score id -> column type.
    ``defaults``: aggregators by score id that come before the kind's own."""

    kind: str
    df: DataFrame
    values: dict[str, str]
    chrom: str = "chrom"
    begin: str = "pos_begin"
    end: str = "pos_end"
    ref: str = "reference"
    alt: str = "alternative"
    order: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)

    def aggregator(self, a: Attribute) -> aggregators.Aggregator:
        kind = self.values[a.source]
        name = a.aggregator or self.defaults.get(a.source) or DEFAULTS[self.kind].get(kind)
        if name is None:
            raise ValueError(f"{a.source}: no aggregator for {kind}")
        return aggregators.parse(name, kind)

    def record(self, sources: list[str]) -> DataFrame:
        """The columns that a read needs, under names of their own."""
        extra = [self.ref, self.alt] if self.kind == "allele" else []
        order = [F.col(c) for c in (self.begin, self.end, *extra, *self.order)]
        cols = [F.col(self.chrom).alias("__r_chrom"), F.col(self.begin).cast("bigint").alias("__r_begin"), F.col(self.end).cast("bigint").alias("__r_end"), F.struct(*order).alias("__r_order")]
        cols += [F.col(c).alias(f"__r_{n}") for c, n in zip(extra, ("ref", "alt"), strict=False)]
        return self.df.select(*cols, *[F.col(s).alias(f"__v_{s}") for s in dict.fromkeys(sources)])


def _narrow(df: DataFrame, ann: str) -> DataFrame:
    """What a join needs of the annotatables: each distinct place once. What is
    told of a place goes back to all rows that have it, so rows need no ids of
    their own, and a place that many rows share is looked up once."""
    p = F.col("__id")
    one = df.select(F.col(ann).alias("__id")).where(p.isNotNull()).distinct()
    return one.select("__id", p["type"].alias("__type"), p["chrom"].alias("__chrom_a"), p["pos"].alias("__begin"), p["pos_end"].alias("__end"), p["ref"].alias("__ref"), p["alt"].alias("__alt"))


def _regions(df: DataFrame, cols: tuple[str, str, str]) -> tuple[DataFrame, Column]:
    """The same for regions in three columns, and the place of a row of ``df``."""
    place = F.struct(F.col(cols[0]).alias("c"), F.col(cols[1]).cast("bigint").alias("b"), F.col(cols[2]).cast("bigint").alias("e"))
    one = df.select(place.alias("__id")).distinct()
    return one.select("__id", F.col("__id.c").alias("__chrom_a"), F.col("__id.b").alias("__begin"), F.col("__id.e").alias("__end")), place


_L, _R = ("__chrom_a", "__begin", "__end"), ("__r_chrom", "__r_begin", "__r_end")


def _back(df: DataFrame, place: Column, told: DataFrame) -> DataFrame:
    return df.join(told.withColumnRenamed("__id", "__told_id"), place == F.col("__told_id"), "left").drop("__told_id")


def _asked(score: Score, attributes: list[Attribute], keep: Column | None = None) -> list[aggregators.Asked]:
    out = []
    for a in attributes:
        v = F.col(f"__v_{a.source}")
        out.append(aggregators.Asked(score.aggregator(a), v if keep is None else F.when(keep, v), score.values[a.source], a.column))
    return out


def annotate_position(df: DataFrame, score: Score, attributes: list[Attribute], ann: str = "ann", limit: int = REGION_LIMIT) -> DataFrame:
    """A substitution reads its one base: the first record that covers it, the
    value as it is, not aggregated. Anything else aggregates the records it
    overlaps, weighted by the bases shared; beyond ``limit`` bases it is null.
    A null annotatable gives nulls."""
    sources = [a.source for a in attributes]
    narrow = _narrow(df, ann).where(F.col("__end") - F.col("__begin") + 1 <= limit)
    hits = overlap_join(narrow, score.record(sources), _L, _R)
    point = F.col("__type") == "SUBSTITUTION"
    weight = overlap_width("__begin", "__end", "__r_begin", "__r_end")
    first = {f"__p{k}": F.when(point, F.struct(F.col("__r_order").alias("o"), F.col(f"__v_{a.source}").alias("v"))) for k, a in enumerate(attributes)}
    told = aggregators.grouped(hits, ["__id", "__type"], _asked(score, attributes), weight, F.col("__r_order"), first)
    cols = []
    for k, a in enumerate(attributes):
        out_kind = score.aggregator(a).kind(score.values[a.source])
        if out_kind.startswith(("array", "map")) or out_kind == "boolean":
            # A scalar and a collection do not fit one column: a point's value is the collection of it.
            cols.append(F.col(a.column))
        else:
            cols.append(F.when(point, F.col(f"__p{k}.v").cast(out_kind)).otherwise(F.col(a.column)).alias(a.column))
    return _back(df, F.col(ann), told.select("__id", *cols))


def region_segments(regions: DataFrame, score: Score, sources: list[str], id_col: str = "id", cols: tuple[str, str, str] = ("chrom", "begin", "end")) -> DataFrame:
    """One row per region and record it meets: (id, seg_begin, seg_end, weight,
    values), clipped to the region."""
    left = regions.select(F.col(id_col).alias("__id"), F.col(cols[0]).alias("__chrom_a"), F.col(cols[1]).cast("bigint").alias("__begin"), F.col(cols[2]).cast("bigint").alias("__end"))
    hits = overlap_join(left, score.record(sources), _L, _R)
    weight = overlap_width("__begin", "__end", "__r_begin", "__r_end") if score.kind == "position" else F.lit(1).cast("bigint")
    return hits.select(F.col("__id").alias(id_col), F.greatest("__begin", "__r_begin").alias("seg_begin"), F.least("__end", "__r_end").alias("seg_end"), weight.alias("weight"), *[F.col(f"__v_{s}").alias(s) for s in dict.fromkeys(sources)])


def aggregate_regions(regions: DataFrame, score: Score, attributes: list[Attribute], cols: tuple[str, str, str] = ("chrom", "begin", "end")) -> DataFrame:
    """One row per region, every record counting, from one join; a score may be
    asked for more than once."""
    left, place = _regions(regions, cols)
    hits = overlap_join(left, score.record([a.source for a in attributes]), _L, _R)
    weight = overlap_width("__begin", "__end", "__r_begin", "__r_end") if score.kind == "position" else F.lit(1)
    return _back(regions, place, aggregators.grouped(hits, ["__id"], _asked(score, attributes), weight, F.col("__r_order")))


def first_covering_runs(score: Score, sources: list[str], chrom: str | None = None) -> DataFrame:
    """Records cut to where they are the first to cover: overlap-free runs
    (chrom, begin, end, values). A later record keeps only what no earlier one
    reaches."""
    r = score.record(sources)
    if chrom is not None:
        r = r.where(F.col("__r_chrom") == chrom)
    r = running(r, "__r_chrom", "__r_begin", ["__r_order"], {"__reach": ("max_before", F.col("__r_end"))})
    cut = F.greatest(F.col("__r_begin"), F.coalesce(F.col("__reach") + 1, F.col("__r_begin")))
    return r.withColumn("__cut", cut).where(F.col("__cut") <= F.col("__r_end")).select(F.col("__r_chrom").alias("chrom"), F.col("__cut").alias("begin"), F.col("__r_end").alias("end"), *[F.col(f"__v_{s}").alias(s) for s in dict.fromkeys(sources)])


def _runs_as_score(score: Score, sources: list[str]) -> Score:
    return Score("position", first_covering_runs(score, sources), {s: score.values[s] for s in sources}, "chrom", "begin", "end", defaults=score.defaults)


def positions(regions: DataFrame, score: Score, sources: list[str], id_col: str = "id", cols: tuple[str, str, str] = ("chrom", "begin", "end")) -> DataFrame:
    """One row per base of each region, null in gaps, the first record winning.
    For short regions: the output has as many rows as the regions have bases."""
    left, place = _regions(regions, cols)
    own = regions.select(F.col(id_col).alias("__own"), place.alias("__id"), F.explode(F.sequence(F.col(cols[1]).cast("bigint"), F.col(cols[2]).cast("bigint"))).alias("pos"))
    hits = overlap_join(left, _runs_as_score(score, sources).record(sources), _L, _R)
    seg = hits.select(F.col("__id").alias("__sid"), F.explode(F.sequence(F.greatest("__begin", "__r_begin"), F.least("__end", "__r_end"))).alias("__spos"), *[F.col(f"__v_{s}").alias(s) for s in dict.fromkeys(sources)])
    return own.join(seg, (F.col("__id") == F.col("__sid")) & (F.col("pos") == F.col("__spos")), "left").select(F.col("__own").alias(id_col), "pos", *sources)


def aggregate_gap_aware(regions: DataFrame, score: Score, a: Attribute, replacement=None, cols: tuple[str, str, str] = ("chrom", "begin", "end")) -> DataFrame:
    """Like ``aggregate_regions``, but each base counts once (first record), and
    bases without a value count as ``replacement`` if one is given. Nothing is
    expanded: the bases missing are one row with their number as weight."""
    runs = _runs_as_score(score, [a.source])
    left, place = _regions(regions, cols)
    hits = overlap_join(left, runs.record([a.source]), _L, _R)
    seg = hits.select("__id", F.greatest("__begin", "__r_begin").alias("__o"), F.col(f"__v_{a.source}").alias("__v"), overlap_width("__begin", "__end", "__r_begin", "__r_end").alias("__w"))
    if replacement is not None:
        have = seg.where(F.col("__v").isNotNull()).groupBy("__id").agg(F.sum("__w").alias("__have"))
        gaps = left.withColumnRenamed("__id", "__g").join(have, F.col("__g") == F.col("__id"), "left")
        gaps = gaps.select(F.col("__g").alias("__id"), F.lit(None).cast("bigint").alias("__o"), F.lit(replacement).cast(score.values[a.source]).alias("__v"), (F.col("__end") - F.col("__begin") + 1 - F.coalesce("__have", F.lit(0))).alias("__w"))
        seg = seg.unionByName(gaps.where("__w > 0"))
    asked = aggregators.Asked(score.aggregator(a), F.col("__v"), score.values[a.source], a.column)
    return _back(regions, place, aggregators.grouped(seg, ["__id"], [asked], F.col("__w"), F.col("__o")))


def aggregate_bins(score: Score, chrom: str, begin: int, end: int, bin_size: int, a: Attribute) -> DataFrame:
    """(bin_begin, bin_end, value) on the global grid (pos - 1) div size, edges
    clipped to the region, empty bins included."""
    spark = score.df.sparkSession
    first, last = (begin - 1) // bin_size, (end - 1) // bin_size
    spine = spark.range(first, last + 1).select(
        F.col("id").alias("bin"), F.lit(chrom).alias("chrom"), F.greatest(F.col("id") * bin_size + 1, F.lit(begin)).cast("bigint").alias("bin_begin"), F.least((F.col("id") + 1) * bin_size, F.lit(end)).cast("bigint").alias("bin_end")
    )
    runs = _runs_as_score(score, [a.source])
    return aggregate_regions(spine, runs, [a], ("chrom", "bin_begin", "bin_end")).drop("bin", "chrom")


def annotate_allele(df: DataFrame, score: Score, attributes: list[Attribute], ann: str = "ann", mode: str = "exact", record_filter: str | None = None, limit: int = REGION_LIMIT) -> DataFrame:
    """``exact``: the first record with the same chrom, pos, ref and alt that the
    filter lets pass; values as they are. ``region``: all records that overlap,
    aggregated with weight 1; null where none is met before the filter. The
    source ``allele`` gives the sorted ``chrom:pos:ref:alt`` of the records."""
    real = [a for a in attributes if a.source != "allele"]
    named = [a for a in attributes if a.source == "allele"]
    keep = F.lit(True)
    used = [a.source for a in real]
    if record_filter:
        keep = compile_filter(record_filter, score.values)
    # The filter reads score columns, so it is worked out before they are renamed.
    kept = Score(score.kind, score.df.withColumn("__keep", keep), {**score.values, "__keep": "boolean"}, score.chrom, score.begin, score.end, score.ref, score.alt, score.order, score.defaults)
    records = kept.record([*used, "__keep"]).withColumnRenamed("__v___keep", "__keep")
    narrow = _narrow(df, ann)
    if mode == "exact":
        key = ["__r_chrom", "__r_begin", "__r_ref", "__r_alt"]
        firsts = records.where("__keep").groupBy(*key).agg(*[F.min_by(F.struct(F.col(f"__v_{s}").alias("v")), F.col("__r_order")).alias(f"__f_{s}") for s in dict.fromkeys(used)], F.count("*").alias("__n"))
        hit = narrow.join(firsts, (F.col("__chrom_a") == F.col("__r_chrom")) & (F.col("__begin") == F.col("__r_begin")) & (F.col("__ref") == F.col("__r_ref")) & (F.col("__alt") == F.col("__r_alt")))
        name = F.array(F.concat_ws(":", "__r_chrom", F.col("__r_begin").cast("string"), "__r_ref", "__r_alt"))
        told = hit.select("__id", *[F.col(f"__f_{a.source}.v").alias(a.column) for a in real], *[name.alias(a.column) for a in named])
        return _back(df, F.col(ann), told)
    small = F.col("__ref").isNotNull() | (F.col("__end") - F.col("__begin") + 1 <= limit)
    hits = overlap_join(narrow.where(small), records, _L, _R)
    name = F.concat_ws(":", "__r_chrom", F.col("__r_begin").cast("string"), "__r_ref", "__r_alt")
    # A group is there for every place that met a record, whatever the filter keeps.
    told = aggregators.grouped(hits, ["__id"], _asked(score, real, F.col("__keep")), F.lit(1), F.col("__r_order"), {"__met": F.lit(1)}).drop("__met")
    if named:
        alleles = hits.groupBy("__id").agg(*[F.array_sort(F.collect_set(F.when(F.col("__keep"), name))).alias(a.column) for a in named])
        told = told.join(alleles, "__id") if real else alleles
    return _back(df, F.col(ann), told)


def allele_points(score: Score, sources: list[str], chrom: str, begin: int, end: int) -> DataFrame:
    """(pos, values) of the allele records that start in a region."""
    return score.df.where((F.col(score.chrom) == chrom) & F.col(score.begin).between(begin, end)).select(F.col(score.begin).alias("pos"), *sources)


def _levels(n: int) -> int:
    return max(1, int(n).bit_length())


def _spread(size: int, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The greatest value put on each of ``size`` cells, where each value goes to [lo, hi)."""
    level = np.frexp(hi - lo)[1] - 1
    table = np.zeros((_levels(size), size), np.int64)
    np.maximum.at(table, (level, lo), value)
    np.maximum.at(table, (level, hi - (1 << level)), value)
    for k in range(len(table) - 1, 0, -1):
        half, n = 1 << (k - 1), size - (1 << k) + 1
        if n > 0:
            np.maximum(table[k - 1][:n], table[k][:n], out=table[k - 1][:n])
            np.maximum(table[k - 1][half : half + n], table[k][:n], out=table[k - 1][half : half + n])
    return table[0]


def _greatest(cells: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The greatest of the cells [lo, hi)."""
    table = [cells]
    while 2 << (len(table) - 1) <= len(cells):
        half = 1 << (len(table) - 1)
        table.append(np.maximum(table[-1][:-half], table[-1][half:]))
    level = np.frexp(hi - lo)[1] - 1
    out = np.zeros(len(lo), np.int64)
    for k in np.unique(level):
        m = level == k
        out[m] = np.maximum(table[k][lo[m]], table[k][hi[m] - (1 << k)])
    return out


def _extremes(narrow: DataFrame, score: Score, attributes: list[Attribute], sources: list[str]) -> DataFrame:
    """The number of records that each place overlaps, ``__n``, and greatest or
    least values of them, without making the pairs: the greatest value over each
    stretch of bases, then the greatest of the stretches that a place touches."""
    names = list(dict.fromkeys(sources))
    records = score.record(sources).select("__r_chrom", "__r_begin", "__r_end", *[F.col(f"__v_{s}").cast("double").alias(f"v{k}") for k, s in enumerate(names)])
    asked = [(names.index(a.source), score.aggregator(a).name == "max") for a in attributes]

    def run(places: pa.Table, records: pa.Table) -> pa.Table | None:
        (pb, pe), (rb, re_) = ([t.column(c).to_numpy() for c in cols] for t, cols in ((places, ("__begin", "__end")), (records, ("__r_begin", "__r_end"))))
        n = np.searchsorted(np.sort(rb), pe, "right") - np.searchsorted(np.sort(re_), pb, "left")
        met = n > 0
        if not met.any():
            return None
        cuts = np.unique(np.r_[rb, re_ + 1])
        spread = (np.searchsorted(cuts, rb), np.searchsorted(cuts, re_ + 1))
        reach = (np.maximum(np.searchsorted(cuts, pb[met], "right") - 1, 0), np.searchsorted(cuts, pe[met], "right"))
        cols = {}
        for k, (v, most) in enumerate(asked):
            value = records.column(f"v{v}")
            known = pc.is_valid(value).to_numpy()
            # Values as their ranks, NaN above all; 0 is no value.
            order, rank = np.unique(value.drop_null().to_numpy(), return_inverse=True)
            rank = rank + 1 if most else len(order) - rank
            got = _greatest(_spread(len(cuts), spread[0][known], spread[1][known], rank), *reach)
            at = np.where(got > 0, got - 1 if most else len(order) - got, 0)
            cols[f"x{k}"] = pa.array(order, pa.float64()).take(pa.array(at, mask=got == 0))
        return pa.table({"__id": places.column("__id").filter(pa.array(met)), "__n": n[met].astype(np.int64), **cols})

    schema = StructType([narrow.schema["__id"], StructField("__n", LongType()), *[StructField(f"x{k}", DoubleType()) for k in range(len(asked))]])
    told = spans.fold(narrow.select("__id", "__chrom_a", "__begin", "__end"), records, _L, _R, run, schema)
    return told.withColumnsRenamed({f"x{k}": a.column for k, a in enumerate(attributes)})


def annotate_fragment(df: DataFrame, score: Score, attributes: list[Attribute], ann: str = "ann", record_filter: str | None = None, count_as: str | None = None, limit: int = REGION_LIMIT, strict: bool = False) -> DataFrame:
    """All fragments that overlap, aggregated with weight 1. An attribute without
    an aggregator of its own, by resource or by kind (a flag), gives their
    number, as does ``count_as``: 0 where none is met. With ``strict`` an
    annotatable on a contig without fragments is an error."""
    sources = [a.source for a in attributes]
    records = score.df
    if record_filter:
        records = records.where(compile_filter(record_filter, score.values))
    kept = Score(score.kind, records, score.values, score.chrom, score.begin, score.end, order=score.order, defaults=score.defaults)
    narrow = _narrow(df, ann).where(F.col("__end") - F.col("__begin") + 1 <= limit)
    counted = [a for a in attributes if not (a.aggregator or score.defaults.get(a.source) or DEFAULTS["fragment"].get(score.values[a.source]))]
    plain = [a for a in attributes if a not in counted]
    names = [a.column for a in counted] + ([count_as] if count_as else [])
    if plain and all(score.aggregator(a).name in ("max", "min") for a in plain):
        told = _extremes(narrow, kept, plain, sources)
    elif plain:
        hits = overlap_join(narrow, kept.record(sources), _L, _R)
        asked = [*_asked(score, plain), *([aggregators.Asked(aggregators.parse("count"), F.lit(1), "bigint", "__n")] if names else [])]
        told = aggregators.grouped(hits, ["__id"], asked, F.lit(1), F.col("__r_order"))
    else:
        told = overlap_counts(narrow, kept.record([]), _L, _R, "__n")
    told = told.select("__id", *[a.column for a in plain], *[F.col("__n").alias(n) for n in names])
    out = _back(df, F.col(ann), told)
    for n in names:
        out = out.withColumn(n, F.when(F.col(f"{ann}.pos_end") - F.col(f"{ann}.pos") + 1 <= limit, F.coalesce(F.col(n), F.lit(0))))
    if strict:
        contigs = score.df.select(F.col(score.chrom).alias("__contig")).distinct()
        out = out.join(contigs, F.col(f"{ann}.chrom") == F.col("__contig"), "left")
        out = out.where(F.when(F.col("__contig").isNull(), F.raise_error(F.concat(F.lit("no fragments on contig "), F.col(f"{ann}.chrom"))).cast("boolean")).otherwise(F.lit(True))).drop("__contig")
    return out


def contigs(score: Score) -> DataFrame:
    """(chrom, length): the greatest end on each contig."""
    return score.df.groupBy(F.col(score.chrom).alias("chrom")).agg(F.max(score.end).cast("bigint").alias("length"))


def overlapping_records(score: Score) -> DataFrame:
    """Position records that begin before the one before them ends: a position
    score must have none."""
    r = running(score.record([]), "__r_chrom", "__r_begin", ["__r_order"], {"prev_end": ("prev", F.col("__r_end"))})
    return r.where("__r_begin <= prev_end").select(F.col("__r_chrom").alias("chrom"), F.col("__r_begin").alias("pos_begin"), F.col("__r_end").alias("pos_end"), "prev_end")


def unordered_records(df: DataFrame, file_order: str, chrom: str = "chrom", begin: str = "pos_begin") -> DataFrame:
    """Records that begin before the one before them in file order (a number) on
    their contig."""
    return running(df, chrom, file_order, [], {"prev_begin": ("prev", F.col(begin))}).where(F.col(begin) < F.col("prev_begin"))
