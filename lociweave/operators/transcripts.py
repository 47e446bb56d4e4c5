"""Gene models as a DataFrame of transcripts, and the simple effects on them.

Schema: tr_id, tr_name, gene, chrom, strand, tx_begin, tx_end, cds_begin,
cds_end, exons array<struct<start,stop,frame>>, attributes map. Closed, 1-based.
A transcript codes if cds_begin < cds_end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import spans

SCHEMA = "tr_id string, tr_name string, gene string, chrom string, strand string, tx_begin bigint, tx_end bigint, cds_begin bigint, cds_end bigint, exons array<struct<start:bigint,stop:bigint,frame:int>>, attributes map<string,string>"


def is_coding() -> Column:
    return F.col("cds_begin") < F.col("cds_end")


def _exon(a: Column, b: Column) -> Column:
    return F.struct(a.alias("start"), b.alias("stop"))


def cds_regions() -> Column:
    """Coding parts of the exons."""
    cut = F.transform("exons", lambda e: _exon(F.greatest(e["start"], F.col("cds_begin")), F.least(e["stop"], F.col("cds_end"))))
    return F.when(is_coding(), F.filter(cut, lambda e: e["start"] <= e["stop"])).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))


def _side(before: bool) -> Column:
    if before:
        cut = F.transform("exons", lambda e: _exon(e["start"], F.least(e["stop"], F.col("cds_begin") - 1)))
    else:
        cut = F.transform("exons", lambda e: _exon(F.greatest(e["start"], F.col("cds_end") + 1), e["stop"]))
    return F.when(is_coding(), F.filter(cut, lambda e: e["start"] <= e["stop"])).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))


def utr5_regions() -> Column:
    return F.when(F.col("strand") == "-", _side(False)).otherwise(_side(True))


def utr3_regions() -> Column:
    return F.when(F.col("strand") == "-", _side(True)).otherwise(_side(False))


def introns() -> Column:
    n = F.size("exons")
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: _exon(F.get("exons", i)["stop"] + 1, F.get("exons", i + 1)["start"] - 1))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))


def length_of(regions: Column) -> Column:
    return F.aggregate(regions, F.lit(0).cast("bigint"), lambda a, e: a + e["stop"] - e["start"] + 1)


def with_frames(df: DataFrame) -> DataFrame:
    """Exon frames: coding bases before the exon, in reading direction, mod 3;
    -1 for an exon without coding bases."""
    size = lambda e: F.greatest(F.least(e["stop"], F.col("cds_end")) - F.greatest(e["start"], F.col("cds_begin")) + 1, F.lit(0).cast("bigint"))
    forward = F.aggregate(
        "exons",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<start:bigint,stop:bigint,frame:int>>").alias("out")),
        lambda a, e: F.struct(
            (a["n"] + size(e)).alias("n"),
            F.concat(a["out"], F.array(F.struct(e["start"].alias("start"), e["stop"].alias("stop"), F.when(is_coding() & (size(e) > 0), F.pmod(a["n"], F.lit(3))).otherwise(F.lit(-1)).cast("int").alias("frame")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    backward = F.aggregate(
        F.reverse("exons"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<start:bigint,stop:bigint,frame:int>>").alias("out")),
        lambda a, e: F.struct(
            (a["n"] + size(e)).alias("n"),
            F.concat(F.array(F.struct(e["start"].alias("start"), e["stop"].alias("stop"), F.when(is_coding() & (size(e) > 0), F.pmod(a["n"], F.lit(3))).otherwise(F.lit(-1)).cast("int").alias("frame"))), a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return df.withColumn("exons", F.when(F.col("strand") == "-", backward).otherwise(forward))


# --- simple effects -----------------------------------------------------------

#: Classes by severity; a transcript counts under the first it matches.
SIMPLE = ("coding", "inter-coding_intronic", "peripheral", "noncoding")
INTERGENIC = "intergenic"


def _class_parts() -> Column:
    """Regions (rank, begin, end) that make a transcript match a class.
    Peripheral is all from the transcript's ends to its coding part, introns too."""
    one = lambda rank, rs: F.transform(rs, lambda r: F.struct(F.lit(rank).alias("rank"), r["start"].alias("begin"), r["stop"].alias("end")))
    inner = F.filter(introns(), lambda r: (r["start"] > F.col("cds_begin")) & (r["stop"] < F.col("cds_end")))
    outer = F.array(_exon(F.col("tx_begin"), F.col("cds_begin") - 1), _exon(F.col("cds_end") + 1, F.col("tx_end")))
    whole = F.array(_exon(F.col("tx_begin"), F.col("tx_end")))
    return F.when(is_coding(), F.concat(one(0, cds_regions()), one(1, inner), one(2, outer))).otherwise(one(3, whole))


def class_regions(transcripts: DataFrame) -> DataFrame:
    """(tr_id, gene, chrom, rank, begin, end): what makes a transcript match a class."""
    return transcripts.select("tr_id", "gene", F.col("chrom").alias("c_chrom"), F.explode(_class_parts()).alias("p")).select("tr_id", "gene", "c_chrom", "p.rank", F.col("p.begin").alias("c_begin"), F.col("p.end").alias("c_end")).where("c_begin <= c_end")


#: What is told of a place, and its type.
SIMPLE_TOLD = {"worst_effect": "string", "gene_effects": "string", "genes": "array<string>", **{f"{c}_genes": "array<string>" for c in SIMPLE}}
_NONE = len(SIMPLE)  # rank of being over a transcript without any class


def _simple_fold(told: list[str]):
    def run(places: pa.Table, records: pa.Table) -> pa.Table:
        records = records.sort_by("c_begin")
        names = spans.Names(records.column("members").combine_chunks())
        parts = records.column("parts").combine_chunks()
        owner = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
        rank, begin, end = (parts.flatten().field(k).to_numpy() for k in range(3))
        left = min(int(begin.min()), int(pc.min(places.column("__begin")).as_py()))
        size = np.int64(max(int(end.max()), int(pc.max(places.column("__end")).as_py())) - left + 2)
        # A record's regions of a class: as many begin by a place's end as end before it, unless one overlaps.
        begins = [np.sort(owner[rank == k] * size + begin[rank == k] - left) for k in range(_NONE + 1)]
        ends = [np.sort(owner[rank == k] * size + end[rank == k] - left) for k in range(_NONE + 1)]
        pb, pe = places.column("__begin").to_numpy(), places.column("__end").to_numpy()
        known = pc.is_valid(names.names).to_numpy(zero_copy_only=False)
        labels = pa.chunked_array([pc.binary_join_element_wise(names.names, s, ":") for s in SIMPLE]).combine_chunks()
        out = []
        for i, j, own, rec in spans.pairs((pb, pe), (records.column("c_begin").to_numpy(), records.column("c_end").to_numpy()), names.words):
            best = np.full(len(own), _NONE + 1)
            for k in range(_NONE, -1, -1):
                if len(begins[k]):
                    hit = np.searchsorted(begins[k], rec * size + pe[i:j][own] - left, "right") > np.searchsorted(ends[k], rec * size + pb[i:j][own] - left, "left")
                    best[hit] = k
            over = np.zeros(j - i, bool)
            over[own[best <= _NONE]] = True
            bits = [names.union(j - i, own[best == k], rec[best == k])[over] for k in range(_NONE)]
            every = np.concatenate(bits, 1)
            cols = {"__id": places.column("__id").slice(i, j - i).filter(pa.array(over))}
            if "worst_effect" in told:
                found = np.stack([b.any(1) for b in bits])
                cols["worst_effect"] = pa.array(SIMPLE).take(pa.array(found.argmax(0), mask=~found.any(0)))
            if "gene_effects" in told:
                cols["gene_effects"] = pc.binary_join(spans.listed(every & np.tile(known, _NONE), labels), "|")
            if "genes" in told:
                fresh, seen = [], np.zeros_like(bits[0])
                for b in bits:
                    fresh.append(b & ~seen)
                    seen = seen | b
                cols["genes"] = spans.listed(np.concatenate(fresh, 1), pa.chunked_array([names.names] * _NONE).combine_chunks())
            for k, c in enumerate(SIMPLE):
                if f"{c}_genes" in told:
                    cols[f"{c}_genes"] = spans.listed(bits[k], names.names)
            out.append(pa.table({c: cols[c] for c in ["__id", *told]}))
        return pa.concat_tables(out)

    return run


def annotate_simple_effects(df: DataFrame, transcripts: DataFrame, ann: str = "ann", wanted: list[str] | None = None) -> DataFrame:
    """Adds worst_effect, genes, gene_effects (``gene:class|...``) and a gene
    list per class, or those of them that are ``wanted``. No transcript over the
    place: intergenic. A transcript that matches no class counts for nothing; if
    none matches, worst_effect is null."""
    told = [c for c in SIMPLE_TOLD if wanted is None or c in wanted]
    # Each distinct place once; what is told of it goes back to all rows that have it.
    place = F.struct(F.col(f"{ann}.chrom").alias("c"), F.col(f"{ann}.pos").cast("bigint").alias("b"), F.col(f"{ann}.pos_end").cast("bigint").alias("e"))
    narrow = df.select(place.alias("__id")).distinct().select("__id", F.col("__id.c").alias("__chrom_a"), F.col("__id.b").alias("__begin"), F.col("__id.e").alias("__end"))
    # Transcripts with the same regions are one record with several genes.
    own = F.array(F.struct(F.lit(_NONE).alias("rank"), F.col("tx_begin").alias("begin"), F.col("tx_end").alias("end")))
    parts = F.filter(F.concat(_class_parts(), own), lambda p: p["begin"] <= p["end"])
    parts = F.transform(parts, lambda p: F.struct(p["rank"].cast("int").alias("rank"), p["begin"].cast("bigint").alias("begin"), p["end"].cast("bigint").alias("end")))
    shapes = transcripts.groupBy("chrom", "tx_begin", "tx_end", "cds_begin", "cds_end", "exons").agg(F.collect_set(F.struct("gene")).alias("members"))
    shapes = shapes.select(F.col("chrom").alias("c_chrom"), parts.alias("parts"), "members").withColumn("members", F.transform("members", lambda m: m["gene"])).withColumns({"c_begin": F.array_min(F.transform("parts", lambda p: p["begin"])), "c_end": F.array_max(F.transform("parts", lambda p: p["end"]))})
    schema = StructType([narrow.schema["__id"], *[StructField(c, StringType() if SIMPLE_TOLD[c] == "string" else ArrayType(StringType())) for c in told]])
    found = spans.fold(narrow, shapes, ("__chrom_a", "__begin", "__end"), ("c_chrom", "c_begin", "c_end"), _simple_fold(told), schema)
    found = found.withColumnsRenamed({c: f"__t_{k}" for k, c in enumerate(told)})
    empty = {"gene_effects": F.lit(""), "worst_effect": F.lit(INTERGENIC)}
    absent = F.col("__id").isNull()
    out = df.join(found, place == F.col("__id"), "left")
    told_of = {c: F.when(absent, empty.get(c, F.array().cast("array<string>"))).otherwise(F.col(f"__t_{k}")) for k, c in enumerate(told)}
    return out.withColumns(told_of).drop("__id", *[f"__t_{k}" for k in range(len(told))])


def by_gene(transcripts: DataFrame, genes: list[str]) -> DataFrame:
    return transcripts.where(F.col("gene").isin(genes))


def by_location(transcripts: DataFrame, chrom: str, begin: int, end: int | None = None) -> DataFrame:
    return transcripts.where((F.col("chrom") == chrom) & (F.col("tx_begin") <= (end if end is not None else begin)) & (F.col("tx_end") >= begin))


def regions_of_genes(transcripts: DataFrame, genes: list[str], margin: int = 20_000, most: int = 20, within: DataFrame | None = None) -> DataFrame:
    """Collapsed regions around at most ``most`` genes."""
    from .regions import collapse, intersection

    if len(genes) > most:
        raise ValueError(f"more than {most} genes")
    r = by_gene(transcripts, genes).select("chrom", F.greatest(F.col("tx_begin") - margin - 1, F.lit(1)).alias("start"), (F.col("tx_end") + margin + 1).alias("stop"))
    return collapse(r) if within is None else intersection(r, within)


def union_models(*models: DataFrame) -> DataFrame:
    """Later models replace transcripts of the same id."""
    out = None
    for k, m in enumerate(models):
        m = m.withColumn("__k", F.lit(k))
        out = m if out is None else out.unionByName(m)
    w = Window.partitionBy("tr_id").orderBy(F.desc("__k"))
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__k")


def model_statistics(transcripts: DataFrame) -> DataFrame:
    """Per chrom and in total (null): transcripts, genes, coding of each."""
    coding = is_coding()
    t = transcripts.withColumns({"__coding": coding, "__cg": F.when(coding, F.col("gene"))})
    return t.cube("chrom").agg(F.count("*").alias("n_transcripts"), F.count_if("__coding").alias("n_coding_transcripts"), F.countDistinct("gene").alias("n_genes"), F.countDistinct("__cg").alias("n_coding_genes"))
