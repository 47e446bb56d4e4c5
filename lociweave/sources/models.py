"""Gene models, gene sets, gene scores and gene names from their text formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.transcripts import with_frames
from .tables import read_rows

# Column names of the UCSC style formats.
LAYOUTS = {
    "refflat": ["#geneName", "name", "chrom", "strand", "txStart", "txEnd", "cdsStart", "cdsEnd", "exonCount", "exonStarts", "exonEnds"],
    "refseq": ["#bin", "name", "chrom", "strand", "txStart", "txEnd", "cdsStart", "cdsEnd", "exonCount", "exonStarts", "exonEnds", "score", "name2", "cdsStartStat", "cdsEndStat", "exonFrames"],
    "ccds": ["#bin", "name", "chrom", "strand", "txStart", "txEnd", "cdsStart", "cdsEnd", "exonCount", "exonStarts", "exonEnds", "score", "name2", "cdsStartStat", "cdsEndStat", "exonFrames"],
    "knowngene": ["name", "chrom", "strand", "txStart", "txEnd", "cdsStart", "cdsEnd", "exonCount", "exonStarts", "exonEnds", "proteinID", "alignID"],
    "ucscgenepred": ["name", "chrom", "strand", "txStart", "txEnd", "cdsStart", "cdsEnd", "exonCount", "exonStarts", "exonEnds", "score", "name2", "cdsStartStat", "cdsEndStat", "exonFrames"],
}
_GENE = {"refflat": "geneName", "refseq": "name2", "ccds": "name", "knowngene": "name", "ucscgenepred": "name2"}
_CORE = ("name", "chrom", "strand", "txStart", "txEnd", "cdsStart", "cdsEnd", "exonStarts", "exonEnds")


def _numbers(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("bigint"))


def _exons(starts: Column, ends: Column, shift: int) -> Column:
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda e: F.struct((e["a"] + shift).alias("start"), e["b"].alias("stop"), F.lit(-1).alias("frame")))


def read_gene_models(spark: SparkSession, path: str, format: str, gene_mapping: DataFrame | None = None, header: list[str] | None = None) -> DataFrame:
    """``default``, ``gtf`` or one of ``LAYOUTS`` -> transcripts. UCSC begins are
    0-based and are moved by one. Transcript ids that a file repeats are
    numbered in file order. ``gene_mapping``: (from, to) gene names."""
    if format == "gtf":
        out = _gtf(spark, path)
    elif format == "default":
        raw = read_rows(spark, path, "\t")
        have = raw.columns
        atts = F.col("atts") if "atts" in have else F.lit(None).cast("string")
        pairs = F.filter(F.split(F.coalesce(atts, F.lit("")), ";"), lambda x: x.contains(":"))
        out = raw.select(
            F.col("trID").alias("tr_id"), F.coalesce(*([F.col("trOrigId")] if "trOrigId" in have else []), F.col("trID")).alias("tr_name"), "gene", F.col("chr").alias("chrom"), "strand", F.col("tsBeg").cast("bigint").alias("tx_begin"), F.col("txEnd").cast("bigint").alias("tx_end"),
            F.col("cdsStart").cast("bigint").alias("cds_begin"), F.col("cdsEnd").cast("bigint").alias("cds_end"), _exons(_numbers(F.col("exonStarts")), _numbers(F.col("exonEnds")), 0).alias("exons"),
            F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split(x, ":", 2)[0], F.split(x, ":", 2)[1]))).alias("attributes"),
        )
    else:
        cols = [c.lstrip("#") for c in LAYOUTS[format]]
        if header is None:
            first = spark.read.text(path).limit(1).collect()
            given = first[0].value.lstrip("#").split("\t") if first else []
            header = None if set(_CORE) <= set(given) else cols[: len(given)]
        raw = read_rows(spark, path, "\t", header)
        gene = _GENE[format]
        gene_col = F.coalesce(F.nullif(F.col(gene), F.lit("")), F.col("name")) if gene in raw.columns else F.col("name")
        extra = [c for c in raw.columns if c not in (*_CORE, gene, "__line")]
        attributes = F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c))]) if extra else F.create_map().cast("map<string,string>")
        w = Window.partitionBy("name").orderBy("__line")
        out = raw.select(
            F.concat_ws("_", "name", F.row_number().over(w).cast("string")).alias("tr_id"), F.col("name").alias("tr_name"), gene_col.alias("gene"), "chrom", "strand", (F.col("txStart").cast("bigint") + 1).alias("tx_begin"), F.col("txEnd").cast("bigint").alias("tx_end"),
            (F.col("cdsStart").cast("bigint") + 1).alias("cds_begin"), F.col("cdsEnd").cast("bigint").alias("cds_end"), _exons(_numbers(F.col("exonStarts")), _numbers(F.col("exonEnds")), 1).alias("exons"), attributes.alias("attributes"),
        )
    if gene_mapping is not None:
        m = gene_mapping.select(F.col(gene_mapping.columns[0]).alias("__from"), F.col(gene_mapping.columns[1]).alias("__to"))
        out = out.join(m, F.col("gene") == F.col("__from"), "left").withColumn("gene", F.coalesce("__to", "gene")).drop("__from", "__to")
    return with_frames(out)


def _gtf(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "\t")
    raw = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    att = lambda k: F.nullif(F.regexp_extract(p[8], rf'(?:^|;)\s*{k} "?([^";]*)"?', 1), F.lit(""))
    rows = raw.select(p[0].alias("chrom"), p[2].alias("feature"), p[3].cast("bigint").alias("start"), p[4].cast("bigint").alias("stop"), p[6].alias("strand"), att("transcript_id").alias("tr_id"), F.coalesce(att("gene_name"), att("gene_id")).alias("gene"), att("gene_biotype").alias("biotype")).where("tr_id is not null")
    coding = F.col("feature").isin("CDS", "start_codon", "stop_codon")
    g = rows.groupBy("tr_id").agg(
        F.max("gene").alias("gene"), F.max("chrom").alias("chrom"), F.max("strand").alias("strand"), F.max("biotype").alias("biotype"),
        F.min("start").alias("tx_begin"), F.max("stop").alias("tx_end"), F.min(F.when(coding, F.col("start"))).alias("cb"), F.max(F.when(coding, F.col("stop"))).alias("ce"),
        F.array_sort(F.collect_set(F.when(F.col("feature") == "exon", F.struct("start", "stop", F.lit(-1).alias("frame"))))).alias("exons"),
    )
    # Without a coding feature the coding part is empty: its end comes before its begin.
    return g.select("tr_id", F.col("tr_id").alias("tr_name"), "gene", "chrom", "strand", "tx_begin", "tx_end", F.coalesce("cb", F.col("tx_end")).alias("cds_begin"), F.coalesce("ce", F.col("tx_begin")).alias("cds_end"), "exons", F.when(F.col("biotype").isNotNull(), F.create_map(F.lit("gene_biotype"), F.col("biotype"))).otherwise(F.create_map().cast("map<string,string>")).alias("attributes"))


def infer_format(spark: SparkSession, path: str) -> str:
    """The one format whose header or shape the first 50 lines have."""
    lines = [r.value for r in spark.read.text(path).limit(50).collect() if r.value.strip()]
    if not lines:
        raise ValueError(f"{path} is empty")
    head = lines[0].lstrip("#").split("\t")
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    found = []
    if {"chr", "trID", "gene", "tsBeg", "exonStarts"} <= set(head):
        found.append("default")
    if all(len(x) >= 9 and x[3].isdigit() and x[4].isdigit() and re.search(r"transcript_id|gene_id", x[8]) for x in body):
        found.append("gtf")
    for name, cols in LAYOUTS.items():
        cols = [c.lstrip("#") for c in cols]
        if name != "ccds" and head == cols:
            found.append(name)
    if len(found) != 1:
        raise ValueError(f"{path}: cannot tell the format ({', '.join(found) or 'none fits'})")
    return found[0]


def write_default(transcripts: DataFrame, path: str) -> None:
    join = lambda f: F.array_join(F.transform("exons", lambda e: e[f].cast("string")), ",")
    atts = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws(":", e["key"], e["value"])), ";")
    transcripts.select(
        F.col("chrom").alias("chr"), F.col("tr_id").alias("trID"), F.col("tr_name").alias("trOrigId"), "gene", "strand", F.col("tx_begin").alias("tsBeg"), F.col("tx_end").alias("txEnd"), F.col("cds_begin").alias("cdsStart"), F.col("cds_end").alias("cdsEnd"), join("start").alias("exonStarts"), join("stop").alias("exonEnds"), join("frame").alias("exonFrames"), atts.alias("atts")
    ).write.option("sep", "\t").option("header", True).csv(path)


def gtf_features(transcripts: DataFrame) -> DataFrame:
    """Rows of a GTF: transcript, exon, CDS without the stop codon, start and stop
    codon (in parts where an intron splits them), with frames."""
    plus = F.col("strand") != "-"
    coding = F.col("cds_begin") < F.col("cds_end")
    feature = lambda name, rs: F.transform(rs, lambda r: F.struct(F.lit(name).alias("feature"), r["start"].alias("start"), r["stop"].alias("stop"), r["number"].alias("number")))
    n = F.size("exons")
    numbered = F.transform(F.col("exons"), lambda e, i: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), F.when(plus, i + 1).otherwise(n - i).alias("number")))
    clip = lambda lo, hi: F.filter(F.transform(numbered, lambda e: F.struct(F.greatest(e["start"], lo).alias("start"), F.least(e["stop"], hi).alias("stop"), e["number"].alias("number"))), lambda e: e["start"] <= e["stop"])
    t = transcripts.withColumn("__cds", F.when(coding, clip(F.col("cds_begin"), F.col("cds_end"))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,number:int>>")))

    def codon(left: bool) -> Column:
        """The outermost three coding bases on one side, in parts."""
        zero = F.struct(F.lit(3).cast("bigint").alias("need"), F.array().cast("array<struct<start:bigint,stop:bigint,number:int>>").alias("out"))

        def step(a, e):
            k = F.least(a["need"], e["stop"] - e["start"] + 1)
            part = F.struct((e["start"] if left else e["stop"] - k + 1).alias("start"), (e["start"] + k - 1 if left else e["stop"]).alias("stop"), e["number"].alias("number"))
            return F.struct((a["need"] - k).alias("need"), F.when(k > 0, F.concat(a["out"], F.array(part))).otherwise(a["out"]).alias("out"))

        return F.aggregate(F.col("__cds") if left else F.reverse("__cds"), zero, step, lambda a: a["out"])

    t = t.withColumns({"__first": codon(True), "__last": codon(False)})
    stop = F.when(plus, F.col("__last")).otherwise(F.col("__first"))
    start = F.when(plus, F.col("__first")).otherwise(F.col("__last"))
    # The CDS ends where the stop codon begins.
    low = F.when(plus, F.col("cds_begin")).otherwise(F.coalesce(F.array_max(F.transform("__first", lambda r: r["stop"])) + 1, F.col("cds_begin")))
    high = F.when(plus, F.coalesce(F.array_min(F.transform("__last", lambda r: r["start"])) - 1, F.col("cds_end"))).otherwise(F.col("cds_end"))
    cds = F.when(coding, clip(low, high)).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,number:int>>"))
    whole = F.array(F.struct(F.lit("transcript").alias("feature"), F.col("tx_begin").alias("start"), F.col("tx_end").alias("stop"), F.lit(None).cast("int").alias("number")))
    rows = F.concat(whole, feature("exon", numbered), feature("CDS", cds), feature("start_codon", start), feature("stop_codon", stop))
    out = t.select("tr_id", "gene", "chrom", "strand", "exons", F.explode(rows).alias("r"))
    frame = F.get(F.transform(F.filter("exons", lambda e: (e["start"] <= F.col("r.start")) & (e["stop"] >= F.col("r.stop"))), lambda e: e["frame"]), F.lit(0))
    phase = F.when(F.col("r.feature").isin("CDS", "start_codon", "stop_codon") & (frame >= 0), F.pmod(3 - frame, F.lit(3)).cast("string")).otherwise(".")
    return out.select("chrom", "r.feature", "r.start", "r.stop", "strand", phase.alias("phase"), "gene", "tr_id", "r.number")


def write_gtf(transcripts: DataFrame, path: str) -> None:
    f = gtf_features(transcripts)
    att = F.concat(F.lit('gene_id "'), "gene", F.lit('"; transcript_id "'), "tr_id", F.lit('";'), F.coalesce(F.concat(F.lit(' exon_number "'), F.col("number").cast("string"), F.lit('";')), F.lit("")))
    f.select(F.concat_ws("\t", "chrom", F.lit("lociweave"), "feature", F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("."), "strand", "phase", att).alias("value")).write.text(path)


# --- gene sets, scores, names ---------------------------------------------------


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, description, gene, ordinal): name, one token of description, genes."""
    p = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path).where("trim(value) <> ''").withColumn("ordinal", F.monotonically_increasing_id())
    return raw.select(p[0].alias("set_name"), p[1].alias("description"), F.explode(F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0)))).alias("gene"), "ordinal")


def read_set_directory(spark: SparkSession, path: str) -> DataFrame:
    """One file per set: name, description, then a gene a line."""
    raw = spark.read.text(f"{path.rstrip('/')}/*.txt", wholetext=True)
    lines = F.transform(F.split("value", "\n"), lambda x: F.trim(x))
    genes = F.filter(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), lambda x: x != "")
    return raw.select(lines[0].alias("set_name"), lines[1].alias("description"), F.explode(genes).alias("gene"), F.lit(0).alias("ordinal"))


def read_map(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """gene -> sets: ``#geneNS`` header, then gene, tab, sets by ``|`` or space;
    ``names`` has set, tab, description."""
    raw = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    p = F.split("value", "\t")
    out = raw.select(p[0].alias("gene"), F.explode(F.filter(F.split(p[1], r"[|\s]+"), lambda x: x != "")).alias("set_name"))
    if names is None:
        return out.select("set_name", F.lit(None).cast("string").alias("description"), "gene", F.lit(0).alias("ordinal"))
    told = spark.read.text(names).select(F.split("value", "\t")[0].alias("s"), F.split("value", "\t")[1].alias("description"))
    return out.join(told, F.col("set_name") == F.col("s"), "left").select("set_name", "description", "gene", F.lit(0).alias("ordinal"))


def as_terms(sets: DataFrame) -> DataFrame:
    return sets.groupBy("gene", F.col("set_name").alias("term")).agg(F.count("*").cast("bigint").alias("n"))


def write_map(terms: DataFrame, path: str, namespace: str = "sym") -> None:
    """gene, tab, terms by ``|`` (a term as often as it counts)."""
    names = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("term", "n"))), lambda x: F.array_repeat(x["term"], x["n"].cast("int"))))
    rows = terms.groupBy("gene").agg(F.array_join(names, "|").alias("t")).select(F.concat_ws("\t", "gene", "t").alias("value"))
    rows.unionByName(rows.sparkSession.createDataFrame([(f"#geneNS\t{namespace}",)], "value string")).sort(F.desc(F.col("value").startswith("#")), "value").write.text(path)


def read_gene_info(spark: SparkSession, path: str) -> DataFrame:
    """(id, sym, syn): NCBI gene info, a row per synonym; repeated ids are an error."""
    raw = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    p = F.split("value", "\t")
    one = raw.select(p[1].alias("id"), p[2].alias("sym"), F.filter(F.split(p[4], r"\|"), lambda x: x != "-").alias("syns"))
    twice = F.count("*").over(Window.partitionBy("id"))
    checked = one.withColumn("n", twice).where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("gene id twice: "), F.col("id"))).cast("boolean")).otherwise(F.lit(True)))
    return checked.select("id", "sym", F.explode_outer("syns").alias("syn"))


def read_gene_scores(spark: SparkSession, path: str, values: list[str], gene_column: str = "gene", sep: str | None = None) -> DataFrame:
    raw = read_rows(spark, path, sep or ("\t" if path.rstrip("/").endswith((".tsv", ".txt")) else ","))
    return raw.select(F.col(gene_column).alias("gene"), *[parse_float(F.col(v)).alias(v) for v in values])


def parse_float(c: Column) -> Column:
    from ..functions.values import parse_value

    return parse_value(c, "float")
