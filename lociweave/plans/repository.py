"""Resources from a folder: one ``genomic_resource.yaml`` each, data beside it.

Folders are listed and read by Spark, so a repository can be on any file system
that Spark reads. A resource's data is planned when an annotator first asks for
it. Ids are folders, with a version in brackets where there is one.
"""

from __future__ import annotations

from functools import cached_property

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genome
from ..operators.scores import Score
from ..sources import models, tables
from . import catalog as cat

# Names of the configuration's keys and types.
CONFIG = "genomic_resource.yaml"
_SCORES = {"position_score": "position", "allele_score": "allele", "np_score": "allele", "fragment_score": "fragment", "cnv_collection": "fragment"}
_COLUMNS = ("chrom", "pos_begin", "pos_end", "reference", "alternative")
_AGGREGATORS = ("aggregator", "position_aggregator", "allele_aggregator", "nucleotide_aggregator")


def read_configs(spark: SparkSession, root: str) -> list[tuple[str, str, dict]]:
    """(id, folder, configuration) of every resource under ``root``. Driver-side:
    a row for each resource, none of its data."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", CONFIG).load(root).select("path", "content").collect()
    if not found:
        raise ValueError(f"{root}: no {CONFIG}")
    base = spark.range(1).select(F.lit(root)).first()[0].rstrip("/")
    tail = base.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    out = []
    for r in sorted(found, key=lambda r: r.path):
        folder = r.path[: -len(CONFIG) - 1]
        at = folder.find(tail)
        out.append((folder[at + len(tail) :].strip("/") if at >= 0 else folder.rsplit("/", 1)[-1], folder, yaml.safe_load(bytes(r.content)) or {}))
    return out


def _renamed(df: DataFrame, spark: SparkSession, folder: str, mapping: dict | None, column: str = "chrom") -> DataFrame:
    """Contigs by a table's ``chrom_mapping``: prefixes, or a file of old and new names."""
    if not mapping:
        return df
    c = F.col(column)
    if "filename" in mapping:
        m = tables.read_rows(spark, f"{folder}/{mapping['filename']}", None)
        m = m.select(F.col(m.columns[0]).alias("__from"), F.col(m.columns[1]).alias("__to"))
        return df.join(m, c == F.col("__from")).withColumn(column, F.col("__to")).drop("__from", "__to")
    if mapping.get("del_prefix"):
        c = F.when(F.startswith(c, F.lit(mapping["del_prefix"])), F.substring(c, len(mapping["del_prefix"]) + 1, 1 << 30)).otherwise(c)
    return df.withColumn(column, F.concat(F.lit(mapping.get("add_prefix", "")), c))


def _score(spark: SparkSession, folder: str, config: dict) -> Score:
    table, kind = config["table"], _SCORES[config["type"]]
    path = f"{folder}/{table['filename']}"
    form = tables.table_format(table["filename"], table.get("format"))
    scores = config.get("scores") or []
    names = {s["id"]: s for s in scores}
    if form == "vcf_info":
        lines, fields = tables.read_vcf(spark, path)
        df, kinds = tables.vcf_scores(lines, fields, [s.get("column_name", s["id"]) for s in scores] or None)
        for s in scores:
            source = s.get("column_name", s["id"])
            df, kinds = df.withColumnRenamed(source, s["id"]), {s["id"] if k == source else k: v for k, v in kinds.items()}
    elif form == "bigwig":
        (name,) = names or {"value": None}
        df, kinds = tables.read_bigwig(spark, path, name), {name: "double"}
    else:
        header = table.get("header") if table.get("header_mode") == "list" else None
        if table.get("header_mode") == "none":
            width = len(spark.read.text(path).where("trim(value) <> ''").first().value.split("\t"))
            header = [str(k) for k in range(width)]
        columns, asked = {}, {}
        for role in _COLUMNS:
            spec = table.get(role) or {}
            if "column_index" in spec or "index" in spec:
                columns[role] = (header or tables.read_rows(spark, path, None if form == "mem" else "\t").columns)[spec.get("column_index", spec.get("index"))]
            elif "column_name" in spec or "name" in spec:
                columns[role] = spec.get("column_name", spec.get("name"))
        for s in scores:
            one = {"type": s.get("type", "float"), **({"na": s["na_values"]} if "na_values" in s else {})}
            at = s.get("column_index", s.get("index"))
            asked[s["id"]] = {**one, **({"index": at} if at is not None else {"column": s.get("column_name", s.get("name", s["id"]))})}
        df = tables.read_score_table(spark, path, asked, columns, form, zero_based=bool(table.get("zero_based")), header=header)
        kinds = {k: tables.KINDS[v["type"]] for k, v in asked.items()}
    defaults = {k: next(s[a] for a in _AGGREGATORS if a in s) for k, s in names.items() if any(a in s for a in _AGGREGATORS)}
    order = ("__line",) if "__line" in df.columns else ()
    return Score(kind, _renamed(df, spark, folder, table.get("chrom_mapping")), kinds, order=order, defaults=defaults)


def _value(spark: SparkSession, folder: str, config: dict):
    kind = config["type"]
    path = f"{folder}/{config['filename']}" if "filename" in config else folder
    if kind in _SCORES:
        return _score(spark, folder, config)
    if kind == "genome":
        return genome.read_fasta(spark, path)
    if kind == "gene_models":
        mapping = tables.read_rows(spark, f"{folder}/{config['gene_mapping']}", None) if config.get("gene_mapping") else None
        out = models.read_gene_models(spark, path, config.get("format") or models.infer_format(spark, path), mapping)
        return _renamed(out, spark, folder, config.get("chrom_mapping"))
    if kind == "gene_score":
        return models.read_gene_scores(spark, path, [s.get("column_name", s.get("name", s["id"])) for s in config["scores"]])
    if kind in ("gene_set_collection", "gene_set"):
        form = config.get("format", "directory")
        if form == "gmt":
            return models.read_gmt(spark, path)
        if form == "map":
            return models.read_map(spark, path)
        return models.read_set_directory(spark, f"{folder}/{config.get('directory', '')}".rstrip("/"))
    if kind == "liftover_chain":
        return genome.read_chain(spark, path)
    raise ValueError(f"{folder}: resource type {kind!r}")


class FileResource:
    """A resource whose data is planned on first use."""

    def __init__(self, spark: SparkSession, name: str, folder: str, config: dict):
        self.id, self.type, self._of = name, config.get("type", "basic"), (spark, folder, config)
        meta = config.get("meta") or {}
        self.labels = {k: str(v) for k, v in (meta.get("labels") or {}).items()}
        self.description, self.summary = meta.get("description", ""), meta.get("summary", "")
        given = config.get("default_annotation") or []
        self.default_attributes = given.get("attributes", []) if isinstance(given, dict) else given

    @cached_property
    def value(self):
        return _value(*self._of)


def load(spark: SparkSession, *roots: str, genome: str | None = None, gene_models: str | None = None) -> cat.Catalog:
    """A catalogue of the repositories' resources; of equal ids the first counts."""
    return cat.Catalog([FileResource(spark, *r) for root in roots for r in read_configs(spark, root)], genome, gene_models)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, md5) of every file under ``root``, paths from there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = root.split("://", 1)[-1].removeprefix("file:").strip("/")
    return files.select(F.substring_index("path", f"{tail}/", -1).alias("path"), F.col("length").alias("size"), F.md5("content").alias("md5"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): files that a manifest has ADDED, DELETED or CHANGED."""
    o, n = old.select("path", F.col("md5").alias("was"), F.lit(1).alias("had")), new.select("path", "md5", F.lit(1).alias("has"))
    what = F.when(F.col("had").isNull(), "ADDED").when(F.col("has").isNull(), "DELETED").when(F.col("was") != F.col("md5"), "CHANGED")
    return o.join(n, "path", "full").select("path", what.alias("change")).where("change is not null")
