"""Score tables from text: tab, comma or white space separated, bed graphs, VCF."""

from __future__ import annotations

import csv
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import KINDS, parse_value


def table_format(path: str, declared: str | None = None) -> str:
    """Backend of a table by its suffix, unless declared."""
    if declared:
        return declared
    p = path.lower()
    for suffix, name in ((".vcf.gz", "vcf_info"), (".vcf", "vcf_info"), (".bgz", "tabix"), (".bw", "bigwig"), (".bigwig", "bigwig"), (".txt", "tsv"), (".tsv", "tsv"), (".txt.gz", "tsv"), (".tsv.gz", "tsv"), (".csv", "csv"), (".csv.gz", "csv"), (".parquet", "parquet")):
        if p.endswith(suffix):
            return name
    return "mem"


def in_file_order(text: DataFrame, name: str) -> DataFrame:
    """Adds the place of each line of a file, or of several one after the other,
    by name. Spark reads the parts of one file in order, but the longest of
    several files first, so these are told by name and part."""
    files = text.inputFiles()
    line = F.monotonically_increasing_id()
    if len(files) < 2:
        return text.withColumn(name, line)
    return text.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), line.alias("line")))


def vcf_header(spark: SparkSession, path: str) -> list[str]:
    """The header lines of a VCF, in order."""
    head = in_file_order(spark.read.text(path), "line").where("value like '#%'").orderBy("line").select("value").collect()
    return [r.value for r in head]


def read_rows(spark: SparkSession, path: str, sep: str | None = "\t", header: list[str] | None = None) -> DataFrame:
    """All columns as text, ``__line`` the order in the file. Without ``header``
    the first line is it (a leading # is taken off). ``sep`` None: white space,
    and the cell EMPTY is the empty text."""
    lines = in_file_order(spark.read.text(path), "__line")
    if header is None:
        first = lines.where("trim(value) <> ''").orderBy("__line").limit(1).collect()
        if not first:
            raise ValueError(f"{path}: no header")
        text = first[0].value.lstrip("#")
        header = text.split() if sep is None else [h.strip() for h in next(csv.reader([text], delimiter=sep))]
        lines = lines.where(F.col("value") != first[0].value)
    lines = lines.where("trim(value) <> '' and value not like '#%'")
    if sep is None:
        cells = F.split(F.trim("value"), r"\s+")
        cell = lambda k: F.when(F.get(cells, F.lit(k)) == "EMPTY", "").otherwise(F.get(cells, F.lit(k)))
    else:
        # Cells may be quoted, with separators and doubled quotes in them; text that is not stays as it is.
        kinds = ", ".join(f"`c{k}` string" for k in range(len(header)))
        told = F.from_csv("value", kinds, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"})
        lines = lines.withColumn("__cells", told)
        cell = lambda k: F.coalesce(F.col("__cells")[f"c{k}"], F.lit(""))
    return lines.select(*[cell(k).alias(h) for k, h in enumerate(header)], "__line")


def read_score_table(spark: SparkSession, path: str, scores: dict[str, dict], columns: dict[str, str] | None = None, format: str | None = None, sep: str | None = None, zero_based: bool = False, header: list[str] | None = None) -> DataFrame:
    """chrom, pos_begin, pos_end[, reference, alternative], typed scores.

    ``scores``: id -> {type, column or index, na}. ``columns``: role -> column.
    Without a pos_end column, records end where they begin. ``zero_based``
    shifts the begin by one, and the end too where the row would be empty.
    """
    kind = table_format(path, format)
    if kind == "parquet":
        raw = spark.read.parquet(path)
        raw = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns], F.monotonically_increasing_id().alias("__line"))
    else:
        raw = read_rows(spark, path, sep if sep is not None else {"csv": ",", "mem": None}.get(kind, "\t"), header)
    roles = {"chrom": "chrom", "pos_begin": "pos_begin", "pos_end": "pos_end", "reference": "reference", "alternative": "alternative"} | (columns or {})
    have = raw.columns
    begin = F.col(roles["pos_begin"]).cast("bigint")
    end = F.col(roles["pos_end"]).cast("bigint") if roles["pos_end"] in have else begin
    if zero_based:
        begin, end = begin + 1, F.when(end == begin, end + 1).otherwise(end)
    out = [F.col(roles["chrom"]).alias("chrom"), begin.alias("pos_begin"), end.alias("pos_end")]
    out += [F.col(roles[r]).alias(r) for r in ("reference", "alternative") if roles[r] in have]
    for name, spec in scores.items():
        source = have[spec["index"]] if "index" in spec else spec.get("column", name)
        out.append(parse_value(F.col(f"`{source}`"), spec.get("type", "float"), spec.get("na")).alias(name))
    return raw.select(*out, "__line")


def convert(df: DataFrame, path: str, chrom: str = "chrom", begin: str = "pos_begin") -> None:
    """Once, from a compressed text that cannot be split to Parquet that region
    filters prune: one folder per contig, rows in order, so row groups hold
    ranges of positions."""
    df.repartitionByRange(chrom, begin).sortWithinPartitions(chrom, begin).write.partitionBy(chrom).parquet(path)


def in_region(df: DataFrame, chrom: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Records that overlap a region; both tests reach the Parquet scan."""
    out = df.where(F.col("chrom") == chrom)
    if end is not None:
        out = out.where(F.col("pos_begin") <= end)
    return out if begin is None else out.where(F.col("pos_end") >= begin)


def read_bedgraph(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """Half-open, 0-based runs of a number."""
    p = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path).where("value not like 'track%' and value not like '#%' and trim(value) <> ''")
    return raw.select(p[0].alias("chrom"), (p[1].cast("bigint") + 1).alias("pos_begin"), p[2].cast("bigint").alias("pos_end"), p[3].cast("double").alias(value))


# --- bigWig -------------------------------------------------------------------


def bigwig_runs(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(chrom, begins, ends, values) of each data block of a bigWig file, 1-based
    and closed (bed graph, variable step and fixed step)."""
    order = "<" if struct.unpack("<I", data[:4])[0] == 0x888FFC26 else ">"
    magic, _, _, tree_at, _, index_at, _, _, _, _, buffer = struct.unpack(order + "IHHQQQHHQQI", data[:56])
    if magic != 0x888FFC26:
        raise ValueError("not a bigWig file")
    names: dict[int, str] = {}
    key_size = struct.unpack(order + "I", data[tree_at + 8 : tree_at + 12])[0]

    def chroms(at: int) -> None:
        leaf, _, n = struct.unpack(order + "BBH", data[at : at + 4])
        at += 4
        for _ in range(n):
            key = data[at : at + key_size]
            at += key_size
            if leaf:
                names[struct.unpack(order + "I", data[at : at + 4])[0]] = key.rstrip(b"\0").decode()
            else:
                chroms(struct.unpack(order + "Q", data[at : at + 8])[0])
            at += 8

    chroms(tree_at + 32)
    blocks: list[tuple[int, int]] = []

    def leaves(at: int) -> None:
        leaf, _, n = struct.unpack(order + "BBH", data[at : at + 4])
        at += 4
        for _ in range(n):
            if leaf:
                blocks.append(struct.unpack(order + "QQ", data[at + 16 : at + 32]))
                at += 32
            else:
                leaves(struct.unpack(order + "Q", data[at + 16 : at + 24])[0])
                at += 24

    leaves(index_at + 48)
    head = struct.Struct(order + "IIIIIBBH")
    kinds = {1: np.dtype([("b", order + "u4"), ("e", order + "u4"), ("v", order + "f4")]), 2: np.dtype([("b", order + "u4"), ("v", order + "f4")]), 3: np.dtype([("v", order + "f4")])}
    for at, size in blocks:
        block = data[at : at + size]
        if buffer:
            block = zlib.decompress(block)
        chrom, start, _, step, span, kind, _, n = head.unpack_from(block)
        items = np.frombuffer(block, kinds[kind], n, head.size)
        begin = start + step * np.arange(n, dtype=np.int64) if kind == 3 else items["b"].astype(np.int64)
        end = items["e"].astype(np.int64) if kind == 1 else begin + span
        yield names[chrom], begin + 1, end, items["v"].astype(np.float64)


def read_bigwig(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """One task per file of at most 2 GB; meant to be converted to Parquet once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                for chrom, begin, end, values in bigwig_runs(bytes(data)):
                    yield pd.DataFrame({"chrom": chrom, "pos_begin": begin, "pos_end": end, value: values})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"chrom string, pos_begin bigint, pos_end bigint, {value} double")


# --- VCF ------------------------------------------------------------------------


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """(lines, INFO fields). Lines: line, chrom, pos, id, ref, alts, qual,
    filter, info map, rest. Fields: name -> (Number, Type) from the header."""
    text = in_file_order(spark.read.text(path), "line")
    rx = r'^##INFO=<ID=([^,>]+),Number=([^,>]+),Type=([^,>]+)'
    head = text.where("value like '##INFO=<%'").select(*[F.regexp_extract("value", rx, k).alias(n) for k, n in enumerate(("id", "number", "type"), 1)]).collect()
    p = F.split("value", "\t")
    alts = F.when(p[4].isin(".", ""), F.array().cast("array<string>")).otherwise(F.split(p[4], ","))
    info = F.when(p[7].isin(".", ""), F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(F.transform(F.array_distinct(F.transform(F.split(p[7], ";"), lambda x: F.split(x, "=")[0])), lambda k: F.struct(k, F.coalesce(F.get(F.transform(F.filter(F.split(p[7], ";"), lambda x: F.split(x, "=")[0] == k), lambda x: F.when(x.contains("="), F.substring(x, F.length(k) + 2, F.length(x)))), F.lit(0)), F.lit(""))))))
    lines = text.where("value not like '#%' and trim(value) <> ''").select(
        "line", p[0].alias("chrom"), p[1].cast("bigint").alias("pos"), p[2].alias("id"), p[3].alias("ref"), alts.alias("alts"), p[5].alias("qual"), p[6].alias("filter"), info.alias("info"), F.slice(p, 9, 1 << 20).alias("rest")
    )
    return lines, {r.id: (r.number, r.type) for r in head}


# VCF types.
_VCF_KINDS = {"Integer": "int", "Float": "float", "String": "str", "Character": "str", "Flag": "bool"}


def info_value(info: Column, name: str, number: str, kind: str, allele: Column) -> Column:
    """One INFO field for an allele (index from 0, null where the line has no
    ALT). A picks by allele, R by allele + 1 (the reference's where there is no
    ALT), ``.`` text is joined by ``|``, other counts give the first value."""
    raw = info[name]
    if kind == "Flag":
        return F.coalesce(F.map_contains_key(info, F.lit(name)), F.lit(False))
    parts = F.filter(F.split(raw, ","), lambda x: x != "")
    if number == "A":
        cell = F.when(allele.isNotNull(), F.get(parts, allele))
    elif number == "R":
        cell = F.get(parts, F.coalesce(allele + 1, F.lit(0)))
    elif number == "1" or kind not in ("String", "Character"):
        cell = raw if number == "1" else F.get(parts, F.lit(0))
    else:
        cell = F.array_join(parts, "|")
    return parse_value(F.nullif(cell, F.lit(".")), _VCF_KINDS[kind], ())


def vcf_scores(lines: DataFrame, fields: dict[str, tuple[str, str]], wanted: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """One record per ALT (one with a null ALT where there is none): chrom,
    pos_begin, pos_end, reference, alternative, scores; and the scores' types."""
    names = wanted or list(fields)
    one = lines.select("line", "chrom", "pos", "ref", "info", F.posexplode_outer("alts").alias("allele", "alternative"))
    cols = [info_value(F.col("info"), n, *fields[n], F.col("allele")).alias(n) for n in names]
    out = one.select("chrom", F.col("pos").alias("pos_begin"), F.col("pos").alias("pos_end"), F.col("ref").alias("reference"), "alternative", *cols, F.col("line").alias("__line"))
    return out, {n: KINDS[_VCF_KINDS[fields[n][1]]] for n in names}


def vcf_alleles(lines: DataFrame) -> DataFrame:
    """Annotatables of a VCF: one per ALT, rows without ref or alts left out."""
    from ..functions.sequences import allele

    one = lines.where("ref is not null and ref <> '.' and size(alts) > 0").select("*", F.posexplode("alts").alias("alt_idx", "alt"))
    return one.withColumn("ann", allele(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
