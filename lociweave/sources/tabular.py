"""Annotation inputs and outputs as delimited text and VCF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import from_row
from ..functions.values import stringify, vcf_text
from .tables import in_file_order, read_rows, read_vcf, vcf_alleles, vcf_header

BAD_LINES = 10


def read_tabular(spark: SparkSession, path: str, columns: dict[str, str] | None = None, sep: str = "\t") -> DataFrame:
    """Rows of a delimited file with ``id`` (file order) and ``ann``. The layout
    is the first whose columns are there; positions that are no numbers make
    the row bad, and any action fails with up to ten bad rows named."""
    raw = read_rows(spark, path, sep)
    have = {c: c for c in raw.columns if not c.startswith("__")}
    roles = have | (columns or {})
    typed = raw
    for r in ("pos", "pos_beg", "pos_end"):
        if roles.get(r) in have:
            c = roles[r]
            typed = typed.withColumn(f"__n_{r}", F.col(c).try_cast("bigint"))
            roles[r] = f"__n_{r}"
    numbers = [c for c in typed.columns if c.startswith("__n_")]
    bad = F.lit(False)
    for c in numbers:
        bad = bad | F.col(c).isNull()
    out = typed.withColumn("ann", from_row(roles)).withColumnRenamed("__line", "id")
    checked = out.where(F.when(bad, F.raise_error(F.concat(F.lit("bad row: "), F.concat_ws(" ", *[F.col(c) for c in have]))).cast("boolean")).otherwise(F.lit(True)))
    return checked.drop(*numbers)


def bad_rows(spark: SparkSession, path: str, numbers: list[str], sep: str = "\t") -> DataFrame:
    """The first ten rows of a file whose number columns do not read as numbers."""
    raw = read_rows(spark, path, sep)
    bad = F.lit(False)
    for c in numbers:
        bad = bad | F.col(c).try_cast("bigint").isNull()
    return raw.where(bad).orderBy("__line").limit(BAD_LINES)


def has_at_most(df: DataFrame, n: int) -> bool:
    """Whether a table has no more than ``n`` rows, without counting the rest."""
    return df.limit(n + 1).count() <= n


def render(df: DataFrame, columns: list[str], missing: str = "") -> DataFrame:
    """``columns`` as text; complex ones printed by ``stringify``."""
    kinds = dict(df.dtypes)
    return df.select(*[stringify(F.col(c), kinds[c], missing).alias(c) for c in columns])


def write_tabular(df: DataFrame, columns: list[str], path: str, order: list[str] | None = None, sep: str = "\t", compression: str | None = None, one_file: bool = False) -> None:
    """Text parts under ``path``, each with a header; rows in order if asked.
    ``one_file`` makes it one part, which one task writes."""
    kinds = dict(df.dtypes)
    keys = order or []
    shown = df.select(*[F.col(c).alias(f"__o{k}") for k, c in enumerate(keys)], *[stringify(F.col(c), kinds[c]).alias(c) for c in columns])
    if keys:
        names = [f"__o{k}" for k in range(len(keys))]
        shown = (shown.repartition(1) if one_file else shown.repartitionByRange(*names)).sortWithinPartitions(*names).drop(*names)
    elif one_file:
        shown = shown.coalesce(1)
    w = shown.write.option("sep", sep).option("header", True).option("quote", "").option("emptyValue", "")
    (w.option("compression", compression) if compression else w).csv(path)


def read_vcf_input(spark: SparkSession, path: str) -> DataFrame:
    """One row per ALT with ``ann``; ``line`` and ``alt_idx`` say where it goes
    back. Lines without ALT have no row; ``write_vcf`` takes them from the file."""
    lines, _ = read_vcf(spark, path)
    return vcf_alleles(lines)


def _cells(alleles: str, name: str) -> Column:
    return F.transform(alleles, lambda e: F.when(e[name] == "", ".").otherwise(e[name]))


def write_vcf(df: DataFrame, attributes: list[str], path: str, source: str) -> None:
    """The lines of the VCF ``source`` as they are, with samples, ids and lines
    without ALT, and to INFO the attributes of the alleles ``df`` (line, alt_idx
    as ``read_vcf_input`` gave them): lists by ALT, ``.`` for none; an attribute
    that is empty for all ALTs of a line is left out. The header is the source's,
    with a line for each attribute before its last."""
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    cells = [vcf_text(F.col(a), kinds[a]).alias(f"__a{k}") for k, a in enumerate(attributes)]
    got = F.array_sort(F.collect_list(F.struct("alt_idx", *[f"__a{k}" for k in range(len(attributes))])))
    by_line = df.select(F.col("line").alias("__l"), "alt_idx", *cells).distinct().groupBy("__l").agg(got.alias("__x"))
    new = []
    for k, a in enumerate(attributes):
        values = _cells("__x", f"__a{k}")
        new.append(F.when(F.exists(values, lambda v: v != "."), F.concat(F.lit(f"{a}="), F.array_join(values, ","))))
    text = in_file_order(spark.read.text(source), "line").where("value not like '#%' and trim(value) <> ''")
    told = text.join(by_line, F.col("line") == F.col("__l"), "left").withColumn("__p", F.split("value", "\t"))
    info = F.get("__p", F.lit(7))
    added = F.concat_ws(";", F.when(info.isin(".", ""), F.lit(None)).otherwise(info), *new)
    size = F.size("__p")
    cut = F.concat(F.slice("__p", 1, 7), F.array(F.when(added == "", ".").otherwise(added)), F.when(size > 8, F.slice("__p", F.lit(9), F.greatest(size - 8, F.lit(1)))).otherwise(F.array().cast("array<string>")))
    body = told.select("line", F.when((size >= 8) & F.col("__x").isNotNull(), F.array_join(cut, "\t", "")).otherwise(F.col("value")).alias("value"))
    top = vcf_header(spark, source)
    at = next((k for k, t in enumerate(top) if t.startswith("#CHROM")), len(top))
    top[at:at] = [f'##INFO=<ID={a},Number=A,Type=String,Description="{a}">' for a in attributes]
    first = F.lit(0).alias("of")
    head = spark.createDataFrame([(k, t) for k, t in enumerate(top)], "at bigint, value string").select(first, "at", F.lit(None).cast(body.schema["line"].dataType).alias("line"), "value")
    every = head.unionByName(body.select(F.lit(1).alias("of"), F.lit(0).cast("bigint").alias("at"), "line", "value"))
    every.repartitionByRange("of", "at", "line").sortWithinPartitions("of", "at", "line").select("value").write.text(path)


def prepare_order(df: DataFrame, ranks: DataFrame, chrom: str, *then: str) -> DataFrame:
    """Rows by contig rank (unknown contigs last, by name), then position.
    ``ranks``: (chrom, rank)."""
    r = ranks.select(F.col("chrom").alias("__rc"), F.col("rank").alias("__rank"))
    out = df.join(r, F.col(chrom) == F.col("__rc"), "left")
    return out.orderBy(F.col("__rank").asc_nulls_last(), F.col(chrom), *then).drop("__rc", "__rank")
