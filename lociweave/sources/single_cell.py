"""Count matrices of single cells in text form (market matrix, features, barcodes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import in_file_order


def _numbered(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """Lines of a file with their numbers from 1. A part of a file has a range of
    numbers of its own, so the parts' sizes, a row each, are added up."""
    text = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    sizes = text.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.expr("b.p < a.p"), "left").groupBy("a.p").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    cells = F.split("value", "\t")
    told = text.join(F.broadcast(before), part == F.col("p"))
    return told.select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("nth"), *[F.get(cells, F.lit(k)).alias(n) for k, n in enumerate(names)])


def read_market_matrix(spark: SparkSession, folder: str, suffix: str = ".gz") -> DataFrame:
    """(barcode, feature_id, feature_name, feature_type, value): the entries of
    ``matrix.mtx`` with the names of their rows (features) and columns (barcodes)."""
    lines = in_file_order(spark.read.text(f"{folder}/matrix.mtx{suffix}"), "line").where("value not like '%\\%%' and trim(value) <> ''")
    size = lines.orderBy("line").limit(1)
    p = F.split("value", r"\s+")
    entries = lines.join(F.broadcast(size.select(F.col("line").alias("first"))), F.col("line") != F.col("first")).select(p[0].cast("bigint").alias("f"), p[1].cast("bigint").alias("b"), p[2].cast("double").alias("value"))
    features = _numbered(spark, f"{folder}/features.tsv{suffix}", ("feature_id", "feature_name", "feature_type")).withColumnRenamed("nth", "f")
    barcodes = _numbered(spark, f"{folder}/barcodes.tsv{suffix}", ("barcode",)).withColumnRenamed("nth", "b")
    return entries.join(features, "f").join(barcodes, "b").select("barcode", "feature_id", "feature_name", "feature_type", "value")
