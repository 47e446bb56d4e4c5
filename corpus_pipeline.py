"""A corpus in four stages: quality, exact copies, near copies, packing.

All stages take null and empty texts (as empty), null and repeated ids, rows
that repeat, texts of any length (whole), empty tables (empty results) and
columns beyond those of ``documents``, whatever their names.

Each stage takes (spark, docs, sf_dir), works on every document the one before
it kept, and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each result to the shared folder and reads it
back, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import dedup, ngram_join, packing, quality
from lociweave.llm.common import cut, text_or_empty
from lociweave.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It scores texts, so the
    columns travel with their rows and nothing is joined. Rows with one text go
    or stay together; a score equal to the threshold stays."""
    return quality.keep_clean(docs)


def _sha(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__sha", F.sha2(text_or_empty("text"), 256))


def _on(keys: DataFrame) -> Column:
    """A row of documents is known by its id, null or not, and its text's digest."""
    return F.col("doc_id").eqNullSafe(keys["__id"]) & (F.col("__sha") == keys["__key"])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; a row without an id
    only where no other has the text. Rows are told by id and text, so an id
    that is repeated, or null, costs no other text of that id its row. Of rows
    that repeat both, one stays (the last of the files they come from)."""
    told = dedup.deduplicate(docs).groupBy(F.col("id").alias("__id"), F.col("text_sha256").alias("__key")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__n"))
    marked = cut(told.where("not __kept or __n > 1"), "marked")
    left = _sha(docs).join(marked, _on(marked), "left_anti").select(docs.columns)
    many = marked.where("__kept")
    if many.isEmpty():
        return left
    placed, place = dedup.locator(docs)
    order = F.struct(place, F.xxhash64(*docs.columns))
    again = _sha(placed.withColumn("__order", order)).join(many, _on(many), "left_semi")
    again = again.groupBy("doc_id", "__sha").agg(F.max_by(F.struct(*docs.columns), "__order").alias("__row"))
    return left.unionByName(again.select("__row.*"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 over five-word shingles the least doc_id
    stays. Rows that share an id, or have none, are linked each by its own text:
    they get numbers outside the range of ids (an id counts before none, and of
    equal ids the least digest). An id and a text come once, as exact_stage
    leaves them."""
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("__n")).where("doc_id is null or __n > 1").select(F.col("doc_id").alias("__id"))
    repeated = cut(repeated, "repeated")
    if repeated.isEmpty():
        gone = ngram_join.link(docs, n=5, percent=80).where("id <> component_id").select(F.col("id").alias("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    keyed = _sha(docs).select("doc_id", "__sha").join(repeated, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").distinct()
    odd = cut(keyed.select(F.col("doc_id").alias("__id"), F.col("__sha").alias("__key"), (F.lit(top).cast("long") + 1 + F.monotonically_increasing_id()).alias("__odd")), "odd")
    numbered = _sha(docs).join(odd, _on(odd), "left").withColumn("__num", F.coalesce("__odd", "doc_id")).select(*docs.columns, "__num")
    linked = cut(ngram_join.link(numbered, id_col="__num", n=5, percent=80).distinct(), "linked")
    real = linked.join(odd, F.col("id") == F.col("__odd"), "left").withColumn("__id", F.when(F.col("__odd").isNull(), F.col("id")).otherwise(F.col("__id")))
    first = real.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__key", "id"))["id"].alias("__first"))
    gone = linked.join(first, "component_id").where("id <> __first").select(F.col("id").alias("__num"))
    return numbered.join(gone, "__num", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, in the proportions of
    their sources. Rows that share an id are packed each; a null source is a
    source of its own."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("ngram_join", near_stage), ("packing", packing_stage)]

#: The classifier, the token ids and the layout of sequences are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
