"""Token counts through a cache of digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, prepare, shared_dir, text_or_empty
from .vocab_cache import byte_tokenizer

_COUNT = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
CACHE_SQL = "tokenizer string, digest binary, n_bytes long, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tok, done = byte_tokenizer(path), set()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            # Rows that repeat id and text all come as representatives of their digest.
            new = {d: t for d, t in zip(*(batch.column(k).slice(lo, 256).to_pylist() for k in (0, 1)), strict=True) if d not in done}
            done.update(new)
            texts = list(new.values())
            n = [len(x) // 4 for x in tok.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], schema=_COUNT)
    tok.forget()


class CountCache:
    """A table of (tokenizer version, content digest) -> counts, only ever
    appended to. By default there is one in the shared folder, which every run
    meets; ``CountCache.fresh`` is one that none has used."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/lociweave/token-counts"

    @classmethod
    def fresh(cls, spark: SparkSession) -> CountCache:
        return cls(spark, fresh_path(spark, "token-counts"))

    def read(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(CACHE_SQL).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], CACHE_SQL)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, tokenizer: str, cache: CountCache | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """-> (id, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    The digest is SHA-256 over the normalised content. The contract allows no
    change that could move a count, so normalising is only null -> empty. Rows
    are joined to the cache on digest and tokenizer version; what is missing is
    reduced to one representative row per distinct digest (a narrow partial
    aggregate, so a digest with any share of the rows costs one row a task),
    only those are encoded, and the new counts are appended to the cache before
    the final join. A lost executor repeats single tasks; a lost driver leaves
    a cache that is whole up to its last append, which a second run picks up.
    Should a digest be appended twice, by two runs or for repeated rows that lie
    in different tasks, the join takes one row of them.

    Null or empty text: 0 bytes, 0 tokens. Rows with a null or repeated id are
    counted like any other. Texts are encoded whole, however long; a count equal
    to ``limit`` is not over it. Only the two named columns are read, so others
    may have any name. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    prepare(spark)
    cache = cache or CountCache(spark)
    version = tokenizer_version(tokenizer)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = cut(rows.select("id", "digest"), "digests")
    known = cache.read().where(F.col("tokenizer") == version).select("digest", "n_bytes", "n_tokens")
    # Reduced before anything is joined, so that no digest meets in a task with all its rows.
    firsts = keys.groupBy("digest").agg(F.min_by("id", F.coalesce("id", F.lit(0))).alias("id"))
    misses = firsts.join(known.select("digest").distinct(), "digest", "left_anti")
    picked = rows.join(misses.withColumnRenamed("digest", "d").withColumnRenamed("id", "i"), F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left_semi")
    fresh = picked.select("digest", "text").mapInArrow(partial(_counts, path=tokenizer), "digest binary, n_bytes long, n_tokens long")
    cache.append(fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_bytes", "n_tokens"))
    table = cache.read().where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))
    # As a table of its own, the join has plain exchanges below it, and AQE can split a hot digest.
    table = cut(table, "counts")
    return keys.join(table, "digest").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
