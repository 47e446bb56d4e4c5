"""Exact deduplication as a stateful stream, in DataFrame operations only.

Rows arrive as (digest, identifier, locator). The stream keeps, for every
digest ever seen and without expiry, the winning identifier, its content
locator and the number of rows, in the disk-backed RocksDB state store, with
checkpoints in the shared folder. A partial aggregate runs before the state's
shuffle, so a digest with a third of all rows costs one row a task.

A digest that was hit is not trusted: full bytes are compared. ``min`` and
``max`` of the text by digest, again aggregated before the shuffle, are equal
exactly if all rows are. State that outlives a call also keeps one text per
digest beside the stream, and a digest that earlier calls had brings that text
into the comparison. Where texts differ, the digest moves to a ledger, by whole
text, from which its groups are told ever after.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, text_or_empty

_STATE = "spark.sql.streaming.stateStore."
_SHUFFLE = "spark.sql.shuffle.partitions"
#: Settings of a stream's session. Preallocated files would cost every state
#: partition megabytes of disk, however little it holds.
_CONF = {
    _STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STATE + "rocksdb.allowFAllocate": "false",
    _STATE + "rocksdb.changelogCheckpointing.enabled": "true",
}


class KeyedState:
    """State of a deduplicating stream, kept under ``path``. Rows offered in
    later calls, also by another session, meet the digests of earlier ones.

    Beside the stream: ``changes``, what each call changed; ``contents``, one
    text per digest; ``ledger``, the groups of digests that several texts share.
    Each call only adds to them. Offers to one path must follow one another. A
    call that failed after its rows were taken in counts them again when it is
    repeated on the same path.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "dedup-state")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None

    def held(self) -> DataFrame | None:
        """(digest, id, locator, n) of all digests so far; null before any call."""
        told = self._read("changes")
        return None if told is None else told.groupBy("digest").agg(F.max_by("best", "n").alias("best"), F.max("n").alias("n")).select("digest", "best.id", "best.locator", "n")

    def contents(self) -> DataFrame | None:
        """(digest, text)"""
        return self._read("contents")

    def ledger(self) -> DataFrame | None:
        """(digest, text, best, n) as last written: a group's count only grows."""
        told = self._read("ledger")
        return None if told is None else told.groupBy("digest", "text").agg(F.max_by("best", "n").alias("best"), F.max("n").alias("n"))

    def add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def offer(self, rows: DataFrame) -> DataFrame:
        """``rows`` (digest, id, locator) -> state (digest, id, locator, n) of
        their digests, those of earlier calls counted in."""
        inbox, changes = f"{self.path}/inbox", f"{self.path}/changes/{uuid.uuid4().hex}"
        rows.write.mode("append").parquet(inbox)
        # A session of its own for the stream, so that its settings are nobody else's.
        own = self.spark.newSession()
        for k, v in {**_CONF, _SHUFFLE: self.spark.conf.get(_SHUFFLE)}.items():
            own.conf.set(k, v)
        arriving = own.readStream.schema(rows.schema).parquet(inbox)
        state = arriving.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("best"), F.count("*").alias("n"))
        numbers: list[int] = []

        def keep(df: DataFrame, number: int) -> None:
            numbers.append(number)
            df.write.mode("overwrite").parquet(f"{changes}/{number}")

        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .foreachBatch(keep)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        schema = f"digest binary, best {rows.select(F.struct('id', 'locator').alias('x')).schema['x'].dataType.simpleString()}, n bigint"
        told = self.spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(changes)
        if len(numbers) > 1:
            told = told.groupBy("digest").agg(F.max_by("best", "n").alias("best"), F.max("n").alias("n"))
        return told.select("digest", "best.id", "best.locator", F.col("n"))


def locator(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Where a row's content is: file and row in it, if the rows come from files."""
    try:
        probe = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        probe.schema  # noqa: B018  analysis happens here
        return probe, F.struct(F.col("__file").alias("file"), F.col("__row").alias("row"))
    except AnalysisException:
        return docs, F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("row"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, state: KeyedState | None = None) -> DataFrame:
    """-> (id, locator, keep_id, group_size, kept, text_sha256), one row per row
    of ``docs``, dropped ones too.

    Texts are equal when identical; null counts as empty. Of equal texts the
    row with the largest id stays; of rows that repeat that id too, the one
    whose locator is greatest (rows of a table that is not read from files have
    no locator: then all of them stay). A row without an id loses to any other.
    With a ``state`` that earlier calls used, their rows count too; without one,
    nothing is kept for later calls. ``digest_bits`` shortens the digest, to try
    what happens when digests meet. Texts are compared whole, however long. Only
    the two named columns are read, so other columns may have any name. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    later = state is not None
    state = state or KeyedState(spark)
    with_place, place = locator(docs)
    text = text_or_empty(text_col)
    full = F.sha2(text, 256)
    digest = F.unhex(F.substring(full, 1, digest_bits // 4))
    rows = with_place.select(F.col(id_col).cast("long").alias("id"), place.alias("locator"), digest.alias("digest"), *([full.alias("sha")] if digest_bits < 256 else []))
    rows = cut(rows, "arrivals")
    same = docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    known = before = ledger = None
    if later:
        same = cut(same, "texts")
        known, ledger, before = state.contents(), state.ledger(), state.held()
        if before is not None:
            before = cut(before.join(same.select("digest"), "digest", "left_semi"), "before")
    met = same
    if known is not None:
        # Digests that earlier calls had: their text, fetched for the comparison.
        met = same.join(known.withColumnRenamed("text", "then"), "digest", "left").select("digest", F.least("lo", F.coalesce("then", "lo")).alias("lo"), F.greatest("hi", F.coalesce("then", "hi")).alias("hi"))
    clash = met.where("lo <> hi").select("digest")
    if ledger is not None:
        clash = clash.unionByName(ledger.join(same.select("digest"), "digest", "left_semi").select("digest")).distinct()
    clash = cut(clash, "clashes")
    held = state.offer(rows.select("digest", "id", "locator"))
    sha = F.col("sha") if digest_bits < 256 else F.lower(F.hex("digest"))

    def told(r: DataFrame, keys: list[str], won: DataFrame) -> DataFrame:
        won = won.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("_id"), F.col("locator").alias("_locator"), F.col("n").alias("group_size"))
        on = [F.col(k) == F.col(f"_{k}") for k in keys]
        kept = F.col("id").eqNullSafe(F.col("_id")) & (F.col("locator") == F.col("_locator"))
        return r.join(won, on).select("id", "locator", F.col("_id").alias("keep_id"), "group_size", kept.alias("kept"), sha.alias("text_sha256"))

    if later:
        new = same.select("digest", F.col("lo").alias("text"))
        state.add("contents", new if known is None else new.join(cut(known.select("digest").join(same.select("digest"), "digest", "left_semi"), "known"), "digest", "left_anti"))
    if clash.isEmpty():
        return told(rows, ["digest"], held)
    clean = told(rows.join(clash, "digest", "left_anti"), ["digest"], held)
    full_rows = with_place.select(F.col(id_col).cast("long").alias("id"), place.alias("locator"), digest.alias("digest"), text.alias("text"), full.alias("sha"))
    full_rows = full_rows.join(clash, "digest", "left_semi")
    groups = full_rows.groupBy("digest", "text").agg(F.max(F.struct("id", "locator")).alias("best"), F.count("*").alias("n"))
    # What earlier calls had of these digests: by text in the ledger, or one text and its state.
    if ledger is not None:
        groups = groups.unionByName(ledger.join(clash, "digest", "left_semi"))
    if known is not None and before is not None:
        one = before.select("digest", F.struct("id", "locator").alias("best"), "n").join(known, "digest").join(clash, "digest", "left_semi")
        groups = groups.unionByName((one if ledger is None else one.join(ledger.select("digest").distinct(), "digest", "left_anti")).select("digest", "text", "best", "n"))
    won = cut(groups.groupBy("digest", "text").agg(F.max("best").alias("best"), F.sum("n").alias("n")), "groups")
    if later:
        state.add("ledger", won)
    return clean.unionByName(told(full_rows, ["digest", "text"], won.select("digest", "text", "best.id", "best.locator", "n")))
