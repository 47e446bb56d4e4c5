"""Folds over what overlaps, where the pairs never leave their task.

A contig is cut into spans at levels of growing width. A place is filed once, at
the level whose span it is no longer than and under the span it begins in, so it
ends in that span or the next. A record goes, at each level that has places, to
the spans it touches and to the one before. So a place meets all its records in
one task, which folds them: pairs are neither shuffled nor grouped again, and
there is one row for each place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

_WIDTHS = [1 << (12 + 4 * k) for k in range(7)]
_PARTS = 4  # groups of spans for each shuffle partition
_PAIRS = 1 << 22  # pairs, or words of their sets, that are in memory at once
_TEXT = 3 << 18  # bytes told of the places of a task: a writer that keeps each value of a file once gives up at 1 MB
_LIST = 1 << 16  # rows of a place in one list
_CONTIGS = 1000  # contigs whose spans are dealt in turn; those of others are hashed


def _ok(cols: tuple[str, str, str]) -> Column:
    c, b, e = (F.col(x) for x in cols)
    return c.isNotNull() & b.isNotNull() & e.isNotNull() & (e >= b)


def _groups(t: pa.Table, chroms: dict) -> tuple[np.ndarray, list[tuple], np.ndarray]:
    """Row order by span, the spans in it, and where each begins."""
    names = [chroms.setdefault(c, len(chroms)) for c in t.column("__sc").unique().to_pylist()]
    code = t.column("__sc").combine_chunks().dictionary_encode()
    code = np.array(names, np.int64)[code.indices.to_numpy(zero_copy_only=False)] if t.num_rows else np.zeros(0, np.int64)
    level, span = (t.column(c).to_numpy() for c in ("__sl", "__ss"))
    order = np.lexsort((span, level, code))
    key = np.stack([code[order], level[order], span[order]], 1) if t.num_rows else np.zeros((0, 3), np.int64)
    at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if t.num_rows else np.zeros(0, np.int64)
    return order, [tuple(k) for k in key[at].tolist()], np.r_[at, t.num_rows]


def fold(left: DataFrame, right: DataFrame, left_cols: tuple[str, str, str], right_cols: tuple[str, str, str], run: Callable[[pa.Table, pa.Table], pa.Table | None], schema: StructType) -> DataFrame:
    """``run`` over the places and the records of each span that has both: all
    records that a place overlaps are there, and some that it does not. Closed
    intervals; rows with a null or an end before the begin overlap nothing."""
    lb, le = F.col(left_cols[1]), F.col(left_cols[2])
    width = lambda k: F.element_at(F.array(*[F.lit(w).cast("bigint") for w in _WIDTHS]), k + 1)
    a = left.where(_ok(left_cols)).withColumns({"__sc": F.col(left_cols[0]), "__sl": _levels(le - lb, _WIDTHS)}).withColumn("__ss", F.floor(lb / width(F.col("__sl"))).cast("bigint"))
    used = F.broadcast(a.agg(F.collect_set("__sl").alias("__used")))  # one row
    b = right.where(_ok(right_cols)).crossJoin(used).withColumn("__sl", F.explode("__used")).drop("__used").withColumn("__sc", F.col(right_cols[0]))
    w = width(F.col("__sl"))
    b = b.withColumn("__ss", F.explode(F.sequence(F.floor(F.col(right_cols[1]) / w).cast("bigint") - 1, F.floor(F.col(right_cols[2]) / w).cast("bigint"))))
    n = _PARTS * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("__sc", "__sl", "__ss"), F.lit(n))
    none = to_arrow_schema(schema).empty_table()

    def spans(places: pa.Table, records: pa.Table) -> pa.Table:
        chroms: dict = {}
        if not places.num_rows or not records.num_rows:
            return none
        p_order, p_keys, p_at = _groups(places, chroms)
        r_order, r_keys, r_at = _groups(records, chroms)
        where = {k: i for i, k in enumerate(r_keys)}
        told = []
        for i, k in enumerate(p_keys):
            j = where.get(k)
            if j is not None:
                got = run(places.take(p_order[p_at[i] : p_at[i + 1]]), records.take(r_order[r_at[j] : r_at[j + 1]]))
                if got is not None and got.num_rows:
                    told.append(got)
        return pa.concat_tables(told) if told else none

    return a.groupBy(part.alias("__part")).cogroup(b.groupBy(part.alias("__part"))).applyInArrow(spans, schema)


def _levels(length: Column, widths: list[int]) -> Column:
    level = F.lit(len(widths) - 1)
    for k in range(len(widths) - 2, -1, -1):
        level = F.when(length < widths[k], F.lit(k)).otherwise(level)
    return level


def _dealing(left: DataFrame, place: Callable[[DataFrame], DataFrame], sizes: DataFrame, left_cols: tuple[str, str, str], right_cols: tuple[str, str, str], pair: int) -> tuple[list[int], dict[str, int], int, list[int]]:
    """(widths of spans, by contig the number of span 0, tasks, levels that have
    places) so that a task tells about ``_TEXT`` bytes, ``pair`` of each overlap."""
    (c, b, e), (rc, rb, re_) = left_cols, right_cols
    # No filter: it would be evaluated for every row, ahead of the grouping.
    places = place(left.select("__id").distinct()).select(F.when(_ok(left_cols), F.col(c)).alias("chrom"), F.col(b).alias("b"), (F.col(e) - F.col(b)).alias("long")).withColumn("level", _levels(F.col("long"), _WIDTHS))
    places = places.groupBy("chrom").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n"), F.max(F.when(F.col("level") == 0, F.col("long"))).alias("near"), F.collect_set("level").alias("levels"))
    records = sizes.where(_ok(right_cols)).groupBy(F.col(rc).alias("chrom")).agg(F.min(rb).alias("lo"), F.max(re_).alias("hi"), F.sum((F.col(re_) - F.col(rb) + 1).cast("double")).alias("bases"))
    over = {r.chrom: r.bases / (r.hi - r.lo + 1) for r in records.collect()}
    found = sorted((r for r in places.collect() if r.chrom in over), key=lambda r: r.chrom)
    text = sum(r.n * over[r.chrom] for r in found) * pair
    extent = sum(r.hi - r.lo + 1 for r in found)
    width = max(16, min(_WIDTHS[0], int(extent * _TEXT / max(text, 1))))
    widths = [width, *(w for w in _WIDTHS if w > width)]
    used = {k + len(widths) - len(_WIDTHS) for r in found for k in r.levels if k}
    # Places of the first level of ``_WIDTHS`` may be of two levels now.
    used |= {k for r in found if r.near is not None for k in ((0, 1) if r.near >= width else (0,))}
    first, at = {}, 0
    for r in found[:_CONTIGS]:
        first[r.chrom] = at - r.lo // width
        at += r.hi // width - r.lo // width + 1
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(text) // _TEXT))
    return widths, first, tasks, sorted(used)


def fold_rows(left: DataFrame, place: Callable[[DataFrame], DataFrame], right: DataFrame, sizes: DataFrame, left_cols: tuple[str, str, str], right_cols: tuple[str, str, str], run: Callable[[pa.Table, pa.Table], pa.Table | None], schema: StructType, pair: int) -> DataFrame:
    """``fold`` where what is told is long and rows are short: rows go to their
    place, and what is told of it is neither shuffled nor sorted. ``left`` has one
    row for each row, with its place, a struct, in ``__id`` and the rest of it in
    ``__row``; ``place`` adds the columns of ``left_cols`` and those for ``run``. Of
    each place there come back ``__id``, ``__rows`` (its rows, at times in several
    lists), and what ``run`` tells, nulls where it tells nothing. The first field
    of ``schema`` is ``__id``. ``sizes`` has the ends of the records, each overlap
    tells about ``pair`` bytes: tasks have as many places as give ``_TEXT``."""
    widths, first, n, levels = _dealing(left, place, sizes, left_cols, right_cols, pair)
    width = lambda k: F.element_at(F.array(*[F.lit(w).cast("bigint") for w in widths]), k + 1)
    turn = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[F.col("__sc")] + F.col("__ss") if first else F.lit(None)
    part = F.pmod(F.coalesce(F.when(F.col("__sl") == 0, turn), F.xxhash64("__sc", "__sl", "__ss")), F.lit(n)).cast("int")
    lb, le = F.col(left_cols[1]), F.col(left_cols[2])
    ok = F.coalesce(_ok(left_cols), F.lit(False))

    def filed(df: DataFrame) -> DataFrame:
        out = place(df).withColumns({"__sc": F.when(ok, F.col(left_cols[0])).otherwise(""), "__sl": F.when(ok, _levels(le - lb, widths)).otherwise(-1)})
        return out.withColumn("__ss", F.when(ok, F.floor(lb / width(F.col("__sl"))).cast("bigint")).otherwise(0))

    # What has no place in a span is dealt by where it was read.
    a = filed(left).select("__id", "__row", F.when(ok, part).otherwise(F.pmod(F.spark_partition_id(), F.lit(n))).alias("__part"))
    b = right.where(_ok(right_cols)).withColumn("__sl", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("__sc", F.col(right_cols[0]))
    w = width(F.col("__sl"))
    b = b.withColumn("__ss", F.explode(F.sequence(F.floor(F.col(right_cols[1]) / w).cast("bigint") - 1, F.floor(F.col(right_cols[2]) / w).cast("bigint")))).withColumn("__part", part)
    rows = StructType([left.schema["__id"], StructField("__rows", ArrayType(left.schema["__row"].dataType)), *schema.fields[1:]])
    kinds, most = to_arrow_schema(rows), _LIST

    def by_place(some: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Table]:
        """The distinct places; lists of ``_LIST`` rows at most: whose, and the lists."""
        ids = some.column("__id").combine_chunks()
        keys = {"known": pc.is_valid(ids)} | {f"k{i}": x for i, x in enumerate(ids.flatten())}
        own = pa.table(keys | {"at": np.arange(len(ids))}).group_by(list(keys), use_threads=False).aggregate([("at", "list")]).column("at_list").combine_chunks()
        ends = own.offsets.to_numpy()
        size, at = np.diff(ends), own.flatten()
        many = -(-size // most)
        whose = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many)
        cuts = np.r_[0, np.minimum((ends[:-1] - ends[0])[whose] + (nth + 1) * most, (ends[1:] - ends[0])[whose])]
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), some.column("__row").combine_chunks().take(at))
        return some.take(at.take(pa.array(ends[:-1] - ends[0]))), whose, lists

    def told(places: pa.Table, records: pa.Table) -> Iterator[pa.Table]:
        chroms: dict = {}
        p_order, p_keys, p_at = _groups(places, chroms)
        r_order, r_keys, r_at = _groups(records, chroms) if records.num_rows else ([], [], [])
        where = {k: i for i, k in enumerate(r_keys)}
        for i, k in enumerate(p_keys):
            one, whose, lists = by_place(places.take(p_order[p_at[i] : p_at[i + 1]]))
            j = where.get(k)
            numbered = one.set_column(one.schema.get_field_index("__id"), "__id", pa.array(np.arange(one.num_rows)))
            got = None if j is None else run(numbered, records.take(r_order[r_at[j] : r_at[j + 1]]))
            known = np.full(one.num_rows, -1)
            if got is not None:
                known[got.column("__id").to_numpy()] = np.arange(got.num_rows)
            known = known[whose]
            cols = [one.column("__id").take(pa.array(whose)), lists]
            cols += [pa.nulls(len(whose), f.type) if got is None else got.column(f.name).take(pa.array(known, mask=known < 0)) for f in list(kinds)[2:]]
            yield pa.table([x.cast(f.type) for x, f in zip(cols, kinds, strict=True)], schema=kinds)

    def whole(places: pa.Table, records: pa.Table) -> pa.Table:
        return pa.concat_tables(told(places, records)) if places.num_rows else kinds.empty_table()

    return filed(a.repartitionById(n, "__part")).groupBy("__part").cogroup(b.repartitionById(n, "__part").groupBy("__part")).applyInArrow(whole, rows)


def pairs(places: tuple[np.ndarray, np.ndarray], records: tuple[np.ndarray, np.ndarray], words: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first place, last place + 1, place of each pair from the first, record)
    of the pairs that overlap, by place, some places at a time. The records are
    to be in the order of their begins."""
    (pb, pe), (rb, re_) = places, records
    lo = np.searchsorted(rb, pb - (re_ - rb).max(), "left")
    n = np.maximum(np.searchsorted(rb, pe, "right") - lo, 0)
    total = np.r_[0, np.cumsum(n)]
    i = 0
    while i < len(pb):
        j = max(i + 1, int(np.searchsorted(total, total[i] + _PAIRS // max(words, 1), "right")) - 1)
        own = np.repeat(np.arange(j - i), n[i:j])
        rec = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], n[i:j]) + np.repeat(lo[i:j], n[i:j])
        hit = re_[rec] >= pb[i:j][own]
        yield i, j, own[hit], rec[hit]
        i = j


class Names:
    """Sets of names as bits, one set for each record."""

    def __init__(self, lists: pa.Array):
        flat = lists.flatten()
        known = sorted(flat.unique().to_pylist(), key=lambda x: (x is not None, x or ""))
        self.names = pa.array(known, pa.string())
        self.words = -(-len(known) // 64) or 1
        place = {x: k for k, x in enumerate(known)}
        coded = flat.dictionary_encode(null_encoding="encode")
        code = np.array([place[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        sizes = np.diff(lists.offsets.to_numpy())
        self.masks = np.zeros((len(lists), self.words), np.uint64)
        np.bitwise_or.at(self.masks, (np.repeat(np.arange(len(lists)), sizes), code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))

    def union(self, n: int, own: np.ndarray, rec: np.ndarray) -> np.ndarray:
        """Of ``n`` places with pairs (place, record), by place: a row of bits each."""
        out = np.zeros((n, self.words), np.uint64)
        if len(own):
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[at]] = np.bitwise_or.reduceat(self.masks[rec], at, axis=0)
        return self.bits(out)

    def bits(self, masks: np.ndarray) -> np.ndarray:
        return np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, : len(self.names)].view(bool)


def listed(bits: np.ndarray, values: pa.Array) -> pa.ListArray:
    """For each row of bits the values whose bits are set, in order."""
    ends = np.r_[0, np.cumsum(bits.sum(1))]
    big = pa.LargeListArray.from_arrays(ends, values.take(pa.array(np.nonzero(bits)[1])))
    return big.cast(pa.list_(values.type))
