"""Document fingerprints from content-defined chunks.

A gear hash runs over the UTF-8 bytes; it depends on the last 32 bytes only, so
it is computed for many texts at once. Boundaries are normalised: before the
normal length a chunk ends where more bits are zero than after it, between a
least and a greatest length. As no chunk is shorter than the window, where a
boundary falls depends on what is near, and an edit moves only its own chunks.

The fingerprint is the sorted set of (digest, length) of the chunks, written as
hex. Likeness is containment: the bytes in chunks of both, over the bytes of
the lighter one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, input_bytes, mix64, prepare, text_or_empty

_LEAST, _NORMAL, _MOST = 32, 80, 256
_STRICT, _LOOSE = np.uint32(0x7F << 20), np.uint32(0x1F << 20)
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_PIECE = 4 << 20
#: Rows of a range of ids for each task, and the most ranges; their heads are
#: held by the driver and every task (8 bytes each).
_RANGES, _MOST_RANGES = 4, 200_000
_TASK_BYTES, _LEAST_TASKS = 8 << 20, 8
_SAMPLED = 20  # ids looked at for each bound between ranges


def _places(factor: int) -> np.ndarray:
    out = np.ones(_MOST + 1, np.uint64)
    out[1:] = np.uint64(factor)
    np.multiply.accumulate(out, out=out)
    return out


#: A chunk's digest is two hashes of 64 bits, by two rows of place factors.
_PLACES = (_places(0xD6E8FEB86659FD93), _places(0xA0761D6478BD642F))


def _gear(data: np.ndarray) -> np.ndarray:
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        up = h.copy()
        up[s:] += h[:-s] << np.uint32(s)
        h = up
    return h


def _cuts(size: int, at: list[int], strict: list[bool]) -> list[int]:
    """Ends of the chunks of a text of ``size`` bytes; ``at`` are the places
    after which the hash has zeros."""
    out, begin, k, n = [], 0, 0, len(at)
    while size - begin > _LEAST:
        stop = min(begin + _MOST, size)
        end = stop
        while k < n and at[k] < begin + _LEAST:
            k += 1
        i = k
        while i < n and at[i] < stop:
            if strict[i] or at[i] >= begin + _NORMAL:
                end = at[i]
                break
            i += 1
        out.append(end)
        begin, k = end, i
    if begin < size:
        out.append(size)
    return out


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """For each text, digest (128 bits) -> length of its distinct chunks."""
    out: list[dict[int, int]] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _PIECE):
            size += len(texts[hi])
            hi += 1
        out.extend(_chunk_piece(texts[lo:hi]))
        lo = hi
    return out


def _chunk_piece(texts: list[bytes]) -> list[dict[int, int]]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [{} for _ in texts]
    h = _gear(data)
    hits = np.flatnonzero((h & _LOOSE) == 0)
    strict = ((h[hits] & _STRICT) == 0).tolist()
    begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    first = np.searchsorted(hits, begin)
    ends, count = [], []
    for i in range(len(texts)):
        a, b, o = first[i], first[i + 1], int(begin[i])
        cuts = _cuts(len(texts[i]), (hits[a:b] + (1 - o)).tolist(), strict[a:b])
        count.append(len(cuts))
        ends.extend([c + o for c in cuts])
    ends = np.array(ends)
    starts = np.concatenate(([0], ends[:-1]))
    lengths = ends - starts
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    byte = data.astype(np.uint64) + np.uint64(1)
    high, low = (mix64(np.add.reduceat(byte * p[place], starts) + lengths.astype(np.uint64)).tolist() for p in _PLACES)
    digest = [a << 64 | b for a, b in zip(high, low, strict=True)]
    lengths = lengths.tolist()
    out, k = [], 0
    for c in count:
        out.append(dict(zip(digest[k : k + c], lengths[k : k + c], strict=True)))
        k += c
    return out


def written(chunks: dict[int, int]) -> str:
    """35 hex digits a chunk: 32 of the digest, 3 of the length."""
    return "".join([f"{d:032x}{n:03x}" for d, n in sorted(chunks.items())])


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """0 to 1; two empty fingerprints are alike (1), an empty and another not (0)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    return sum(n for d, n in a.items() if d in b) / min(sum(a.values()), sum(b.values()))


_PLACED = pa.schema([("block", pa.int64()), ("copy", pa.bool_()), ("id", pa.int64()), ("text", pa.string())])
_OUT = pa.schema(
    [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_OUT_SQL = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _heads(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).drop_null().to_numpy()
        if len(ids):
            b = np.searchsorted(bounds, ids)
            top = np.full(len(bounds) + 1, np.iinfo(np.int64).min)
            np.maximum.at(top, b, ids)
            u = np.unique(b)
            yield pa.RecordBatch.from_pydict({"b": u, "id": top[u]})


def _place(batches: Iterator[pa.RecordBatch], heads: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Block of a row: the least head not below its id. The first row of each
    block also goes, as a copy, to the block that comes before it."""
    last = len(heads) - 1
    for batch in batches:
        ids = batch.column(0).to_pylist()
        key = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
        block = np.searchsorted(heads, key) if len(heads) else np.zeros(len(ids), np.int64)
        head = heads[block] == key if len(heads) else np.ones(len(ids), bool)
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.zeros(len(ids), bool)), batch.column(0), batch.column(1)], schema=_PLACED)
        if head.any():
            at = np.flatnonzero(head)
            before = np.where(block[at] == last, 0, block[at] + 1) if len(heads) else block[at]
            yield pa.RecordBatch.from_arrays([pa.array(before, pa.int64()), pa.array(np.ones(len(at), bool)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], schema=_PLACED)


def _pairs(ids: list, texts: list[str]) -> pa.RecordBatch:
    """``texts`` has one text more than ``ids``: the next of the last."""
    raw = [t.encode() for t in texts]
    edited = []
    for t, nxt in zip(texts[:-1], texts[1:], strict=True):
        k = len(t) // 3
        edited.append((t[: len(t) - k] + nxt[:k]).encode())
    sets = chunk_sets(raw + edited)
    own, other = sets[: len(raw)], sets[len(raw) :]
    cols = [[], [], [], [], [], []]
    for i in range(len(ids)):
        for c, v in zip(cols, (len(texts[i]), hashlib.sha256(edited[i]).hexdigest(), written(own[i]), written(other[i]), containment(own[i], other[i]), containment(own[i], own[i + 1])), strict=True):
            c.append(v)
    return pa.RecordBatch.from_pydict(dict(zip(_OUT.names, [ids, *cols], strict=True)), schema=_OUT)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, own rows before copies, ids falling."""
    ids: list = []
    texts: list[str] = []
    now, done, size = None, True, 0
    for batch in batches:
        for block, copy, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if block != now:
                now, done = block, False
                ids, texts, size = [], [], 0
            if done:
                continue
            texts.append(text)
            size += len(text)
            if copy:
                if len(texts) > 1:
                    yield _pairs(ids, texts)
                done = True
            elif len(ids) >= 400 or size > _PIECE and len(ids):
                yield _pairs(ids, texts)
                ids, texts, size = [i], [text], len(text)
            else:
                ids.append(i)


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next), one row per row of ``docs``.

    The edited text has the last third (rounded down) of the code points
    replaced by as many, or all, from the start of the next text, ids falling;
    after the least id comes the greatest. Rows that repeat an id follow one
    another by text; rows without an id come last; a single row follows itself.
    Null texts are empty: no chunks, fingerprint "". An empty table gives an
    empty table. Texts are taken whole.

    Ids are cut into ranges by a sample of them (it moves bounds between tasks,
    never a result); a range gets the first row of the next one as well, so that
    each text travels once and the order needs no window over all rows. Only
    the two named columns are read, so others may have any name.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    tasks = max(_LEAST_TASKS, min(_MOST_RANGES // _RANGES, input_bytes(docs, text_col) // _TASK_BYTES))
    ids = src.select("id").where("id is not null")
    share = min(1.0, _SAMPLED * _RANGES * tasks / max(1, ids.count()))
    seen = np.sort(np.array([r.id for r in ids.sample(share, seed=1).collect()], np.int64))
    bounds = np.unique(seen[np.linspace(0, len(seen) - 1, _RANGES * tasks).astype(int)]) if len(seen) else seen
    heads = ids.mapInArrow(partial(_heads, bounds=bounds), "b long, id long")
    heads = np.array(sorted(r.id for r in heads.groupBy("b").agg(F.max("id").alias("id")).collect()), np.int64)
    placed = src.mapInArrow(partial(_place, heads=heads), "block long, copy boolean, id long, text string")
    placed = placed.repartition(max(1, min(len(heads), tasks)), "block")
    placed = placed.sortWithinPartitions("block", "copy", F.col("id").desc_nulls_last(), "text")
    return placed.mapInArrow(_follow, _OUT_SQL)


def stored_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, n_chars, fingerprint): the fingerprints alone, without a shuffle,
    as a table in the shared folder."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "fingerprint": [written(c) for c in chunk_sets([t.encode() for t in texts])]})

    src = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return cut(src.mapInArrow(run, "id long, n_chars long, fingerprint string"), "fingerprints")
