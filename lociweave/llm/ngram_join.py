"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix.

The incidence matrix A (documents x shingles) is cut into *document blocks*
(runs of input rows of bounded postings) and *shingle blocks* (ranges of the
shingle hash). Only entries that can count in A * A' travel on:

1. ``_incidence`` reads each text once and sends every (document block, shingle
   block) cell as two packed arrays: short codes, from which a shingle block
   learns how many rows hold a shingle, then the postings themselves.
2. ``_columns`` works through a shingle block: it first adds the codes up in a
   table of column counts of fixed size, then streams the postings and returns
   those whose column holds more than one row. A column with a single row adds
   nothing to the product. Codes that meet in a cell of the table keep a few
   entries too many, never one too few.
3. ``_rows`` puts the returned entries of a document together. A partner at
   ``percent`` shares at least ceil(percent * n / 100) shingles, so a document
   with fewer entries left is discarded by that size-derived bound. The others
   keep their entries, rarest column first.
4. Rows with equal sets become one node (their copies hang on it). Nodes that
   meet in a min-hash column are multiplied first; what this links is known to
   be one component. Then the exact candidate columns are taken: by the prefix
   bound two linked nodes meet in one of the n - ceil(percent * n / 100) + 1
   rarest columns of each. Columns whose nodes already lie in one component
   need no product; the rest are multiplied, in blocks, pairs that fall under
   the bound for their sizes being dropped.

Inside a block ``_product`` accumulates overlap counts row by row against all
columns, and ends once all rows left lie in the block's largest component, so a
group of k near copies costs about k row operations, not k squared, and writes
a spanning forest, never its pairs. No pair, row or partner is capped. A block
is bounded in rows and in entries. A min-hash column that is larger is dealt
into parts, twice, by two hashes, and only rows of one part are multiplied: the
second deal joins what the first left apart. An exact column that is larger,
and still has several components, becomes blocks of pairs of its parts.

Shingles are known by hashes of 48 bits and those of their block, 54 at least
and 64 from half a terabyte on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, input_bytes, mix64, prepare, release_memory, string_parts, text_or_empty
from .graph import components
from .shingles import shingle_sets

_CHUNK = 1_000_000  # postings of a document block
_CHUNK_ROWS = 60_000
_BLOCK_ROWS = 4096  # nodes of a part of a column
_BLOCK_ENTRIES = 4_000_000  # entries of a part of a column
_MOST_BITS = 17  # shingle blocks: one task each
_KEYS = 3  # min-hash columns tried before the exact ones

_CELL = pa.schema([("block", pa.int64()), ("phase", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_CELL_SQL = "block long, phase int, chunk long, a binary, b binary, c binary"


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _low(bits: int) -> np.uint64:
    """Of a shingle's hash, what is kept beside the block: 48 bits at most."""
    return np.uint64((1 << min(48, 64 - bits)) - 1)


def table_bits(size: int, bits: int) -> int:
    """Cells of a block's table of counts, as a power of two: some eight a
    posting (a text has about one in six bytes), 2 ** 20 to 2 ** 29 (512 MB)."""
    return int(min(29, max(20, np.ceil(np.log2(max(1, 8 * size / 6 / (1 << bits)))))))


def _cells(chunk: int, ids: list, sets: list[np.ndarray], bits: int, wide: int) -> pa.RecordBatch:
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    rows = {k: [] for k in _CELL.names}

    def add(block, phase, a, b, c):
        for k, v in zip(_CELL.names, (block, phase, chunk, a, b, c), strict=True):
            rows[k].append(v)

    given = np.array([i is not None for i in ids], np.uint8)
    prints = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    add(-1 - chunk, 0, given.tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes(), n.astype("<i8").tobytes(), prints)
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), n)
    block = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    order = np.argsort(block, kind="stable")
    h, doc, block = h[order], doc[order], block[order]
    edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(h))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = h[lo:hi]
        add(int(block[lo]), 0, _coded(part, wide), None, None)
        add(int(block[lo]), 1, _six(part), np.diff(doc[lo:hi], prepend=0).astype("<u2").tobytes(), None)
    return pa.RecordBatch.from_pydict(rows, schema=_CELL)


def _coded(h: np.ndarray, wide: int) -> bytes:
    """Cells of a block's table for its shingles: three bytes each, or four."""
    code = (h & np.uint64((1 << wide) - 1)).astype("<u4")
    return code.tobytes() if wide > 24 else np.ascontiguousarray(code.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _uncoded(b: bytes, wide: int) -> np.ndarray:
    if wide > 24:
        return np.frombuffer(b, "<u4")
    out = np.zeros((len(b) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(b, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _incidence(batches: Iterator[pa.RecordBatch], n: int, bits: int, wide: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    chunk = (TaskContext.get().partitionId() + 1) << 32
    ids: list = []
    sets: list[np.ndarray] = []
    held = 0
    for batch in batches:
        offsets, data = string_parts(batch.column(1))
        for i, s in zip(batch.column(0).to_pylist(), shingle_sets(offsets, data, n), strict=True):
            ids.append(i)
            sets.append(s)
            held += len(s)
            if held >= _CHUNK or len(sets) >= _CHUNK_ROWS:
                yield _cells(chunk, ids, sets, bits, wide)
                chunk, ids, sets, held = chunk + 1, [], [], 0
    if sets:
        yield _cells(chunk, ids, sets, bits, wide)
    ids, sets = [], []
    release_memory()


def _columns(batches: Iterator[pa.RecordBatch], bits: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block and phase."""
    now = None
    table = np.zeros(1 << wide, np.uint8)  # rows of each column, as far as 255
    for batch in batches:
        out = {k: [] for k in _CELL.names}
        for block, phase, chunk, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if block < 0:
                reply = (0, a, b, c)
            elif phase == 0:
                if block != now:
                    now = block
                    table[:] = 0
                x, k = np.unique(_uncoded(a, wide), return_counts=True)
                table[x] = np.minimum(table[x] + k, 255)
                continue
            else:
                h = _unsix(a)
                df = table[h & np.uint64((1 << wide) - 1)]
                keep = df > 1
                if not keep.any():
                    continue
                doc = np.cumsum(np.frombuffer(b, "<u2").astype(np.int64))
                full = h[keep] & _low(bits) | np.uint64(block) << np.uint64(64 - bits)
                reply = (1, doc[keep].astype("<u2").tobytes(), full.astype("<u8").tobytes(), df[keep].tobytes())
            for k, v in zip(_CELL.names, (block, reply[0], chunk, *reply[1:]), strict=True):
                out[k].append(v)
        if out["block"]:
            yield pa.RecordBatch.from_pydict(out, schema=_CELL)
    table = None
    release_memory()


_ROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("entries", pa.binary())])
_ROW_SQL = "id long, n long, print binary, entries binary"


def _rows(table: pa.Table, percent: int) -> pa.Table:
    doc, full, df = [], [], []
    ids = n = prints = b""
    for phase, a, b, c in zip(*(table.column(k).to_pylist() for k in ("phase", "a", "b", "c")), strict=True):
        if phase == 0:
            ids, n, prints = a, np.frombuffer(b, "<i8"), c
        else:
            doc.append(np.frombuffer(a, "<u2"))
            full.append(np.frombuffer(b, "<u8"))
            df.append(np.frombuffer(c, np.uint8))
    m = len(n)
    given, ids = np.frombuffer(ids[:m], np.uint8), np.frombuffer(ids[m:], "<i8")
    entries: list[bytes | None] = [None] * m
    if doc:
        d, f, k = np.concatenate(doc).astype(np.int64), np.concatenate(full), np.concatenate(df)
        shared = np.bincount(d, minlength=m)
        need = -(-n * percent // 100)
        stays = (shared >= need) & (n > 0) & (given > 0)
        pick = stays[d]
        d, f, k = d[pick], f[pick], k[pick]
        order = np.lexsort((f, k, d))
        d, f = d[order], f[order]
        ends = np.cumsum(np.bincount(d, minlength=m))
        for i in np.flatnonzero(stays):
            entries[i] = f[ends[i - 1] if i else 0 : ends[i]].tobytes()
    return pa.Table.from_pydict(
        {
            "id": pa.array(ids, mask=given == 0),
            "n": n,
            "print": [prints[i * 16 : i * 16 + 16] for i in range(m)],
            "entries": entries,
        },
        schema=_ROW,
    )


def _keys(batches: Iterator[pa.RecordBatch], percent: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Candidate columns of a node, with the number of its entries: its min-hash
    columns, or its exact prefix."""
    for batch in batches:
        ids, keys, entries = [], [], []
        for i, n, e in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            f = np.frombuffer(e, "<u8")
            if exact:
                k = f[: max(0, n + (-n * percent // 100) + 1 - (n - len(f)))].astype(np.int64)
            else:
                k = np.array([(int(mix64(f ^ np.uint64(0x632BE59BD9B4E019 * (s + 1) & 0xFFFFFFFFFFFFFFFF)).min()) >> 2 << 2 | s) - (1 << 63) for s in range(_KEYS)], np.int64)
            ids.append(np.full(len(k), i, np.int64))
            keys.append(k)
            entries.append(np.full(len(k), len(f), np.int32))
        if ids:
            yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys), "id": np.concatenate(ids), "entries": np.concatenate(entries)})


_EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _product(table: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links between the nodes of one block, beyond
    those that ``component`` already joins."""
    ids = table.column("id").to_numpy()
    n = table.column("n").to_numpy()
    m = len(ids)
    sets = [np.frombuffer(e, "<u8") for e in table.column("entries").to_pylist()]
    _, boss = np.unique(table.column("component").to_numpy(), return_inverse=True)
    boss = boss.astype(np.int64)
    col = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    by_col = row[order]
    edge = np.concatenate(([0], np.cumsum(np.bincount(col))))
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    size = np.bincount(boss, minlength=m)
    src, dst = [], []
    todo = np.ones(m, bool)
    while True:
        # Which component is the largest can change: rows passed over in one that
        # no longer is are in line again. At the end all rows not worked on lie in
        # one component, so every link has a worked row or joins nothing new.
        rest = np.flatnonzero(todo & (boss != size.argmax()))
        if not len(rest):
            break
        r = int(rest[0])
        todo[r] = False
        cols = col[at[r] : at[r + 1]]
        counts = np.zeros(m, np.int64)
        lens = edge[cols + 1] - edge[cols]
        # Accumulate in slices, so that the gathered row numbers stay bounded.
        step = max(1, 4_000_000 // max(1, int(lens.max()) if len(lens) else 1))
        for lo in range(0, len(cols), step):
            c, k = cols[lo : lo + step], lens[lo : lo + step]
            flat = np.repeat(edge[c] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(int(k.sum()))
            counts += np.bincount(by_col[flat], minlength=m)
        for s in np.flatnonzero((100 * counts >= percent * (n[r] + n - counts)) & (counts > 0)):
            if boss[s] != boss[r]:
                src.append(ids[r])
                dst.append(ids[s])
                a, b = boss[r], boss[s]
                if size[a] < size[b]:
                    a, b = b, a
                boss[boss == b] = a
                size[a] += size[b]
                size[b] = 0
    return pa.Table.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())}, schema=_EDGE)


def _shared_columns(cand: DataFrame) -> DataFrame:
    """``cand`` (key, id, component, entries) cut to columns of two nodes or
    more, each with the number of parts that it needs. Columns with the same
    nodes (equal counts and sums of hashes) are multiplied once."""
    h = F.xxhash64("id")
    low = [F.sum(x.bitwiseAND(F.lit(0x3FFFFFFF))).alias(f"s{k}") for k, x in enumerate((h, F.shiftright(h, 30), F.xxhash64("id", F.lit(1))))]
    parts = F.ceil(F.greatest(F.count("*") / _BLOCK_ROWS, F.sum("entries") / _BLOCK_ENTRIES)).cast("int").alias("parts")
    whole = cand.groupBy("key").agg(F.count("*").alias("rows"), parts, *low).where("rows > 1")
    whole = whole.groupBy("rows", "parts", "s0", "s1", "s2").agg(F.min("key").alias("key"))
    return cand.join(whole.select("key", "parts"), "key")


def _part(seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts").cast("long")).cast("int")


def _products(blocks: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    return blocks.join(nodes, "id").groupBy("key", "i", "j").applyInArrow(lambda t: _product(t, percent), "src long, dst long")


def _deal(cand: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of one part of a column, for two ways of dealing; a
    column of one part is dealt once. No node travels more than twice a column."""
    deals = F.when(F.col("parts") > 1, F.array(F.struct(F.lit(0).alias("i"), _part(0).alias("j")), F.struct(F.lit(1).alias("i"), _part(1).alias("j")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    return _products(_shared_columns(cand).select("key", "id", "component", F.explode(deals).alias("p")).select("key", "p.i", "p.j", "id", "component"), nodes, percent)


def _multiply(cand: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All links of the candidate columns: of a column with several parts, every
    pair of parts becomes a block."""
    mine = _part(0)
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    return _products(_shared_columns(cand).select("key", "id", "component", F.explode(pairs).alias("p")).select("key", "p.i", "p.j", "id", "component"), nodes, percent)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """-> (id, n_shingles, component_id), one row per row of ``docs``.

    Two rows link when 100 * |A & B| >= percent * |A | B| over their sets of
    distinct ``n``-word shingles (A-Z lower-cased; words are runs of anything
    but space and \\t-\\r; fewer than ``n`` words are one shingle).
    ``component_id`` is the smallest id reachable by links, itself included.

    Null or empty texts, or texts of white space only, have 0 shingles and link
    with nothing. Rows without an id are returned with a null component and
    link with nothing. Rows that repeat an id are one node: their links count
    together. Only the two named columns are read. An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = max(1, input_bytes(docs, text_col))
    bits = min(_MOST_BITS, max(6, int(np.ceil(np.log2(size / (8 << 20) + 1)))))
    wide = table_bits(size, bits)
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    cells = src.mapInArrow(partial(_incidence, n=n, bits=bits, wide=wide), _CELL_SQL)
    cells = cells.repartition(1 << bits, "block").sortWithinPartitions("block", "phase")
    replies = cells.mapInArrow(partial(_columns, bits=bits, wide=wide), _CELL_SQL)
    rows = replies.groupBy("chunk").applyInArrow(lambda t: _rows(t, percent), _ROW_SQL)
    rows = cut(rows, "rows")
    live = rows.where("entries is not null")
    firsts = live.groupBy("print").agg(F.min("id").alias("first"))
    copies = live.select("id", "print").join(firsts, "print").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    nodes = cut(live.join(firsts.select(F.col("first").alias("id"), "print"), ["id", "print"], "left_semi").dropDuplicates(["id", "print"]).select("id", "n", "entries"), "nodes")
    near = nodes.mapInArrow(partial(_keys, percent=percent, exact=False), "key long, id long, entries int").withColumn("component", F.col("id"))
    first_links = cut(_deal(near, nodes, percent), "links")
    known = components(first_links)
    exact = nodes.mapInArrow(partial(_keys, percent=percent, exact=True), "key long, id long, entries int")
    exact = cut(exact.join(known.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", "entries", F.coalesce("component", "id").alias("component")), "columns")
    open_keys = exact.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    more_links = _multiply(exact.join(open_keys, "key", "left_semi"), nodes, percent)
    comp = components(first_links.unionByName(more_links).unionByName(copies))
    return rows.select("id", F.col("n").alias("n_shingles")).join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
