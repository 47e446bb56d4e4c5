"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. Windows of ``window`` sequences are filled in
turn: in each round a queue is credited its share of the window and sends the
whole tokens its credit allows; the fraction left is its deficit and goes with
it to the next window. Run one after the other that would be a loop over all
windows. But a queue's credit after w windows is known in closed form (share
times tokens so far, by pieces where queues run dry), so what it has sent is
that number rounded down, and any task can place any document from its
position in its queue alone: deficits carry over windows and partitions alike.

Queue positions come from two levels: a running sum in the task that tokenises,
and a sum over the (task, source) totals, a table of one row each.

Where there are very many sources, several share a bundle. A bundle is a queue
to all others, credited for all its sources; inside it the same schedule deals
its tokens to them, window by window, by their own weights and deficits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, text_or_empty
from .vocab_cache import byte_tokenizer


class Schedule:
    """``totals``: tokens of each queue; ``weights``: target proportions. A
    schedule ``inside`` a queue of another, (that schedule, queue), has its
    windows where the other's windows cut that queue."""

    def __init__(self, totals: list[int], weights: list[int], window: int, inside: tuple[Schedule, int] | None = None):
        self.inside = inside
        if any(w <= 0 for w in weights):
            raise ValueError("weights must be positive")
        self.totals, self.weights, self.window = totals, weights, window
        self.total = sum(totals)
        # Phases between queues running dry: (time, tokens sent by all, active weight).
        order = sorted((i for i in range(len(totals)) if totals[i]), key=lambda i: Fraction(totals[i], weights[i]))
        time, sent, active, self._phases = Fraction(0), Fraction(0), sum(weights[i] for i in order), []
        for i in order:
            dry = Fraction(totals[i], weights[i])
            if dry > time or not self._phases:
                self._phases.append((time, sent, active))
                sent += active * (dry - time)
                time = dry
            active -= weights[i]
        self.row = lru_cache(maxsize=4096)(self._row)

    def _row(self, w: int) -> list[int]:
        """Tokens each queue has sent after ``w`` windows."""
        x = self.inside[0].row(w)[self.inside[1]] if self.inside else min(w * self.window, self.total)
        if x >= self.total:
            return list(self.totals)
        time, sent, active = next(p for p in reversed(self._phases) if p[1] <= x)
        time += (x - sent) / active
        n, d = time.numerator, time.denominator
        return [min(t, q * n // d) for t, q in zip(self.totals, self.weights, strict=True)]

    def windows(self) -> int:
        return self.inside[0].windows() if self.inside else -(-self.total // self.window)

    def find(self, queue: int, x: int) -> int:
        """The window that sends token ``x`` of ``queue``."""
        lo, hi = 0, self.windows()
        ahead = x * self.total // self.totals[queue]
        guess = self.inside[0].find(self.inside[1], ahead) if self.inside else min(hi, ahead // self.window)
        for a in (guess - 1, guess):
            if a >= 0 and a < hi and self.row(a)[queue] <= x < self.row(a + 1)[queue]:
                return a
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if self.row(mid)[queue] <= x:
                lo = mid
            else:
                hi = mid
        return lo

    def place(self, queue: int, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(from, to, position in the packed stream) of tokens begin..end of a queue."""
        if begin >= end:
            return
        w = self.find(queue, begin)
        while begin < end:
            a, b = self.row(w), self.row(w + 1)
            stop = min(end, b[queue])
            if stop > begin:
                before = sum(a) + sum(b[:queue]) - sum(a[:queue])
                yield begin, stop, before + begin - a[queue]
                begin = stop
            w += 1


_TOK = pa.schema([("part", pa.int64()), ("ahead", pa.int64()), ("id", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])
_TOK_SQL = "part long, ahead long, id long, source string, n long, ids binary"


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tok, part, sent = byte_tokenizer(path), TaskContext.get().partitionId(), {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            b = batch.slice(lo, 256)
            cols = {k: [] for k in ("ahead", "n", "ids")}
            sources = b.column(1).to_pylist()
            for source, raw in zip(sources, tok.encode(b.column(2).to_pylist()), strict=True):
                ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype(width)
                cols["ahead"].append(sent.get(source, 0))
                cols["n"].append(len(ids))
                cols["ids"].append(ids.tobytes())
                sent[source] = sent.get(source, 0) + len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * b.num_rows, pa.int64()), pa.array(cols["ahead"], pa.int64()), b.column(0), b.column(1), pa.array(cols["n"], pa.int64()), pa.array(cols["ids"], pa.binary())], schema=_TOK
            )
    tok.forget()


_PIECE = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECE_SQL = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(batches: Iterator[pa.RecordBatch], totals: list[int], weights: list[int], window: int, size: int, width: str, tokens: bool) -> Iterator[pa.RecordBatch]:
    plan = Schedule(totals, weights, window * size)

    @lru_cache(maxsize=256)
    def bundle(number: int, totals: tuple[int, ...], weights: tuple[int, ...]) -> Schedule:
        return Schedule(list(totals), list(weights), window * size, (plan, number))

    def placed(number: int, nth: int, own: list[int], shares: list[int], begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Like ``Schedule.place``, through the bundle of the source."""
        for a, b, at in bundle(number, tuple(own), tuple(shares)).place(nth, begin, end) if len(own) > 1 else [(begin, end, begin)]:
            for c, d, to in plan.place(number, at, at + b - a):
                yield a + c - at, a + d - at, to

    names = [*_PIECE.names, *(["tokens"] if tokens else [])]
    for batch in batches:
        out = {k: [] for k in names}
        for number, nth, own, shares, begin, i, n, raw in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            ids = np.frombuffer(raw, width).astype("<u4")
            for a, b, at in placed(number, nth, own, shares, begin, begin + n):
                while a < b:
                    length = min(b - a, size - at % size)
                    part = ids[a - begin : a - begin + length]
                    for k, v in zip(names, (i, a - begin, length, zlib.crc32(part.tobytes()), n, at // size, at % size, part.tolist() if tokens else None), strict=False):
                        out[k].append(v)
                    a, at = a + length, at + length
        yield pa.RecordBatch.from_pydict(out, schema=_PIECE.append(pa.field("tokens", pa.list_(pa.int64()))) if tokens else _PIECE)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: int = 2048,
    end_id: int = 1,
    window: int = 64,
    mixture: dict[str, int] | None = None,
    max_queues: int = 4096,
    tokens: bool = False,
) -> DataFrame:
    """-> one row per piece: (id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset), with ``tokens`` also the ids.

    Every token of every document, then ``end_id``, is in one piece; sequences
    hold ``size`` tokens, the last one what is left. ``mixture`` gives whole
    weights by source; sources it does not name share the weight 1 each. By
    default the weights are the sources' own token counts, so all queues last
    to the end. A queue that runs dry leaves its share to the others. Within a
    window a queue's tokens are one run, so few documents are cut.

    Null texts are empty (one piece: ``end_id``); a null source is a queue of
    its own; ids may be null or repeat. Where there are more than
    ``max_queues`` sources, they share that many bundles by hash, so what the
    driver holds stays bounded; of a source that runs dry the share then goes
    to its bundle first. Texts are packed whole, however long. Only the three
    named columns are read, so others may have any name. An empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    prepare(spark)
    from tokenizers import Tokenizer

    width = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), text_or_empty(text_col).alias("text"))
    tok = cut(src.mapInArrow(partial(_tokenise, path=tokenizer, end_id=end_id, width=width), _TOK_SQL), "tokens")
    part_totals = cut(tok.groupBy("part", "source").agg(F.sum("n").alias("n")), "queue-parts")
    totals = part_totals.groupBy("source").agg(F.sum("n").alias("n"))
    many = totals.limit(max_queues + 1).count() > max_queues
    share = F.col("n")
    if mixture:
        given = spark.createDataFrame(list(mixture.items()), "named string, weight long")
        totals, share = totals.join(F.broadcast(given), F.col("source") == F.col("named"), "left").drop("named"), F.coalesce("weight", F.lit(1).cast("long"))
    bundle = F.pmod(F.xxhash64("source"), F.lit(max_queues)).cast("string") if many else F.col("source")
    sources = cut(totals.select("source", bundle.alias("bundle"), "n", share.alias("share")), "sources")
    members = F.array_sort(F.collect_list(F.struct("source", "n", "share")))
    bundles = cut(sources.groupBy("bundle").agg(members.alias("members")), "bundles")
    sums = sources.groupBy("bundle").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    got = sorted(sums.collect(), key=lambda r: (r.bundle is not None, r.bundle or ""))
    numbers = spark.createDataFrame([(r.bundle, k) for k, r in enumerate(got)], "of string, number int")
    told = bundles.join(F.broadcast(numbers), F.col("bundle").eqNullSafe(F.col("of"))).select("number", "members", F.posexplode("members").alias("nth", "m"))
    told = told.select("number", "nth", F.transform("members", lambda m: m["n"]).alias("own"), F.transform("members", lambda m: m["share"]).alias("shares"), F.col("m.source").alias("t"))
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = part_totals.select(F.col("part").alias("p"), F.col("source").alias("s"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("begin"))
    starts = cut(starts.join(told, F.col("s").eqNullSafe(F.col("t"))).drop("t"), "queue-starts")
    placed = tok.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("number", "nth", "own", "shares", (F.col("begin") + F.col("ahead")).alias("begin"), "id", "n", "ids")
    totals, weights = [r.n for r in got], [r.share for r in got]
    sql = _PIECE_SQL + (", tokens array<long>" if tokens else "")
    return placed.mapInArrow(partial(_pieces, totals=totals, weights=weights, window=window, size=size, width=width, tokens=tokens), sql)
