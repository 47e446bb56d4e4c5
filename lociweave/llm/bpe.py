"""BPE as a deterministic automaton built from merges.

The automaton starts as one state with a loop for every base symbol. Each merge
(u, v) -> w, in rank order, puts in a gadget: u-arcs are led to a new state,
which is where they led before without its v-arc, and every state with a u-arc
gets a w-arc to where that v-arc led. All arcs of one label lead to one state,
so a state is kept as (state it was made from, label taken away, rank) and the
whole construction is one pass over the merges. A token sequence is accepted
exactly if it is what the merges make of its text.

Which arcs a state has follows from the same records: an arc for a merged label
was added when the state had an arc for its left half, so a label's arc lives
on unless a gadget took the label, or an early enough one took the left half,
and so on down the left halves. Spelt out, the arcs would be some 49,000 for
each of as many states; the table holds those that were asked for.

The labels' spellings are a second table, over bytes: a state for every
beginning of a label, with the longest label that ends there, and for each label
the next shorter one that ends with it. Encoding a pre-split word is one pass of
table look-ups over its bytes: the byte's transition gives the labels that end
here, and exactly one of them has an arc from the state that the word before it
leads to. Decoding writes out the labels of the arcs taken.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty
from .pretokens import byte_chars, normalise_words, specials_splitter, word_chunks, word_level

_MOST_WORDS, _MOST_ARCS = 300_000, 2_000_000
_END = 256  # the end of a word, as a symbol after bytes


class Spellings:
    """Which labels end at a place of a word: transitions over bytes and word
    ends. ``labels``: label -> its symbols."""

    def __init__(self, labels: dict[int, tuple[int, ...]]):
        self.next: dict[int, int] = {}  # state << 9 | symbol -> state
        self.label, depth, children = [-1], [0], [[]]
        for t, symbols in labels.items():
            q = 0
            for c in symbols:
                r = self.next.get(q << 9 | c)
                if r is None:
                    r = self.next[q << 9 | c] = len(self.label)
                    self.label.append(-1)
                    depth.append(depth[q] + 1)
                    children.append([])
                    children[q].append((c, r))
                q = r
            self.label[q] = t
        # Where a beginning ends in turn: at its longest proper end that is a beginning too.
        self.back = [0] * len(self.label)
        self.shorter = dict.fromkeys(labels, -1)
        line = [r for _, r in children[0]]
        for q in line:
            for c, r in children[q]:
                self.back[r] = self.step(self.back[q], c)
                line.append(r)
            longest = self.label[self.back[q]]
            if self.label[q] < 0:
                self.label[q] = longest
            else:
                self.shorter[self.label[q]] = longest
        self.built = len(self.next)

    def step(self, q: int, c: int) -> int:
        got = self.next.get(q << 9 | c)
        while got is None and q:
            q = self.back[q]
            got = self.next.get(q << 9 | c)
        return got or 0


class MergeAutomaton:
    """``symbols``: base labels; ``merges``: (u, v, w) as label ids in rank order."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], size: int):
        self.state = [0] * size  # where arcs of a label lead now
        self.made_from, self.taken, self.when = [-1], [-1], [-1]
        self.left, self.rank = [-1] * size, [-1] * size
        self.alive = [False] * size
        for b in base:
            self.alive[b] = True
        for rank, (u, v, w) in enumerate(merges):
            self.left[w], self.rank[w] = u, rank
            if not (self.alive[u] and self.alive[v] and self._has(self.state[u], v)):
                continue  # no accepted sequence has u before v, so w never comes up
            before = self.state[u]
            after_v = self.state[v]
            self.made_from.append(before)
            self.taken.append(v)
            self.when.append(rank)
            self.state[u] = len(self.taken) - 1
            self.state[w] = after_v
            self.alive[w] = True
        self._gone: dict[int, dict[int, int]] = {}
        self.arcs: dict[int, bool] = {}

    def _takings(self, q: int) -> dict[int, int]:
        """Label -> rank at which it was taken on the way to state ``q``."""
        got = {}
        while q > 0:
            got[self.taken[q]] = self.when[q]
            q = self.made_from[q]
        return got

    def _has(self, q: int, label: int, gone: dict[int, int] | None = None) -> bool:
        if gone is None:
            # While building: walk the records; the halves of a label are few.
            limits, y, limit = {}, label, 1 << 60
            while y >= 0:
                limits.setdefault(y, limit)
                limit, y = self.rank[y], self.left[y]
            while q > 0:
                t = self.taken[q]
                if t in limits and self.when[q] <= limits[t]:
                    return False
                q = self.made_from[q]
            return True
        y, limit = label, 1 << 60
        while y >= 0:
            r = gone.get(y)
            if r is not None and r <= limit:
                return False
            limit, y = self.rank[y], self.left[y]
        return True

    def step(self, label: int, nxt: int) -> bool:
        """Whether the state that ``label`` leads to has an arc ``nxt``."""
        key = label << 20 | nxt
        got = self.arcs.get(key)
        if got is None:
            q = self.state[label]
            gone = self._gone.get(q)
            if gone is None:
                if len(self._gone) > 4000:
                    self._gone.clear()
                gone = self._gone[q] = self._takings(q)
            if len(self.arcs) > _MOST_ARCS:
                self.arcs.clear()
            got = self.arcs[key] = self._has(q, nxt, gone)
        return got


class WordBPE:
    """Encoder and decoder for a vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec["post_processor"] or spec["decoder"] or model["continuing_subword_prefix"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a vocabulary with word ends as known here")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.labels = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: t for t, i in self.added.items()}
        self._split = specials_splitter(list(self.added))
        v = self.vocab
        merges = [(v[a], v[b], v[a + b]) for a, b in model["merges"]]
        made = {w for _, _, w in merges}
        self.automaton = MergeAutomaton([i for i in v.values() if i not in made], merges, max(v.values()) + 1)
        alive, byte = self.automaton.alive, {c: b for b, c in byte_chars().items()}
        symbols = {}
        for t, i in v.items():
            ends = t.endswith(self.end)
            plain = t[: -len(self.end)] if ends else t
            if alive[i] and all(c in byte for c in plain):
                symbols[i] = (*(byte[c] for c in plain), *((_END,) if ends else ()))
        self._spellings = Spellings(symbols)
        self._size = {i: len(x) - (x[-1:] == (_END,)) for i, x in symbols.items()}
        self._words: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}

    def _walk(self, word: str) -> list[int]:
        data = word.encode()
        n, size, arcs, has = len(data), self._size, self.automaton.arcs, self.automaton.step
        move, follow, label, shorter = self._spellings.next, self._spellings.step, self._spellings.label, self._spellings.shorter
        taken = [-1] * (n + 1)  # the label by which each prefix ends
        q = 0
        for j, c in enumerate(data, 1):
            r = move.get(q << 9 | c)
            q = follow(q, c) if r is None else r
            if j == n:
                q = follow(q, _END)
            t = label[q]
            while t >= 0:
                i = j - size[t]
                if not i:
                    break
                before = taken[i]
                got = arcs.get(before << 20 | t)
                if has(before, t) if got is None else got:
                    break
                t = shorter[t]
            taken[j] = t
        out, j = [], n
        while j:
            t = taken[j]
            out.append(t)
            j -= size[t]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        got = self._words.get(word)
        if got is None:
            if len(self._words) > _MOST_WORDS:
                self._words.clear()
            got = self._words[word] = np.array(self._walk(word), "<u4").tobytes()
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self._split.split(text) if self._split and any(s in text for s in self.added) else (text,)
        out: list[bytes] = []
        known = self._chunks
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            chunks, before = word_chunks(normalise_words(part)), len(out)
            try:
                out.extend(map(known.__getitem__, chunks))
            except KeyError:
                if len(known) > _MOST_WORDS:
                    known.clear()
                for c in set(chunks).difference(known):
                    known[c] = b"".join(map(self._word, word_level(c)))
                del out[before:]
                out.extend(map(known.__getitem__, chunks))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, as the file has no decoder: joined by spaces."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


_OUT = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DIGEST = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _coded(batches: Iterator[pa.RecordBatch], path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    bpe = word_bpe(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            ids = [bpe.encode(t) for t in batch.column(1).slice(lo, 256).to_pylist()]
            texts = [bpe.decode(x) for x in ids]
            own = batch.column(0).slice(lo, 256)
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])], schema=_DIGEST
                )
            else:
                yield pa.RecordBatch.from_arrays([own, pa.array(ids, pa.binary()), pa.array(texts)], schema=_OUT)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """-> (id, ids binary, decoded), or with ``digests`` (id, n_tokens,
    ids_sha256, decoded_sha256), one row per row of ``docs``; no shuffle.

    Texts are taken whole. Null and empty texts, and texts of white space only,
    have no ids and decode to "". Ids may be null or repeat. Special strings in
    a text become their ids, as in the library. An empty table gives an empty
    table; columns other than the two named are not read.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    sql = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "id long, ids binary, decoded string"
    return src.mapInArrow(partial(_coded, path=tokenizer, digests=digests), sql)
