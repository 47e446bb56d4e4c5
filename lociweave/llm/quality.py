"""Quality classifier from weak labels.

Overlapping heuristics vote clean, junk or nothing on every document. The votes
of a document form a pattern; the counts of the patterns over all documents
(at most 3 ** labellers rows, whatever the corpus) are all that
expectation-maximisation needs to estimate each labeller's accuracy and the
share of junk. The posterior of a pattern is the label of its documents, and a
linear scorer over hashed features is fitted to posteriors of a sample whose
size is a parameter, then run over every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, prepare, string_parts, text_or_empty
from .shingles import pieces, word_hashes

# Byte classes: letters small, capital and beyond ASCII, digits, white space, marks.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[128:] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, *range(0x09, 0x0E)]] = 4
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"()-?"]] = True
_ODD = (_CLASS == 5) & ~_PLAIN
#: Names of the labellers; thresholds are below, in ``_votes``.
LABELLERS = ("odd_marks", "capitals", "bars", "repeats", "short_words", "variety", "marked_words")
_DIMS = 4096


def _stats(data: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The figures that labellers look at, of one text."""
    n = len(words)
    if not n:
        return np.zeros(8)
    c = _CLASS[data]
    letters = max(1, int((c <= 2).sum()))
    solid = max(1, int((c != 4).sum()))
    kinds = np.unique(words)
    ends = np.append(at[1:], len(data))
    length = ends - at - 1
    length[-1] += 1
    first_odd = _ODD[data[at]]
    last_odd = _ODD[data[np.maximum(at + length - 1, at)]]
    runs = words[1:] == words[:-1]
    return np.array([n, _ODD[data].sum() / solid, (c == 1).sum() / letters, first_odd.mean(), runs.mean() if n > 1 else 0.0, (length <= 3).mean(), len(kinds) / n, last_odd.mean()])


def _votes(s: np.ndarray) -> int:
    """The pattern: a base-3 digit per labeller, 0 nothing, 1 clean, 2 junk."""
    n, odd, capital, bars, runs, short, variety, marked = s
    if n < 8:
        return 0
    # A sign of one kind of junk says nothing about the others, so most abstain where they see none.
    plain = odd < 0.01 and capital < 0.15 and runs < 0.06
    said = (
        2 if odd > 0.06 else 0,
        2 if capital > 0.5 else 0,
        2 if bars > 0.2 else 0,
        2 if runs > 0.2 else 0,
        0 if n < 20 else 2 if short < 0.12 else 1 if plain and short > 0.15 else 0,
        0 if n < 40 else 2 if variety < 0.25 else 1 if plain and variety > 0.5 else 0,
        2 if marked > 0.4 else 1 if plain and marked < 0.05 else 0,
    )
    return int(sum(v * 3**k for k, v in enumerate(said)))


def _features(data: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashed features, one entry per occurrence: shapes of three bytes, and per
    word its length, how often the text has it, and the marks at its ends."""
    if not len(words):
        return np.zeros(0, np.int64)
    shape = _CLASS[data].astype(np.uint64)
    mark = shape == 5
    shape[mark] = data[mark].astype(np.uint64)
    tri = shape[:-2] << np.uint64(16) | shape[1:-1] << np.uint64(8) | shape[2:] if len(shape) > 2 else np.zeros(0, np.uint64)
    _, which, counts = np.unique(words, return_inverse=True, return_counts=True)
    share = np.minimum(np.ceil(np.log2(counts[which] / len(words) * 1024 + 1)), 15).astype(np.uint64)
    ends = np.append(at[1:], len(data))
    length = np.minimum(ends - at, 15).astype(np.uint64)
    last = shape[np.maximum(ends - 2, 0)]
    same = np.append(False, words[1:] == words[:-1]).astype(np.uint64)
    word = np.uint64(1) << np.uint64(40) | length << np.uint64(24) | share << np.uint64(16) | last << np.uint64(8) | same
    return (mix64(np.concatenate((tri, word))) % np.uint64(_DIMS)).astype(np.int64)


def _texts(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    offsets, data = string_parts(column)
    for i, j in pieces(offsets):
        lo = offsets[i]
        piece = data[lo : offsets[j]]
        starts = offsets[i : j + 1] - lo
        words, at = word_hashes(piece, starts[:-1])
        cuts = np.searchsorted(at, starts)
        for k in range(j - i):
            a, b = cuts[k], cuts[k + 1]
            yield piece[starts[k] : starts[k + 1]], words[a:b], at[a:b] - starts[k]


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_votes(_stats(*t)) for t in _texts(batch.column(0))]
        values, counts = np.unique(np.array(out, np.int64), return_counts=True)
        yield pa.RecordBatch.from_pydict({"pattern": values, "n": counts})


@dataclass
class LabelModel:
    """P(vote | class) per labeller as (labeller, class, vote) with class 1 clean;
    ``clean`` the share of clean documents."""

    votes: np.ndarray
    clean: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(clean) of each pattern; without any vote, the prior."""
        said = np.stack([patterns // 3**k % 3 for k in range(len(self.votes))], 1)
        log = np.tile(np.log([1 - self.clean, self.clean]), (len(patterns), 1))
        for k in range(len(self.votes)):
            told = said[:, k] > 0
            log[told] += np.log(self.votes[k][:, said[told, k]]).T
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(1)

    def accuracies(self) -> np.ndarray:
        """P(right vote | a vote), per labeller."""
        right = self.clean * self.votes[:, 1, 1] + (1 - self.clean) * self.votes[:, 0, 2]
        return right / np.maximum(self.clean * self.votes[:, 1, 1:].sum(1) + (1 - self.clean) * self.votes[:, 0, 1:].sum(1), 1e-12)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over pattern counts."""
    start = np.array([[0.2, 0.2, 0.6], [0.2, 0.6, 0.2]])
    model = LabelModel(np.tile(start, (labellers, 1, 1)), 0.8)
    said = np.stack([patterns // 3**k % 3 for k in range(labellers)], 1)
    total = counts.sum()
    for _ in range(rounds):
        p = model.posterior(patterns)
        weight = np.stack([(1 - p) * counts, p * counts])
        votes = np.empty_like(model.votes)
        for k in range(labellers):
            for v in range(3):
                votes[k, :, v] = weight[:, said[:, k] == v].sum(1)
        votes += 0.5
        votes /= votes.sum(2, keepdims=True)
        clean = float(np.clip(weight[1].sum() / max(total, 1), 0.02, 0.98))
        moved = np.abs(votes - model.votes).max()
        model = LabelModel(votes, clean)
        if moved < 1e-6:
            break
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        """P(clean); a text without words gets its prior, the bias."""
        z = self.bias + (self.weights[features].mean() if len(features) else 0.0)
        return float(1 / (1 + np.exp(-z)))


def shares(features: np.ndarray) -> tuple[bytes, bytes]:
    """What a text's features come to, whatever its length: the features that it
    has (two bytes each) and their shares (four bytes)."""
    n = np.bincount(features, minlength=_DIMS)
    at = np.flatnonzero(n)
    return at.astype("<u2").tobytes(), (n[at] / max(1, len(features))).astype("<f4").tobytes()


def fit_scorer(rows: list[tuple[bytes, bytes]], target: np.ndarray, rounds: int = 400, rate: float = 0.3, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on feature shares by full-batch Adam."""
    x = np.zeros((len(rows), _DIMS), np.float32)
    for i, (at, share) in enumerate(rows):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(share, "<f4")
    scale = x.std(0) + 1e-4
    x /= scale
    w, b = np.zeros(_DIMS, np.float32), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m, v = np.zeros(_DIMS + 1), np.zeros(_DIMS + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = ((p - target) / len(target)).astype(np.float32)
        g = np.append(x.T @ d + ridge * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = (w - step[:-1]).astype(np.float32)
        b -= float(step[-1])
    return Scorer((w / scale).astype(np.float64), b)


_SCORE = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("weak", pa.float64())])


def _scores(batches: Iterator[pa.RecordBatch], scorer: Scorer, labels: dict[int, float], prior: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score, weak = [], []
        for text in _texts(batch.column(1)):
            score.append(scorer.score(_features(*text)))
            weak.append(labels.get(_votes(_stats(*text)), prior))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(weak, pa.float64())], schema=_SCORE)


_SAMPLE = pa.schema([("h", pa.int64()), ("target", pa.float64()), ("at", pa.binary()), ("share", pa.binary())])


def _sampled(batches: Iterator[pa.RecordBatch], labels: dict[int, float], prior: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        target, rows = [], []
        for text in _texts(batch.column(1)):
            target.append(labels.get(_votes(_stats(*text)), prior))
            rows.append(shares(_features(*text)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(target, pa.float64()), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], schema=_SAMPLE)


_FITTED = pa.schema([("weights", pa.binary()), ("bias", pa.float64())])


def _train(t: pa.Table) -> pa.Table:
    t = t.sort_by("h")  # sums in one order, so that a repeated run is the same run
    s = fit_scorer(list(zip(t.column("at").to_pylist(), t.column("share").to_pylist(), strict=True)), t.column("target").to_numpy())
    return pa.Table.from_pydict({"weights": [s.weights.tobytes()], "bias": [s.bias]}, schema=_FITTED)


def fit(docs: DataFrame, text_col: str = "text", sample_rows: int = 4000) -> tuple[LabelModel, dict[int, float], Scorer]:
    """The label model from all documents; the scorer from ``sample_rows`` of
    them, those with the least hash of their text. A text of the sample comes to
    its feature shares where it lies, 25 KB at most; these meet in the one task
    that fits (100 MB of them by default, and the matrix of as many)."""
    src = docs.select(text_or_empty(text_col).alias("text"))
    got = src.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    got.sort(key=lambda r: r.pattern)  # sums in one order, so that a repeated run is the same run
    patterns = np.array([r.pattern for r in got], np.int64)
    model = fit_labels(patterns, np.array([r.n for r in got], np.float64)) if got else LabelModel(np.full((len(LABELLERS), 2, 3), 1 / 3), 0.98)
    labels = dict(zip(patterns.tolist(), model.posterior(patterns).tolist(), strict=True)) if got else {}
    # Picked by a hash of the text, so that copies of one text count once.
    keys = src.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(sample_rows)
    last = keys.agg(F.max("h")).first()[0]
    if last is None:
        return model, labels, Scorer(np.zeros(_DIMS), 0.0)
    picked = src.withColumn("h", F.xxhash64("text")).where(F.col("h") <= last).select("h", "text")
    picked = picked.mapInArrow(partial(_sampled, labels=labels, prior=model.clean), "h long, target double, at binary, share binary").dropDuplicates(["h"])
    row = picked.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_train, "weights binary, bias double").first()
    return model, labels, Scorer(np.frombuffer(row.weights), row.bias)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample_rows: int = 4000) -> DataFrame:
    """-> (id, score, weak, keep), one row per row of ``docs``.

    ``score`` is the scorer's P(clean), ``weak`` the label model's; a document
    is kept from ``threshold`` on. Null and empty texts, and texts of fewer
    than eight words, get no vote: their weak label is the prior. A score equal
    to the threshold is kept. Texts are read whole, however long; copies of one
    text have one score. Ids may be null or repeat. Only the two named columns
    are read, so others may have any name. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    model, labels, scorer = fit(docs, text_col, sample_rows)
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    out = src.mapInArrow(partial(_scores, scorer=scorer, labels=labels, prior=model.clean), "id long, score double, weak double")
    return out.withColumn("keep", F.col("score") >= threshold)


def keep_clean(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, sample_rows: int = 4000) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns
    as they were (names that clash with ours do no harm). Scored in one pass
    over the rows; see ``classify`` for how odd texts are treated."""
    prepare(docs.sparkSession)
    _, _, scorer = fit(docs, text_col, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            keep = [scorer.score(_features(*t)) >= threshold for t in _texts(column)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
