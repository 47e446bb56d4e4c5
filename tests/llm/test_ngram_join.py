import random
import re

import pytest

from lociweave.llm import graph, ngram_join

_LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, n, percent):
    """Components by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = re.findall("[^ \t-\r]+", (t or "").translate(_LOW))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()))
    boss = {i: i for i, _ in sets if i is not None}

    def root(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(i), root(j)
                boss[max(p, q)] = min(p, q)
    return sorted((repr(i), len(s), None if i is None else root(i)) for i, s in sets)


def run(spark, rows, n=4, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((repr(r.id), r.n_shingles, r.component_id) for r in ngram_join.link(df, n=n, percent=percent).collect())


def corpus(seed, size):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows, base = [], []
    for i in range(size):
        if base and r.random() < 0.7:
            w = list(r.choice(base))
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.3:
                w = w[: max(1, len(w) - r.randint(0, 6))]
        else:
            w = [r.choice(words) for _ in range(r.randint(1, 70))]
        base.append(w)
        rows.append((i * 7 % (size * 7), " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_equals_all_pairs(spark, seed, n, percent):
    rows = corpus(seed, 130)
    assert run(spark, rows, n, percent) == brute(rows, n, percent)


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "One Two\tThree"), (None, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (9, "A B C D E"), (10, "x " * 5000), (11, "X " * 7000), (12, "é b c d é"), (13, "É b c d É")]
    got = run(spark, rows)
    assert got == brute(rows, 4, 85)
    assert ("4", 1, 4) in got and ("5", 1, 4) in got and ("2", 0, 2) in got and ("13", 2, 13) in got


def test_ties_at_the_bound(spark):
    # 17 of 20 shingles shared is exactly 85 percent.
    a = [f"t{k}" for k in range(20)]
    one, two = " ".join(a[:17] + ["p", "q", "r"][:1]), " ".join(a[:17] + ["p"] + a[17:19])
    rows = [(1, one), (2, two), (3, " ".join(a))]
    assert run(spark, rows, 1, 90) == brute(rows, 1, 90)
    assert run(spark, rows, 1, 85) == brute(rows, 1, 85)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link(df).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "x", 5, b"y")], "doc_id long, text string, id string, n int, entries binary")
    assert [tuple(r) for r in ngram_join.link(df).collect()] == [(1, 2, 1)]


def test_large_groups_become_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_BLOCK_ROWS", 8)
    rows = corpus(5, 90)
    assert run(spark, rows) == brute(rows, 4, 85)


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)] + [(5, 5), (None, 3), (7, 6)]
    boss = {}

    def root(x):
        boss.setdefault(x, x)
        while boss[x] != x:
            x = boss[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = root(a), root(b)
            boss[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in list(boss)}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
