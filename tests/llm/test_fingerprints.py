import hashlib
import random

from lociweave.llm import fingerprints as f


def expected(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        sets = f.chunk_sets([t.encode(), e.encode(), nxt.encode()])
        out.append((repr(i), len(t), hashlib.sha256(e.encode()).hexdigest(), f.written(sets[0]), f.written(sets[1]), f.containment(sets[0], sets[1]), f.containment(sets[0], sets[2])))
    return sorted(out)


def plain_chunks(t):
    """Chunks of a text, byte by byte; the gear table and lengths are the operator's."""
    data, out, begin = t.encode(), [], 0
    while begin < len(data):
        end, h = len(data), 0
        if len(data) - begin > f._LEAST:
            end = min(begin + f._MOST, len(data))
            for k in range(max(0, begin + f._LEAST - 32), end):
                h = (h * 2 + int(f._GEAR[data[k]])) & 0xFFFFFFFF
                size = k + 1 - begin
                if k + 1 < end and size >= f._LEAST and h & int(f._LOOSE if size >= f._NORMAL else f._STRICT) == 0:
                    end = k + 1
                    break
        out.append(data[begin:end])
        begin = end
    return frozenset(out)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return sum(map(len, a & b)) / min(sum(map(len, a)), sum(map(len, b)))


def test_fingerprints_are_those_of_plain_chunks(spark):
    r = random.Random(8)
    rows = [(k, text(r, r.randint(0, 120))) for k in range(40)] + [(50, None), (60, "x" * 5000), (61, "x" * 5000 + "y")]
    got = {int(i): x for i, *x in run(spark, rows)}
    order = sorted(rows, reverse=True)
    seen = {}
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        t, nxt = t or "", nxt or ""
        n = len(t) // 3
        own, edited, other = plain_chunks(t), plain_chunks(t[: len(t) - n] + nxt[:n]), plain_chunks(nxt)
        n_chars, _, told, edited_told, near_edited, near_next = got[i]
        assert n_chars == len(t) and len(told) == 35 * len(own) and len(edited_told) == 35 * len(edited)
        assert near_edited == plain_likeness(own, edited) and near_next == plain_likeness(own, other)
        assert sorted(int(told[k + 32 : k + 35], 16) for k in range(0, len(told), 35)) == sorted(map(len, own))
        assert seen.setdefault(told, own) == own


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((repr(r[0]), *r[1:]) for r in f.fingerprint_pairs(df).collect())


def text(r, n):
    return " ".join("".join(r.choice("abcdeéß中") for _ in range(r.randint(1, 9))) for _ in range(n))


def test_against_a_plain_order(spark):
    r = random.Random(1)
    rows = [(k * 3 - 50, text(r, r.randint(0, 300))) for k in range(120)]
    rows += [(7, None), (7, "twin"), (1000, ""), (None, "no id"), (2000, text(r, 9000))]
    assert run(spark, rows) == expected(rows)


def test_single_and_empty(spark):
    assert run(spark, [(5, "abc def ghi")], 1) == expected([(5, "abc def ghi")])
    assert run(spark, [(None, None)], 1) == expected([(None, None)])
    assert run(spark, [], 1) == []
    df = spark.createDataFrame([(1, "x", 3, True), (2, "y", 4, False)], "doc_id long, text string, block int, copy boolean")
    assert f.fingerprint_pairs(df).count() == 2


def test_chunks_cover_and_resist_shifts():
    r = random.Random(2)
    t = text(r, 2000).encode()
    own, moved = f.chunk_sets([t, b"some words before " + t])
    assert f.containment(own, moved) > 0.97
    h = f._gear(__import__("numpy").frombuffer(t, "uint8"))
    hits = [k + 1 for k in range(len(t)) if h[k] & f._LOOSE == 0]
    cuts = f._cuts(len(t), hits, [h[k - 1] & f._STRICT == 0 for k in hits])
    sizes = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
    assert sum(sizes) == len(t) and all(f._LEAST <= s <= f._MOST for s in sizes[:-1])


def test_pieces_do_not_matter(monkeypatch):
    r = random.Random(3)
    texts = [text(r, r.randint(0, 200)).encode() for _ in range(40)]
    whole = f.chunk_sets(texts)
    assert whole == [f.chunk_sets([t])[0] for t in texts]


def test_stored(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None)], "doc_id long, text string")
    got = {r.id: r.fingerprint for r in f.stored_fingerprints(df).collect()}
    assert got[1] == got[2] != got[3] == ""
