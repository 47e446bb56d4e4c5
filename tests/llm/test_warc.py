import base64
import gzip
import hashlib

import pytest

from lociweave.llm import warc


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {(r.page_id, r.payload_digest): r for r in warc.round_trip(df, **kw).collect()}


ROWS = [(1, "http://a/", "x"), (2, "http://b/\r\n é", "x"), (3, None, None), (4, "u", ""), (5, "v", "é\r\n0\r\n\r\nWARC/1.1\r\n" * 9000), (6, "w", "\n\n"), (7, "w", "中" * 20000), (8, "w", "中" * 20000)]


@pytest.mark.parametrize("segment", [100, 32 << 10])
def test_round_trip(spark, segment):
    got = run(spark, ROWS, segment=segment)
    assert len(got) == len(ROWS)
    for i, _, h in ROWS:
        r = got[i, warc.digest((h or "").encode())]
        assert r.problem is None and r.payload_bytes == len((h or "").encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    kinds = {k[0]: (r.record_type, r.refers_to) for k, r in got.items()}
    assert kinds == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("revisit", 7)}


def test_least_bytes_and_repeats(spark):
    got = run(spark, ROWS[:4], least_bytes=1)
    assert got[4, warc.digest(b"")].record_type == "response"
    rows = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, "u", "x")], "page_id long, url string, html string")
    got = sorted((repr(r.page_id), r.record_type, r.refers_to) for r in warc.round_trip(rows).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("2", "revisit", 1), ("None", "response", None)]


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), segment=500)
    got = warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()
    assert len(got) == len(ROWS)
    for r in got:  # revisits too
        want = next(h or "" for i, _, h in ROWS if i == r.page_id)
        assert bytes(r.payload) == want.encode()


def test_records_are_gzip_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "_RECORDS", 3)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), segment=4000)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 2
    for f in files:
        data, starts = f.read_bytes(), 0
        assert gzip.decompress(data).startswith(b"WARC/1.1")
        for piece in data.split(warc.member(b""))[:-1]:
            assert len(list(warc.parse([gzip.decompress(piece)]))) == 1
            starts += 1
        assert 1 <= starts <= 3


def test_archives_are_parsed_in_pieces(monkeypatch):
    import random

    r = random.Random(1)
    whole = [x for k in range(30) for x in warc.records(f"0-{k}", k, "u", bytes(r.randrange(256) for _ in range(r.choice([0, 5, 700]))), None, 300)]
    plain = b"".join(whole)
    want = list(warc.parse([plain]))
    assert len(want) == len(whole)
    for size in (1, 7, 64, 10_000):
        monkeypatch.setattr(warc, "_INFLATE", size)
        assert list(warc.parse(plain[k : k + size] for k in range(0, len(plain), size))) == want
        for stored in (b"".join(map(gzip.compress, whole)), gzip.compress(plain), b"".join(map(warc.member, whole)), plain):
            assert list(warc.parse(warc.inflated(stored))) == want
    for bad in (plain[:-3], plain[:-700], b"x" + plain):
        with pytest.raises(ValueError):
            list(warc.parse([bad]))
    with pytest.raises(ValueError):
        list(warc.parse(warc.inflated(gzip.compress(plain)[:-20])))


def test_damage_is_told(spark, tmp_path):
    parts = list(warc.records("0-1", 1, "u", b"y" * 900, None, 200))
    assert len(parts) > 3
    for name, keep in (("lost", parts[:2] + parts[3:]), ("short", parts[:-1]), ("whole", parts[::-1])):
        d = tmp_path / name
        d.mkdir()
        (d / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in keep))
        (r,) = warc.read_archives(spark, str(d)).collect()
        assert (r.problem is None) == (name == "whole"), name


def test_chunked():
    for n in (0, 1, 8192, 8193, 30000):
        data = bytes(range(256)) * (n // 256 + 1)
        assert warc.unchunked(warc.chunked(data[:n])) == data[:n]
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_empty_and_clashing(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "u", "x", "p", 2)], "page_id long, url string, html string, payload string, page int")
    assert warc.round_trip(df).count() == 1
