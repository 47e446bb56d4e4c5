"""Every registered query of the subpackage on the smallest tables: against its
SQL twin, or against libraries and plain Python."""

import base64
import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from lociweave.llm import queries as q

from .test_fingerprints import plain_chunks, plain_likeness
from .test_ngram_join import brute

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pages(spark, sf):
    return {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = q.QUERIES[name](spark, sf)
    want = con.sql(q.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(map(repr, (tuple(r) for r in df.select(order).collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_op1(spark, sf, documents):
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in q.op1_ngram_jaccard_join(spark, sf).collect())
    assert got == brute([(r.doc_id, r.text) for r in documents.values()], 4, 85)


def test_op2(spark, sf, pages):
    import html

    got = {r.page_id: r for r in q.op2_html_extraction(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, p in pages.items():
        (article,) = re.findall("(?s)<article>(.*?)</article>", p.html)
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[i].text == "\n\n".join(b for b in blocks if b) and got[i].n_chars == len(got[i].text) and got[i].url == p.url


def test_op4_and_op10(spark, sf, documents, tokenizers_dir):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizers_dir("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    got = {r.doc_id: r for r in q.op4_bpe_coding(spark, sf).collect()}
    counts = {r.doc_id: r for r in q.op10_token_counts(spark, sf).collect()}
    bytes_lib = Tokenizer.from_file(tokenizers_dir("byte_bpe_50k.json"))
    assert got.keys() == counts.keys() == documents.keys()
    for i, d in documents.items():
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), *sha)
        n = len(bytes_lib.encode(d.text or "", add_special_tokens=False).ids)
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((d.text or "").encode()), n, n > 1024)


def test_op5(spark, sf, documents):
    got = {r.doc_id: r for r in q.op5_fingerprints(spark, sf).collect()}
    order = sorted(documents, reverse=True)
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        t, nxt = documents[i].text or "", documents[j].text or ""
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        own = plain_chunks(t)
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (got[i].near_edited, got[i].near_next) == (plain_likeness(own, plain_chunks(e)), plain_likeness(own, plain_chunks(nxt)))


def test_op6(spark, sf, documents, tokenizers_dir):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizers_dir("byte_bpe_50k.json"))
    got = q.op6_packing(spark, sf).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == documents.keys()
    for i, d in documents.items():
        ids, at = [*lib.encode(d.text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, rows in by_sequence.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or k == max(by_sequence) and at < 2048


def test_op8(spark, sf, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in q.op8_quality_classifier(spark, sf).collect()}
    assert got.keys() == documents.keys()
    assert np.mean([got[i].keep == bool(y) for i, y in labels.items()]) > 0.95  # no label was seen in fitting


def test_op9(spark, sf, pages):
    got = {r.page_id: r for r in q.op9_warc(spark, sf).collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i].html or "", i)
    for i, p in pages.items():
        data = (p.html or "").encode()
        of = first[p.html or ""]
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if of == i else "revisit", None if of == i else of)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want and got[i].problem is None


def test_pipeline(spark, sf, documents, tokenizers_dir):
    """Stage by stage in plain Python, from what the first stage keeps."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    last = {}
    for i in kept:
        t = documents[i].text or ""
        last[t] = max(i, last.get(t, i))
    rows = brute([(i, t) for t, i in last.items()], 5, 80)
    want = {int(i) for i, _, c in rows if int(i) == c}
    lib = Tokenizer.from_file(tokenizers_dir("byte_bpe_50k.json"))
    tokens = {}
    for r in q.pipeline(spark, sf).collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {i: len(lib.encode(documents[i].text or "", add_special_tokens=False).ids) + 1 for i in want}


def test_all_are_named(spark):
    named = {n.split("_")[0] for n in q.QUERIES}
    assert {f"op{k}" for k in range(1, 11)} <= named and "pipeline" in named and os.path.exists(q.tokenizer_path("byte_bpe_50k.json"))
