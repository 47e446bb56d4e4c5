import random

import numpy as np

from lociweave.llm import token_counts as c
from lociweave.llm.vocab_cache import ByteTokenizer


def test_equals_the_library(tokenizers_dir):
    from tokenizers import Tokenizer

    path = tokenizers_dir("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), ByteTokenizer(path)
    r = random.Random(5)
    letters = "abcdeétß'’  0123.,!?Σ中한🙂‍ \t\n\n\x1c\x85½²Ⅷ\u2003"
    texts = ["", " ", "  a  ", "a\n \nb", "a\n\n  b ", "x \t y", "it's we'LL", "<|endoftext|>a <|endoftext|>", " a", "a ", "\n", "a \n", "x" * 2000]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for t, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_counts_and_cache(spark, tokenizers_dir):
    from tokenizers import Tokenizer

    path = tokenizers_dir("byte_bpe_50k.json")
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "Hello world"), (None, "no id"), (5, "é" * 3000), (1, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lib = Tokenizer.from_file(path)
    want = sorted((repr(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    cache = c.CountCache.fresh(spark)
    got = c.count_tokens(df, path, cache, limit=5).collect()
    assert sorted((repr(r.id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    assert cache.read().select("digest").distinct().count() == 4
    again = spark.createDataFrame([(9, "Hello world"), (10, "new")], "doc_id long, text string")
    assert {r.id: r.n_tokens for r in c.count_tokens(again, path, cache).collect()} == {9: 2, 10: 1}
    assert cache.read().select("digest").distinct().count() == 5


def test_other_versions_do_not_count(spark, tokenizers_dir):
    path = tokenizers_dir("byte_bpe_50k.json")
    cache = c.CountCache.fresh(spark)
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    cache.append(spark.sql("select 'other' as tokenizer, unhex(sha2('abc', 256)) as digest, 3L as n_bytes, 77L as n_tokens"))
    assert c.count_tokens(df, path, cache).first().n_tokens == 1


def test_empty_and_clashing(spark, tokenizers_dir):
    path = tokenizers_dir("byte_bpe_50k.json")
    assert c.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    df = spark.createDataFrame([(1, "x", "d", 4)], "doc_id long, text string, digest string, n_tokens int")
    assert c.count_tokens(df, path).first().n_tokens == 1


def test_a_second_run_encodes_nothing(spark, tokenizers_dir, monkeypatch):
    path = tokenizers_dir("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "said once"), (2, None), (3, "said once")], "doc_id long, text string")
    first = sorted(c.count_tokens(df, path).collect())  # the cache that all runs share
    held = c.CountCache(spark).read().count()
    def none(batches, **kw):
        assert all(b.num_rows == 0 for b in batches)
        return iter(())

    monkeypatch.setattr(c, "_counts", none)
    assert sorted(c.count_tokens(df, path).collect()) == first
    assert c.CountCache(spark).read().count() == held
