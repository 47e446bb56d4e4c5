import numpy as np

from lociweave.llm import quality as q


def test_em_recovers_accuracies():
    r = np.random.default_rng(1)
    n, acc, speak = 20000, [0.95, 0.8, 0.7, 0.9], [0.9, 0.8, 0.9, 0.5]
    y = r.random(n) < 0.8
    pattern = np.zeros(n, np.int64)
    for k in range(4):
        right = r.random(n) < acc[k]
        vote = np.where(right == y, 1, 2)
        pattern += np.where(r.random(n) < speak[k], vote, 0) * 3**k
    u, c = np.unique(pattern, return_counts=True)
    m = q.fit_labels(u, c.astype(float), labellers=4)
    assert abs(m.clean - 0.8) < 0.03
    assert np.abs(m.accuracies() - acc).max() < 0.04


def test_held_out_accuracy(spark):
    import pytest

    try:
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    except Exception:
        pytest.skip("no test tables")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = q.classify(docs, sample_rows=500).join(labels, labels.doc_id == q.F.col("id")).collect()
    # No label was used in training.
    clean = [r.keep for r in got if r.quality == 1]
    junk = [not r.keep for r in got if r.quality == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) > 0.9


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x | " * 4000), (4, "the man is in the house and it is a good day for all of us " * 3), (4, "the same id")], "doc_id long, text string")
    got = q.classify(df, sample_rows=10).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert q.classify(df.limit(0)).count() == 0
    more = spark.createDataFrame([(1, "a b c", 0.5, True)], "doc_id long, text string, score double, keep boolean")
    assert q.keep_clean(more).columns == more.columns
    assert q.classify(more).count() == 1
