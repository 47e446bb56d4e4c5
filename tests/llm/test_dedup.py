import hashlib

from lociweave.llm import dedup


def run(spark, df, **kw):
    return sorted(((repr(r.id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup.deduplicate(df, **kw).collect()), key=repr)


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a "), (8, "long " * 5000), (9, "long " * 5000), (None, "a"), (None, "z")]
WANT = sorted(
    [
        ("1", 3, 3, False, sha("a")), ("3", 3, 3, True, sha("a")), ("None", 3, 3, False, sha("a")), ("2", 2, 1, True, sha("b")), ("4", 5, 2, False, sha("")), ("5", 5, 2, True, sha("")), ("6", 6, 1, True, sha("A")),
        ("7", 7, 1, True, sha("a ")), ("8", 9, 2, False, sha("long " * 5000)), ("9", 9, 2, True, sha("long " * 5000)), ("None", None, 1, True, sha("z")),
    ], key=repr,
)


def test_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert run(spark, df) == WANT


def test_digests_that_meet(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    # One hex digit of digest: nearly all texts meet, and bytes tell them apart.
    assert run(spark, df, digest_bits=4) == WANT


def test_repeated_rows_of_a_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (2, "y")], "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    got = dedup.deduplicate(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert len(got) == 4
    assert sorted((r.id, r.kept) for r in got if r.text_sha256 == sha("x")) == [(1, False), (2, False), (2, True)]


def test_state_outlives_a_call(spark):
    state = dedup.KeyedState(spark)
    one = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "x"), (4, "z")], "doc_id long, text string")
    dedup.deduplicate(one, state=state).count()
    got = {r.id: (r.keep_id, r.group_size) for r in dedup.deduplicate(two, state=state).collect()}
    assert got == {3: (3, 2), 4: (4, 1)}


def test_bytes_are_compared_with_earlier_calls(spark):
    # Digests of four bits meet; texts are told apart over calls and sessions.
    path = dedup.KeyedState(spark).path
    calls = [[(k, f"text {k % 7}") for k in range(20)], [(30 + k, f"text {k % 11}") for k in range(25)], [(60 + k, f"text {k % 13}") for k in range(9)]]
    so_far = []
    for call in calls:
        so_far += call
        df = spark.newSession().createDataFrame(call, "doc_id long, text string")
        got = {r.id: (r.keep_id, r.group_size, r.text_sha256) for r in dedup.deduplicate(df, digest_bits=4, state=dedup.KeyedState(df.sparkSession, path)).collect()}
        for i, t in call:
            same = [j for j, u in so_far if u == t]
            assert got[i] == (max(same), len(same), sha(t))


def test_settings_of_the_session_stay(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    run(spark, spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    assert spark.conf.get(key) == before


def test_empty_and_clashing(spark):
    assert run(spark, spark.createDataFrame([], "doc_id long, text string")) == []
    df = spark.createDataFrame([(1, "x", "q", 3)], "doc_id long, text string, digest string, n int")
    assert run(spark, df) == [("1", 1, 1, True, sha("x"))]
