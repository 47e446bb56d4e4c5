import corpus_pipeline

X, Y, Z = (f"{w} " + " ".join(f"{w}{k}" for k in range(40)) for w in "xyz")
NEAR = X + " more"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_exact_stage_keeps_one_row_of_each_text(spark, tmp_path):
    rows = [(1, "x", "a"), (2, "x", "a"), (2, "x", "a"), (2, "y", "a"), (None, "x", "a"), (None, "z", "a"), (None, "z", "a"), (None, None, "a"), (3, "", "a"), (3, "w", "a")]
    want = sorted([(2, "x"), (2, "y"), (None, "z"), (3, ""), (3, "w")], key=repr)
    df = frame(spark, rows)
    assert left(corpus_pipeline.exact_stage(spark, df, "")) == want
    df.repartition(3).write.parquet(str(tmp_path / "d"))
    files = spark.read.parquet(str(tmp_path / "d"))
    out = corpus_pipeline.exact_stage(spark, files, "")
    assert out.columns == files.columns and left(out) == want


def test_near_stage_decides_each_text_of_a_repeated_id(spark):
    rows = [(1, X, "a"), (2, NEAR, "a"), (2, Y, "a"), (None, Z, "a"), (None, Y + " more", "a"), (None, Z + " more", "a"), (5, "alone here", "a")]
    got = left(corpus_pipeline.near_stage(spark, frame(spark, rows), ""))
    assert [r for r in got if r[0] is not None] == [(1, X), (2, Y), (5, "alone here")]
    assert len(got) == 4 and got[-1][1] in (Z, Z + " more")


def test_near_stage_keeps_the_least_id_of_plain_rows(spark):
    rows = [(4, X, "a"), (3, NEAR, "a"), (7, Y, "a")]
    assert left(corpus_pipeline.near_stage(spark, frame(spark, rows), "")) == [(3, NEAR), (7, Y)]
