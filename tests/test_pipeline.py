import pytest
from pyspark.sql import functions as F

from lociweave.functions import sequences as S
from lociweave.operators import scores as sc
from lociweave.plans import catalog as cat
from lociweave.plans import pipeline as pl
from lociweave.plans import plugins
from lociweave.streaming.annotate import annotate_stream, run_batches


@pytest.fixture
def setting(spark):
    df = spark.createDataFrame([("1", 10, 19, 0.5, "a"), ("1", 30, 39, 1.5, "b"), ("x1", 10, 19, 9.0, "z")], "chrom string, pos_begin bigint, pos_end bigint, v double, s string")
    c = cat.Catalog([cat.Resource("scores/one", "position_score", sc.Score("position", df, {"v": "double", "s": "string"})), cat.Resource("scores/two", "position_score", sc.Score("position", df, {"v": "double"}))])
    rows = spark.createDataFrame([(1, "1", 12, 33), (2, "1", 12, 12), (3, "2", 1, 5), (4, "1", 100, 200)], "id bigint, c string, b bigint, e bigint")
    return rows.select("id", S.region(F.col("c"), F.col("b"), F.col("e")).alias("ann")), c


def test_forms_and_order(setting):
    df, c = setting
    text = """
preamble: {summary: s, input_reference_genome: g}
annotators:
- position_score: scores/two
- position_score:
    resource_id: scores/one
    attributes:
    - {source: v, name: top, aggregator: max, value: value * 10}
    - {name: s_list, source: s, internal: true}
- chrom_mapping:
    add_prefix: x
    attributes: [{source: renamed_chromosome, name: moved, internal: true}]
- position_score:
    resource_id: scores/one
    input_annotatable: moved
    attributes: [{source: v, name: v_moved}]
- debug_annotator
"""
    p = pl.parse(text, c)
    out = pl.annotate(df, p, c)
    assert out.columns == ["id", "ann", "v", "top", "v_moved", "debug"]
    got = {r.id: r for r in out.collect()}
    assert len(got) == 4
    assert got[1].v == pytest.approx((0.5 * 8 + 1.5 * 4) / 12) and got[1].top == 15 and got[1].v_moved == 9
    assert got[3].top is None and got[4].v is None and got[4].debug == "debug"


def test_one_join_for_one_resource(setting):
    df, c = setting
    text = "- position_score: {resource_id: scores/one, attributes: [{source: v, name: a}]}\n- position_score: {resource_id: scores/one, attributes: [{source: v, name: b, aggregator: max}]}"
    assert len(pl.merge(pl.parse(text, c).specs)) == 1
    assert {r.id: (r.a, r.b) for r in pl.annotate(df, pl.parse(text, c), c).collect()}[2] == (0.5, 0.5)


@pytest.mark.parametrize(
    "text",
    [
        "- nothing_like_it: x", "- position_score: {resource_id: scores/one, what: 1}", "- position_score: {resource_id: scores/one, attributes: [{source: v, what: 1}]}", "preamble: {other: 1}\nannotators: []",
        "- position_score: scores/one\n- position_score: scores/two", "- position_score: {resource_id: scores/one, input_annotatable: none, attributes: [v]}", "- {a: 1, b: 2}", "- position_score: none/*",
    ],
)
def test_refused(setting, text):
    with pytest.raises((pl.PipelineProblem, ValueError, KeyError)):
        pl.parse(text, setting[1])


def test_wildcards_and_repeats(setting):
    _, c = setting
    p = pl.parse("- position_score: scores/*", c, rename_repeated=True)
    assert [a.name for a in p.attributes()] == ["v", "s", "v_A1"]


def test_reannotation(setting):
    df, c = setting
    one = "- position_score: {resource_id: scores/one, attributes: [{source: v, name: a}]}\n"
    moved = "- chrom_mapping: {add_prefix: x, attributes: [{source: renamed_chromosome, name: m, internal: true}]}\n"
    use = "- position_score: {resource_id: scores/two, input_annotatable: m, attributes: [{source: v, name: b}]}\n"
    old, new = pl.parse(one + moved, c), pl.parse(moved + use, c)
    change = pl.reannotation(old, new)
    assert change.deleted == ("a",) and set(change.computed) == {"m", "b"} and change.copied == ()
    same = pl.reannotation(old, pl.parse(one, c))
    assert same.copied == ("a",) and same.run == ()
    done = pl.annotate(df, old, c)
    assert pl.reannotate(done, old, new, c).columns == ["id", "ann", "b"]
    assert ("a", "", "DELETED") in pl.describe(new, old) and ("b", "A1", "ADDED") in pl.describe(new, old)


def test_plug_ins(setting, spark):
    df, c = setting
    plugins.python_annotator("length_of", lambda pdf: (pdf.pos_end - pdf.pos + 1).to_frame("n"), {"n": "bigint"})
    p = pl.parse("- length_of: {attributes: [{source: n, name: span}]}", c)
    assert sorted(r.span for r in pl.annotate(df, p, c).collect()) == [1, 5, 22, 101]
    plugins.command_annotator("echo_chrom", ["cut", "-f1"], ["out"])
    p = pl.parse("- echo_chrom: {attributes: [out]}", c)
    assert sorted(r.out for r in pl.annotate(df, p, c).collect()) == ["1", "1", "1", "2"]
    assert plugins.one_hot("ANt").tolist() == [[1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 1]]


def test_catalogue(spark):
    assert cat.parse_id("a/b(1.2)") == ("a/b", (1, 2)) and cat.parse_id("a") == ("a", (0,))
    c = cat.Catalog([cat.Resource("a(1.2)", "t", 1), cat.Resource("a(1.10)", "t", 2), cat.Resource("b", "fragment_score", 3, {"genome": "hg38"}, "conservation of bases")])
    assert c.get("a").value == 2 and c.get("a(=1.2)").value == 1 and c.get("a(>=1.3)").value == 2
    with pytest.raises(KeyError):
        c.get("a(=9)")
    t = c.table(spark)
    assert {r.full_id for r in cat.newest(t).collect()} == {"a(1.10)", "b"}
    assert [r.id for r in cat.search(t, "conserv* bases").collect()] == ["b"]
    assert [r.id for r in cat.search(t, type="cnv_collection", query="*[genome=hg* and '38' in genome]").collect()] == ["b"]
    assert cat.search(t, query="[genome=hg19]").count() == 0
    with pytest.raises(ValueError):
        cat.compile_query("x" * 300)


def test_streams_equal_batches(spark, setting, tmp_path):
    df, c = setting
    src = str(tmp_path / "in")
    df.write.parquet(src)
    score = c.get("scores/one").value
    asked = [sc.Attribute("v", "mean_v", "mean"), sc.Attribute("v", "n", "count")]
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = annotate_stream(stream, score, asked).writeStream.format("memory").queryName("annotated").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert not q.lastProgress["stateOperators"]
    want = {r.id: (r.mean_v, r.n) for r in sc.annotate_position(df, score, asked).collect()}
    got = {r.id: (r.mean_v, r.n) for r in spark.table("annotated").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    p = pl.parse("- position_score: scores/one", c)
    q = run_batches(spark.readStream.schema(df.schema).parquet(src), lambda d: pl.annotate(d, p, c), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
