"""Golden rows and properties of score reads."""

import random

import pytest
from pyspark.sql import functions as F

from lociweave.functions import sequences as S
from lociweave.operators import aggregators, regions
from lociweave.operators import scores as sc
from lociweave.operators.overlap import overlap_join

HUNDRED = [(14966, 14967, 0.02), (14968, 14969, 0.01), (14970, 14971, 0.1), (14972, 14973, 0.2), (14974, 14975, 0.3), (14976, 14977, 0.4)]
FRAGMENTS = [("1", 10, 20, 0.02, "SSC", "affected"), ("1", 50, 100, 0.1, "AGRE", "affected"), ("2", 1, 2, 0.00001, "AGRE", "unaffected"), ("2", 16, 20, 0.3, "SSC", "affected"), ("2", 200, 203, 0.0002, "AGRE", "unaffected"), ("15", 16, 20, 0.2, "AGRE", "affected")]
ALLELES = [("1", 10, "A", "G", 0.02), ("1", 10, "A", "C", 0.03), ("1", 10, "A", "A", 0.04), ("1", 16, "CA", "G", 0.03), ("1", 16, "C", "T", 0.04), ("1", 16, "C", "A", 0.05)]


def position(spark, rows, chrom="1"):
    df = spark.createDataFrame([(chrom, *r) for r in rows], "chrom string, pos_begin bigint, pos_end bigint, v double")
    return sc.Score("position", df, {"v": "double"})


@pytest.mark.parametrize(
    ("pos", "ref", "alt", "agg", "want"),
    [
        (14970, "C", "A", "mean", 0.1), (14970, "CC", "C", "mean", 0.4 / 3), (14970, "CC", "C", "max", 0.2), (14970, "CCT", "C", "mean", 0.6 / 4), (14970, "C", "CA", "mean", 0.1), (14971, "C", "CA", "mean", 0.15),
        (14970, "CCT", "AT", "mean", 0.6 / 4), (14970, "CC", "ATTTT", "mean", 0.4 / 3),
    ],
)
def test_alleles_over_positions(spark, pos, ref, alt, agg, want):
    df = spark.range(1).select("id", S.allele(F.lit("1"), F.lit(pos), F.lit(ref), F.lit(alt)).alias("ann"))
    got = sc.annotate_position(df, position(spark, HUNDRED), [sc.Attribute("v", "x", agg)]).first().x
    assert got == pytest.approx(want)


def test_three_kinds_of_nothing(spark):
    rows = [(1, "1", 10, 12), (2, "9", 1, 2), (3, "1", 500, 510)]
    df = spark.createDataFrame(rows, "id bigint, c string, b bigint, e bigint").select("id", S.region(F.col("c"), F.col("b"), F.col("e")).alias("ann"))
    score = position(spark, [(10, 12, None), (600, 700, 1.0)])
    asked = [sc.Attribute("v", a, a) for a in ("list", "bool", "value_count", "mean", "count")]
    got = {r.id: r for r in sc.annotate_position(df, score, asked).collect()}
    assert (got[1].list, got[1].bool, got[1].value_count, got[1].mean, got[1]["count"]) == ([], False, {}, None, None)
    for k in (2, 3):
        assert got[k].list is None and got[k].bool is None and got[k].value_count is None


def test_length_limit(spark):
    df = spark.range(1).select("id", S.region(F.lit("1"), F.lit(1), F.lit(600_000)).alias("ann"))
    assert sc.annotate_position(df, position(spark, HUNDRED), [sc.Attribute("v", "x", "mean")]).first().x is None


def region(spark, b, e):
    return spark.createDataFrame([(1, "1", b, e)], "id bigint, chrom string, begin bigint, end bigint")


def test_plane(spark):
    gapped = position(spark, [(10, 13, 0.2), (16, 16, 0.8)])
    got = sc.positions(region(spark, 12, 16), gapped, ["v"]).orderBy("pos").collect()
    assert [r.v for r in got] == [0.2, 0.2, None, None, 0.8]
    one = lambda s, *a: sc.aggregate_gap_aware(region(spark, 10, 16), s, sc.Attribute("v", "x", "mean"), *a).first().x
    assert one(gapped) == pytest.approx((0.2 * 4 + 0.8) / 5)
    assert one(gapped, 0.0) == pytest.approx((0.2 * 4 + 0.8) / 7)
    lapping = position(spark, [(10, 14, 1.0), (12, 16, 2.0)])
    assert one(lapping) == pytest.approx((5 + 4) / 7)
    assert sc.aggregate_regions(region(spark, 10, 16), lapping, [sc.Attribute("v", "x", "mean")]).first().x == pytest.approx(1.5)
    bins = sc.aggregate_bins(gapped, "1", 10, 26, 5, sc.Attribute("v", "x", "mean")).orderBy("bin_begin").collect()
    assert [(r.bin_begin, r.bin_end, r.x and round(r.x, 9)) for r in bins] == [(10, 10, 0.2), (11, 15, 0.2), (16, 20, 0.8), (21, 25, None), (26, 26, None)]


def fragments(spark):
    df = spark.createDataFrame(FRAGMENTS, "chrom string, pos_begin bigint, pos_end bigint, frequency double, collection string, status string")
    return sc.Score("fragment", df, {"frequency": "double", "collection": "string", "status": "string"})


def test_fragment_counts(spark):
    rows = [(1, "1", 15, 15), (2, "1", 15, 60), (3, "1", 30, 40)]
    df = spark.createDataFrame(rows, "id bigint, c string, b bigint, e bigint").select("id", S.region(F.col("c"), F.col("b"), F.col("e")).alias("ann"))
    n = lambda f: [r.n for r in sc.annotate_fragment(df, fragments(spark), [], record_filter=f, count_as="n").orderBy("id").collect()]
    assert n(None) == [1, 2, 0]
    assert n('frequency < 0.05 or collection == "SSC"') == [1, 1, 0]
    with pytest.raises(Exception, match="no fragments on contig"):
        bad = df.withColumn("ann", F.col("ann").withField("chrom", F.lit("77")))
        sc.annotate_fragment(bad, fragments(spark), [], count_as="n", strict=True).collect()


def test_alleles(spark):
    df = spark.createDataFrame(ALLELES, "chrom string, pos_begin bigint, reference string, alternative string, freq double").withColumn("pos_end", F.col("pos_begin"))
    score = sc.Score("allele", df, {"freq": "double"})
    ann = spark.range(1).select("id", S.allele(F.lit("1"), F.lit(10), F.lit("A"), F.lit("C")).alias("ann"))
    assert sc.annotate_allele(ann, score, [sc.Attribute("freq")]).first().freq == 0.03
    assert sc.annotate_allele(ann, score, [sc.Attribute("freq")], record_filter="freq > 0.03").first().freq is None
    area = spark.range(1).select("id", S.region(F.lit("1"), F.lit(10), F.lit(16)).alias("ann"))
    got = sc.annotate_allele(area, score, [sc.Attribute("freq"), sc.Attribute("allele")], mode="region", record_filter="freq > 0.03").first()
    assert got.freq == 0.05 and got.allele == ["1:10:A:A", "1:16:C:A", "1:16:C:T"]


def test_aggregators(spark):
    def agg(name, values, kind="double", weights=None):
        rows = [(k, v, (weights or [1] * len(values))[k]) for k, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"o int, v {kind}, w int")
        a = aggregators.parse(name, kind)
        return df.agg(aggregators.aggregate(a, F.col("v"), F.col("w"), F.col("o"), kind).alias("x")).first().x

    assert agg("concatenate", list("abcd"), "string") == "abcd"
    assert agg("min", [5.0, 6.0, 1.0, 2.0, 7.0]) == 1 and agg("max", [5.0, 6.0, 1.0, 2.0, 7.0]) == 7
    assert agg("mean", [1.0, 2.0, 3.0, 4.0]) == 2.5 and agg("count", [1.0, 2.0, 3.0, 4.0]) == 4
    assert agg("median", [2.0, 3.0, 4.0, 1.0]) == 2.5
    assert agg("join(;)", ["x", None, "y"], "string", [2, 1, 1]) == "x;x;y"
    assert agg("mode", [3.0, 1.0, 3.0, 1.0]) == 1.0 and agg("mode", [3.0, 1.0], weights=[2, 1]) == 3.0
    assert agg("value_count", [3.0, 1.0, None], weights=[2, 1, 5]) == {3.0: 2, 1.0: 1}
    for bad in ("what", "mean(2)", "join(", "max;"):
        with pytest.raises(ValueError):
            aggregators.parse(bad)
    with pytest.raises(ValueError):
        aggregators.parse("mean", "string")


@pytest.mark.parametrize("name", ["mean", "median", "mode", "count", "list", "value_count", "concatenate", "join"])
def test_weights_are_copies(spark, name):
    r = random.Random(name)
    rows = [(k, float(r.randint(0, 4)) if r.random() < 0.8 else None, r.randint(1, 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "o int, v double, w int")
    copies = df.select("o", "v", F.explode(F.array_repeat(F.lit(1), F.col("w"))).alias("w"))
    a = aggregators.parse(name)
    f = lambda d: d.agg(aggregators.aggregate(a, F.col("v"), F.col("w"), F.col("o"), "double").alias("x")).first().x
    assert f(df) == pytest.approx(f(copies)) if name == "mean" else f(df) == f(copies)


def test_binned_join_is_the_naive_join(spark):
    r = random.Random(7)
    spans = [0, 3, 900, 1023, 1024, 20_000, 700_000, 30_000_000]
    make = lambda n: [(k, f"c{r.randint(0, 2)}", b := r.randint(-50, 2_000_000), b + r.choice(spans)) for k in range(n)]
    left = spark.createDataFrame(make(80), "a int, lc string, lb bigint, le bigint")
    right = spark.createDataFrame(make(120) + [(999, None, 1, 2), (998, "c0", 9, 3)], "b int, rc string, rb bigint, re bigint")
    got = sorted((x.a, x.b) for x in overlap_join(left.where("le - lb < 100000"), right, ("lc", "lb", "le"), ("rc", "rb", "re")).collect())
    naive = left.where("le - lb < 100000").join(right.where("re >= rb"), F.expr("lc = rc and lb <= re and le >= rb"))
    assert got == sorted((x.a, x.b) for x in naive.collect())


def test_regions(spark):
    R = lambda rows: spark.createDataFrame(rows, "chrom string, start bigint, stop bigint")
    flat = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert flat(regions.collapse(R([("1", 1, 2), ("1", 2, 3)]))) == [("1", 1, 3)]
    assert flat(regions.collapse(R([("1", 1, 2), ("1", 3, 4)]))) == [("1", 1, 2), ("1", 3, 4)]
    assert flat(regions.collapse(R([("1", None, 5), ("1", 4, None)]))) == [("1", None, None)]
    assert flat(regions.split(spark.createDataFrame([("1", 11)], "chrom string, length bigint"), 10)) == [("1", 1, 10), ("1", 11, 11)]
    assert flat(regions.difference(R([("1", 1, 10)]), R([("1", 3, 4)]))) == [("1", 1, 2), ("1", 5, 10)]
    assert flat(regions.intersection(R([("1", None, 10)]), R([("1", 3, 14), ("2", 1, 2)]))) == [("1", 3, 10)]


def test_bed(spark, tmp_path):
    d = spark.createDataFrame([("1", 5, 9), ("2", 1, 1)], "chrom string, start bigint, stop bigint")
    regions.write_bed(d, str(tmp_path / "b"))
    assert sorted(map(tuple, regions.read_bed(spark, str(tmp_path / "b")).collect())) == [("1", 5, 9), ("2", 1, 1)]


def test_running_values_over_spans(spark):
    from pyspark.sql import Window

    from lociweave.operators.running import running

    r = random.Random(3)
    rows = [(k, f"c{r.randint(0, 2)}" if k % 9 else None, r.randint(-50, 400), r.randint(0, 99) if k % 5 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, c string, p bigint, v int")
    kinds = {"a": ("max_before", F.col("v")), "b": ("max_to", F.col("v")), "s": ("sum_to", F.coalesce("v", F.lit(0))), "l": ("prev", F.col("v")), "n": ("next", F.col("v"))}
    got = sorted(map(tuple, running(df, "c", "p", ["k"], kinds, span=16).collect()))
    w = Window.partitionBy("c").orderBy("p", "k")
    to, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.max("v").over(before), F.max("v").over(to), F.sum(F.coalesce("v", F.lit(0))).over(to), F.lag("v").over(w), F.lead("v").over(w))
    assert got == sorted(map(tuple, want.collect()))


def test_rows_need_no_ids(spark):
    one = lambda b, e: S.region(F.lit("1"), F.lit(b), F.lit(e))
    df = spark.range(3).select(F.lit(7).alias("id"), one(14970, 14973).alias("ann")).unionByName(spark.range(2).select(F.lit(None).cast("int").alias("id"), F.when(F.col("id") == 0, one(14972, 14972)).alias("ann")))
    got = sc.annotate_position(df, position(spark, HUNDRED), [sc.Attribute("v", "x", "max"), sc.Attribute("v", "n", "value_count")]).collect()
    assert sorted(((repr(r.id), r.x, r.n) for r in got), key=repr) == [("7", 0.2, {0.1: 2, 0.2: 2})] * 3 + [("None", 0.2, {0.2: 1}), ("None", None, None)]


def test_counts_without_pairs(spark):
    from lociweave.operators.overlap import overlap_counts

    r = random.Random(5)
    make = lambda n: [(k, f"c{r.randint(0, 2)}", b := r.randint(-100, 900), b + r.randint(-1, 300)) for k in range(n)]
    left, right = spark.createDataFrame([*make(60), (997, None, 1, 2), (996, "c9", 1, 2)], "a int, lc string, lb bigint, le bigint"), spark.createDataFrame([*make(90), (999, None, 1, 2)], "b int, rc string, rb bigint, re bigint")
    got = {x.a: x.n for x in overlap_counts(left, right, ("lc", "lb", "le"), ("rc", "rb", "re"), "n", width=64).collect()}
    naive = left.join(right.where("re >= rb"), F.expr("lc = rc and lb <= re and le >= rb and le >= lb"), "left").groupBy("a").agg(F.count("b").alias("n"))
    assert got == {x.a: x.n for x in naive.collect()}
