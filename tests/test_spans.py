"""Folds by spans against plain Python over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lociweave.operators import effects, genes, genome, scores, spans, transcripts
from lociweave.queries import QUERIES

KIND = "id int, ann struct<type:string,chrom:string,pos:bigint,pos_end:bigint,ref:string,alt:string>"


def some_models(rng, n, names):
    out = []
    for k in range(n):
        b = rng.choice([rng.randint(1, 20_000), 4096 * rng.randint(1, 4)])
        exons, at = [], b
        for _ in range(rng.randint(1, 4)):
            size = rng.choice([5, 30, 3000])
            exons.append((at, at + size - 1, -1))
            at += size + rng.choice([1, 20, 9000])
        end = exons[-1][1]
        cds = (end, b) if rng.random() < 0.2 else (b + rng.randint(0, 9), end - rng.randint(0, 3))
        out.append((f"t{k}", f"t{k}", rng.choice(names), f"c{rng.randint(0, 1)}", rng.choice("+-"), b, end, *cds, exons, {}))
    return out


def some_places(rng, n):
    out = []
    for k in range(n):
        b = rng.choice([rng.randint(1, 60_000), 4096 * rng.randint(1, 6) + rng.randint(-1, 1)])
        out.append((k, ("REGION", f"c{rng.randint(0, 2)}", b, b + rng.choice([0, 25, 4095, 4096, 70_000, 3_000_000]), None, None)))
    return out + [(n, None), (n + 1, out[0][1]), (n + 2, ("REGION", None, 5, 9, None, None)), (n + 3, ("REGION", "c0", 9, 5, None, None))]


def naive_simple(models, ann):
    if ann is None or ann[1] is None or ann[3] < ann[2]:
        return "intergenic", []
    pairs, over = set(), False
    for _, _, gene, chrom, _, tb, te, cb, ce, exons, _ in models:
        if cb < ce:
            inner = [(a[1] + 1, b[0] - 1) for a, b in zip(exons, exons[1:], strict=False)]
            parts = [(0, max(a, cb), min(b, ce)) for a, b, _ in exons] + [(1, a, b) for a, b in inner if a > cb and b < ce] + [(2, tb, cb - 1), (2, ce + 1, te)]
        else:
            parts = [(3, tb, te)]
        hit = [r for r, a, b in [*parts, (9, tb, te)] if chrom == ann[1] and a <= b and a <= ann[3] and b >= ann[2]]
        over |= bool(hit)
        if hit and min(hit) < 9:
            pairs.add((min(hit), gene))
    return ("intergenic" if not over else transcripts.SIMPLE[min(pairs)[0]] if pairs else None), sorted(pairs)


@pytest.mark.parametrize("pairs", [spans._PAIRS, 50])
def test_simple_effects_are_those_of_all_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(spans, "_PAIRS", pairs)
    rng = random.Random(pairs)
    models = some_models(rng, 150, [f"g{k}" for k in range(70)])
    rows = some_places(rng, 250)
    got = transcripts.annotate_simple_effects(spark.createDataFrame(rows, KIND), spark.createDataFrame(models, transcripts.SCHEMA)).collect()
    assert len(got) == len(rows)
    given = dict(rows)
    for r in got:
        worst, told = naive_simple(models, given[r.id])
        assert r.worst_effect == worst
        assert r.gene_effects == "|".join(f"{g}:{transcripts.SIMPLE[k]}" for k, g in told)
        assert r.genes == list(dict.fromkeys(g for _, g in told))
        for k, c in enumerate(transcripts.SIMPLE):
            assert r[f"{c}_genes"] == [g for x, g in told if x == k]


def shuffled(df):
    """Bytes that the exchanges of a run of ``df`` have written."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if name == "ShuffleExchangeExec":
            total += p.metrics().get("dataSize").get().value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_simple_effects_do_not_shuffle_pairs(spark):
    # 400 places of one base apart, each over 500 transcripts: 200,000 pairs.
    models = [(f"t{k}", f"t{k}", f"g{k % 7}", "c", "+", 1000 + k % 5, 3000, 1010, 2900, [(1000 + k % 5, 1500, -1), (2000, 3000, -1)], {}) for k in range(500)]
    m = spark.createDataFrame(models, transcripts.SCHEMA)
    df = spark.range(400).select("id", F.expr("named_struct('type', 'REGION', 'chrom', 'c', 'pos', 1100 + id, 'pos_end', 1110 + id, 'ref', string(null), 'alt', string(null)) as ann"))
    assert shuffled(transcripts.annotate_simple_effects(df, m, wanted=["worst_effect", "gene_effects"])) < 1_000_000


def some_variants(rng, n):
    out = []
    for k in range(n):
        b = rng.choice([rng.randint(1, 40_000), 4096 * rng.randint(1, 4) + rng.randint(-1, 1)])
        kind = rng.choice(["SUBSTITUTION", "SMALL_DELETION", "SMALL_INSERTION", "LARGE_DELETION", "LARGE_DUPLICATION", "REGION", "HALF"])
        ref = "".join(rng.choices("acGT", k=rng.randint(2, 7) if kind == "SMALL_DELETION" else 1))
        alt = ref[0] + "".join(rng.choices("ACGT", k=rng.randint(1, 6))) if kind == "SMALL_INSERTION" else ref[0] if kind == "SMALL_DELETION" else rng.choice("ACGT")
        if kind.startswith(("LARGE", "REGION")):
            ref, alt, end = None, None, b + rng.choice([0, 25, 4096, 70_000, 16_000_000])
        else:
            end, alt = b + len(ref) - 1, None if kind == "HALF" else alt
        out.append((k, (kind, f"c{rng.randint(0, 2)}", b, end, ref, alt)))
    return [*out, (n, None), (n + 1, out[0][1]), (n + 2, ("REGION", None, 5, 9, None, None))]


@pytest.mark.parametrize("pairs", [spans._PAIRS, 50])
@pytest.mark.parametrize("promoter", [0, 60])
def test_what_is_told_of_places_is_what_their_effects_come_to(spark, monkeypatch, pairs, promoter):
    monkeypatch.setattr(spans, "_PAIRS", pairs)
    rng = random.Random(pairs + promoter)
    some = some_models(rng, 60, [f"g{k}" for k in range(40)])
    # Transcripts of one shape, and one without a gene.
    some += [(f"u{k}", f"u{k}", None if k == 3 else f"g{k}", *m[3:]) for k, m in enumerate(some[:30])]
    models = spark.createDataFrame(some, transcripts.SCHEMA)
    sequence = genome.from_sequences(spark, {c: "".join(rng.choices("ACGT", k=60_000)) for c in ("c0", "c1", "c2")})
    df = spark.createDataFrame(some_variants(rng, 200), KIND)
    lists = ["LGDs", "coding", "CNV"]
    full = effects.summarise(effects.variant_effects(df, models, sequence, promoter), lists)
    full = full.withColumn("gene_list", F.array_distinct(F.transform(F.filter("effects", lambda x: x["gene"].isNotNull()), lambda x: x["gene"])))
    told = ["worst_effect", "gene_effects", "effect_details", "gene_list", *[f"{c}_genes" for c in lists]]
    want = sorted(map(str, full.select("id", *told).collect()))
    assert sorted(map(str, effects.annotate_effects(df, models, sequence, told, promoter).select("id", *told).collect())) == want
    few = ["worst_effect", "LGDs_genes", "CNV_genes"]
    assert sorted(map(str, effects.annotate_effects(df, models, sequence, few, promoter).select("id", *few).collect())) == sorted(map(str, full.select("id", *few).collect()))


@pytest.mark.parametrize(("name", "most"), [("cnv_effects", 10e6), ("full_effects", 2e6)])
def test_effects_do_not_shuffle_pairs(spark, tmp_path, name, most):
    # Places near the first base of a contig, all over 400 transcripts that begin there.
    keys = [k for k in range(0, 43_200, 6) if k * 7919 % 43_200 < 140]
    spark.createDataFrame([(k + 43_200 * w * 6, w) for k in keys for w in range(50)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(43_200 * k,) for k in range(400)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    assert shuffled(QUERIES[name](spark, str(tmp_path))) < most


def test_rows_go_to_their_texts(spark, monkeypatch):
    # Narrow spans in many tasks, lists of two rows, rows of one place that are read apart, other columns kept.
    monkeypatch.setattr(spans, "_TEXT", 3000)
    monkeypatch.setattr(spans, "_LIST", 2)
    rng = random.Random(9)
    models = spark.createDataFrame(some_models(rng, 60, [f"g{k}" for k in range(40)]), transcripts.SCHEMA)
    sequence = genome.from_sequences(spark, {c: "".join(rng.choices("ACGT", k=60_000)) for c in ("c0", "c1", "c2")})
    rows = [(5 * k + i, ann) for k, ann in some_variants(rng, 150) for i in range(k % 5)]
    df = spark.createDataFrame(rows, KIND).repartition(3).withColumn("more.columns", F.map_from_arrays(F.array("id"), F.array(F.lit(None).cast("timestamp"))))
    told = ["effect_details", "worst_effect", "coding_genes"]
    got = effects.annotate_effects(df, models, sequence, told, 60)
    assert got.columns == ["id", "ann", "more.columns", *told]
    want = effects.summarise(effects.variant_effects(df, models, sequence, 60), ["coding"]).select("id", "ann", "`more.columns`", *told)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_texts_of_places_are_not_shuffled(spark):
    # 400 places over 500 transcripts, some 5 MB of details; before, these were shuffled to be joined to the rows.
    models = [(f"t{k}", f"t{k}", f"g{k % 7}", "c", "+", 1000 + k % 5, 3000, 1010, 2900, [(1000 + k % 5, 1500, -1), (2000, 3000, -1)], {}) for k in range(500)]
    m = spark.createDataFrame(models, transcripts.SCHEMA)
    df = spark.range(400).select("id", F.expr("named_struct('type', 'SUBSTITUTION', 'chrom', 'c', 'pos', 1100 + id, 'pos_end', 1100 + id, 'ref', 'A', 'alt', 'C') as ann"))
    out = effects.annotate_effects(df, m, genome.from_sequences(spark, {"c": "ACGT" * 1000}), ["effect_details"])
    assert out.agg(F.sum(F.length("effect_details"))).first()[0] > 5_000_000
    assert shuffled(out) < 2_500_000


def test_extremes_of_fragments_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    values = [None, 0.5, -1.0, 2.0, float("nan"), float("inf")]
    some = [(f"c{rng.randint(0, 1)}", b, b + rng.choice([0, 30, 5000, 80_000]), rng.choice(values), rng.choice(values[:3])) for b in (rng.randint(1, 30_000) for _ in range(300))]
    score = scores.Score("fragment", spark.createDataFrame(some, "chrom string, pos_begin bigint, pos_end bigint, v double, w double"), {"v": "double", "w": "double"})
    rows = some_places(rng, 200)
    asked = [scores.Attribute("v", "top", "max"), scores.Attribute("v", "low", "min"), scores.Attribute("w", "w_low", "min")]
    got = scores.annotate_fragment(spark.createDataFrame(rows, KIND), score, asked, count_as="n").collect()
    given, first = dict(rows), lambda x: (x != x, x)  # NaN is the greatest
    assert len(got) == len(rows)
    for r in got:
        a = given[r.id]
        if a is None or a[3] - a[2] + 1 > scores.REGION_LIMIT:
            assert (r.top, r.low, r.n) == (None, None, None)
            continue
        hit = [f for f in some if a[1] == f[0] and a[2] <= a[3] and f[1] <= a[3] and f[2] >= a[2]]
        v, w = sorted((f[3] for f in hit if f[3] is not None), key=first), [f[4] for f in hit if f[4] is not None]
        assert (repr(r.top), repr(r.low), r.w_low, r.n) == (repr(v[-1]) if v else "None", repr(v[0]) if v else "None", min(w, default=None), len(hit))


def test_gene_lists_do_not_travel_with_their_genes(spark):
    # 300 lists of 200 genes each; before, each of the 60,000 genes took its whole list along.
    df = spark.range(300).select("id", F.expr("transform(sequence(0, 199), i -> concat('gene', (id + i) % 500)) as genes"))
    table = spark.range(5000).select(F.expr("concat('gene', id) as gene"), F.expr("double(id) as price"))
    out = genes.annotate_gene_score(df, table, "price", "top", aggregator="max").select("id", "top")
    assert {r.id: r.top for r in out.collect()} == {k: float(max((k + i) % 500 for i in range(200))) for k in range(300)}
    assert shuffled(out) < 2_000_000
