import pytest
from pyspark.sql import functions as F

from lociweave.functions import sequences as S
from lociweave.operators import effects, genome, transcripts
from lociweave.sources import models

REFFLAT = """#geneName\tname\tchrom\tstrand\ttxStart\ttxEnd\tcdsStart\tcdsEnd\texonCount\texonStarts\texonEnds
g1\ttx1\tfoo\t+\t3\t17\t3\t17\t2\t3,13\t6,17
g1\ttx2\tfoo\t+\t3\t9\t3\t6\t1\t3\t6
g4\ttx4\tfoo\t-\t20\t40\t25\t35\t1\t25\t35
g5\ttx5\tfoo\t-\t25\t35\t27\t35\t1\t27\t35
g6\ttx6\tfoo\t-\t50\t80\t55\t71\t2\t55,65\t61,71
g2\ttx3\tbar\t-\t3\t20\t3\t15\t1\t3\t17
g7\ttx7\tbaz\t+\t10\t20\t10\t10\t1\t10\t20
"""


@pytest.fixture(scope="module")
def simple(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("m") / "refflat.txt"
    p.write_text(REFFLAT)
    assert models.infer_format(spark, str(p)) == "refflat"
    return models.read_gene_models(spark, str(p), "refflat").cache()


@pytest.mark.parametrize(
    ("chrom", "pos", "worst", "pairs"),
    [
        ("foo", 2, "intergenic", ""), ("foo", 7, "inter-coding_intronic", "g1:inter-coding_intronic|g1:peripheral"), ("foo", 14, "coding", "g1:coding"), ("bar", 16, "peripheral", "g2:peripheral"),
        ("foo", 26, "coding", "g4:coding|g5:peripheral"), ("foo", 51, "peripheral", "g6:peripheral"), ("foo", 62, "inter-coding_intronic", "g6:inter-coding_intronic"), ("foo", 50, "intergenic", ""), ("baz", 12, "noncoding", "g7:noncoding"),
    ],
)
def test_simple_effects(spark, simple, chrom, pos, worst, pairs):
    df = spark.range(1).select("id", S.position(F.lit(chrom), F.lit(pos)).alias("ann"))
    r = transcripts.annotate_simple_effects(df, simple).first()
    assert (r.worst_effect, r.gene_effects) == (worst, pairs)


def test_gtf_round_trip(spark, simple, tmp_path):
    t = simple.where("tx_begin < cds_end and cds_begin < cds_end and gene in ('g6', 'g4')")
    models.write_gtf(t, str(tmp_path / "g"))
    back = models.read_gene_models(spark, str(tmp_path / "g"), "gtf")
    keep = ["tr_id", "gene", "chrom", "strand", "tx_begin", "tx_end", "cds_begin", "cds_end", "exons"]
    assert sorted(map(str, back.select(keep).collect())) == sorted(map(str, t.select(keep).collect()))
    models.write_default(simple, str(tmp_path / "d"))
    again = models.read_gene_models(spark, str(tmp_path / "d"), "default")
    assert sorted(map(str, again.select(keep).collect())) == sorted(map(str, simple.select(keep).collect()))


#     123456789012345678901234567890
SEQ = "TTATGGCATGTACGGTAAGTCCAGGATTAAAACCCC"
MODEL = [("t1", "t1", "G", "c", "+", 2, 34, 3, 29, [(2, 14, 0), (24, 34, 0)], {})]


def effect(spark, pos, ref, alt, promoter=0, strand="+", seq=SEQ):
    rows = [(*MODEL[0][:4], strand, *MODEL[0][5:])]
    m = spark.createDataFrame(rows, transcripts.SCHEMA)
    g = genome.from_sequences(spark, {"c": seq})
    df = spark.range(1).select("id", S.allele(F.lit("c"), F.lit(pos), F.lit(ref), F.lit(alt)).alias("ann"))
    return effects.summarise(effects.variant_effects(df, m, g, promoter)).first()


def test_full_effects(spark):
    # Coding: 3-14 ATGGCATGTACG, 24-29 GGATTA.
    assert effect(spark, 6, "G", "A").worst_effect == "missense"  # GCA > ACA
    assert effect(spark, 8, "A", "C").worst_effect == "synonymous"  # GCA > GCC
    assert effect(spark, 4, "T", "C").worst_effect == "noStart"
    assert effect(spark, 15, "G", "A").worst_effect == "splice-site"
    assert effect(spark, 19, "T", "A").worst_effect == "intron"
    assert effect(spark, 2, "T", "A").worst_effect == "5'UTR"
    assert effect(spark, 32, "A", "T").worst_effect == "3'UTR"
    assert effect(spark, 7, "C", "CT").worst_effect == "frame-shift"
    assert effect(spark, 7, "CATG", "C").worst_effect == "no-frame-shift"
    assert effect(spark, 1, "T", "A", promoter=5).worst_effect == "promoter"
    far = effect(spark, 36, "C", "A")
    assert far.worst_effect == "intergenic" and far.gene_effects == "intergenic:intergenic"
    r = effect(spark, 6, "G", "A")
    assert r.gene_effects == "G:missense" and r.effect_details.startswith("t1:G:missense:2/6(")


def test_stop_gained(spark):
    # The third codon TGT at 9-11 becomes TGA.
    assert effect(spark, 11, "T", "A").worst_effect == "nonsense"


def test_effect_groups():
    from lociweave.operators.genes import effect_in

    assert effect_in(effects.GROUPS, ["CNV"]) == ["CNV+", "CNV-"]
    assert "frame-shift" in effect_in(effects.GROUPS, ["LGDs"])


def test_cnv_gene_lists(spark):
    df = spark.createDataFrame([([("frame-shift", "gene2"), ("CNV+", "gene1")],)], "effects array<struct<effect:string,gene:string>>")
    from lociweave.operators.genes import effect_in, genes_with_effect

    got = df.select(genes_with_effect(F.col("effects"), effect_in(effects.GROUPS, ["CNV"])).alias("a"), genes_with_effect(F.col("effects"), effect_in(effects.GROUPS, ["LGDs"])).alias("b")).first()
    assert got.a == ["gene1"] and got.b == ["gene2"]


@pytest.mark.parametrize(
    ("seq", "given", "want"),
    [
        ("GGGGCATGGG", (4, "GCAT", "GTGC"), (5, "CAT", "TGC")), ("GGGGCATGGG", (5, "CATG", "TGCG"), (5, "CAT", "TGC")), ("GGGGCATGGG", (4, "GCATG", "GTGCG"), (5, "CAT", "TGC")), ("GGGGCATGGG", (5, "CAT", "TGC"), (5, "CAT", "TGC")),
        ("A" + "T" * 14, (2, "T" * 12, "T" * 11), (1, "AT", "A")), ("A" + "T" * 14, (2, "T" * 12, "T" * 13), (1, "A", "AT")),
    ],
)
def test_normalise(spark, monkeypatch, seq, given, want):
    monkeypatch.setattr(genome, "_MARGINS", (2, 12))
    g = genome.from_sequences(spark, {"1": seq})
    df = spark.range(1).select("id", S.allele(F.lit("1"), F.lit(given[0]), F.lit(given[1]), F.lit(given[2])).alias("ann"))
    n = genome.annotate_normalised(df, g).first().normalized
    assert (n.pos, n.ref, n.alt) == want


def test_fasta_and_bases(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 first\nACGTAC\nGTAC\n\n>c2\nTTTT\n")
    g = genome.read_fasta(spark, str(tmp_path / "g.fa"), chunk=4)
    got = {(r.chrom, r.chunk): r.seq for r in g.collect()}
    assert got == {("c1", 0): "ACGT", ("c1", 1): "ACGT", ("c1", 2): "AC", ("c2", 0): "TTTT"}
    df = spark.createDataFrame([(1, "c1", 3, 9), (2, "c1", 9, 99), (3, "zz", 1, 2), (4, "c2", -3, 2)], "id int, c string, b int, e int")
    out = {r.id: r.s for r in genome.bases(df, g, "c", "b", "e", "s", chunk=4).collect()}
    assert out == {1: "GTACGTA", 2: "AC", 3: "", 4: "TT"}


def test_liftover(spark, tmp_path):
    (tmp_path / "x.chain").write_text("chain 4900 foo 48 + 4 44 chrFoo 48 + 2 40 1\n16 0 2\n10 2 0\n12\n\nchain 4800 bar 28 + 4 24 chrBar 28 - 4 24 2\n20\n\n")
    b = genome.read_chain(spark, str(tmp_path / "x.chain"))
    assert b.count() == 4
    df = spark.createDataFrame([(1, "foo", 5), (2, "foo", 21), (3, "foo", 4), (4, "bar", 5), (5, "foo", 31)], "id int, c string, p int")
    got = {r.id: r.lifted and tuple(r.lifted) for r in genome.lift_positions(df, b, "c", "p").collect()}
    assert got == {1: ("chrFoo", 3, "+"), 2: ("chrFoo", 21, "+"), 3: None, 4: ("chrBar", 24, "-"), 5: None}
    s = genome.from_sequences(spark, {"foo": "N" * 4 + "ACGTACGTACGTACGT" + "N" * 28})
    t = genome.from_sequences(spark, {"chrFoo": "NN" + "ACGTACGTACGTACGT" + "N" * 30})
    v = spark.createDataFrame([(1, 6, "C", "T"), (2, 6, "T", "C"), (3, 2, "N", "A")], "id int, p int, r string, a string").select("id", S.allele(F.lit("foo"), F.col("p"), F.col("r"), F.col("a")).alias("ann"))
    lifted = {r.id: r.lifted and (r.lifted.chrom, r.lifted.pos, r.lifted.ref, r.lifted.alt) for r in genome.lift_alleles(v, b, s, t).collect()}
    assert lifted == {1: ("chrFoo", 4, "C", "T"), 2: ("chrFoo", 4, "C", "T"), 3: None}


def test_lifting_keeps_every_row(spark):
    b = spark.createDataFrame([("foo", 0, 100, "new", 10, 500, "+", 1.0, "c")], "src_chrom string, src_begin bigint, src_end bigint, dst_chrom string, dst_begin bigint, dst_size bigint, strand string, score double, chain_id string")
    df = spark.createDataFrame([(1, "foo", 5), (1, "foo", 5), (1, "foo", 7), (None, "foo", 9), (None, None, None)], "id int, c string, p int")
    got = sorted((repr(r.id), r.p, r.lifted and r.lifted.pos) for r in genome.lift_positions(df, b, "c", "p").collect() if r.p is not None)
    assert got == [("1", 5, 15), ("1", 5, 15), ("1", 7, 17), ("None", 9, 19)] and genome.lift_positions(df, b, "c", "p").count() == 5


def test_walks_go_on_until_they_end(spark, monkeypatch):
    # An A taken from a run of 700: it slides over the whole run, through all margins.
    monkeypatch.setattr(genome, "_MARGINS", (10, 100, 1 << 20))
    g = genome.from_sequences(spark, {"1": "CG" + "A" * 700 + "TT"})
    df = spark.createDataFrame([(600, "AA", "A"), (600, "A", "AA"), (3, "A", "T")], "p int, r string, a string").select(S.allele(F.lit("1"), F.col("p"), F.col("r"), F.col("a")).alias("ann"))
    got = sorted((r.normalized.pos, r.normalized.ref, r.normalized.alt) for r in genome.annotate_normalised(df, g).collect())
    assert got == [(2, "G", "GA"), (2, "GA", "G"), (3, "A", "T")]
    b = spark.createDataFrame([("1", 0, 704, "n1", 0, 704, "-", 1.0, "c")], "src_chrom string, src_begin bigint, src_end bigint, dst_chrom string, dst_begin bigint, dst_size bigint, strand string, score double, chain_id string")
    t = genome.from_sequences(spark, {"n1": "AA" + "T" * 700 + "CG"})
    got = sorted((r.lifted.pos, r.lifted.ref, r.lifted.alt) for r in genome.lift_alleles(df, b, g, t).collect())
    assert got == [(2, "A", "AT"), (2, "AT", "A"), (702, "T", "A")]


def test_gene_set_files(spark, tmp_path):
    (tmp_path / "s.gmt").write_text("one desc A B\ntwo d2 B\n")
    got = sorted((r.set_name, r.gene) for r in models.read_gmt(spark, str(tmp_path / "s.gmt")).collect())
    assert got == [("one", "A"), ("one", "B"), ("two", "B")]
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "x.txt").write_text("name\ndescription\nA\nB\n\n")
    assert sorted(r.gene for r in models.read_set_directory(spark, str(tmp_path / "dir")).collect()) == ["A", "B"]
    (tmp_path / "m.txt").write_text("#geneNS\tsym\nA\tone|two\nB\tone\n")
    sets = models.read_map(spark, str(tmp_path / "m.txt"))
    assert sorted((r.set_name, r.gene) for r in sets.collect()) == [("one", "A"), ("one", "B"), ("two", "A")]
    models.write_map(models.as_terms(sets), str(tmp_path / "out"))
    assert models.read_map(spark, str(tmp_path / "out")).count() == 3
