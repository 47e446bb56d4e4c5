import struct
import zlib

from lociweave.sources import tables, tabular


def test_score_tables(spark, tmp_path):
    (tmp_path / "a.mem").write_text("chrom pos_begin pos_end v s\n1 10 12 0.5 x\n1 20 20 NA EMPTY\n\n")
    got = tables.read_score_table(spark, str(tmp_path / "a.mem"), {"v": {"type": "float"}, "s": {"type": "str"}}).orderBy("pos_begin").collect()
    assert [(r.pos_begin, r.pos_end, r.v, r.s) for r in got] == [(10, 12, 0.5, "x"), (20, 20, None, "")]
    (tmp_path / "b.tsv").write_text("#chrom\tpos_begin\tval\nc\t9\t7\nc\t11\t-1\n")
    got = tables.read_score_table(spark, str(tmp_path / "b.tsv"), {"n": {"type": "int", "index": 2, "na": -1}}, zero_based=True).orderBy("pos_begin").collect()
    assert [(r.pos_begin, r.pos_end, r.n) for r in got] == [(10, 10, 7), (12, 12, None)]
    (tmp_path / "q.csv").write_text('chrom,pos_begin,s,v\n1,5,"a,""b""",2\n1,6,,3\n')
    got = tables.read_score_table(spark, str(tmp_path / "q.csv"), {"s": {"type": "str"}, "v": {"type": "int"}}).orderBy("pos_begin").collect()
    assert [(r.s, r.v) for r in got] == [('a,"b"', 2), ("", 3)]
    assert tables.table_format("x.vcf.gz") == "vcf_info" and tables.table_format("x.bw") == "bigwig" and tables.table_format("x") == "mem"


VCF = """##fileformat=VCFv4.2
##INFO=<ID=A,Number=1,Type=Integer,Description="Score A">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=R,Number=R,Type=String,Description="r">
##INFO=<ID=S,Number=.,Type=String,Description="s">
##INFO=<ID=FL,Number=0,Type=Flag,Description="flag">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO
1\t5\t.\tA\tT,G\t.\tPASS\tA=3;AF=0.1,0.2;R=x,y,z;S=p,,q;FL
1\t7\trs\tC\t.\t.\tPASS\tA=.;R=ref,alt
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "v.vcf").write_text(VCF)
    lines, fields = tables.read_vcf(spark, str(tmp_path / "v.vcf"))
    df, kinds = tables.vcf_scores(lines, fields)
    assert kinds == {"A": "bigint", "AF": "double", "R": "string", "S": "string", "FL": "boolean"}
    got = sorted(((r.pos_begin, r.alternative, r.A, r.AF, r.R, r.S, r.FL) for r in df.collect()), key=repr)
    assert got == [(5, "G", 3, 0.2, "z", "p|q", True), (5, "T", 3, 0.1, "y", "p|q", True), (7, None, None, None, "ref", None, False)]
    ann = tabular.read_vcf_input(spark, str(tmp_path / "v.vcf"))
    assert ann.count() == 2
    from pyspark.sql import functions as F

    (tmp_path / "v.vcf").write_text(VCF.replace("\tINFO\n", "\tINFO\tFORMAT\tme\n").replace(";FL\n", ";FL\tGT\t0/1\n").replace("R=ref,alt\n", "R=ref,alt\tGT\t./.\n"))
    ann = tabular.read_vcf_input(spark, str(tmp_path / "v.vcf"))
    scored = ann.withColumn("score", F.when(F.col("alt") == "G", 0.25)).withColumn("none", F.lit(None).cast("string"))
    tabular.write_vcf(scored, ["score", "none"], str(tmp_path / "out"), str(tmp_path / "v.vcf"))
    text = [t for f in sorted((tmp_path / "out").glob("part-*")) for t in f.read_text().splitlines()]
    given = (tmp_path / "v.vcf").read_text().splitlines()
    added = ['##INFO=<ID=score,Number=A,Type=String,Description="score">', '##INFO=<ID=none,Number=A,Type=String,Description="none">']
    # The header, ids, samples and the line without ALT are as they were.
    assert text == [*given[:6], *added, given[6], given[7].replace(";FL", ";FL;score=.,0.25"), given[8]]


def test_tabular(spark, tmp_path):
    import pytest

    (tmp_path / "i.tsv").write_text("#chrom\tpos\tref\talt\textra\n1\t5\tA\tT\tq\n1\t6\tAC\tA\tw\n")
    df = tabular.read_tabular(spark, str(tmp_path / "i.tsv"))
    assert sorted((r.ann.type, r.ann.pos_end, r.extra) for r in df.collect()) == [("SMALL_DELETION", 8, "w"), ("SUBSTITUTION", 5, "q")]
    tabular.write_tabular(df.selectExpr("chrom", "pos", "0.1D as v", "map('a', 1L) as m"), ["chrom", "pos", "v", "m"], str(tmp_path / "o"), order=["pos"])
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect() if not r.value.startswith("chrom"))
    assert got == ["1\t5\t0.1\ta:1", "1\t6\t0.1\ta:1"]
    (tmp_path / "bad.tsv").write_text("chrom\tpos\n1\tx\n1\t3\n")
    with pytest.raises(Exception, match="bad row"):
        tabular.read_tabular(spark, str(tmp_path / "bad.tsv")).collect()
    assert tabular.bad_rows(spark, str(tmp_path / "bad.tsv"), ["pos"]).count() == 1


def bigwig(rows, chrom="chr1", size=1000):
    """A file with one data block of bed graph items."""
    block = struct.pack("<IIIIIBBH", 0, rows[0][0], rows[-1][1], 0, 0, 1, 0, len(rows)) + b"".join(struct.pack("<IIf", *r) for r in rows)
    packed = zlib.compress(block)
    tree_at = 64
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 1, 8, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + chrom.encode().ljust(8, b"\0") + struct.pack("<II", 0, size)
    data_at = tree_at + len(tree)
    data = struct.pack("<I", 1) + packed
    index_at = data_at + len(data)
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 1, 1, 0, rows[0][0], 0, rows[-1][1], index_at, 1, 0) + struct.pack("<BBH", 1, 0, 1) + struct.pack("<IIIIQQ", 0, rows[0][0], 0, rows[-1][1], data_at + 4, len(packed))
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, tree_at, data_at, index_at, 0, 0, 0, 0, 1 << 15, 0)
    return head + tree + data + index


def test_bigwig(spark, tmp_path):
    rows = [(0, 10, 0.5), (10, 12, 1.5), (50, 51, -2.0)]
    (tmp_path / "x.bw").write_bytes(bigwig(rows))
    got = sorted(map(tuple, tables.read_bigwig(spark, str(tmp_path / "x.bw")).collect()))
    assert got == [("chr1", b + 1, e, v) for b, e, v in rows]
    (tmp_path / "x.bg").write_text("chr1 0 10 0.5\nchr1\t10\t12\t1.5\n")
    assert sorted(map(tuple, tables.read_bedgraph(spark, str(tmp_path / "x.bg")).collect())) == [("chr1", 1, 10, 0.5), ("chr1", 11, 12, 1.5)]


def test_region_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("1", 5, 9, 0.1), ("2", 5, 9, 0.2)], "chrom string, pos_begin bigint, pos_end bigint, v double")
    tables.convert(df, str(tmp_path / "p"))
    part = tables.in_region(spark.read.parquet(str(tmp_path / "p")), "2", 1, 6)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "LessThanOrEqual(pos_begin,6)" in plan
    assert part.count() == 1


def test_entry_points(spark):
    import os

    import pytest

    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert e.entry(spark).count() == 1500


def test_market_matrix(spark, tmp_path):
    from lociweave.sources.single_cell import read_market_matrix

    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%made\n3 2 3\n1 1 5\n3 1 2\n2 2 7\n")
    (tmp_path / "features.tsv").write_text("ENS1\tA\tGene Expression\nENS2\tB\tGene Expression\nENS3\tC\tPeaks\n")
    (tmp_path / "barcodes.tsv").write_text("AAA-1\nCCC-1\n")
    got = sorted(map(tuple, read_market_matrix(spark, str(tmp_path), "").collect()))
    assert got == [("AAA-1", "ENS1", "A", "Gene Expression", 5.0), ("AAA-1", "ENS3", "C", "Peaks", 2.0), ("CCC-1", "ENS2", "B", "Gene Expression", 7.0)]


def test_histograms_are_kept(spark, tmp_path):
    from lociweave.operators import histograms as h

    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 9.9, 10.0, 11.0, None)], "v double")
    one = h.measure(df, "v", h.NumberHistogram(0.0, 10.0, 5))
    assert (one.bars, one.out_of_range, one.least, one.greatest) == ([2, 0, 0, 0, 2], (1, 1), -1.0, 11.0)
    h.save(spark, one, str(tmp_path / "h.json"))
    two = h.load(spark, str(tmp_path / "h.json"))
    assert two == one and sorted(map(tuple, two.rows(spark).collect())) == [(-1, 1), (0, 2), (4, 2), (5, 1)]
