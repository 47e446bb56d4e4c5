import pytest
from pyspark.sql import functions as F

from lociweave.functions import sequences as S
from lociweave.functions.filters import compile_filter
from lociweave.functions.parsing import SyntaxProblem
from lociweave.functions.transforms import compile_transform
from lociweave.functions.values import parse_value, stringify, vcf_escape


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "value", "want"),
    [
        ("value * 2", 3.0, 6.0), ("1 - value", 3.0, -2.0), ("value if value > 0 else 0", -1.0, 0.0), ("min(value, 1.0)", 3.0, 1.0), ("round(value, 2)", 3.14159, 3.14), ("round(value)", 2.5, 2), ("-7 // 2 + value", 0.0, -4.0),
        ("-7 % 3 + value", 0.0, 2.0), ("7 % -3 + value", 0.0, -2.0), ("1 < value < 5", 3.0, True), ("not value", 0.0, True), ("value / 0", 1.0, None), ("abs(value)", -2.0, 2.0), ("value > 5", None, None), ("max(value, 1.0)", None, None), ("str(int(value))", 3.9, "3"),
    ],
)
def test_transforms(spark, text, value, want):
    assert one(spark, compile_transform(text, F.lit(value).cast("double"), "double")[0]) == want


@pytest.mark.parametrize("text", ["value ** 2", "__import__('os')", "value.real", "[value]", "lambda: 1", "open(value)", "value +", "x + 1", "round(value, value)"])
def test_refused_transforms(spark, text):
    with pytest.raises(SyntaxProblem):
        compile_transform(text, F.lit(1.0), "double")


def test_text_transforms(spark):
    assert one(spark, compile_transform("len(value)", F.lit("abc"), "string")[0]) == 3
    assert one(spark, compile_transform("len(value)", F.array(F.lit(1), F.lit(2)), "array")[0]) == 2
    assert one(spark, compile_transform("int(value)", F.lit("12"), "string")[0]) == 12


def test_filters_are_two_valued(spark):
    df = spark.createDataFrame([(1, 0.5, "ab"), (2, None, "b"), (3, float("nan"), None), (4, 2.0, "zb")], "id int, x double, s string")
    kinds = {"x": "double", "s": "string"}

    def ids(text):
        return [r.id for r in df.where(compile_filter(text, kinds)).orderBy("id").collect()]

    assert ids("x == 0.5") == [1]
    assert ids("not (x == 0.5)") == [2, 3, 4]
    assert ids("x > 0") == [1, 4]
    assert ids("x != 0.5") == [3, 4]
    assert ids("'b' in s and x <= 2") == [1, 4]
    assert ids("not ('a' in s)") == [2, 3, 4]
    for bad in ("y == 1", "x ==", "x", "x === 1", "x = 1", "(x > 1", "x > s"):
        with pytest.raises(SyntaxProblem):
            compile_filter(bad, kinds)


def test_values(spark):
    cases = [("1.5", "float", None, 1.5), ("NA", "float", None, None), (".", "int", None, None), ("3.5", "int", None, None), ("7", "int", [7], None), ("7.0", "float", 7, None), ("77", "int", [7], 77), ("NA", "str", None, "NA"), ("x", "float", None, None), ("yes", "bool", None, True)]
    for raw, kind, na, want in cases:
        assert one(spark, parse_value(F.lit(raw), kind, na)) == want, (raw, kind)


def test_stringify(spark):
    cases = [(0.1, "double", "0.1"), (123.456789, "double", "123.457"), (99999.9, "double", "99999.9"), (1234567.0, "double", "1.23e+06"), (0.00012345, "double", "0.000123"), (None, "double", ""), (5, "bigint", "5")]
    for v, kind, want in cases:
        assert one(spark, stringify(F.lit(v).cast(kind), kind)) == want
    assert one(spark, stringify(F.lit(True), "boolean")) == "yes" and one(spark, stringify(F.lit(False), "boolean")) == ""
    assert one(spark, stringify(F.array(F.lit("a"), F.lit("b")), "array<string>")) == "['a', 'b']"
    assert one(spark, stringify(F.create_map(F.lit("k"), F.lit(2)), "map<string,int>")) == "k:2"
    assert one(spark, vcf_escape(F.lit("a b;c,d"))) == "a_b|c|d"


def test_annotatables(spark):
    def span(ref, alt):
        r = one(spark, S.allele(F.lit("1"), F.lit(10), F.lit(ref), F.lit(alt)))
        return r.type, r.pos_end

    assert span("A", "C") == ("SUBSTITUTION", 10)
    assert span("A", "AC") == ("SMALL_INSERTION", 11)
    assert span("AC", "A") == ("SMALL_DELETION", 12)
    assert span("AC", "GT") == ("COMPLEX", 12)
    a = one(spark, S.parse_annotatable(F.lit("VCFAllele(chr1, 5,A,AT)")))
    assert (a.type, a.chrom, a.pos, a.pos_end, a.ref, a.alt) == ("SMALL_INSERTION", "chr1", 5, 6, "A", "AT")
    assert one(spark, S.parse_annotatable(F.lit("REGION(1,2,9)"))).pos_end == 9
    assert one(spark, S.parse_annotatable(F.lit("what"))) is None
    r = one(spark, S.parse_region(F.lit("chr1:1,000,000-2,000,000")))
    assert (r.chrom, r.start, r.stop) == ("chr1", 1000000, 2000000)
    assert one(spark, S.parse_region(F.lit("chr1"))).start is None


def test_layouts():
    assert S.choose_layout({"chrom": "c", "pos_beg": "b", "pos_end": "e", "cnv_type": "t"})[0] == "cnv"
    assert S.choose_layout({"chrom": "c", "pos_beg": "b", "pos_end": "e", "cnv_type": "-"})[0] == "region"
    assert S.choose_layout({"chrom": "c", "pos": "p", "ref": "r", "alt": "a"})[0] == "allele"
    assert S.choose_layout({"chrom": "c", "pos": "p"})[0] == "position"
    with pytest.raises(ValueError):
        S.choose_layout({"chrom": "c"})


def test_trims(spark):
    t = lambda f, *a: tuple(one(spark, f(*map(F.lit, a))))
    assert t(S.trim_left, 4, "GCAT", "GTGC") == (5, "CAT", "TGC")
    assert t(S.trim_right, 4, "GCATG", "GTGCG") == (4, "GCAT", "GTGC")
    assert t(S.trim_both, 4, "GCATG", "GTGCG") == (5, "CAT", "TGC")
    assert t(S.trim_parsimonious, 2, "TTT", "TT") == (2, "TT", "T")
    assert one(spark, S.reverse_complement(F.lit("aCgTx"))) == "NACGT"
