"""Files in, files out: a repository of five kinds of tables and a pipeline over it."""

import pytest

from lociweave import commands
from lociweave.plans import repository

from test_sources import bigwig

PIPELINE = """
- position_score: {resource_id: scores/mem, attributes: [mem_float, mem_int, mem_str, mem_by_index, mem_big]}
- position_score: {resource_id: scores/tab, attributes: [tbx_float, tbx_by_index]}
- allele_score: {resource_id: alleles, attributes: [a_score, a_label]}
- position_score: {resource_id: track, attributes: [bw_value]}
- allele_score: {resource_id: variants, attributes: [VCF_FLOAT, VCF_INT, VCF_AF, VCF_STR, VCF_STR_MULTI]}
"""
INPUT = "chrom\tpos\tref\talt\n" + "".join(f"{x}\n" for x in ("chr1\t10\tA\tT", "chr1\t11\tA\tT", "chr1\t12\tA\tT", "chr1\t99\tA\tT", "chr2\t20\tC\tG", "chr2\t21\tC\tG"))
WANT = [
    "chr1 10 A T 0.1 1 alpha 100 12345.7 0.75 7 0.9 hit 0.11 0.5 11 0.05 benign a|b",
    "chr1 11 A T 0.2 2 beta 200 100 - 8 - na_row 0.22 0.6 12 0.06 likely_pathogenic -",
    "chr1 12 A T - 3 gamma 300 100 - - - - 0.22 - - - - -",
    "chr1 99 A T - - - - - - - - - - - - - - -",
    "chr2 20 C G 0.123 4 delta 400 1e+05 0.25 9 0.7 two - 0.7 13 0.07 - x|y|z",
    "chr2 21 C G -0.0015 5 eps 500 0 - - - - - - - - - -",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("repository")

    def add(name, config, **files):
        d = top / "grr" / name
        d.mkdir(parents=True)
        (d / "genomic_resource.yaml").write_text(config)
        for k, v in files.items():
            f = d / k.replace("__", ".")
            f.write_bytes(v) if isinstance(v, bytes) else f.write_text(v)

    tsv = lambda *rows: "\n".join("\t".join(r.split()) for r in rows) + "\n"
    add(
        "scores/mem",
        "type: position_score\ntable: {filename: data.mem}\nscores:\n- {id: mem_float, type: float, column_name: s_float}\n- {id: mem_int, type: int, column_name: s_int}\n- {id: mem_str, type: str, column_name: s_str}\n- {id: mem_by_index, type: int, column_index: 5}\n- {id: mem_big, type: float, column_name: s_big}\nmeta: {summary: kept in memory, labels: {genome: hg38}}\n",
        data__mem="chrom pos_begin s_float s_int s_str s_extra s_big\nchr1 10 0.1 1 alpha 100 12345.6789\nchr1 11 0.2 2 beta 200 99.99999\nchr1 12 NA 3 gamma 300 100.0\nchr2 20 0.1234567890123456789 4 delta 400 100000.0\nchr2 21 -1.5e-3 5 eps 500 0.0\n",
    )
    add(
        "scores/tab",
        "type: position_score\ntable: {filename: data.txt, format: tabix, chrom_mapping: {add_prefix: chr}}\nscores:\n- {id: tbx_float, type: float, column_name: tbx_float}\n- {id: tbx_by_index, type: int, column_index: 4}\n",
        data__txt=tsv("#chrom pos_begin pos_end tbx_float tbx_extra", "1 10 10 0.75 7", "1 11 11 NA 8", "2 20 20 0.25 9"),
    )
    add(
        "alleles",
        "type: allele_score\ntable: {filename: data.txt, format: tabix, chrom_mapping: {add_prefix: chr}}\nscores:\n- {id: a_score, type: float, column_name: a_score}\n- {id: a_label, type: str, column_index: 6}\n",
        data__txt=tsv("#chrom pos_begin pos_end reference alternative a_score a_label", "1 10 10 A T 0.9 hit", "1 10 10 A C 0.8 wrong_alt", "1 11 11 A T NA na_row", "2 20 20 C G 0.7 two"),
    )
    add("track", "type: position_score\ntable: {filename: x.bw}\nscores:\n- {id: bw_value, type: float}\n", x__bw=bigwig([(0, 10, 0.11), (10, 20, 0.22)]))
    add(
        "variants",
        "type: allele_score\ntable: {filename: v.vcf}\n",
        v__vcf="".join(f"##INFO=<ID={i},Number={n},Type={t},Description=\"\">\n" for i, n, t in (("VCF_FLOAT", "1", "Float"), ("VCF_INT", "1", "Integer"), ("VCF_AF", "A", "Float"), ("VCF_STR", "1", "String"), ("VCF_STR_MULTI", ".", "String")))
        + tsv("#CHROM POS ID REF ALT QUAL FILTER INFO", "chr1 10 . A T . . VCF_FLOAT=0.5;VCF_INT=11;VCF_AF=0.05;VCF_STR=benign;VCF_STR_MULTI=a,b", "chr1 11 . A T . . VCF_FLOAT=0.6;VCF_INT=12;VCF_AF=0.06;VCF_STR=likely_pathogenic", "chr2 20 . C G . . VCF_FLOAT=0.7;VCF_INT=13;VCF_AF=0.07;VCF_STR_MULTI=x,y,z"),
    )
    (top / "in.tsv").write_text(INPUT)
    (top / "in.csv").write_text(INPUT.replace("\t", ","))
    (top / "p.yaml").write_text(PIPELINE)
    (top / "in.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\t10\trs1\tA\tC,T\t.\tPASS\tQ=1\nchr1\t11\trs2\tA\t.\t.\t.\t.\n")
    return top


def lines(path):
    return [t for f in sorted(path.glob("part-*")) for t in f.read_text().splitlines()]


def test_tabular(spark, folder, tmp_path):
    commands.main(["annotate_tabular", f"{folder}/in.tsv", f"{folder}/p.yaml", "-r", f"{folder}/grr", "-o", f"{tmp_path}/out"], spark)
    got = [t for t in lines(tmp_path / "out") if not t.startswith("chrom\t")]
    assert got == ["\t".join("" if c == "-" else c for c in w.split(" ")) for w in WANT]
    commands.main(["annotate_columns", f"{folder}/in.csv", f"{folder}/p.yaml", "-r", f"{folder}/grr", "-o", f"{tmp_path}/csv", "--input-separator", ",", "-R", "chr1:11-99", "--one-file"], spark)
    assert len(list((tmp_path / "csv").glob("part-*"))) == 1
    got = [t for t in lines(tmp_path / "csv") if not t.startswith("chrom,")]
    assert got == [",".join("" if c == "-" else c for c in w.split(" ")) for w in WANT[1:4]]


def test_vcf(spark, folder, tmp_path):
    (tmp_path / "p.yaml").write_text("- allele_score: {resource_id: alleles, attributes: [a_score, a_label]}\n- position_score: {resource_id: scores/mem, attributes: [mem_str]}\n")
    (tmp_path / "in.vcf").write_text((folder / "in.vcf").read_text() + "chr1\t10\t.\tAC\tA\t.\t.\t.\n")
    commands.main(["annotate_vcf", f"{tmp_path}/in.vcf", f"{tmp_path}/p.yaml", "-r", f"{folder}/grr", "-o", f"{tmp_path}/out"], spark)
    got = lines(tmp_path / "out")
    assert got[-3:] == ["chr1\t10\trs1\tA\tC,T\t.\tPASS\tQ=1;a_score=0.8,0.9;a_label=wrong_alt,hit;mem_str=alpha,alpha", "chr1\t11\trs2\tA\t.\t.\t.\t.", "chr1\t10\t.\tAC\tA\t.\t.\tmem_str=alpha|beta|gamma"]
    assert got[0] == "##fileformat=VCFv4.2" and got[4].startswith("#CHROM")


def test_reannotation(spark, folder, tmp_path):
    old, new = "- position_score: {resource_id: scores/mem, attributes: [mem_float]}\n", "- position_score: {resource_id: scores/mem, attributes: [mem_int]}\n"
    (tmp_path / "old.yaml").write_text(old)
    (tmp_path / "new.yaml").write_text(new)
    common = ["-r", f"{folder}/grr"]
    commands.main(["annotate_tabular", f"{folder}/in.tsv", f"{tmp_path}/old.yaml", *common, "-o", f"{tmp_path}/one"], spark)
    commands.main(["annotate_tabular", f"{tmp_path}/one", f"{tmp_path}/new.yaml", *common, "-o", f"{tmp_path}/two", "--reannotate", f"{tmp_path}/old.yaml"], spark)
    got = lines(tmp_path / "two")
    assert got[0] == "chrom\tpos\tref\talt\tmem_int" and "chr1\t10\tA\tT\t1" in got


def test_search(spark, folder, capsys, tmp_path):
    commands.main(["search", "-r", f"{folder}/grr", "memor*", "--query", "*[genome=hg38]"], spark)
    assert capsys.readouterr().out == "scores/mem\tposition_score\tkept in memory\n"
    with pytest.raises(ValueError):
        repository.load(spark, str(tmp_path))


def test_manifests(spark, folder, tmp_path):
    import hashlib
    import shutil

    shutil.copytree(folder / "grr", tmp_path / "grr")
    one = repository.manifest(spark, f"{tmp_path}/grr")
    kept = [tuple(r) for r in one.collect()]
    data = (tmp_path / "grr/scores/mem/data.mem").read_bytes()
    assert ("scores/mem/data.mem", len(data), hashlib.md5(data).hexdigest()) in kept and len(kept) == 10
    old = spark.createDataFrame(kept, one.schema)
    (tmp_path / "grr/scores/mem/data.mem").write_text("x")
    (tmp_path / "grr/track/x.bw").unlink()
    (tmp_path / "grr/new.txt").write_text("y")
    got = {r.path: r.change for r in repository.changed(old, repository.manifest(spark, f"{tmp_path}/grr")).collect()}
    assert got == {"scores/mem/data.mem": "CHANGED", "track/x.bw": "DELETED", "new.txt": "ADDED"}
