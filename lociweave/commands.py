"""Commands: annotate files through a YAML pipeline and a repository of resources.

    python -m lociweave.commands annotate_tabular in.tsv pipeline.yaml -r repository -o out
    python -m lociweave.commands annotate_vcf in.vcf pipeline.yaml -r repository -o out
    python -m lociweave.commands search -r repository "conserv*"

The session is the one that spark-submit sets up, or a local one. Output is a
folder of parts in the input's order, each tabular part with a header.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import stringify, vcf_text
from .plans import catalog as cat
from .plans import pipeline as pl
from .plans import repository
from .sources import tabular


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def _annotated(spark: SparkSession, rows: DataFrame, a: argparse.Namespace, show) -> tuple[DataFrame, list[str]]:
    """Rows with the pipeline's attributes, and the names of those to be written."""
    c = repository.load(spark, *a.repository, genome=a.reference_genome, gene_models=a.gene_models)
    new = pl.parse(_text(spark, a.pipeline), c, a.allow_repeated_attributes)
    made = [x.name for x in new.attributes() if not x.internal]
    if a.reannotate:
        old = pl.parse(_text(spark, a.reannotate), c, a.allow_repeated_attributes)
        out = pl.reannotate(rows, old, new, c, full=a.full_reannotation)
    else:
        out = pl.annotate(rows, new, c)
    return pl.printable(out, new, show=show), made


def annotate_tabular(spark: SparkSession, a: argparse.Namespace) -> None:
    columns = dict(x.split("=", 1) for x in a.columns)
    rows = tabular.read_tabular(spark, a.input, columns, a.input_separator)
    given = [c for c in rows.columns if c not in ("id", "ann")]
    if a.region:
        rows = rows.where(_in_region(a.region))
    out, made = _annotated(spark, rows, a, stringify)
    kept = [c for c in given if c not in made and c in out.columns]
    tabular.write_tabular(out, [*kept, *made], a.output, ["id"], a.output_separator or a.input_separator, a.compression, a.one_file)


def annotate_vcf(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = tabular.read_vcf_input(spark, a.input)
    if a.region:
        rows = rows.where(_in_region(a.region))
    out, made = _annotated(spark, rows, a, vcf_text)
    tabular.write_vcf(out, made, a.output, a.input)


def _in_region(region: str):
    chrom, _, span = region.replace(",", "").partition(":")
    test = F.col("ann.chrom") == chrom
    if span:
        begin, _, end = span.partition("-")
        test = test & (F.col("ann.pos") >= int(begin)) & (F.col("ann.pos") <= int(end or begin))
    return test


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    t = repository.load(spark, *a.repository).table(spark)
    for r in cat.search(t, a.term, a.type, a.query).orderBy("full_id").collect():
        print(r.full_id, r.type, r.summary, sep="\t")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lociweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    for name, run in (("annotate_tabular", annotate_tabular), ("annotate_columns", annotate_tabular), ("annotate_vcf", annotate_vcf)):
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("input")
        c.add_argument("pipeline")
        c.add_argument("-o", "--output", required=True)
        c.add_argument("-r", "--repository", action="append", required=True, help="folder of resources; may be given more than once")
        c.add_argument("-R", "--region", help="chrom or chrom:begin-end")
        c.add_argument("--reference-genome")
        c.add_argument("--gene-models")
        c.add_argument("--reannotate", help="the pipeline that made the input")
        c.add_argument("--full-reannotation", action="store_true")
        c.add_argument("--allow-repeated-attributes", action="store_true")
        if run is annotate_tabular:
            c.add_argument("--columns", nargs="*", default=[], metavar="ROLE=COLUMN")
            c.add_argument("--input-separator", default="\t")
            c.add_argument("--output-separator")
            c.add_argument("--compression", choices=["gzip"])
            c.add_argument("--one-file", action="store_true", help="one part, written by one task")
    c = commands.add_parser("search")
    c.set_defaults(run=search)
    c.add_argument("term", nargs="?")
    c.add_argument("-r", "--repository", action="append", required=True)
    c.add_argument("--type")
    c.add_argument("--query")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName(f"lociweave {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
