"""Gene scores, gene sets and gene terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aggregators

GENE_LIMIT = 200_000  # genes of a score that may travel with the plan


def gene_score_map(scores: DataFrame, gene: str, value: str) -> DataFrame:
    """gene -> value rows with missing and NaN left out, one per gene (the last by value wins nothing: equal genes keep their least)."""
    v = F.col(value).cast("double")
    return scores.where(v.isNotNull() & ~F.isnan(v) & F.col(gene).isNotNull()).groupBy(F.col(gene).alias("__gene")).agg(F.min(v).alias("__value"))


def _lists(df: DataFrame, genes: str) -> DataFrame:
    """(list, place in it, gene) of the distinct gene lists of a table: what is
    told of a list goes back to all rows that have it."""
    return df.select(F.col(genes).alias("__list")).where("__list is not null").distinct().select("__list", F.posexplode("__list").alias("__at", "__g"))


def _list_key(genes: str) -> Column:
    """128 bits that stand for a gene list in joins; null for none. A list by
    itself is as long as its genes and would travel with each of them."""
    g = F.col(genes)
    return F.when(g.isNotNull(), F.struct(F.xxhash64(g).alias("a"), F.xxhash64(F.lit("lists"), F.size(g), F.reverse(g)).alias("b")))


def annotate_gene_score(df: DataFrame, scores: DataFrame, value: str, name: str, genes: str = "genes", gene: str = "gene", aggregator: str | None = None) -> DataFrame:
    """A map gene -> value of a row's genes in list order, or its aggregate.
    Null where the row has no gene list or none of its genes has a value."""
    m = gene_score_map(scores, gene, value)
    key = _list_key(genes)
    lists = df.select(key.alias("__list"), F.array_distinct(genes).alias("__gs")).where("__gs is not null")
    # Of the score only genes that are in a list at all travel, to the lists.
    used = lists.select(F.explode("__gs").alias("__u")).distinct()
    m = F.broadcast(m.join(used, F.col("__gene") == F.col("__u"), "left_semi"))
    if aggregator not in ("max", "min"):  # those two do not count how often a list is met
        lists = lists.groupBy("__list").agg(F.any_value("__gs").alias("__gs"))
    hit = lists.select("__list", F.posexplode("__gs").alias("__at", "__g")).join(m, F.col("__g") == F.col("__gene"))
    if aggregator is None:
        items = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__g", "__value"))), lambda x: F.struct(x["__g"].alias("key"), x["__value"].alias("value")))
        told = hit.groupBy("__list").agg(F.map_from_entries(items).alias(name))
    else:
        asked = aggregators.Asked(aggregators.parse(aggregator, "double"), F.col("__value"), "double", name)
        told = aggregators.grouped(hit, ["__list"], [asked], F.lit(1), F.col("__at"))
    return df.withColumn("__key", key).join(told, F.col("__key") == F.col("__list"), "left").drop("__list", "__key")


def gene_score_range(scores: DataFrame, value: str, low: float | None = None, high: float | None = None, gene: str = "gene") -> DataFrame:
    """Genes whose value lies in [low, high]; NaN and null never do."""
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return scores.where(ok).select(F.col(gene).alias("gene")).distinct()


def gene_score_values(scores: DataFrame, value: str, wanted: list, gene: str = "gene") -> DataFrame:
    return scores.where(F.col(value).cast("double").isin([float(x) for x in wanted])).select(F.col(gene).alias("gene")).distinct()


def to_tsv(scores: DataFrame, values: list[str], path: str, gene: str = "gene") -> None:
    """Rows with a gene and at least one value."""
    scores.select(gene, *values).dropna("all", subset=values).dropna(subset=[gene]).write.option("sep", "\t").option("header", True).csv(path)


def annotate_gene_sets(df: DataFrame, sets: DataFrame, in_sets: str = "in_sets", per_set: dict[str, str] | None = None, genes: str = "genes") -> DataFrame:
    """``sets`` (set_name, gene[, ordinal]): the names of the sets that a row's
    genes meet, in collection order (else by name), and for sets in ``per_set``
    (set -> column) the genes in common, in row order. Rows with a gene list
    that meets nothing get empty lists, rows without one null."""
    order = F.col("ordinal") if "ordinal" in sets.columns else F.lit(0)
    s = sets.select(F.col("gene").alias("__sg"), "set_name", order.alias("__o")).distinct()
    hit = _lists(df, genes).join(s, F.col("__g") == F.col("__sg"))
    names = F.transform(F.array_sort(F.collect_set(F.struct("__o", "set_name"))), lambda x: x["set_name"]).alias(in_sets)
    extra = [F.transform(F.array_sort(F.collect_set(F.when(F.col("set_name") == k, F.struct("__at", "__g")))), lambda x: x["__g"]).alias(c) for k, c in (per_set or {}).items()]
    told = hit.groupBy("__list").agg(names, *extra)
    out = df.join(told, F.col(genes) == F.col("__list"), "left").drop("__list")
    empty = F.array().cast("array<string>")
    for c in [in_sets, *(per_set or {}).values()]:
        found = F.array_distinct(F.col(c))
        out = out.withColumn(c, F.when(F.col(genes).isNotNull(), F.coalesce(found, empty)))
    return out


def gene_set_statistics(sets: DataFrame) -> dict[str, DataFrame]:
    """``genes_per_set`` (most genes first, then by name), ``sets_per_gene`` and ``totals``."""
    s = sets.select("set_name", "gene").distinct()
    return {
        "genes_per_set": s.groupBy("set_name").agg(F.count("*").alias("n_genes")).orderBy(F.desc("n_genes"), "set_name"),
        "sets_per_gene": s.groupBy("gene").agg(F.count("*").alias("n_sets")).orderBy(F.desc("n_sets"), "gene"),
        "totals": s.agg(F.countDistinct("set_name").alias("n_sets"), F.countDistinct("gene").alias("n_genes"), F.count("*").alias("n_members")),
    }


def filter_terms(terms: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, term, n) for the genes of ``genes`` only."""
    return terms.join(genes.select("gene").distinct(), "gene", "left_semi")


def rename_terms(terms: DataFrame, names: DataFrame, source: str, target: str) -> DataFrame:
    """Genes from one namespace to another; a name that stands for several
    genes there, or for none, is dropped."""
    one = names.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("__s"), F.col(target).alias("__t")).distinct()
    clear = one.groupBy("__s").agg(F.count("*").alias("__n"), F.min("__t").alias("__t")).where("__n = 1")
    return terms.join(clear, F.col("gene") == F.col("__s")).groupBy(F.col("__t").alias("gene"), "term").agg(F.sum("n").cast("bigint").alias("n"))


def effect_in(groups: dict[str, list[str]], wanted: list[str]) -> list[str]:
    """Effect names with group names among them written out."""
    out: list[str] = []
    for w in wanted:
        for e in groups.get(w, [w]):
            if e not in out:
                out.append(e)
    return out


def genes_with_effect(effects: Column, wanted: list[str]) -> Column:
    """Distinct genes, sorted, of an array<struct<effect,gene,...>> column."""
    hit = F.filter(effects, lambda x: x["effect"].isin(wanted) & x["gene"].isNotNull())
    return F.array_sort(F.array_distinct(F.transform(hit, lambda x: x["gene"])))
