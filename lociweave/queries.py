"""Every operator as a query over the driver's tables, with its SQL twin.

The tables hold no genomes, so each is read as one by whole-number expressions
that mean the same in both engines: orders are annotatables, events a position
score without overlaps, line items fragments, parts alleles and genes,
suppliers and customers regions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sequences as S
from .functions.filters import compile_filter
from .functions.transforms import compile_transform
from .functions.values import parse_value
from .operators import effects, genes, genome, histograms, regions, transcripts
from .operators import scores as sc
from .plans import catalog as cat
from .plans import pipeline as pl
from .sources import models, tables, tabular
from .shared import fresh_path, kept
from .streaming.annotate import annotate_stream, to_files

# --- the tables as genomic data: Spark ---------------------------------------


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def annotatables(spark: SparkSession, d: str) -> DataFrame:
    return _as_annotatables(_t(spark, d, "orders"))


def _as_annotatables(orders: DataFrame) -> DataFrame:
    o = orders.selectExpr("o_orderkey as id", "concat('chr', o_orderkey % 6) as chrom", "1 + (o_orderkey * 7919) % 43200 as pos", "o_custkey % 50 as width")
    return o.select("id", S.region(F.col("chrom"), F.col("pos"), F.col("pos") + F.col("width")).alias("ann"))


def substitutions(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").selectExpr("o_orderkey as id", "concat('chr', o_orderkey % 6) as chrom", "1 + (o_orderkey * 7919) % 43200 as pos", "substring('ACGT', cast(1 + o_orderkey % 4 as int), 1) as ref", "substring('CGTA', cast(1 + o_orderkey % 4 as int), 1) as alt")
    return o.select("id", S.allele(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("ann"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").selectExpr("concat('chr', user_id % 5) as chrom", "timestampdiff(MINUTE, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) + 1 as pos", "event_id", "case when event_id % 7 = 0 then null else value end as value", "event_type as label")
    first = e.groupBy("chrom", "pos").agg(F.min_by(F.struct("value", "label"), "event_id").alias("x"))
    w = Window.partitionBy("chrom").orderBy("pos")
    return first.select("chrom", F.col("pos").alias("pos_begin"), F.least(F.lead("pos").over(w) - 1, F.col("pos") + 9).alias("pos_end"), "x.value", "x.label")


def position_score(spark: SparkSession, d: str) -> sc.Score:
    return sc.Score("position", _runs(spark, d), {"value": "double", "label": "string"})


def fragment_score(spark: SparkSession, d: str) -> sc.Score:
    f = _t(spark, d, "lineitem").selectExpr("concat('chr', l_partkey % 5) as chrom", "1 + (l_orderkey * 37 + l_partkey * 11) % 43200 as pos_begin", "(l_orderkey * 37 + l_partkey * 11) % 43200 + cast(l_quantity as bigint) as pos_end", "l_discount as freq", "l_returnflag as status")
    return sc.Score("fragment", f, {"freq": "double", "status": "string"})


def allele_score(spark: SparkSession, d: str) -> sc.Score:
    p = _t(spark, d, "part").selectExpr("concat('chr', p_partkey % 5) as chrom", "1 + (p_partkey * 7919) % 43200 as pos_begin", "1 + (p_partkey * 7919) % 43200 as pos_end", "substring('ACGT', cast(1 + p_partkey % 4 as int), 1) as reference", "substring('CGTA', cast(1 + p_partkey % 4 as int), 1) as alternative", "p_retailprice as price", "cast(p_size as bigint) as size", "p_partkey")
    return sc.Score("allele", p, {"price": "double", "size": "bigint"}, order=("p_partkey",))


def gene_lists(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").selectExpr("o_orderkey as id", "array(concat('g', o_custkey % 97), concat('g', o_orderkey % 89)) as gs", "o_orderkey % 11 as r")
    return o.select("id", F.when(F.col("r") != 0, F.array_distinct("gs")).alias("gene_list"))


def gene_scores(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").selectExpr("concat('g', p_partkey) as gene", "p_retailprice as price", "cast(p_size as double) as size")


def gene_sets(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").selectExpr("p_type as set_name", "concat('g', p_partkey % 97) as gene").distinct()


def models_of(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of three exons from parts; every fifth does not code."""
    p = _t(spark, d, "part").selectExpr("concat('t', p_partkey) as tr_id", "concat('g', p_partkey % 97) as gene", "concat('chr', p_partkey % 5) as chrom", "case when p_partkey % 2 = 0 then '+' else '-' end as strand", "1 + (p_partkey * 7919) % 43200 as b", "p_partkey % 5 as k")
    exon = lambda i: F.struct((F.col("b") + 60 * i).cast("bigint").alias("start"), (F.col("b") + 60 * i + 29).cast("bigint").alias("stop"), F.lit(-1).alias("frame"))
    out = p.select(
        "tr_id", F.col("tr_id").alias("tr_name"), "gene", "chrom", "strand", F.col("b").alias("tx_begin"), (F.col("b") + 149).alias("tx_end"), F.when(F.col("k") == 0, F.col("b") + 149).otherwise(F.col("b") + 10).alias("cds_begin"),
        F.when(F.col("k") == 0, F.col("b")).otherwise(F.col("b") + 135).alias("cds_end"), F.array(exon(0), exon(1), exon(2)).alias("exons"), F.create_map().cast("map<string,string>").alias("attributes"),
    )
    return out


def sequence(spark: SparkSession, d: str) -> DataFrame:
    """Five contigs of 43,500 bases in chunks, base k a function of k."""
    c = spark.range(5).selectExpr("concat('chr', id) as chrom", "id as c").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(42))))
    base = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.substring(F.lit("ACGT"), (F.pmod((F.col("chunk") * 1024 + i) * (F.col("c") + 3) + F.floor((F.col("chunk") * 1024 + i) / 7), F.lit(4)) + 1).cast("int"), F.lit(1)))
    return c.select("chrom", F.col("chunk").cast("bigint").alias("chunk"), F.concat_ws("", base).alias("seq"))


def region_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = _t(spark, d, "customer").selectExpr("concat('chr', c_custkey % 3) as chrom", "1 + (c_custkey * 7919) % 20000 as start", "1 + (c_custkey * 7919) % 20000 + c_custkey % 23 as stop")
    b = _t(spark, d, "part").selectExpr("concat('chr', p_partkey % 3) as chrom", "1 + (p_partkey * 104729) % 20000 as start", "1 + (p_partkey * 104729) % 20000 + p_size as stop")
    return a, b


# --- the same in SQL ------------------------------------------------------------

ANN = "ann as (select o_orderkey as id, 'chr' || (o_orderkey % 6) as chrom, 1 + (o_orderkey * 7919) % 43200 as pos, 1 + (o_orderkey * 7919) % 43200 + o_custkey % 50 as pos_end, substr('ACGT', cast(1 + o_orderkey % 4 as int), 1) as ref, substr('CGTA', cast(1 + o_orderkey % 4 as int), 1) as alt from orders)"
POS = """ev as (select 'chr' || (user_id % 5) as chrom, date_diff('minute', timestamp '2024-01-01', ts) + 1 as pos, event_id, case when event_id % 7 = 0 then null else value end as value, event_type as label from events),
    ev1 as (select *, row_number() over (partition by chrom, pos order by event_id) as rn from ev),
    runs as (select chrom, pos as pos_begin, least(lead(pos) over (partition by chrom order by pos) - 1, pos + 9) as pos_end, value, label from ev1 where rn = 1)"""
HITS = f"""{ANN}, {POS}, hits as (select a.id, r.pos_begin, r.value, r.label, least(a.pos_end, r.pos_end) - greatest(a.pos, r.pos_begin) + 1 as w
    from ann a join runs r on a.chrom = r.chrom and a.pos <= r.pos_end and a.pos_end >= r.pos_begin)"""
FRAG = "frag as (select 'chr' || (l_partkey % 5) as chrom, 1 + (l_orderkey * 37 + l_partkey * 11) % 43200 as pos_begin, (l_orderkey * 37 + l_partkey * 11) % 43200 + cast(l_quantity as bigint) as pos_end, l_discount as freq, l_returnflag as status from lineitem)"
ALLELE = "al as (select 'chr' || (p_partkey % 5) as chrom, 1 + (p_partkey * 7919) % 43200 as pos_begin, substr('ACGT', cast(1 + p_partkey % 4 as int), 1) as reference, substr('CGTA', cast(1 + p_partkey % 4 as int), 1) as alternative, p_retailprice as price, cast(p_size as bigint) as size, p_partkey from part)"
REG = "a as (select 'chr' || (c_custkey % 3) as chrom, 1 + (c_custkey * 7919) % 20000 as start, 1 + (c_custkey * 7919) % 20000 + c_custkey % 23 as stop from customer), b as (select 'chr' || (p_partkey % 3) as chrom, 1 + (p_partkey * 104729) % 20000 as start, 1 + (p_partkey * 104729) % 20000 + p_size as stop from part)"
GENES = "gl as (select o_orderkey as id, case when o_orderkey % 11 <> 0 then ['g' || (o_custkey % 97), 'g' || (o_orderkey % 89)] end as gs from orders), g as (select id, unnest(gs) as gene, generate_subscripts(gs, 1) as o from gl where gs is not null), gu as (select id, gene, min(o) as o from g group by id, gene)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# --- position scores -------------------------------------------------------------


def _region(agg: str, source: str, out: Callable, sql: str) -> None:
    name = f"pos_region_{agg.split('(')[0]}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = sc.annotate_position(annotatables(spark, d), position_score(spark, d), [sc.Attribute(source, "v", agg)])
        return df.select("id", out(F.col("v")).alias("v"))

    run.__name__ = name
    query(f"with {HITS}, told as (select id, {sql} as v from hits group by id) select ann.id, told.v from ann left join told using (id)")(run)


_WEIGHED = "(select label, sum(w) as n from hits h where h.id = hits.id group by label)"
_region("mean", "value", lambda c: F.round(c, 9), "round(sum(value * w) / nullif(sum(case when value is not null then w end), 0), 9)")
_region("max", "value", lambda c: c, "max(value)")
_region("min", "value", lambda c: c, "min(value)")
_region("count", "value", lambda c: c, "cast(nullif(sum(case when value is not null then w end), 0) as bigint)")
_region("bool", "value", lambda c: c, "count(value) > 0")
_region("concatenate", "label", lambda c: c, "string_agg(repeat(label, cast(w as int)), '' order by pos_begin)")
_region("join(;)", "label", lambda c: c, "string_agg(rtrim(repeat(label || ';', cast(w as int)), ';'), ';' order by pos_begin)")
_region("list", "label", lambda c: F.array_join(c, ","), "string_agg(rtrim(repeat(label || ',', cast(w as int)), ','), ',' order by pos_begin)")


@query(f"with {HITS}, told as (select id, median(value) as v from (select id, value, unnest(range(w)) from hits where value is not null) group by id) select ann.id, round(told.v, 9) as v from ann left join told using (id)")
def pos_region_median(spark: SparkSession, d: str) -> DataFrame:
    df = sc.annotate_position(annotatables(spark, d), position_score(spark, d), [sc.Attribute("value", "v", "median")])
    return df.select("id", F.round("v", 9).alias("v"))


_BY_LABEL = f"with {HITS}, n as (select id, label, sum(w) as n from hits group by id, label)"


@query(f"{_BY_LABEL}, told as (select id, label as v from (select *, row_number() over (partition by id order by n desc, label) as k from n) where k = 1) select ann.id, told.v from ann left join told using (id)")
def pos_region_mode(spark: SparkSession, d: str) -> DataFrame:
    return sc.annotate_position(annotatables(spark, d), position_score(spark, d), [sc.Attribute("label", "v", "mode")]).select("id", "v")


@query(f"{_BY_LABEL}, told as (select id, string_agg(label || ':' || cast(n as bigint), ';' order by label) as v from n group by id) select ann.id, told.v from ann left join told using (id)")
def pos_region_value_count(spark: SparkSession, d: str) -> DataFrame:
    df = sc.annotate_position(annotatables(spark, d), position_score(spark, d), [sc.Attribute("label", "v", "value_count")])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("v")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ";")
    return df.select("id", shown.alias("v"))


@query(f"with {HITS}, told as (select id, round(sum(value * w) / nullif(sum(case when value is not null then w end), 0), 9) as mean_value, max(value) as max_value, cast(nullif(sum(case when value is not null then w end), 0) as bigint) as bases from hits group by id) select ann.id, mean_value, max_value, bases from ann left join told using (id)")
def pos_region_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    asked = [sc.Attribute("value", "mean_value"), sc.Attribute("value", "max_value", "max"), sc.Attribute("value", "bases", "count")]
    df = sc.annotate_position(annotatables(spark, d), position_score(spark, d), asked)
    return df.select("id", F.round("mean_value", 9).alias("mean_value"), "max_value", "bases")


@query(f"with {ANN}, {POS} select ann.id, r.value, r.label from ann left join runs r on ann.chrom = r.chrom and ann.pos between r.pos_begin and r.pos_end")
def pos_point(spark: SparkSession, d: str) -> DataFrame:
    df = sc.annotate_position(substitutions(spark, d), position_score(spark, d), [sc.Attribute("value"), sc.Attribute("label", "label", "mode")])
    return df.select("id", "value", "label")


@query(f"with {HITS} select id, cast(greatest(pos_begin, pos) as bigint) as seg_begin, cast(w as bigint) as weight, value from hits join ann using (id)")
def pos_segments(spark: SparkSession, d: str) -> DataFrame:
    r = annotatables(spark, d).select("id", "ann.chrom", F.col("ann.pos").alias("begin"), F.col("ann.pos_end").alias("end"))
    return sc.region_segments(r, position_score(spark, d), ["value"]).select("id", "seg_begin", "weight", "value")


@query(f"with {HITS}, told as (select id, sum(value * w) as s, sum(case when value is not null then w end) as n from hits group by id) select ann.id, round((coalesce(s, 0) + 0.5 * (pos_end - pos + 1 - coalesce(n, 0))) / (pos_end - pos + 1), 9) as v from ann left join told using (id)")
def pos_gap_mean_replacement(spark: SparkSession, d: str) -> DataFrame:
    r = annotatables(spark, d).select("id", "ann.chrom", F.col("ann.pos").alias("begin"), F.col("ann.pos_end").alias("end"))
    df = sc.aggregate_gap_aware(r, position_score(spark, d), sc.Attribute("value", "v", "mean"), 0.5)
    return df.select("id", F.round("v", 9).alias("v"))


@query(f"""with {POS}, bins as (select k, greatest(k * 1000 + 1, 501) as bin_begin, least((k + 1) * 1000, 40250) as bin_end from range(0, 41) t(k)),
    hit as (select k, value, least(bin_end, pos_end) - greatest(bin_begin, pos_begin) + 1 as w from bins join runs on chrom = 'chr1' and bin_begin <= pos_end and bin_end >= pos_begin),
    told as (select k, round(sum(value * w) / nullif(sum(case when value is not null then w end), 0), 9) as v from hit group by k)
    select bin_begin, bin_end, v from bins left join told using (k)""")
def pos_bins(spark: SparkSession, d: str) -> DataFrame:
    df = sc.aggregate_bins(position_score(spark, d), "chr1", 501, 40250, 1000, sc.Attribute("value", "v", "mean"))
    return df.select("bin_begin", "bin_end", F.round("v", 9).alias("v"))


@query(f"with {ANN}, {POS}, p as (select id, chrom, unnest(range(pos, pos_end + 1)) as pos from ann) select p.id, p.pos, r.value from p left join runs r on p.chrom = r.chrom and p.pos between r.pos_begin and r.pos_end")
def pos_plane(spark: SparkSession, d: str) -> DataFrame:
    """One row per base."""
    r = annotatables(spark, d).select("id", "ann.chrom", F.col("ann.pos").alias("begin"), F.col("ann.pos_end").alias("end"))
    return sc.positions(r, position_score(spark, d), ["value"])


@query(f"with {POS} select chrom, cast(max(pos_end) as bigint) as length from runs group by chrom")
def score_contigs(spark: SparkSession, d: str) -> DataFrame:
    return sc.contigs(position_score(spark, d))


# --- alleles and fragments --------------------------------------------------------


@query(f"with {ANN}, {ALLELE}, f as (select *, row_number() over (partition by chrom, pos_begin, reference, alternative order by p_partkey) as k from al) select ann.id, f.price, f.size from ann left join f on f.k = 1 and ann.chrom = f.chrom and ann.pos = f.pos_begin and ann.ref = f.reference and ann.alt = f.alternative")
def allele_exact(spark: SparkSession, d: str) -> DataFrame:
    return sc.annotate_allele(substitutions(spark, d), allele_score(spark, d), [sc.Attribute("price"), sc.Attribute("size")]).select("id", "price", "size")


@query(f"""with {ANN}, {ALLELE}, h as (select ann.id, al.*, price > 1200 and not (size < 10) as keep from ann join al on ann.chrom = al.chrom and al.pos_begin between ann.pos and ann.pos_end),
    told as (select id, max(price) filter (where keep) as price, cast(nullif(count(size) filter (where keep), 0) as bigint) as n, coalesce(string_agg(distinct chrom || ':' || pos_begin || ':' || reference || ':' || alternative, ',' order by chrom || ':' || pos_begin || ':' || reference || ':' || alternative) filter (where keep), '') as alleles from h group by id)
    select ann.id, price, n, alleles from ann left join told using (id)""")
def allele_region_filter(spark: SparkSession, d: str) -> DataFrame:
    asked = [sc.Attribute("price"), sc.Attribute("size", "n", "count"), sc.Attribute("allele", "alleles")]
    df = sc.annotate_allele(annotatables(spark, d), allele_score(spark, d), asked, mode="region", record_filter="price > 1200 and not (size < 10)")
    return df.select("id", "price", "n", F.array_join("alleles", ",").alias("alleles"))


@query(f"with {ALLELE} select pos_begin as pos, price from al where chrom = 'chr2' and pos_begin between 1000 and 30000")
def allele_points(spark: SparkSession, d: str) -> DataFrame:
    return sc.allele_points(allele_score(spark, d), ["price"], "chr2", 1000, 30000)


@query(f"with {ANN}, {FRAG}, h as (select ann.id, count(*) as n from ann join frag f on ann.chrom = f.chrom and ann.pos <= f.pos_end and ann.pos_end >= f.pos_begin group by ann.id) select ann.id, coalesce(n, 0) as n from ann left join h using (id)")
def fragment_count(spark: SparkSession, d: str) -> DataFrame:
    return sc.annotate_fragment(annotatables(spark, d), fragment_score(spark, d), [], count_as="n").select("id", "n")


@query(f"""with {ANN}, {FRAG}, h as (select ann.id, count(*) as n, max(freq) as freq, string_agg(distinct status, ',' order by status) as status from ann join frag f on ann.chrom = f.chrom and ann.pos <= f.pos_end and ann.pos_end >= f.pos_begin and (freq < 0.05 or status = 'R') group by ann.id)
    select ann.id, coalesce(n, 0) as n, freq, status from ann left join h using (id)""")
def fragment_filter_agg(spark: SparkSession, d: str) -> DataFrame:
    asked = [sc.Attribute("freq"), sc.Attribute("status", "status", "value_count")]
    df = sc.annotate_fragment(annotatables(spark, d), fragment_score(spark, d), asked, record_filter="freq < 0.05 or status == 'R'", count_as="n")
    return df.select("id", "n", "freq", F.array_join(F.array_sort(F.map_keys("status")), ",").alias("status"))


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where not (l_discount > 0.05) and contains(l_returnflag || l_linestatus, 'O') or l_quantity >= 45")
def record_filter(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").withColumn("both", F.concat("l_returnflag", "l_linestatus"))
    test = compile_filter("not (l_discount > 0.05) and 'O' in both or l_quantity >= 45", {"l_discount": "double", "both": "string", "l_quantity": "double"})
    return li.where(test).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


# --- genes ------------------------------------------------------------------------


@query(f"with {GENES}, s as (select 'g' || p_partkey as gene, p_retailprice as price from part), told as (select id, string_agg(gene || ':' || cast(cast(round(price * 100) as bigint) as varchar), ';' order by o) as prices, max(price) as top from gu join s using (gene) group by id) select gl.id, prices, top from gl left join told using (id)")
def gene_score_join(spark: SparkSession, d: str) -> DataFrame:
    df = genes.annotate_gene_score(gene_lists(spark, d), gene_scores(spark, d), "price", "m", genes="gene_list")
    df = genes.annotate_gene_score(df, gene_scores(spark, d), "price", "top", genes="gene_list", aggregator="max")
    shown = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], F.round(e["value"] * 100).cast("bigint").cast("string"))), ";")
    return df.select("id", shown.alias("prices"), "top")


@query(f"""with {GENES}, s as (select distinct p_type as set_name, 'g' || (p_partkey % 97) as gene from part),
    told as (select id, string_agg(distinct set_name, ',' order by set_name) as in_sets from gu join s using (gene) group by id)
    select gl.id, case when gs is not null then coalesce(in_sets, '') end as in_sets from gl left join told using (id)""")
def gene_set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return genes.annotate_gene_sets(gene_lists(spark, d), gene_sets(spark, d), genes="gene_list").select("id", F.array_join("in_sets", ",").alias("in_sets"))


@query("select 'g' || p_partkey as gene from part where p_retailprice between 910 and 950")
def gene_score_range(spark: SparkSession, d: str) -> DataFrame:
    return genes.gene_score_range(gene_scores(spark, d), "price", 910, 950)


@query("with s as (select distinct p_type as set_name, 'g' || (p_partkey % 97) as gene from part) select set_name, count(*) as n_genes from s group by 1")
def gene_set_statistics(spark: SparkSession, d: str) -> DataFrame:
    return genes.gene_set_statistics(gene_sets(spark, d))["genes_per_set"]


_TX = "tx as (select 't' || p_partkey as tr_id, 'g' || (p_partkey % 97) as gene, 'chr' || (p_partkey % 5) as chrom, 1 + (p_partkey * 7919) % 43200 as b, p_partkey % 5 as k from part)"


@query(f"""with {ANN}, {_TX}, h as (select ann.id, gene, case
        when k = 0 then 3
        when (pos <= b + 29 and pos_end >= b + 10) or (pos <= b + 89 and pos_end >= b + 60) or (pos <= b + 135 and pos_end >= b + 120) then 0
        when (pos <= b + 59 and pos_end >= b + 30) or (pos <= b + 119 and pos_end >= b + 90) then 1
        else 2 end as r from ann join tx on ann.chrom = tx.chrom and pos <= b + 149 and pos_end >= b),
    n(r, name) as (values (0, 'coding'), (1, 'inter-coding_intronic'), (2, 'peripheral'), (3, 'noncoding')),
    u as (select distinct id, r, gene from h),
    told as (select id, min(r) as r, string_agg(gene || ':' || name, '|' order by r, gene) as gene_effects from u join n using (r) group by id)
    select ann.id, case when told.id is null then 'intergenic' else n.name end as worst_effect, coalesce(gene_effects, '') as gene_effects from ann left join told using (id) left join n on n.r = told.r""")
def simple_effect(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.annotate_simple_effects(annotatables(spark, d), models_of(spark, d), wanted=["worst_effect", "gene_effects"]).select("id", "worst_effect", "gene_effects")


@query(f"with {_TX} select chrom, count(*) as n_transcripts, count(*) filter (where k <> 0) as n_coding_transcripts, count(distinct gene) as n_genes, count(distinct case when k <> 0 then gene end) as n_coding_genes from tx group by grouping sets ((chrom), ())")
def gene_model_statistics(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.model_statistics(models_of(spark, d))


@query(f"""with {_TX} select tr_id, case when k = 0 then 0 else 66 end as cds_length, case when k = 0 then 0 when tr_n % 2 = 0 then 10 else 14 end as utr5, case when k = 0 then '-1,-1,-1' when tr_n % 2 = 0 then '0,2,2' else '1,1,0' end as frames
    from (select *, cast(substr(tr_id, 2) as int) as tr_n from tx)""")
def transcript_frames(spark: SparkSession, d: str) -> DataFrame:
    m = transcripts.with_frames(models_of(spark, d))
    return m.select(
        "tr_id", transcripts.length_of(transcripts.cds_regions()).cast("int").alias("cds_length"), transcripts.length_of(transcripts.utr5_regions()).cast("int").alias("utr5"), F.array_join(F.transform("exons", lambda e: e["frame"].cast("string")), ",").alias("frames")
    )


# What a substitution does to the transcripts of ``models_of``, from where it lies in them.
_EFFECTS = f"""with {ANN}, tx as (select 't' || p_partkey as tr_id, 'g' || (p_partkey % 97) as gene, 'chr' || (p_partkey % 5) as chrom, p_partkey % 5 as c, p_partkey % 2 = 0 as plus, 1 + (p_partkey * 7919) % 43200 as b, p_partkey % 5 = 0 as silent from part),
    hit as (select ann.id, alt, tx.*, pos - b as r from ann join tx on ann.chrom = tx.chrom and pos between b - 100 and b + 249),
    code as (select *, case when r between 10 and 29 then r - 10 when r between 60 and 89 then r - 40 when r between 120 and 135 then r - 70 end as lo from hit),
    read as (select *, case when plus then lo else 65 - lo end as rd from code),
    sites as (select *, [case when plus then (rd // 3) * 3 + i else 65 - (rd // 3) * 3 - i end for i in [0, 1, 2]] as offs from read),
    bases as (select *, [translate(substr('ACGT', cast(((b + o - 1) * (c + 3) + (b + o - 1) // 7) % 4 as int) + 1, 1), case when plus then '' else 'ACGT' end, case when plus then '' else 'TGCA' end) for o in [case when g < 20 then g + 10 when g < 50 then g + 40 else g + 70 end for g in offs]] as old,
        translate(alt, case when plus then '' else 'ACGT' end, case when plus then '' else 'TGCA' end) as own from sites),
    changed as (select *, [case when i - 1 = rd % 3 then own else old[i] end for i in [1, 2, 3]] as new from bases),
    acids as (select *, rd // 3 + 1 as prot,
        substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', 16 * (strpos('TCAG', old[1]) - 1) + 4 * (strpos('TCAG', old[2]) - 1) + strpos('TCAG', old[3]), 1) as was,
        substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', 16 * (strpos('TCAG', new[1]) - 1) + 4 * (strpos('TCAG', new[2]) - 1) + strpos('TCAG', new[3]), 1) as becomes from changed),
    named as (select *, case
        when plus and r < 0 or not plus and r > 149 then 'promoter'
        when r < 0 or r > 149 then null
        when silent then case when r between 30 and 59 or r between 90 and 119 then 'non-coding-intron' else 'non-coding' end
        when r in (30, 31, 58, 59, 90, 91, 118, 119) then 'splice-site'
        when lo is not null then case
            when prot = 1 and old <> new then 'noStart'
            when prot = 22 and not (was = '*' and becomes = '*') then case when becomes = '*' then '3''UTR' else 'noEnd' end
            when becomes = '*' and was <> '*' then 'nonsense'
            when becomes <> was then 'missense' else 'synonymous' end
        when r < 10 then case when plus then '5''UTR' else '3''UTR' end
        when r > 135 then case when plus then '3''UTR' else '5''UTR' end
        else 'intron' end as effect from acids),
    full_names(x, y) as (values ('F', 'Phe'), ('L', 'Leu'), ('S', 'Ser'), ('Y', 'Tyr'), ('C', 'Cys'), ('W', 'Trp'), ('P', 'Pro'), ('H', 'His'), ('Q', 'Gln'), ('R', 'Arg'), ('I', 'Ile'), ('M', 'Met'), ('T', 'Thr'), ('N', 'Asn'), ('K', 'Lys'), ('V', 'Val'), ('A', 'Ala'), ('D', 'Asp'), ('E', 'Glu'), ('G', 'Gly'), ('*', 'End')),
    ranks(effect, severity) as (values ('splice-site', 23), ('nonsense', 21), ('noStart', 19), ('noEnd', 18), ('missense', 17), ('synonymous', 14), ('3''UTR', 11), ('5''UTR', 10), ('intron', 9), ('non-coding', 8), ('promoter', 5), ('non-coding-intron', 4)),
    told as (select id, tr_id, gene, n.effect, severity, case n.effect
        when 'promoter' then cast(case when plus then -r else r - 149 end as varchar)
        when 'non-coding' then 'None' when 'non-coding-intron' then 'None/2[None]' when 'splice-site' then 'None/None' when 'noStart' then '22' when 'noEnd' then '22'
        when 'nonsense' then prot || '/22(' || a.y || '->' || z.y || ')' when 'missense' then prot || '/22(' || a.y || '->' || z.y || ')' when 'synonymous' then prot || '/22'
        when 'intron' then (case when (r < 60) = plus then 1 else 2 end) || '/2[' || (case when r < 60 then least(r - 30, 59 - r) else least(r - 90, 119 - r) end + 1) || ']'
        else case when r < 10 then cast(10 - r as varchar) when r > 135 then cast(r - 135 as varchar) else 'None' end end as details
        from named n join ranks using (effect) left join full_names a on a.x = was left join full_names z on z.x = becomes),
    pairs as (select id, gene, effect, min(lpad(cast(100 - severity as varchar), 3, '0') || tr_id) as k from told group by all),
    ge as (select id, string_agg(gene || ':' || effect, '|' order by k) as gene_effects, string_agg(distinct gene, ',' order by gene) filter (where effect in ('nonsense', 'splice-site')) as lgds from pairs group by id),
    de as (select id, string_agg(tr_id || ':' || gene || ':' || effect || ':' || details, '|' order by severity desc, tr_id) as effect_details, arg_min(effect, lpad(cast(100 - severity as varchar), 3, '0') || tr_id) as worst_effect from told group by id)
    select ann.id, coalesce(worst_effect, 'intergenic') as worst_effect, coalesce(gene_effects, 'intergenic:intergenic') as gene_effects, coalesce(effect_details, 'intergenic:intergenic:intergenic:intergenic') as effect_details, coalesce(lgds, '') as lgds
    from ann left join ge using (id) left join de using (id)"""


@query(_EFFECTS)
def full_effects(spark: SparkSession, d: str) -> DataFrame:
    asked = ["worst_effect", "gene_effects", "effect_details", "LGDs_genes"]
    df = effects.annotate_effects(substitutions(spark, d), models_of(spark, d), _chunks(spark, d), asked, promoter_len=100)
    return df.select("id", "worst_effect", "gene_effects", "effect_details", F.array_join("LGDs_genes", ",").alias("lgds"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The sequence in chunks of the size that reads expect, as a table."""
    one = sequence(spark, d).withColumn("k", F.floor(F.col("chunk") * 1024 / genome.CHUNK))
    chunks = one.groupBy("chrom", F.col("k").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("o"), "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return kept(chunks, "genome")


@query(f"""with {ANN}, {_TX}, h as (select ann.id, string_agg(distinct gene, ',' order by gene) as genes from ann join tx on ann.chrom = tx.chrom and pos <= b + 149 and pos_end >= b group by ann.id)
    select ann.id, case when h.id is null then 'intergenic' else 'CNV-' end as worst_effect, coalesce(genes, '') as genes from ann left join h using (id)""")
def cnv_effects(spark: SparkSession, d: str) -> DataFrame:
    lost = annotatables(spark, d).withColumn("ann", F.col("ann").withField("type", F.lit("LARGE_DELETION")))
    df = effects.annotate_effects(lost, models_of(spark, d), _chunks(spark, d), ["worst_effect", "CNV_genes"])
    return df.select("id", "worst_effect", F.array_join("CNV_genes", ",").alias("genes"))


# --- regions ------------------------------------------------------------------------

_ISLANDS = """{n}1 as (select *, max(stop) over (partition by chrom order by start, stop rows between unbounded preceding and 1 preceding) as reach from {n}),
    {n}2 as (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (partition by chrom order by start, stop rows unbounded preceding) as k from {n}1),
    {n}c as (select chrom, min(start) as start, max(stop) as stop from {n}2 group by chrom, k)"""
_AC, _BC = _ISLANDS.format(n="a"), _ISLANDS.format(n="b")
# Pieces between neighbouring ends of the collapsed regions, with which sides cover them.
_PIECES = f"""with {REG}, {_AC}, {_BC}, ends as (select chrom, start as p from ac union select chrom, stop + 1 from ac union select chrom, start from bc union select chrom, stop + 1 from bc),
    spans as (select chrom, p as start, lead(p) over (partition by chrom order by p) - 1 as stop from ends),
    pieces as (select s.chrom, s.start, s.stop, ac.start is not null as in_a, bc.start is not null as in_b from spans s left join ac on s.chrom = ac.chrom and s.start between ac.start and ac.stop left join bc on s.chrom = bc.chrom and s.start between bc.start and bc.stop where s.stop is not null)"""


@query(f"with {REG}, {_AC} select chrom, start, stop from ac")
def region_collapse(spark: SparkSession, d: str) -> DataFrame:
    return regions.collapse(region_sets(spark, d)[0])


@query(f"with {REG}, {_AC}, {_BC} select ac.chrom, greatest(ac.start, bc.start) as start, least(ac.stop, bc.stop) as stop from ac join bc on ac.chrom = bc.chrom and ac.start <= bc.stop and ac.stop >= bc.start")
def region_intersection(spark: SparkSession, d: str) -> DataFrame:
    return regions.intersection(*region_sets(spark, d))


@query(f"{_PIECES} select chrom, start, stop from pieces where in_a and not in_b")
def region_difference(spark: SparkSession, d: str) -> DataFrame:
    return regions.difference(*region_sets(spark, d))


@query(f"{_PIECES} select chrom, start, stop from pieces where in_a <> in_b")
def region_symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    return regions.symmetric_difference(*region_sets(spark, d))


@query(f"with {REG}, u as (select * from a union all select * from b), {_ISLANDS.format(n='u')} select chrom, start, stop from uc")
def region_union(spark: SparkSession, d: str) -> DataFrame:
    return regions.union(*region_sets(spark, d))


@query(f"with {REG}, x as (select distinct chrom, unnest(range(start, stop + 1)) as p from a) select chrom, count(*) as length from x group by chrom")
def region_total_length(spark: SparkSession, d: str) -> DataFrame:
    return regions.total_length(region_sets(spark, d)[0])


@query(f"with {POS}, c as (select chrom, max(pos_end) as length from runs group by chrom) select chrom, k * 1000 + 1 as start, least((k + 1) * 1000, length) as stop from c, range(0, 100) t(k) where k * 1000 < length")
def region_split(spark: SparkSession, d: str) -> DataFrame:
    return regions.split(sc.contigs(position_score(spark, d)), 1000)


# --- statistics ------------------------------------------------------------------------


@query(f"with {POS} select bin, cast(sum(pos_end - pos_begin + 1) as bigint) as n from (select *, case when value < 0 then -1 when value > 500 then 20 else least(cast(trunc(value * (20 / 500.0)) as int), 19) end as bin from runs where value is not null) group by bin")
def hist_number_lin(spark: SparkSession, d: str) -> DataFrame:
    h = histograms.NumberHistogram(0.0, 500.0, 20)
    return histograms.number_histogram(_runs(spark, d), "value", h, F.col("pos_end") - F.col("pos_begin") + 1)


@query(f"with {POS} select bin, cast(sum(pos_end - pos_begin + 1) as bigint) as n from (select *, case when value < 20 then -1 when value > 300 then 10 else least(cast(trunc((value - 20) * (10 / 280.0)) as int), 9) end as bin from runs where value is not null) group by bin")
def hist_saved(spark: SparkSession, d: str) -> DataFrame:
    """A histogram measured, kept as JSON, and read back."""
    path = fresh_path(spark, "histogram.json")
    histograms.save(spark, histograms.measure(_runs(spark, d), "value", histograms.NumberHistogram(20.0, 300.0, 10), F.col("pos_end") - F.col("pos_begin") + 1), path)
    return histograms.load(spark, path).rows(spark)


@query(f"with {POS}, v as (select pos_end - pos_begin + 1 as w, floor(value) as v from runs where value is not null) select bin, cast(sum(w) as bigint) as n from (select w, case when v < 0 then -1 when v > 1000 then 10 when v < 1.5 then 0 else least(cast(trunc((log10(v) - log10(1.5)) * (9 / (3.0 - log10(1.5)))) as int) + 1, 9) end as bin from v) group by bin")
def hist_number_log(spark: SparkSession, d: str) -> DataFrame:
    h = histograms.NumberHistogram(0.0, 1000.0, 10, log_from=1.5)
    df = _runs(spark, d).withColumn("value", F.floor("value").cast("double"))
    return histograms.number_histogram(df, "value", h, F.col("pos_end") - F.col("pos_begin") + 1)


@query("with c as (select p_brand as value, count(*) as n, row_number() over (order by count(*) desc, p_brand) as rank from part group by p_brand) select case when rank <= 5 then value else 'Other Values' end as value, cast(least(rank, 6) as int) as rank, cast(sum(n) as bigint) as n from c group by 1, 2")
def hist_categorical_topk(spark: SparkSession, d: str) -> DataFrame:
    return histograms.top_categories(histograms.categorical_histogram(_t(spark, d, "part"), "p_brand"), 5)


@query("select 'l_discount' as score, min(l_discount) as min, max(l_discount) as max, count(l_discount) as n from lineitem union all select 'l_quantity', min(l_quantity), max(l_quantity), count(l_quantity) from lineitem")
def minmax(spark: SparkSession, d: str) -> DataFrame:
    return histograms.min_max(_t(spark, d, "lineitem"), "l_discount", "l_quantity")


@query(f"with {FRAG}, o as (select chrom, pos_begin, pos_end, lag(pos_end) over (partition by chrom order by pos_begin, pos_end) as prev_end from frag) select * from o where pos_begin <= prev_end")
def validate_overlap(spark: SparkSession, d: str) -> DataFrame:
    return sc.overlapping_records(fragment_score(spark, d))


@query("with o as (select 'chr' || (user_id % 5) as chrom, cast(floor(value) as bigint) as pos_begin, event_id, lag(cast(floor(value) as bigint)) over (partition by user_id % 5 order by event_id) as prev_begin from events) select * from o where pos_begin < prev_begin")
def validate_order(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").selectExpr("concat('chr', user_id % 5) as chrom", "cast(floor(value) as bigint) as pos_begin", "event_id")
    return sc.unordered_records(e, "event_id")


@query("""with b as (select 'chr' || c as chrom, k, substr('ACGT', cast(((k * (c + 3) + k // 7) % 4) + 1 as int), 1) as x from range(0, 5) t(c), range(0, 44032) u(k)),
    n as (select chrom, 'base' as what, x as kind from b union all select chrom, 'pair', x || lead(x) over (partition by chrom order by k) from b)
    select chrom, what, kind, count(*) as n from n where kind is not null group by grouping sets ((chrom, what, kind), (what, kind))""")
def genome_statistics(spark: SparkSession, d: str) -> DataFrame:
    return histograms.genome_statistics(sequence(spark, d), "ACGT").where("n > 0").select("chrom", "what", "kind", "n")


# --- scalar functions -----------------------------------------------------------------------


@query(f"with {ANN} select id, case chrom when 'chr0' then '1' when 'chr1' then '2' end as chrom from ann")
def chrom_mapping(spark: SparkSession, d: str) -> DataFrame:
    return genome.map_chroms(annotatables(spark, d), {"chr0": "1", "chr1": "2"}).select("id", F.col("mapped.chrom").alias("chrom"))


@query("select o_orderkey as id, case when o_totalprice > 200000 then least(o_totalprice * 2, 500000.0) else cast(o_custkey % 7 as double) end as a, cast(floor((o_custkey - 700) / 9.0) as bigint) as b, cast(((o_custkey - 700) % 9 + 9) % 9 as bigint) as c from orders")
def value_transform(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    a = compile_transform("min(value * 2, 500000.0) if value > 200000 else 0.0", F.col("o_totalprice"), "double")[0]
    small = F.when(F.col("o_totalprice") > 200000, a).otherwise(compile_transform("value % 7", F.col("o_custkey"), "bigint")[0].cast("double"))
    shifted = F.col("o_custkey") - 700
    return o.select(F.col("o_orderkey").alias("id"), small.alias("a"), compile_transform("value // 9", shifted, "bigint")[0].alias("b"), compile_transform("value % 9", shifted, "bigint")[0].alias("c"))


@query("select p_partkey as id, reverse(translate(upper(regexp_replace(p_name, '[^ACGTNacgtn]', 'N', 'g')), 'ACGT', 'TGCA')) as rc from part")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), S.reverse_complement(F.col("p_name")).alias("rc"))


_ALTS = "v as (select p_partkey as id, 1 + (p_partkey * 7919) % 43200 as pos, substr('ACGTACGTAC', cast(1 + p_partkey % 4 as int), cast(1 + p_partkey % 3 as int)) as ref, substr('ACGTACGTAC', cast(1 + p_partkey % 4 as int), cast(1 + p_size % 4 as int)) || case when p_partkey % 5 = 0 then 'T' else '' end as alt from part)"


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").selectExpr(
        "p_partkey as id", "1 + (p_partkey * 7919) % 43200 as pos", "substring('ACGTACGTAC', cast(1 + p_partkey % 4 as int), cast(1 + p_partkey % 3 as int)) as ref", "substring('ACGTACGTAC', cast(1 + p_partkey % 4 as int), cast(1 + p_size % 4 as int)) || case when p_partkey % 5 = 0 then 'T' else '' end as alt"
    )


@query(f"""with {_ALTS} select id, case when length(ref) = 1 and length(alt) = 1 then 'SUBSTITUTION' when length(ref) = 1 and length(alt) > 1 and ref = substr(alt, 1, 1) then 'SMALL_INSERTION' when length(ref) > 1 and length(alt) = 1 and substr(ref, 1, 1) = alt then 'SMALL_DELETION' else 'COMPLEX' end as type,
    case when length(ref) = 1 and length(alt) = 1 then pos when length(ref) = 1 and ref = substr(alt, 1, 1) then pos + 1 else pos + length(ref) end as pos_end from v""")
def annotatable_spans(spark: SparkSession, d: str) -> DataFrame:
    a = S.allele(F.lit("chr1"), F.col("pos"), F.col("ref"), F.col("alt"))
    return _variants(spark, d).select("id", a["type"].alias("type"), a["pos_end"].alias("pos_end"))


@query(f"with {_ALTS}, k as (select *, (select count(*) from range(1, 12) t(i) where i <= least(length(ref), length(alt)) and substr(ref, 1, i) = substr(alt, 1, i)) as n from v) select id, pos + n as pos, substr(ref, n + 1) as ref, substr(alt, n + 1) as alt from k")
def trim_left(spark: SparkSession, d: str) -> DataFrame:
    t = S.trim_left(F.col("pos"), F.col("ref"), F.col("alt"))
    return _variants(spark, d).select("id", t["pos"].alias("pos"), t["ref"].alias("ref"), t["alt"].alias("alt"))


@query("select c_custkey as id, case when c_acctbal < 0 then null else c_acctbal end as v, c_mktsegment in ('BUILDING', 'MACHINERY') as na from customer")
def na_parse(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    raw = F.when(F.col("c_acctbal") < 0, "NA").otherwise(F.col("c_acctbal").cast("string"))
    seg = parse_value(F.col("c_mktsegment"), "str", ["BUILDING", "MACHINERY"])
    return c.select(F.col("c_custkey").alias("id"), parse_value(raw, "float").alias("v"), seg.isNull().alias("na"))


@query("select c_custkey as id, 'chr' || (c_custkey % 5) as chrom, c_custkey * 1000 as start, c_custkey * 1000 + 500 as stop from customer")
def parse_region(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("chr"), (F.col("c_custkey") % 5).cast("string"), F.lit(":"), F.format_number(F.col("c_custkey") * 1000, 0), F.lit("-"), F.format_number(F.col("c_custkey") * 1000 + 500, 0))
    r = S.parse_region(text)
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), r["chrom"].alias("chrom"), r["start"].alias("start"), r["stop"].alias("stop"))


@query("select p_partkey as id, cast(p_size as double) as af, case p_partkey % 2 when 0 then p_brand else p_type end as ref_value, p_brand || '|' || p_type as names from part")
def vcf_info(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    info = F.create_map(F.lit("AF"), F.concat(F.col("p_size").cast("string"), F.lit(",0.5")), F.lit("R"), F.concat_ws(",", "p_brand", "p_type"), F.lit("N"), F.concat_ws(",", "p_brand", "p_type"))
    zero = F.when(F.col("p_partkey") % 2 == 1, F.lit(0))
    return p.select(F.col("p_partkey").alias("id"), tables.info_value(info, "AF", "A", "Float", F.lit(0)).alias("af"), tables.info_value(info, "R", "R", "String", zero).alias("ref_value"), tables.info_value(info, "N", ".", "String", zero).alias("names"))


# --- genome operators -------------------------------------------------------------------------


@query(f"""with {ANN} select id, coalesce((select string_agg(substr('ACGT', cast((((p - 1) * (cast(substr(chrom, 4) as int) + 3) + (p - 1) // 7) % 4) + 1 as int), 1), '' order by p) from range(pos, pos_end + 1) t(p) where chrom <> 'chr5' and p <= 44032), '') as bases from ann""")
def reference_bases(spark: SparkSession, d: str) -> DataFrame:
    a = annotatables(spark, d).select("id", "ann.chrom", F.col("ann.pos").alias("begin"), F.col("ann.pos_end").alias("end"))
    return genome.bases(a.withColumnRenamed("chrom", "c"), _chunks(spark, d), "c", "begin", "end", "bases").select("id", "bases")


@query(f"with {ANN} select id, chrom, pos, ref, alt from ann")
def normalize_substitution_row(spark: SparkSession, d: str) -> DataFrame:
    """A substitution is its own normal form, wherever it is."""
    n = F.col("normalized")
    return genome.annotate_normalised(substitutions(spark, d), _chunks(spark, d)).select("id", n["chrom"].alias("chrom"), n["pos"].alias("pos"), n["ref"].alias("ref"), n["alt"].alias("alt"))


def _base(k: str, c: str = "c") -> str:
    """Base k (from 0) of contig c, for Spark."""
    return f"substring('ACGT', cast(pmod(({k}) * ({c} + 3) + floor(({k}) / 7), 4) as int) + 1, 1)"


def _run_of(k: str, n: str) -> str:
    return f"array_join(transform(sequence(0, ({n}) - 1), i -> {_base(f'{k} + i')}), '')"


def indels(spark: SparkSession, d: str) -> DataFrame:
    """Deletions and repeats of one or two bases, each with two bases more than
    it needs, and substitutions, over the genome's own bases."""
    o = _t(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderkey % 6 as c", "101 + (o_orderkey * 7919) % 43000 as pos", "1 + o_orderkey div 6 % 2 as n", "o_orderkey div 12 % 3 as shape")
    anchor = _base("pos - 1")
    o = o.selectExpr(
        "id", "concat('chr', c) as chrom", "pos", f"case shape when 0 then {_run_of('pos - 1', 'n + 3')} when 1 then {_run_of('pos - 1', '3')} else {anchor} end as ref",
        f"case shape when 0 then concat({anchor}, {_run_of('pos + n', '2')}) when 1 then concat({anchor}, {_run_of('pos', 'n')}, {_run_of('pos', '2')}) else translate({anchor}, 'ACGT', 'CGTA') end as alt",
    )
    return o.select("id", S.allele(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("ann"))


def _sql_base(k: str) -> str:
    return f"substr('ACGT', cast((({k}) * (c + 3) + ({k}) // 7) % 4 as int) + 1, 1)"


def _sql_run(k: str, n: str) -> str:
    return f"array_to_string([{_sql_base(f'{k} + i')} for i in range(0, {n})], '')"


# The same; ``s`` and ``r``: how far what is deleted or repeated can slide to the left and right.
_INDELS = f"""o as (select o_orderkey as id, o_orderkey % 6 as c, 101 + (o_orderkey * 7919) % 43000 as pos, 1 + o_orderkey // 6 % 2 as n, o_orderkey // 12 % 3 as shape from orders),
    slid as (select *, 'chr' || c as chrom, list_min([j for j in range(0, 90) if {_sql_base('pos - 1 - j')} <> {_sql_base('pos + n - 1 - j')}]) as s, list_min([j for j in range(0, 90) if {_sql_base('pos + n + j')} <> {_sql_base('pos + j')}]) as r from o),
    given as (select *, case shape when 0 then {_sql_run('pos - 1', 'n + 3')} when 1 then {_sql_run('pos - 1', '3')} else {_sql_base('pos - 1')} end as ref,
        case shape when 0 then {_sql_base('pos - 1')} || {_sql_run('pos + n', '2')} when 1 then {_sql_base('pos - 1')} || {_sql_run('pos', 'n')} || {_sql_run('pos', '2')} else translate({_sql_base('pos - 1')}, 'ACGT', 'CGTA') end as alt from slid),
    moved as (select *, {_sql_base('pos - s - 1')} as anchor, {_sql_run('pos - s', 'n')} as unit, {_sql_base('pos + r + n')} as after, {_sql_run('pos + r', 'n')} as last_unit from given),
    normal as (select *, case when shape = 2 or c = 5 then pos else pos - s end as n_pos, case when shape = 2 or c = 5 then ref when shape = 0 then anchor || unit else anchor end as n_ref, case when shape = 2 or c = 5 then alt when shape = 0 then anchor else anchor || unit end as n_alt from moved)"""


@query(f"with {_INDELS} select id, chrom, n_pos as pos, n_ref as ref, n_alt as alt from normal")
def normalize_indels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("normalized")
    return genome.annotate_normalised(indels(spark, d), _chunks(spark, d)).select("id", n["chrom"].alias("chrom"), n["pos"].alias("pos"), n["ref"].alias("ref"), n["alt"].alias("alt"))


def _target(spark: SparkSession) -> DataFrame:
    """The genome that ``_chain`` leads to: 20,000 bases of each contig, of odd
    contigs turned round, and N elsewhere."""
    turned = f"translate({_base('48999 - i')}, 'ACGT', 'TGCA')"
    at = f"case when c % 2 = 0 and i between 1000 and 20999 then {_base('i - 1000')} when c % 2 = 1 and 48999 - i between 0 and 19999 then {turned} else 'N' end"
    return kept(spark.range(5).selectExpr("id as c").selectExpr("concat('new', c) as chrom", "0L as chunk", f"array_join(transform(sequence(0L, 49999L), i -> {at}), '') as seq"), "target")


_TURN = "reverse(translate({}, 'ACGT', 'TGCA'))"


@query(f"""with {_INDELS}, hit as (select *, c <> 5 and case when shape = 2 then pos <= 20000 else pos + n + r <= 19999 end as ok, c % 2 = 0 as plus from normal)
    select id, case when ok then 'new' || c end as chrom, case when not ok then null when plus then n_pos + 1000 when shape = 2 then 49001 - pos else 49000 - (pos + r + n) end as pos,
    case when not ok then null when plus then n_ref when shape = 2 then {_TURN.format('ref')} when shape = 0 then {_TURN.format('after')} || {_TURN.format('last_unit')} else {_TURN.format('after')} end as ref,
    case when not ok then null when plus then n_alt when shape = 2 then {_TURN.format('alt')} when shape = 0 then {_TURN.format('after')} else {_TURN.format('after')} || {_TURN.format('last_unit')} end as alt from hit""")
def liftover_alleles(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("lifted")
    return genome.lift_alleles(indels(spark, d), _chain(spark, d), _chunks(spark, d), _target(spark)).select("id", x["chrom"].alias("chrom"), x["pos"].alias("pos"), x["ref"].alias("ref"), x["alt"].alias("alt"))


def _chain(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(5).selectExpr("concat('chr', id) as src_chrom", "0L as src_begin", "20000L as src_end", "concat('new', id) as dst_chrom", "1000L as dst_begin", "50000L as dst_size", "case when id % 2 = 0 then '+' else '-' end as strand", "100.0D as score", "concat('c', id) as chain_id")


@query(f"with {ANN} select id, case when hit then 'new' || substr(chrom, 4) end as chrom, case when not hit then null when cast(substr(chrom, 4) as int) % 2 = 0 then pos + 1000 else 50000 - (1000 + pos - 1) end as pos from (select *, chrom <> 'chr5' and pos <= 20000 as hit from ann)")
def liftover_positions(spark: SparkSession, d: str) -> DataFrame:
    a = annotatables(spark, d).select("id", F.col("ann.chrom").alias("c"), F.col("ann.pos").alias("p"))
    return genome.lift_positions(a, _chain(spark, d), "c", "p").select("id", F.col("lifted.chrom").alias("chrom"), F.col("lifted.pos").alias("pos"))


@query(f"""with {ANN}, l as (select *, cast(substr(chrom, 4) as int) % 2 = 0 as plus from ann where chrom <> 'chr5' and pos_end <= 20000)
    select ann.id, case when l.id is not null then 'new' || substr(ann.chrom, 4) end as chrom, case when plus then l.pos + 1000 else 49001 - l.pos_end end as pos, case when plus then l.pos_end + 1000 else 49001 - l.pos end as pos_end from ann left join l using (id)""")
def liftover_regions(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("lifted")
    return genome.lift_regions(annotatables(spark, d), _chain(spark, d)).select("id", x["chrom"].alias("chrom"), x["pos"].alias("pos"), x["pos_end"].alias("pos_end"))


# --- catalogue, pipelines, streams --------------------------------------------------------------


@query("select 'part/' || p_partkey as id, p_type as type from part where p_brand like 'Brand#1%' and contains(p_type, 'A') and p_partkey % 10 = 3")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    r = p.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("full_id"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.lit(0)).alias("version"), F.col("p_type").alias("type"), F.col("p_name").alias("description"), F.lit("").alias("summary"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type")).alias("labels"))
    return cat.search(r, query="*3[brand=Brand#1* and A in kind]").select("id", "type")


PIPELINE = """
- position_score:
    resource_id: events
    attributes:
    - {source: value, name: value_mean}
    - {source: value, name: value_max, aggregator: max}
- position_score:
    resource_id: events
    attributes:
    - {source: label, name: label_mode, aggregator: mode}
- fragment_score:
    resource_id: fragments
    fragment_filter: freq < 0.05
    attributes:
    - count
    - {source: freq, name: freq_max, aggregator: max}
- simple_effect_annotator:
    gene_models: models
    attributes:
    - worst_effect
    - {source: genes, name: gene_list, internal: true}
- gene_score_annotator:
    resource_id: gene_prices
    attributes:
    - {source: price, name: gene_price, aggregator: max, value: value / 2}
- chrom_mapping:
    add_prefix: hg_
    attributes:
    - {source: renamed_chromosome, name: hg, internal: true}
"""


def pipeline_catalog(spark: SparkSession, d: str) -> cat.Catalog:
    R = cat.Resource
    return cat.Catalog(
        [R("events", "position_score", position_score(spark, d)), R("fragments", "fragment_score", fragment_score(spark, d)), R("models", "gene_models", models_of(spark, d)), R("gene_prices", "gene_score", gene_scores(spark, d)), R("alleles", "allele_score", allele_score(spark, d))]
    )


@query(f"""with {HITS}, {FRAG}, {_TX}, p as (select id, round(sum(value * w) / nullif(sum(case when value is not null then w end), 0), 9) as value_mean, max(value) as value_max from hits group by id),
    n as (select id, label, sum(w) as n from hits group by id, label), m as (select id, label as label_mode from (select *, row_number() over (partition by id order by n desc, label) as k from n) where k = 1),
    f as (select ann.id, count(*) as n, max(freq) as freq_max from ann join frag f on ann.chrom = f.chrom and ann.pos <= f.pos_end and ann.pos_end >= f.pos_begin and freq < 0.05 group by ann.id),
    h as (select ann.id, gene, case when k = 0 then 3 when (pos <= b + 29 and pos_end >= b + 10) or (pos <= b + 89 and pos_end >= b + 60) or (pos <= b + 135 and pos_end >= b + 120) then 0 when (pos <= b + 59 and pos_end >= b + 30) or (pos <= b + 119 and pos_end >= b + 90) then 1 else 2 end as r
        from ann join tx on ann.chrom = tx.chrom and pos <= b + 149 and pos_end >= b),
    e as (select id, min(r) as r from h group by id),
    gp as (select id, max(p_retailprice) / 2 as gene_price from h join part on gene = 'g' || p_partkey group by id)
    select ann.id, value_mean, value_max, label_mode, coalesce(f.n, 0) as count, freq_max, case when e.r is null then 'intergenic' else ['coding', 'inter-coding_intronic', 'peripheral', 'noncoding'][e.r + 1] end as worst_effect, gene_price
    from ann left join p using (id) left join m using (id) left join f using (id) left join e using (id) left join gp using (id)""")
def pipeline_yaml(spark: SparkSession, d: str) -> DataFrame:
    c = pipeline_catalog(spark, d)
    df = pl.annotate(annotatables(spark, d), pl.parse(PIPELINE, c), c)
    return df.select("id", F.round("value_mean", 9).alias("value_mean"), "value_max", "label_mode", "count", "freq_max", "worst_effect", "gene_price")


@query(f"with {HITS}, told as (select id, round(sum(value * w) / nullif(sum(case when value is not null then w end), 0), 9) as v, max(value) as top from hits group by id) select ann.id, told.v, told.top from ann left join told using (id)")
def stream_region_mean(spark: SparkSession, d: str) -> DataFrame:
    """The stateless form that streams use, on a batch."""
    df = annotate_stream(annotatables(spark, d), position_score(spark, d), [sc.Attribute("value", "v", "mean"), sc.Attribute("value", "top", "max")])
    return df.select("id", F.round("v", 9).alias("v"), "top")


@query(f"with {HITS}, told as (select id, round(sum(value * w) / nullif(sum(case when value is not null then w end), 0), 9) as v, max(value) as top from hits group by id) select ann.id, told.v, told.top from ann left join told using (id)")
def stream_annotation(spark: SparkSession, d: str) -> DataFrame:
    """A stream of files, annotated and written by Structured Streaming, read back."""
    orders = _t(spark, d, "orders")
    stream = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    asked = [sc.Attribute("value", "v", "mean"), sc.Attribute("value", "top", "max")]
    out = annotate_stream(_as_annotatables(stream), position_score(spark, d), asked).select("id", F.round("v", 9).alias("v"), "top")
    path = fresh_path(spark, "stream")
    to_files(out, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("select 'g' || (p_partkey % 97) as gene, p_type as term, count(*) as n from part group by 1, 2")
def gene_terms(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "part").selectExpr("p_type as set_name", "concat('g', p_partkey % 97) as gene")
    return models.as_terms(s)


# --- sources and sinks: tables written in their formats and read back ------------------------------


def _lines(df: DataFrame, head: list[str], name: str) -> str:
    """A text of ``df`` (value) below a header, under a path of the shared folder."""
    path = fresh_path(df.sparkSession, name)
    top = df.sparkSession.createDataFrame([(0, t) for t in head], "o int, value string") if head else None
    body = df.select(F.lit(1).alias("o"), "value")
    (body if top is None else top.unionByName(body)).repartitionByRange("o").sortWithinPartitions("o").select("value").write.text(path)
    return path


@query(f"with {POS} select chrom, pos_begin, cast(pos_end as bigint) as pos_end, value, label from runs where pos_end is not null")
def source_tabular(spark: SparkSession, d: str) -> DataFrame:
    """Gzipped text with a header, missing values as NA."""
    path = fresh_path(spark, "tabular")
    runs = _runs(spark, d).where("pos_end is not null").select("chrom", "pos_begin", "pos_end", F.coalesce(F.col("value").cast("string"), F.lit("NA")).alias("value"), "label")
    runs.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return tables.read_score_table(spark, path, {"value": {"type": "float"}, "label": {"type": "str"}}, format="tsv").drop("__line")


@query(f"with {POS} select chrom, pos_begin, cast(pos_end as bigint) as pos_end, value from runs where pos_end is not null and value is not null")
def source_bedgraph(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d).where("pos_end is not null and value is not null")
    return tables.read_bedgraph(spark, _lines(runs.select(F.concat_ws(" ", "chrom", F.col("pos_begin") - 1, "pos_end", "value").alias("value")), ["track type=bedGraph"], "bedgraph"))


_VCF_HEAD = ["##fileformat=VCFv4.2", '##INFO=<ID=AF,Number=A,Type=Float,Description="f">', '##INFO=<ID=SIZE,Number=1,Type=Integer,Description="s">', '##INFO=<ID=BIG,Number=0,Type=Flag,Description="b">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"]


def _vcf(spark: SparkSession, d: str) -> str:
    """Parts as VCF lines: two ALTs, one, or none."""
    p = _t(spark, d, "part").selectExpr(
        "concat_ws('\t', concat('chr', p_partkey % 5), 1 + (p_partkey * 7919) % 43200, concat('rs', p_partkey), 'A', case p_partkey % 3 when 0 then 'C,G' when 1 then 'T' else '.' end, '.', 'PASS', concat('AF=', case p_partkey % 3 when 0 then concat(p_size, ',', p_size + 0.5) when 1 then cast(p_size as string) else '.' end, ';SIZE=', p_size, case when p_size > 25 then ';BIG' else '' end), 'GT', '0/1') as value"
    )
    return _lines(p, _VCF_HEAD, "vcf")


_VCF_ROWS = "v as (select p_partkey, 'chr' || (p_partkey % 5) as chrom, 1 + (p_partkey * 7919) % 43200 as pos, p_size, unnest(case p_partkey % 3 when 0 then [1, 2] when 1 then [3] else [0] end) as k from part)"


@query(f"with {_VCF_ROWS} select chrom, pos as pos_begin, 'A' as reference, case k when 1 then 'C' when 2 then 'G' when 3 then 'T' end as alternative, case k when 0 then null when 2 then p_size + 0.5 else cast(p_size as double) end as AF, cast(p_size as bigint) as SIZE, p_size > 25 as BIG from v")
def source_vcf(spark: SparkSession, d: str) -> DataFrame:
    lines, fields = tables.read_vcf(spark, _vcf(spark, d))
    return tables.vcf_scores(lines, fields)[0].select("chrom", "pos_begin", "reference", "alternative", "AF", "SIZE", "BIG")


@query("""select concat_ws(chr(9), 'chr' || (p_partkey % 5), cast(1 + (p_partkey * 7919) % 43200 as varchar), 'rs' || p_partkey, 'A', case p_partkey % 3 when 0 then 'C,G' when 1 then 'T' else '.' end, '.', 'PASS',
    'AF=' || case p_partkey % 3 when 0 then p_size || ',' || (p_size + 0.5) when 1 then cast(p_size as varchar) else '.' end || ';SIZE=' || p_size || case when p_size > 25 then ';BIG' else '' end || case p_partkey % 3 when 0 then ';half=.,' || p_partkey % 7 when 1 then ';half=' || p_partkey % 7 else '' end, 'GT', '0/1') as line from part""")
def sink_vcf(spark: SparkSession, d: str) -> DataFrame:
    """A VCF through the annotation of its alleles and out again: ids, samples and
    lines without ALT stay; the first of two alleles has no value."""
    path, out = _vcf(spark, d), fresh_path(spark, "vcf-out")
    alleles = tabular.read_vcf_input(spark, path)
    half = F.when(F.col("alt") != "C", F.substring("id", 3, 20).cast("bigint") % 7)
    tabular.write_vcf(alleles.withColumn("half", half), ["half"], out, path)
    return spark.read.text(out).where("value not like '#%'").select(F.col("value").alias("line"))


@query(f"with {REG} select chrom, start, stop from a")
def source_bed(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "bed")
    regions.write_bed(region_sets(spark, d)[0], path)
    return regions.read_bed(spark, path)


_MODELS = f"with {_TX} select tr_id, gene, chrom, b as tx_begin, b + 149 as tx_end, case when k = 0 then null else b + 10 end as cds_begin, case when k = 0 then null else b + 135 end as cds_end, (b) || '-' || (b + 29) || ',' || (b + 60) || '-' || (b + 89) || ',' || (b + 120) || '-' || (b + 149) as exons from tx"


def _model_rows(m: DataFrame) -> DataFrame:
    codes = F.col("cds_begin") < F.col("cds_end")
    exons = F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["start"].cast("string"), e["stop"].cast("string"))), ",")
    return m.select("tr_id", "gene", "chrom", "tx_begin", "tx_end", F.when(codes, F.col("cds_begin")).alias("cds_begin"), F.when(codes, F.col("cds_end")).alias("cds_end"), exons.alias("exons"))


@query(_MODELS)
def source_gtf(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "gtf")
    models.write_gtf(transcripts.with_frames(models_of(spark, d)), path)
    return _model_rows(models.read_gene_models(spark, path, "gtf"))


@query(_MODELS)
def source_gene_models(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "models")
    models.write_default(models_of(spark, d), path)
    return _model_rows(models.read_gene_models(spark, path, "default"))


@query("""with c as (select c_custkey as k, 10 + c_custkey % 7 as n from customer)
    select 'src' || k as src_chrom, 4 as src_begin, 4 + n as src_end, 'dst' || k as dst_chrom, 2 as dst_begin, 500 as dst_size, case k % 2 when 0 then '+' else '-' end as strand, cast(1000 + k as double) as score, cast(k as varchar) as chain_id from c
    union all select 'src' || k, 7 + n, 7 + n + 20, 'dst' || k, 2 + n + 5, 500, case k % 2 when 0 then '+' else '-' end, cast(1000 + k as double), cast(k as varchar) from c""")
def source_chain(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").selectExpr("c_custkey as k", "10 + c_custkey % 7 as n")
    text = c.selectExpr("concat('chain ', 1000 + k, ' src', k, ' 400 + 4 ', 27 + n, ' dst', k, ' 500 ', case k % 2 when 0 then '+' else '-' end, ' 2 ', 27 + n, ' ', k, '\n', n, ' 3 5\n20\n') as value")
    return genome.read_chain(spark, _lines(text, [], "chain"))


@query(f"select 'chr' || c as chrom, {_sql_run('0', '44032')} as seq from range(0, 5) t(c)")
def source_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Contigs in lines of 64 bases, in one file, read back into chunks."""
    lines = sequence(spark, d).select("chrom", "chunk", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"), "seq").select("chrom", (F.col("chunk") * 16 + F.col("k")).alias("k"), F.substring("seq", F.col("k") * 64 + 1, F.lit(64)).alias("value"))
    heads = lines.select("chrom").distinct().select("chrom", F.lit(-1).cast("bigint").alias("k"), F.concat(F.lit(">"), "chrom", F.lit(" made")).alias("value"))
    path = fresh_path(spark, "fasta")
    lines.unionByName(heads).coalesce(1).sortWithinPartitions("chrom", "k").select("value").write.text(path)
    return genome.read_fasta(spark, path).select("chrom", "seq")


@query("select distinct p_type as set_name, 'g' || (p_partkey % 97) as gene from part")
def source_gmt(spark: SparkSession, d: str) -> DataFrame:
    sets = gene_sets(spark, d).groupBy("set_name").agg(F.concat_ws(" ", F.array_sort(F.collect_list("gene"))).alias("genes"))
    path = _lines(sets.select(F.concat_ws("\t", F.replace("set_name", F.lit(" "), F.lit("_")), F.lit("made"), "genes").alias("value")), [], "gmt")
    return models.read_gmt(spark, path).select(F.replace("set_name", F.lit("_"), F.lit(" ")).alias("set_name"), "gene")


@query("select p_type as set_name, 'g' || (p_partkey % 97) as gene from part group by 1, 2")
def source_set_map(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "map")
    models.write_map(models.as_terms(gene_sets(spark, d).withColumn("set_name", F.replace("set_name", F.lit(" "), F.lit("_")))), path)
    return models.read_map(spark, path).select(F.replace("set_name", F.lit("_"), F.lit(" ")).alias("set_name"), "gene")
