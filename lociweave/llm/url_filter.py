"""URL rules, with block decisions that follow redirects and canonical links.

A url that no rule fits takes the verdict of its aliases: the urls joined to it
by redirects and canonical links, in any number of steps (connected components
over the edge table). An explicit allow among them comes before a block; with
neither, the url is allowed. A url's own rule always comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    def __post_init__(self):
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"verdict {self.verdict!r}")

    @property
    def text(self) -> str:
        return self.host + self.path


_MOST_RULES = 200  # more of them are a table that is joined, not part of the plan


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _ordered(rules: list[Rule]) -> list[Rule]:
    """Longest first; of one length, block before allow, then the greater text."""
    return sorted(sorted(rules, key=lambda r: r.text, reverse=True), key=lambda r: (-len(r.text), r.verdict == "allow"))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A rule fits
    its host and all subdomains where the path starts with its own; of rules of
    one length and url, block comes first."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit("." + r.host).alias("dotted"), F.lit(r.path).alias("path"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in _ordered(rules)])
    fit = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, r["dotted"])) & F.startswith(path, r["path"]))
    first = F.get(fit, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def with_fitting_rule(df: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """``df`` (host, path, ...) with ``fit`` as ``fitting_rule`` gives it. Many
    rules, or a table of them (verdict, host, path), are joined: a url looks up
    its host and the domains above it, each with as much of its path as some
    rule has. Distinct (host, path) pairs travel, not rows."""
    if not isinstance(rules, DataFrame) and len(rules) <= _MOST_RULES:
        return df.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    if not isinstance(rules, DataFrame):
        rules = df.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    told = rules.select(F.col("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.col("path").alias("r_path"))
    told = told.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # "block" > "allow"
    cuts = told.select(F.col("r_host").alias("c_host"), F.length("r_path").alias("cut")).distinct()
    one = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    seen = one.withColumn("r_host", F.explode(above))
    seen = seen.join(cuts, F.col("r_host") == F.col("c_host")).where(F.length("path") >= F.col("cut")).withColumn("r_path", F.expr("substring(path, 1, cut)"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.col("r_verdict"), F.concat("r_host", "r_path").alias("rule"))
    best = seen.join(told, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max(rank).alias("b"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.struct(F.col("b.rule").alias("rule"), F.col("b.r_verdict").alias("verdict")).alias("fit"))
    return df.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").drop("b_host", "b_path")


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments worked off."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    ends = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    plain = F.array_join(kept, "/")
    return F.when(path.contains("/."), F.concat(plain, F.when(plain.endswith("/"), F.lit("")).otherwise(ends))).otherwise(path)


def address(url: Column) -> Column:
    """A url as a node: scheme and host in small letters, no default port, dot
    segments worked off, ``/`` for no path, no fragment. Null without ``://``."""
    bare = F.regexp_replace(F.trim(url), "#(?s:.*)$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^((?s:.*?))://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(?s:.*?)://([^/?]*)", 1)), r"\.$", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(bare, r"^(?s:.*?)://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"^[^?]*(\?(?s:.*))$", 1)
    return F.when(bare.contains("://"), F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(_without_dots(path)), query))


def absolute(base: Column, link: Column) -> Column:
    """``link`` seen from the document ``base``."""
    link = F.trim(link)
    origin = F.regexp_extract(base, r"^((?s:.*?)://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^((?s:.*?))://", 1)
    path = F.regexp_extract(base, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .when((link == "") | link.startswith("#"), base)
        .otherwise(F.concat(origin, folder, link))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) addresses: canonical links and client redirects in the markup,
    seen from the page's ``base`` element where it has one."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    lower = F.lower(html)
    tags = F.when(lower.contains("canonical") | lower.contains("refresh"), F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    quoted = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def value(tag: Column, name: str) -> Column:
        return F.concat(*[F.regexp_extract(tag, r"(?is)\s" + name + quoted, k) for k in (1, 2, 3)])

    page = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), tags.alias("tags")).where(F.size("tags") > 0)
    based = F.get(F.filter("tags", lambda t: t.rlike("(?i)^<base") & (value(t, "href") != "")), F.lit(0))
    one = page.select("url", F.coalesce(absolute(F.col("url"), value(based, "href")), "url").alias("seen"), F.explode("tags").alias("tag"))
    canonical = F.when(F.lower(value(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)"), value(F.col("tag"), "href"))
    refresh = F.when(F.lower(value(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(value(F.col("tag"), "content"), r"""(?is)url\s*=\s*['"]?([^'"]+)""", 1))
    target = F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&"))
    out = one.select("url", "seen", target.alias("to")).where("to <> ''")
    return out.select(address(F.col("url")).alias("src"), address(absolute(F.col("seen"), F.col("to"))).alias("dst"))


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """-> (id, host, path, rule, verdict), one row per row of ``pages``.

    ``redirects`` (src, dst urls) adds redirects known from elsewhere to what
    the markup says. ``rules`` are a list or a table (verdict, host, path). A
    null url, or one without ``://``, has an empty host and path, fits no rule
    and has no aliases: allowed. Repeated urls are one node. Null html has no
    links. Urls and html are read whole, however long. Only the named columns
    are read, so others may have any name. An empty table gives an empty table.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"))
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst")))
    edges = cut(edges.where("src <> dst"), "aliases")
    out = with_fitting_rule(rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    if edges.isEmpty():
        told = F.lit(None).cast("string")
    else:
        comp = cut(components(edges), "alias-components")
        named = with_fitting_rule(comp.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
        # An allow anywhere in the component comes first: "allow" < "block".
        sides = named.groupBy("component").agg(F.min("fit.verdict").alias("told")).where("told is not null")
        by_node = comp.join(sides, "component").select(F.col("node").alias("address"), "told")
        out = out.withColumn("address", address(F.col("url"))).join(by_node, "address", "left")
        told = F.col("told")
    return out.select("id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", told, F.lit("allow")).alias("verdict"))
