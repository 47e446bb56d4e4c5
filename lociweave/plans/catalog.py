"""Resources: versions, identity, search, and what an annotator gets for an id."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import SyntaxProblem

SCHEMA = "full_id string, id string, version array<int>, type string, description string, summary string, labels map<string,string>"
#: Types that a search takes for one another.
SAME_TYPE = {"fragment_score": ("fragment_score", "cnv_collection"), "cnv_collection": ("fragment_score", "cnv_collection"), "allele_score": ("allele_score", "np_score"), "np_score": ("allele_score", "np_score")}


def parse_id(full_id: str) -> tuple[str, tuple[int, ...]]:
    """``name(1.2)`` -> name and version; without a version it is 0."""
    m = re.fullmatch(r"([A-Za-z0-9_./-]+?)(?:\((\d+(?:\.\d+)*)\))?", full_id)
    if m is None:
        raise ValueError(f"resource id {full_id!r}")
    return m[1], tuple(int(x) for x in m[2].split(".")) if m[2] else (0,)


def parse_constraint(text: str) -> tuple[str, tuple[int, ...]]:
    """``=1.2``, ``>=1.2``, or bare, which means >=."""
    m = re.fullmatch(r"(>=|=)?\s*(\d+(?:\.\d+)*)", text.strip())
    if m is None:
        raise ValueError(f"version constraint {text!r}")
    return m[1] or ">=", tuple(int(x) for x in m[2].split("."))


def newest(resources: DataFrame, constraint: str | None = None) -> DataFrame:
    """The highest version of each id, among those a constraint allows."""
    if constraint:
        op, v = parse_constraint(constraint)
        want = F.array(*[F.lit(x) for x in v])
        resources = resources.where(F.col("version") == want if op == "=" else F.col("version") >= want)
    w = Window.partitionBy("id").orderBy(F.desc("version"), "full_id")
    return resources.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def grouped(*children: DataFrame) -> DataFrame:
    """Repositories in order: of equal full ids the first child's counts."""
    out = None
    for k, c in enumerate(children):
        c = c.withColumn("__k", F.lit(k))
        out = c if out is None else out.unionByName(c)
    w = Window.partitionBy("full_id").orderBy("__k")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__k")


def glob(pattern: str) -> str:
    """A regular expression for ``*`` and ``?``."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


LONGEST = 256


def compile_query(text: str) -> Column:
    """``id-glob[label=glob and text in label ...]``: an id glob, then clauses on
    labels joined by ``and``; a label that is not there is the empty text."""
    if len(text) > LONGEST:
        raise SyntaxProblem(f"longer than {LONGEST} characters")
    m = re.fullmatch(r"\s*([^\[\]]*?)\s*(?:\[(.*)\])?\s*", text, re.S)
    if m is None:
        raise SyntaxProblem(f"cannot read {text!r}")
    out = F.col("id").rlike(glob(m[1])) if m[1] and m[1] != "*" else F.lit(True)
    for clause in re.split(r"\s+and\s+", m[2].strip()) if m[2] and m[2].strip() else []:
        c = re.fullmatch(r"""("[^"]*"|'[^']*'|[^\s=]+)\s*(=|\sin\s)\s*("[^"]*"|'[^']*'|[^\s=]+)""", clause.strip())
        if c is None:
            raise SyntaxProblem(f"cannot read the clause {clause!r}")
        a, op, b = c[1].strip("\"'"), c[2].strip(), c[3].strip("\"'")
        label = lambda k: F.coalesce(F.col("labels")[k], F.lit(""))
        out = out & (label(a).rlike(glob(b)) if op == "=" else F.contains(label(b), F.lit(a)))
    return out


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def inverted_index(resources: DataFrame) -> DataFrame:
    """(word, full_id): the search index, to be kept as a table."""
    text = F.concat_ws(" ", "full_id", "type", "description", "summary", F.array_join(F.map_values("labels"), " "))
    return resources.select("full_id", F.explode(F.array_distinct(words(text))).alias("word"))


def search(resources: DataFrame, term: str | None = None, type: str | None = None, query: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Resources that have every word of ``term`` (a trailing * is a prefix), a
    type, and satisfy a query; newest first by id is up to the caller."""
    out = resources
    if type:
        out = out.where(F.col("type").isin(*SAME_TYPE.get(type, (type,))))
    if query:
        out = out.where(compile_query(query))
    if term and term.strip():
        ix = index if index is not None else inverted_index(resources)
        for k, w in enumerate(re.findall(r"[^\W_]+\*?", term.lower())):
            hit = F.col("word").startswith(w[:-1]) if w.endswith("*") else F.col("word") == w
            out = out.join(ix.where(hit).select(F.col("full_id").alias(f"__f{k}")).distinct(), F.col("full_id") == F.col(f"__f{k}"), "left_semi")
    return out


@dataclass
class Resource:
    id: str
    type: str
    value: Any  # a Score, a DataFrame, a Genome ...
    labels: dict[str, str] = field(default_factory=dict)
    description: str = ""
    summary: str = ""
    default_attributes: list[dict] = field(default_factory=list)


class Catalog:
    """Resources by id, driver-side; their data stays in DataFrames."""

    def __init__(self, resources: list[Resource] = (), genome: str | None = None, gene_models: str | None = None):
        self._by_id: dict[str, dict[tuple[int, ...], Resource]] = {}
        self.genome, self.gene_models = genome, gene_models
        for r in resources:
            self.add(r)

    def add(self, r: Resource) -> None:
        name, version = parse_id(r.id)
        self._by_id.setdefault(name, {}).setdefault(version, r)  # the first wins

    def get(self, ref: str) -> Resource:
        name, _, rest = ref.partition("(")
        versions = self._by_id.get(name)
        if not versions:
            raise KeyError(f"no resource {ref!r}")
        if rest:
            op, want = parse_constraint(rest.rstrip(")"))
            versions = {v: r for v, r in versions.items() if (v == want if op == "=" else v >= want)}
            if not versions:
                raise KeyError(f"no version of {name} satisfies {rest.rstrip(')')}")
        return versions[max(versions)]

    def matching(self, pattern: str, types: tuple[str, ...] = ()) -> list[Resource]:
        rx = re.compile(glob(pattern))
        got = [self.get(n) for n in sorted(self._by_id) if rx.match(n)]
        got = [r for r in got if not types or r.type in types]
        if not got:
            raise ValueError(f"nothing matches {pattern!r}")
        return got

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.id, n, list(v), r.type, r.description, r.summary, r.labels) for n, vs in self._by_id.items() for v, r in vs.items()]
        return spark.createDataFrame(rows, SCHEMA)


Factory = Callable[..., DataFrame]
