"""The eleven aggregators, over (value, weight) rows of a group.

A weight w counts as w copies of the value. Nulls do not count. Only ``list``,
``join`` and ``concatenate``, which return the copies, make them.
Over no value at all ``list`` is [], ``value_count`` {}, ``bool`` false and the
others null. Where order matters, rows are taken by an explicit order key.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_ONLY = ("max", "min", "mean", "median")
NAMES = ("max", "min", "mean", "median", "mode", "count", "concatenate", "join", "list", "bool", "value_count")


@dataclass(frozen=True)
class Aggregator:
    name: str
    separator: str = ", "

    def kind(self, value_kind: str) -> str:
        """Type of the result for values of ``value_kind``."""
        element = value_kind[6:-1] if value_kind.startswith("array<") else value_kind
        return {
            "max": "double" if value_kind != "string" else "string",
            "min": "double" if value_kind != "string" else "string",
            "mean": "double",
            "median": "double" if value_kind != "string" else "string",
            "mode": value_kind,
            "count": "bigint",
            "concatenate": "string",
            "join": "string",
            "list": f"array<{element}>",
            "bool": "boolean",
            "value_count": f"map<{element},bigint>",
        }[self.name]


def parse(text: str, value_kind: str | None = None) -> Aggregator:
    """``mean``, ``join(;)`` ... An unknown name, a parameter where none is
    known, or a numeric aggregator over text is an error."""
    m = re.fullmatch(r"\s*([a-z_]+)\s*(?:\((.*)\))?\s*", text, re.S)
    if m is None or m[1] not in NAMES:
        raise ValueError(f"unknown aggregator {text!r}")
    if m[2] is not None and m[1] != "join":
        raise ValueError(f"{m[1]} takes no parameter")
    if value_kind is not None and m[1] in NUMERIC_ONLY and value_kind not in ("double", "bigint"):
        raise ValueError(f"{m[1]} needs numbers, not {value_kind}")
    return Aggregator(m[1], m[2] if m[2] is not None else ", ")


#: Aggregators that look at values with their total weights only.
FOLDED = ("mode", "value_count", "median")
#: Aggregators whose result has every value, in order.
ORDERED = ("list", "concatenate", "join")


def _items(value: Column, weight: Column, order: Column, kind: str) -> Column:
    """The values in order, each as often as its weight; nulls left out. Only
    results that are themselves that long are made from it."""
    kept = F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"), weight.cast("int").alias("w"))))
    one = F.transform(F.array_sort(kept), lambda x: F.array_repeat(x["v"], x["w"]))
    out = F.flatten(one)
    return F.flatten(out) if kind.startswith("array<") else out


def _entries(value: Column, weight: Column) -> Column:
    """Sorted (key, value) of distinct values and their weights, from one row
    for each value and weight of a group; equal values are added up."""
    kept = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(value.alias("key"), weight.cast("bigint").alias("value")))))
    keys = F.array_distinct(F.transform(kept, lambda e: e["key"]))
    summed = F.transform(keys, lambda k: F.struct(k.alias("key"), F.aggregate(F.filter(kept, lambda e: e["key"] == k), F.lit(0).cast("bigint"), lambda a, e: a + e["value"]).alias("value")))
    return F.when(F.size(keys) == F.size(kept), kept).otherwise(summed)


def _told(name: str, entries: Column, kind: str) -> Column:
    """``mode``, ``value_count`` or the median of texts, from sorted entries."""
    if name == "value_count":
        return F.map_from_entries(entries)
    if name == "mode":  # the heaviest, of equals the smallest
        best = F.aggregate(entries, F.struct(F.lit(None).cast(kind).alias("key"), F.lit(0).cast("bigint").alias("value")), lambda a, e: F.when(e["value"] > a["value"], e).otherwise(a))
        return best["key"]
    total = F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, e: a + e["value"])

    def at(place: Column) -> Column:
        none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(kind).alias("v"))
        return F.aggregate(entries, none, lambda a, e: F.struct((a["n"] + e["value"]).alias("n"), F.when(a["v"].isNull() & (a["n"] + e["value"] > place), e["key"]).otherwise(a["v"]).alias("v")))["v"]

    middle = (total / 2).cast("bigint")
    return F.when(total == 0, F.lit(None)).when(total % 2 == 1, at(middle)).otherwise(F.concat(at(middle - 1), at(middle)))


def aggregate(agg: Aggregator, value: Column, weight: Column, order: Column, kind: str) -> Column:
    """An aggregate expression for ``groupBy(...).agg``. ``mode``, ``value_count``
    and the median of texts collect the group's values; ``grouped`` adds weights
    up by value first."""
    n = agg.name
    if n in ("max", "min"):
        return (F.max if n == "max" else F.min)(value if kind == "string" else value.cast("double"))
    if n == "mean":
        num = F.sum(value.cast("double") * weight)
        return num / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0))
    if n == "count":
        return F.nullif(F.sum(F.when(value.isNotNull(), weight)).cast("bigint"), F.lit(0).cast("bigint"))
    if n == "bool":
        return F.count(value) > 0
    if n == "median" and kind != "string":
        return F.percentile(value.cast("double"), 0.5, F.when(value.isNotNull(), weight).otherwise(F.lit(0)).cast("bigint"))
    if n in FOLDED and not kind.startswith("array<"):
        return _told(n, _entries(value, weight), kind)
    items = _items(value, weight, order, kind)
    if n == "list":
        return items
    if n in ("concatenate", "join"):
        return F.nullif(F.array_join(F.transform(items, lambda x: x.cast("string")), "" if n == "concatenate" else agg.separator), F.lit(""))
    counted = F.transform(F.array_sort(F.array_distinct(items)), lambda v: F.struct(v.alias("key"), F.size(F.filter(items, lambda x: x == v)).cast("bigint").alias("value")))
    return _told(n, counted, agg.kind(kind) if n == "mode" else kind)


@dataclass(frozen=True)
class Asked:
    """One aggregate over a group: of ``value`` (type ``kind``), as ``column``."""

    agg: Aggregator
    value: Column
    kind: str
    column: str


def _halves(k: int, a: Asked, weight: Column) -> tuple[list[Column], Column]:
    """What is kept of the rows of a group with equal folded values, and the
    aggregate over what is kept."""
    n, v = a.agg.name, a.value
    if n in ("max", "min"):
        f = F.max if n == "max" else F.min
        return [f(v if a.kind == "string" else v.cast("double")).alias(f"__a{k}")], f(f"__a{k}")
    known = F.sum(F.when(v.isNotNull(), weight)).alias(f"__n{k}")
    if n == "mean":
        return [F.sum(v.cast("double") * weight).alias(f"__a{k}"), known], F.sum(f"__a{k}") / F.nullif(F.sum(f"__n{k}"), F.lit(0))
    if n == "count":
        return [known], F.nullif(F.sum(f"__n{k}").cast("bigint"), F.lit(0).cast("bigint"))
    return [F.count(v).alias(f"__a{k}")], F.sum(f"__a{k}") > 0


def grouped(rows: DataFrame, keys: list[str], asked: list[Asked], weight: Column, order: Column, firsts: dict[str, Column] | None = None) -> DataFrame:
    """``rows.groupBy(keys)`` with the aggregates asked for, and ``firsts``: the
    least of each expression.

    Where only values with their weights matter, equal values of a group are
    added up in an aggregate of their own, which runs before the shuffle too: a
    group then has a row for each distinct value, not for each record it met.
    Values are collected as they come only for results that have them all.
    """
    firsts = firsts or {}
    folded = [a for a in asked if a.agg.name in FOLDED and not a.kind.startswith("array<")]
    plain = [a for a in asked if a not in folded]
    if not folded or any(a.agg.name in ORDERED or a.kind.startswith("array<") for a in plain):
        least = [F.min(c).alias(k) for k, c in firsts.items()]
        return rows.groupBy(*keys).agg(*[aggregate(a.agg, a.value, weight, order, a.kind).alias(a.column) for a in asked], *least)
    # One column for each folded value, however often it is asked for.
    columns: dict[str, Column] = {}
    of = []
    for a in folded:
        name = next((c for c, v in columns.items() if str(v) == str(a.value)), f"__f{len(columns)}")
        columns.setdefault(name, a.value)
        of.append(name)
    halves = [_halves(k, a, weight) for k, a in enumerate(plain)]
    kept = [c for some, _ in halves for c in some] + [F.min(c).alias(k) for k, c in firsts.items()]
    by_value = rows.groupBy(*keys, *[v.alias(c) for c, v in columns.items()]).agg(F.sum(weight).cast("bigint").alias("__w"), *kept)
    out = [last.alias(a.column) for a, (_, last) in zip(plain, halves, strict=True)]
    for a, c in zip(folded, of, strict=True):
        out.append(aggregate(a.agg, F.col(c), F.col("__w"), F.lit(0), a.kind).alias(a.column))
    told = by_value.groupBy(*keys).agg(*out, *[F.min(k).alias(k) for k in firsts])
    return told.select(*keys, *[a.column for a in asked], *firsts)
