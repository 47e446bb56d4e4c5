"""Reading and printing score values."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"float": "double", "int": "bigint", "str": "string", "bool": "boolean"}
#: Tokens that are missing values by default; text and flags have none.
DEFAULT_NA = {"float": ("", "nan", ".", "NA"), "int": ("", "nan", ".", "NA"), "str": (), "bool": ()}


def parse_value(raw: Column, kind: str, na=None) -> Column:
    """A cell as ``float``, ``int``, ``str`` or ``bool``. Missing tokens match the
    whole text, or the number it reads as; what does not parse is null."""
    if kind not in KINDS:
        raise ValueError(f"unknown value type {kind!r}")
    tokens = DEFAULT_NA[kind] if na is None else tuple(na) if isinstance(na, (list, tuple, set)) else (na,)
    texts = [str(t) for t in tokens]
    missing = raw.isin(texts) if texts else F.lit(False)
    text = F.trim(raw)
    if kind == "str":
        value = raw
    elif kind == "float":
        value = text.try_cast("double")
    elif kind == "int":
        value = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    else:
        value = F.when(F.lower(text).isin("true", "yes", "1", "t", "y"), True).when(F.lower(text).isin("false", "no", "0", "f", "n", ""), False)
    if kind in ("float", "int"):
        numbers = []
        for t in tokens:
            try:
                numbers.append(float(t))
            except ValueError:
                continue
        numbers = [x for x in numbers if x == x]
        if numbers:
            missing = missing | F.coalesce(value.cast("double").isin(numbers), F.lit(False))
    return F.when(missing | raw.isNull(), F.lit(None)).otherwise(value)


def numeric_na(value: Column, na) -> Column:
    """Missing values of a column that is already numeric (binary tracks): only
    configured numbers match."""
    numbers = [float(t) for t in (na if isinstance(na, (list, tuple, set)) else [na]) if _is_number(t)] if na is not None else []
    return F.when(~value.isin(numbers), value) if numbers else value


def _is_number(t) -> bool:
    try:
        float(t)
    except (TypeError, ValueError):
        return False
    return True


def c_general(value: Column) -> Column:
    """A float as it is printed: three significant digits, six for 100 <= v <
    100000. C's %g drops trailing zeros, which Spark's printf does not, so this
    is a vectorised function, for writers only."""

    @F.pandas_udf("string")
    def show(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or pd.isna(v) else ("%.6g" if 100 <= v < 100_000 else "%.3g") % v)

    return show(value)


def stringify(value: Column, kind: str, missing: str = "") -> Column:
    """A result as text: floats by ``c_general``, flags yes or empty, maps
    ``k:v;k:v``, lists in brackets, null as ``missing``."""
    if kind == "double":
        out = F.coalesce(F.when(F.isnan(value), F.lit("nan")), c_general(value))
    elif kind == "boolean":
        out = F.when(value, "yes").otherwise("")
    elif kind.startswith("map"):
        out = F.array_join(F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ";")
    elif kind.startswith("array"):
        quote = "string" in kind
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.concat(F.lit("'"), x, F.lit("'")) if quote else x.cast("string")), ", ", "None"), F.lit("]"))
    else:
        out = value.cast("string")
    return F.when(value.isNull(), F.lit(missing)).otherwise(out)


def vcf_escape(text: Column) -> Column:
    """A value for a VCF INFO field: ``;`` and ``,`` become ``|``, a space ``_``."""
    pairs = ((";", "|"), (",", "|"), (" ", "_"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def vcf_text(value: Column, kind: str) -> Column:
    """A result as a VCF INFO value, ``.`` for none: items of a list, or ``k:v``
    of a map, by ``|``; others as ``stringify`` has them."""
    if kind.startswith("array"):
        out = F.array_join(F.transform(value, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ";")
    elif kind.startswith("map"):
        out = F.array_join(F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ";")
    else:
        return vcf_escape(stringify(value, kind, "."))
    return F.when(value.isNull(), F.lit(".")).otherwise(vcf_escape(out))
