"""The record filter language: comparisons, ``in``, ``and``, ``or``, ``not``.

Names stand for columns of the record. A comparison with a missing operand is
false, and stays false-valued below ``not`` (so ``not (x == 1)`` holds where x
is missing): every comparison is compiled with its null, and NaN, turned into
false. ``a in b`` holds where the text b contains the text a.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import Reader, SyntaxProblem

_COMPARE = ("==", "!=", ">=", "<=", ">", "<", "in")
_WORDS = ("and", "or", "not", "in")


def compile_filter(source: str, columns: Mapping[str, str]) -> Column:
    """``columns``: name -> type (``string``, ``double``, ``bigint``, ``boolean``)
    of what the filter may read; any other name is an error."""
    r = Reader(source)
    out = _either(r, columns)
    r.finish()
    return out


def _either(r: Reader, columns) -> Column:
    out = _both(r, columns)
    while r.accept("or"):
        out = out | _both(r, columns)
    return out


def _both(r: Reader, columns) -> Column:
    out = _negated(r, columns)
    while r.accept("and"):
        out = out & _negated(r, columns)
    return out


def _negated(r: Reader, columns) -> Column:
    if r.accept("not"):
        return ~_negated(r, columns)
    if r.now.value == "(" and r.now.kind == "op":
        r.take()
        out = _either(r, columns)
        r.expect(")")
        return out
    left = _operand(r, columns)
    op = r.accept(*_COMPARE)
    if op is None:
        raise SyntaxProblem(f"expected a comparison, found {r.now.value!r}")
    return _comparison(op, left, _operand(r, columns))


def _operand(r: Reader, columns) -> tuple[Column, str]:
    t = r.now
    if t.kind == "op" and t.value in "+-":
        r.take()
        if r.now.kind != "number":
            raise SyntaxProblem("a sign needs a number")
        x = float(r.take().value)
        return F.lit(-x if t.value == "-" else x), "double"
    if t.kind == "number":
        return F.lit(float(r.take().value)), "double"
    if t.kind == "text":
        return F.lit(r.take().value), "string"
    if t.kind == "name" and t.value not in _WORDS:
        r.take()
        if t.value not in columns:
            raise SyntaxProblem(f"unknown name {t.value!r}")
        return F.col(t.value), columns[t.value]
    raise SyntaxProblem(f"expected a value, found {t.value!r}")


def _comparison(op: str, left: tuple[Column, str], right: tuple[Column, str]) -> Column:
    (a, ta), (b, tb) = left, right
    if op == "in":
        return F.coalesce(F.contains(b.cast("string"), a.cast("string")), F.lit(False))
    if (ta == "string") != (tb == "string"):
        # Text and number never compare equal; order between them is no comparison.
        known = a.isNotNull() & b.isNotNull()
        if op not in ("==", "!="):
            raise SyntaxProblem(f"{op} between text and number")
        return known if op == "!=" else known & F.lit(False)
    out = {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    for x, t in (left, right):
        if t == "double":
            out = F.when(F.isnan(x), F.lit(op == "!=")).otherwise(out)
    missing = a.isNull() | b.isNull()
    return F.when(missing, F.lit(False)).otherwise(out)
