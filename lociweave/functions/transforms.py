"""Value transforms: arithmetic over ``value``, compiled to a column.

Python's meaning is kept where Spark's differs: ``//`` floors, ``%`` takes the
sign of the divisor, ``round`` goes half to even, ``if`` tests truth, and ``and``/``or`` give the side
that decides. A null value stays null throughout (no error), as does division by zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import Reader, SyntaxProblem

_FUNCTIONS = ("len", "abs", "min", "max", "round", "int", "float", "str", "bool")


def compile_transform(source: str, value: Column, kind: str) -> tuple[Column, str]:
    """``kind``: ``double``, ``bigint``, ``string``, ``boolean`` or ``array``.
    -> the column and its kind."""
    r = Reader(source)
    out = _choice(r, (value, kind))
    r.finish()
    return out


def _truth(x: tuple[Column, str]) -> Column:
    c, k = x
    if k == "boolean":
        return c
    if k == "string":
        return F.length(c) > 0
    if k == "array":
        return F.size(c) > 0
    return c != 0


def _number(x: tuple[Column, str]) -> tuple[Column, str]:
    c, k = x
    if k == "boolean":
        return c.cast("bigint"), "bigint"
    if k not in ("double", "bigint"):
        raise SyntaxProblem(f"arithmetic on {k}")
    return c, k


def _common(a, b) -> str:
    return "double" if "double" in (a[1], b[1]) else "bigint"


def _choice(r: Reader, v):
    out = _or(r, v)
    if r.accept("if"):
        test = _truth(_or(r, v))
        r.expect("else")
        other = _choice(r, v)
        kind = out[1] if out[1] == other[1] else _common(_number(out), _number(other))
        return F.when(test.isNull(), F.lit(None)).when(test, out[0].cast(kind)).otherwise(other[0].cast(kind)), kind
    return out


def _either(a, b, when: bool):
    """``a`` where its truth is ``when``, else ``b``, as values, not as flags."""
    if a[1] == b[1] == "boolean":
        return (_truth(a) | _truth(b) if when else _truth(a) & _truth(b)), "boolean"
    kind = a[1] if a[1] == b[1] else _common(_number(a), _number(b))
    test = _truth(a)
    return F.when(test.isNull(), F.lit(None)).when(test if when else ~test, a[0].cast(kind) if kind != "array" else a[0]).otherwise(b[0].cast(kind) if kind != "array" else b[0]), kind


def _or(r: Reader, v):
    out = _and(r, v)
    while r.accept("or"):
        out = _either(out, _and(r, v), True)
    return out


def _and(r: Reader, v):
    out = _not(r, v)
    while r.accept("and"):
        out = _either(out, _not(r, v), False)
    return out


def _not(r: Reader, v):
    if r.accept("not"):
        return ~_truth(_not(r, v)), "boolean"
    out = _sum(r, v)
    chain = None
    while op := r.accept("==", "!=", ">=", "<=", ">", "<"):
        b = _sum(r, v)
        a = out[0]
        test = {"==": a == b[0], "!=": a != b[0], ">": a > b[0], ">=": a >= b[0], "<": a < b[0], "<=": a <= b[0]}[op]
        chain = test if chain is None else chain & test
        out = b
    return out if chain is None else (chain, "boolean")


def _sum(r: Reader, v):
    out = _product(r, v)
    while op := r.accept("+", "-"):
        b = _product(r, v)
        if op == "+" and out[1] == b[1] == "string":
            out = (F.concat(out[0], b[0]), "string")
            continue
        a, b = _number(out), _number(b)
        out = (a[0] + b[0] if op == "+" else a[0] - b[0], _common(a, b))
    return out


def _product(r: Reader, v):
    out = _signed(r, v)
    while op := r.accept("*", "//", "/", "%"):
        a, b = _number(out), _number(_signed(r, v))
        kind = _common(a, b)
        zero = b[0] == 0
        if op == "*":
            out = (a[0] * b[0], kind)
        elif op == "/":
            out = (F.when(~zero, a[0].cast("double") / F.nullif(b[0].cast("double"), F.lit(0.0))), "double")
        elif op == "//":
            # floor(a / b): without the remainder that has the divisor's sign, the division is whole.
            m = _remainder(a[0], b[0], zero)
            q = (a[0] - m) / F.when(~zero, b[0])
            out = (F.rint(q.cast("double")).cast(kind), kind)
        else:
            out = (_remainder(a[0], b[0], zero), kind)
    return out


def _remainder(a: Column, b: Column, zero: Column) -> Column:
    safe = F.when(~zero, b)
    m = a % safe
    return F.when((m != 0) & ((m < 0) != (safe < 0)), m + safe).otherwise(m)


def _signed(r: Reader, v):
    if r.accept("-"):
        c, k = _number(_signed(r, v))
        return -c, k
    if r.accept("+"):
        return _number(_signed(r, v))
    return _atom(r, v)


def _atom(r: Reader, v):
    t = r.take()
    if t.kind == "number":
        whole = t.value.isdigit()
        return (F.lit(int(t.value)).cast("bigint"), "bigint") if whole else (F.lit(float(t.value)), "double")
    if t.kind == "text":
        return F.lit(t.value), "string"
    if t.kind == "op" and t.value == "(":
        out = _choice(r, v)
        r.expect(")")
        return out
    if t.kind == "name":
        if t.value == "value":
            return v
        if t.value in ("True", "False"):
            return F.lit(t.value == "True"), "boolean"
        if t.value == "None":
            return F.lit(None).cast("double"), "double"
        if t.value in _FUNCTIONS:
            r.expect("(")
            args = [_choice(r, v)]
            while r.accept(","):
                args.append(_digits(r) if t.value == "round" else _choice(r, v))
            r.expect(")")
            return _call(t.value, args)
    raise SyntaxProblem(f"unexpected {t.value!r}")


def _digits(r: Reader) -> int:
    """The second argument of ``round`` is a literal, as a plan needs it."""
    sign = -1 if r.accept("-") else 1
    t = r.take()
    if t.kind != "number" or not t.value.isdigit():
        raise SyntaxProblem("round takes a literal number of digits")
    return sign * int(t.value)


def _call(name: str, args):
    c, k = args[0]
    if name in ("min", "max"):
        if len(args) == 1:
            if k != "array":
                raise SyntaxProblem(f"{name} of one value")
            return (F.array_min(c) if name == "min" else F.array_max(c)), "double"
        kind = "double" if any(a[1] == "double" for a in args) else args[0][1]
        cols = [a[0].cast(kind) for a in args]
        # Null in, null out, unlike least and greatest.
        some = F.lit(False)
        for a in cols:
            some = some | a.isNull()
        return F.when(~some, (F.least if name == "min" else F.greatest)(*cols)), kind
    if name == "round":
        if len(args) == 1:
            return F.bround(c, 0).cast("bigint"), "bigint"
        return F.bround(c, args[1]), k
    if len(args) != 1:
        raise SyntaxProblem(f"{name} takes one value")
    if name == "abs":
        c, k = _number((c, k))
        return F.abs(c), k
    if name == "len":
        return (F.size(c) if k == "array" else F.length(c)).cast("bigint"), "bigint"
    if name == "int":
        # Towards zero, as a cast from double does; text must be a number.
        return (F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("bigint")) if k == "string" else c.try_cast("bigint")), "bigint"
    if name == "float":
        return c.try_cast("double"), "double"
    if name == "str":
        return c.cast("string"), "string"
    return _truth((c, k)), "boolean"
