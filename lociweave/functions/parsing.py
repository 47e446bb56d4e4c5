"""A small tokenizer and precedence parser shared by the two expression languages."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SyntaxProblem(ValueError):
    """An expression that the language does not have."""


@dataclass(frozen=True)
class Token:
    kind: str  # number, text, name, op, end
    value: str


_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<text>'[^']*'|"[^"]*")|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>//|==|!=|>=|<=|[-+*/%<>(),]))""")


def tokenize(source: str, most: int = 10_000) -> list[Token]:
    if len(source) > most:
        raise SyntaxProblem(f"longer than {most} characters")
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise SyntaxProblem(f"cannot read {source[at:at + 20]!r}")
        kind = m.lastgroup
        value = m[kind]
        out.append(Token(kind, value[1:-1] if kind == "text" else value))
        at = m.end()
    return [*out, Token("end", "")]


class Reader:
    def __init__(self, source: str):
        self.tokens, self.at = tokenize(source), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def accept(self, *values: str) -> str | None:
        if self.now.kind in ("op", "name") and self.now.value in values:
            return self.take().value
        return None

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise SyntaxProblem(f"expected {value!r}, found {self.now.value!r}")

    def finish(self) -> None:
        if self.now.kind != "end":
            raise SyntaxProblem(f"unexpected {self.now.value!r}")
