"""The subread filter language: comparisons of zm ln rq bc1 bc2 bq np qs and integers, joined by && || and parentheses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("zm", "ln", "rq", "bc1", "bc2", "bq", "np", "qs")
DEFAULT = "ln>=500 && rq>=750"
_TOKEN = re.compile(r"\s*(?:(\d+)|([a-z]+\d?)|(&&|\|\||[<>!=]=|[<>()]))")
_COMPARE = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__}


def parse(text: str) -> Column:
    """The condition as a column; ValueError for anything outside the language. && binds before ||."""
    tokens: list[tuple[str, str]] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 10]!r} in filter")
        tokens.append(("int", m[1]) if m[1] else ("field", m[2]) if m[2] else ("op", m[3]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def take(*values: str) -> str | None:
        nonlocal place
        if tokens[place][1] in values and tokens[place][0] == "op":
            place += 1
            return tokens[place - 1][1]
        return None

    def operand() -> Column:
        nonlocal place
        kind, value = tokens[place]
        place += 1
        if kind == "int":
            return F.lit(int(value))
        if kind == "field" and value in FIELDS:
            return F.col(value)
        raise ValueError(f"a field or number is missing before {value!r}")

    def comparison() -> Column:
        if take("("):
            inner = either()
            if not take(")"):
                raise ValueError("a closing parenthesis is missing")
            return inner
        left, op = operand(), take(*_COMPARE)
        if not op:
            raise ValueError("a comparison is missing")
        return _COMPARE[op](left, operand())

    def both() -> Column:
        out = comparison()
        while take("&&"):
            out = out & comparison()
        return out

    def either() -> Column:
        out = both()
        while take("||"):
            out = out | both()
        return out

    out = either()
    if tokens[place][0] != "end":
        raise ValueError(f"unexpected {tokens[place][1]!r} in filter")
    return out
