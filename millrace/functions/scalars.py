"""A calculator for expressions in texts, and clock times in zones."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions and constants by name (fixed values).
FUNCTIONS = {
    "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "log": F.log, "log10": F.log10, "exp": F.exp, "pow": F.pow,
    "degrees": F.degrees, "radians": F.radians, "factorial": lambda c: F.factorial(c.cast("int")).cast("double"),
}
CONSTANTS = {"pi": math.pi, "e": math.e}
LONGEST = 200
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(\*\*|//|[-+*/%^!(),]))")


class ExpressionError(ValueError):
    """An expression that can't be read."""


def _tokens(text: str) -> list[tuple[str, str]]:
    if len(text) > LONGEST:
        raise ExpressionError("the expression is too long")
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:1]!r}")
        out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("mark", m[3]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    """Recursive descent to a Column: sums, products, signs, powers (from the right), factorials."""

    def __init__(self, text: str, names: dict[str, Column]):
        self.tokens, self.at, self.names = _tokens(text), 0, names

    def peek(self, *marks: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind == "mark" and value in marks

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, mark: str) -> None:
        if not self.peek(mark):
            raise ExpressionError(f"{mark!r} is missing")
        self.at += 1

    def sum(self) -> Column:
        left = self.product()
        while self.peek("+", "-"):
            left = left + self.product() if self.take()[1] == "+" else left - self.product()
        return left

    def product(self) -> Column:
        left = self.sign()
        while self.peek("*", "/", "//", "%"):
            op, right = self.take()[1], self.sign()
            if op == "*":
                left = left * right
            else:
                quotient = F.try_divide(left, right)
                floor = F.floor(quotient).cast("double")
                left = quotient if op == "/" else floor if op == "//" else left - right * floor
        return left

    def sign(self) -> Column:
        if self.peek("-", "+"):
            return -self.sign() if self.take()[1] == "-" else self.sign()
        return self.power()

    def power(self) -> Column:
        base = self.postfix()
        if self.peek("^", "**"):
            self.at += 1
            return F.pow(base, self.sign())
        return base

    def postfix(self) -> Column:
        out = self.atom()
        while self.peek("!"):
            self.at += 1
            out = FUNCTIONS["factorial"](out)
        return out

    def atom(self) -> Column:
        kind, value = self.take()
        if kind == "number":
            return F.lit(float(value))
        if kind == "name":
            if value in FUNCTIONS:
                self.expect("(")
                args = [self.sum()]
                while self.peek(","):
                    self.at += 1
                    args.append(self.sum())
                self.expect(")")
                if len(args) != (2 if value == "pow" else 1):
                    raise ExpressionError(f"{value} takes another number of arguments")
                return FUNCTIONS[value](*args)
            if value in CONSTANTS:
                return F.lit(CONSTANTS[value])
            if value in self.names:
                return self.names[value].cast("double")
            raise ExpressionError(f"unknown name {value!r}")
        if (kind, value) == ("mark", "("):
            inner = self.sum()
            self.expect(")")
            return inner
        raise ExpressionError(f"unexpected {value!r}")


def calculate(text: str, **names: Column) -> Column:
    """The value of an expression over numbers and named columns; null where something is divided by zero."""
    parser = _Parser(text, names)
    out = parser.sum()
    if parser.tokens[parser.at][0] != "end":
        raise ExpressionError(f"unexpected {parser.tokens[parser.at][1]!r}")
    return out


def time_in_zone(moment: Column, zone: str = "Asia/Shanghai") -> Column:
    """A UTC time as text in a zone, with the zone's name and offset; a message for an unknown zone."""
    import zoneinfo

    try:
        zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        return F.lit(f"unknown time zone: {zone}")
    utc = moment.cast("timestamp")
    local = F.from_utc_timestamp(utc, zone)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(utc)) / 60).cast("int")
    offset = F.format_string("%s%02d%02d", F.when(minutes < 0, "-").otherwise("+"), F.abs(minutes / 60).cast("int"), F.abs(minutes % 60).cast("int"))
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(f" {zone} "), offset)
