"""Arithmetic typed into a field: + - * / % ^, ratios with colons, signs, parentheses and x.

``a : b`` is the larger over the smaller. Powers, unlike elsewhere, group from the left.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+[.,]?\d*(?:[eE][-+]?\d+)?|[.,]\d+)|([-+*/%^():xX]))")


class _Parser:
    """Recursive descent; ``ops`` builds results, so numbers and columns share one grammar."""

    def __init__(self, text: str, x, ops):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:]!r}")
            self.tokens.append(float(m[1].replace(",", ".")) if m[1] else m[2].lower())
            at = m.end()
        self.at, self.x, self.ops = 0, x, ops

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def chain(self, operators: str, below):
        out = below()
        while isinstance(self.peek(), str) and self.peek() in operators:
            op = self.take()
            out = self.ops[op](out, below())
        return out

    def whole(self):
        out = self.sums()
        if self.peek() is not None:
            raise ValueError(f"unexpected {self.peek()!r}")
        return out

    def sums(self):
        return self.chain("+-", self.products)

    def products(self):
        return self.chain("*/%:", self.powers)

    def powers(self):
        return self.chain("^", self.signed)

    def signed(self):
        if self.peek() in ("+", "-"):
            minus = self.take() == "-"
            value = self.signed()
            return self.ops["neg"](value) if minus else value
        t = self.peek()
        if t == "(":
            self.take()
            out = self.sums()
            if self.peek() != ")":
                raise ValueError("missing )")
            self.take()
            return out
        if t == "x":
            self.take()
            return self.x
        if isinstance(t, float):
            return self.ops["const"](self.take())
        raise ValueError("a number is missing")


_NUMBERS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": math.fmod, "^": lambda a, b: a**b, ":": lambda a, b: max(a, b) / min(a, b), "neg": lambda a: -a, "const": float}
_COLUMNS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "%": lambda a, b: F.try_mod(a, b), "^": F.pow, ":": lambda a, b: F.try_divide(F.greatest(a, b), F.least(a, b)), "neg": lambda a: -a, "const": F.lit}


def evaluate(text: str, x: float = math.nan) -> float:
    """The value; nan if the text is no formula or divides by zero."""
    try:
        return float(_Parser(text, x, _NUMBERS).whole())
    except (ValueError, ZeroDivisionError, OverflowError, TypeError):
        return math.nan


def compile_formula(text: str, x: Column) -> Column:
    """The formula as a column expression of x; raises ValueError if it is none. Division by zero gives null."""
    return _Parser(text, x.cast("double"), _COLUMNS).whole()
