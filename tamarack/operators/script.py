"""The arithmetic language of script_score and bucket_script, compiled to columns."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z0-9_.]*)|([-+*/()]))")
MAX_CHARS, MAX_TOKENS = 512, 128


def tokens_of(script: str) -> list[tuple[str, str]]:
    if len(script) > MAX_CHARS:
        raise RequestError(f"script is longer than {MAX_CHARS} characters")
    out, at = [], 0
    while script[at:].strip():
        m = TOKEN.match(script, at)
        if not m:
            raise RequestError(f"script: unexpected {script[at:].strip()[0]!r}")
        kind = ("number", "name", "sign")[m.lastindex - 1]
        out.append((kind, m.group(m.lastindex)))
        at = m.end()
        if len(out) > MAX_TOKENS:
            raise RequestError(f"script has more than {MAX_TOKENS} tokens")
    return out


def finite(c: Column) -> Column:
    """The value, or null where it isn't a finite number."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def compile_script(script: str, variable: Callable[[str], Column], smallest_divisor: float = 0.0) -> Column:
    """A double; null where a variable is null, a divisor is 0 (or below `smallest_divisor`) or a step isn't finite."""
    tokens = tokens_of(script)
    at = 0

    def peek() -> str:
        return tokens[at][1] if at < len(tokens) and tokens[at][0] == "sign" else ""

    def term() -> Column:
        nonlocal at
        left = factor()
        while (op := peek()) in ("*", "/"):
            at += 1
            right = factor()
            if op == "*":
                left = finite(left * right)
            else:
                zero = F.abs(right) < smallest_divisor if smallest_divisor else right == 0
                left = finite(F.try_divide(left, F.when(~zero, right)))
        return left

    def total() -> Column:
        nonlocal at
        left = term()
        while (op := peek()) in ("+", "-"):
            at += 1
            right = term()
            left = finite(left + right if op == "+" else left - right)
        return left

    def factor() -> Column:
        nonlocal at
        if at >= len(tokens):
            raise RequestError("script ends too early")
        kind, text = tokens[at]
        at += 1
        if kind == "number":
            value = float(text)
            if not math.isfinite(value):
                raise RequestError("script: number out of range")
            return F.lit(value)
        if kind == "name":
            return variable(text).cast("double")
        if text == "-":
            return -factor()
        if text == "(":
            inner = total()
            if peek() != ")":
                raise RequestError("script: missing )")
            at += 1
            return inner
        raise RequestError(f"script: unexpected {text!r}")

    out = total()
    if at != len(tokens):
        raise RequestError(f"script: unexpected {tokens[at][1]!r}")
    return out
