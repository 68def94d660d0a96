"""Filter trees as null-safe predicates: a compiled filter is true or false, never null, unless it is only to be filtered by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError
from ..schema import Field

Get = Callable[[str], Column]


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_value(path: str, fields: dict[str, Field], get: Get, kinds: tuple[str, ...], test: Callable[[Column], Column], exact: bool = True) -> Column:
    """Whether some value under a dotted path passes; false for unknown fields, other kinds and fields that aren't fast."""
    head, _, rest = (path, "", "") if path in fields else path.partition(".")
    f = fields.get(head)
    if f is None:
        return F.lit(False)
    c = get(head)
    if rest:
        if f.kind != "nested":
            return F.lit(False)
        inner = lambda o: any_value(rest, f.fields, lambda n: o[n], kinds, test)
        return two_valued(F.exists(c, inner)) if f.many else two_valued(c.isNotNull() & inner(c))
    if f.kind not in kinds or not f.fast:
        return F.lit(False)
    found = F.exists(c, test) if f.many else test(c)
    return two_valued(found) if exact else found


def compile_filter(spec: dict, fields: dict[str, Field], get: Get = F.col, exact: bool = True) -> Column:
    """KeywordEq, KeywordIn, I64Range, F64Range, Nested, And, Or and Not, over top-level columns or the fields of an object.

    With `exact` false, null may stand for false: plain comparisons then reach the Parquet scan.
    """
    if not isinstance(spec, dict) or len(spec) != 1:
        raise RequestError(f"not a filter: {spec!r}")
    kind, x = next(iter(spec.items()))
    if kind == "KeywordEq":
        return any_value(x["field"], fields, get, ("keyword",), lambda c: F.lower(c) == x["value"].lower(), exact)
    if kind == "KeywordIn":
        return any_value(x["field"], fields, get, ("keyword",), lambda c: F.lower(c).isin([v.lower() for v in x["values"]]), exact)
    if kind == "I64Range":
        return any_value(x["field"], fields, get, ("i64",), lambda c: c.between(int(x["min"]), int(x["max"])), exact)
    if kind == "F64Range":
        return any_value(x["field"], fields, get, ("f64",), lambda c: c.between(float(x["min"]), float(x["max"])), exact)
    if kind == "Nested":
        return nested(x["path"], [x["filter"]], fields, get)
    if kind == "And":
        # Clauses on the same nested path speak of the same object.
        by_path: dict[str, list[dict]] = {}
        out = F.lit(True)
        for clause in x:
            if "Nested" in clause:
                by_path.setdefault(clause["Nested"]["path"], []).append(clause["Nested"]["filter"])
            else:
                out = out & compile_filter(clause, fields, get, exact)
        for path, inner in by_path.items():
            out = out & nested(path, inner, fields, get)
        return out
    if kind == "Or":
        out = F.lit(False)
        for clause in x:
            out = out | compile_filter(clause, fields, get, exact)
        return out
    if kind == "Not":
        return ~compile_filter(x, fields, get)
    raise RequestError(f"unknown filter {kind}")


def nested(path: str, inner: list[dict], fields: dict[str, Field], get: Get) -> Column:
    head, _, rest = (path, "", "") if path in fields else path.partition(".")
    f = fields.get(head)
    if f is None or f.kind != "nested":
        return F.lit(False)

    def holds(o: Column) -> Column:
        if rest:
            return nested(rest, inner, f.fields, lambda n: o[n])
        return compile_filter({"And": inner}, f.fields, lambda n: o[n])

    c = get(head)
    return two_valued(F.exists(c, holds)) if f.many else two_valued(c.isNotNull() & holds(c))


def all_of(specs: list[dict], fields: dict[str, Field], get: Get = F.col) -> Column:
    return compile_filter({"And": specs}, fields, get) if specs else F.lit(True)
