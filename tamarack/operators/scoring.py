"""Scores as column arithmetic: BM25, functions over fields, and ways to combine them. A null score drops a document."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError
from ..schema import Field, Schema
from .filters import compile_filter
from .script import finite

K1, B = 0.9, 0.4


def bm25(tf: Column, df: Column, n: Column, length: Column | None, average: Column | None, weight: float) -> Column:
    """Without a length (keyword fields) the norm is 1."""
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(0.0)) + 1.0
    norm = F.lit(1.0)
    if length is not None:
        own = F.when(length > 0, length.cast("double")).otherwise(F.greatest(average, F.lit(1.0)))
        norm = 1 - B + B * own / average
    tf = tf.cast("double")
    return F.when(tf > 0, idf * (tf * (K1 + 1)) / (tf + K1 * norm) * weight).otherwise(0.0)


def first_value(schema: Schema, name: str) -> Column:
    """The value of a numeric fast field, the first of a list; null where there is none or no such field."""
    f: Field | None = schema.fields.get(name)
    if f is None or f.kind not in ("i64", "f64") or not f.fast:
        return F.lit(None).cast("double")
    c = F.col(f"`{name}`")
    return (F.get(c, F.lit(0)) if f.many else c).cast("double")


def modified(x: Column, modifier: str | None) -> Column:
    """none, log, log1p, log2p, sqrt and reciprocal; 0 outside their domains."""
    zero = F.lit(0.0)
    if modifier in (None, "none"):
        return x
    if modifier == "log":
        return F.when(x > 0, F.log(x)).otherwise(zero)
    if modifier == "log1p":
        return F.when(x > -1, F.log1p(x)).otherwise(zero)
    if modifier == "log2p":
        return F.when(x > -1, F.log2(x + 1)).otherwise(zero)
    if modifier == "sqrt":
        return F.when(x >= 0, F.sqrt(x)).otherwise(zero)
    if modifier == "reciprocal":
        return F.coalesce(F.try_divide(F.lit(1.0), x), zero)
    raise RequestError(f"unknown modifier {modifier}")


def function_value(spec: dict, schema: Schema) -> Column:
    """The value of one function of function_score, null where its filter fails or it has nothing to go by."""
    kind = spec.get("type") or next((k for k in ("weight", "field_value_factor", "decay") if k in spec), None)
    x = spec[kind] if isinstance(spec.get(kind), dict) else spec
    if kind == "weight":
        value = F.lit(_finite(spec["weight"], "weight"))
    elif kind == "field_value_factor":
        raw = F.coalesce(first_value(schema, x["field"]), F.lit(float(x.get("missing") or 0.0)))
        value = finite(modified(raw * _finite(x.get("factor", 1.0), "factor"), x.get("modifier")))
    elif kind == "decay":
        origin, scale = _finite(x["origin"], "origin"), _finite(x["scale"], "scale")
        offset, decay = _finite(x.get("offset") or 0.0, "offset"), _finite(x.get("decay") or 0.5, "decay")
        if scale <= 0 or not 0 < decay < 1:
            raise RequestError("decay needs a scale above 0 and a decay between 0 and 1")
        d = F.greatest(F.abs(first_value(schema, x["field"]) - origin) - offset, F.lit(0.0)) / scale
        curve = x.get("function") or x.get("curve") or "exp"
        if curve == "exp":
            value = F.pow(F.lit(decay), d)
        elif curve == "gauss":
            value = F.pow(F.lit(decay), d * d)
        elif curve == "linear":
            value = F.greatest((1 - d) * (1 - decay) + decay, F.lit(0.0))
        else:
            raise RequestError(f"unknown decay function {curve}")
        # greatest() skips nulls, and a missing value must skip the function.
        value = F.when(first_value(schema, x["field"]).isNotNull(), value)
    else:
        raise RequestError(f"unknown score function {spec!r}")
    condition = x.get("filter") or spec.get("filter")
    return F.when(compile_filter(condition, schema.fields), value) if condition else value


def _finite(x, name: str) -> float:
    if x is None or not math.isfinite(x):
        raise RequestError(f"{name} must be a finite number")
    return float(x)


def combined(values: list[Column], mode: str) -> Column:
    """Over the functions that have a value; null where none has."""
    if not values:
        return F.lit(None).cast("double")
    if mode not in ("sum", "multiply", "max", "min", "avg"):
        raise RequestError(f"unknown score_mode {mode}")
    some = F.coalesce(*values)
    if mode == "multiply":
        out = F.coalesce(values[0], F.lit(1.0))
        for v in values[1:]:
            out = out * F.coalesce(v, F.lit(1.0))
    elif mode in ("max", "min"):
        out = values[0] if len(values) == 1 else (F.greatest if mode == "max" else F.least)(*values)
    else:
        out = sum_of(values)
        if mode == "avg":
            out = F.try_divide(out, _count(values))
    return F.when(some.isNotNull(), out)


def sum_of(values: list[Column]) -> Column:
    out = F.coalesce(values[0], F.lit(0.0))
    for v in values[1:]:
        out = out + F.coalesce(v, F.lit(0.0))
    return out


def _count(values: list[Column]) -> Column:
    n = F.lit(0)
    for v in values:
        n = n + v.isNotNull().cast("int")
    return n


def function_score(base: Column, spec: dict, schema: Schema, boost: float) -> Column:
    values = [function_value(f, schema) for f in spec.get("functions", [])]
    together = combined(values, spec.get("score_mode") or "sum")
    some = together.isNotNull()
    own = F.when((F.abs(base) <= 1.1920929e-07) & some, F.lit(1.0)).otherwise(base)
    mode = spec.get("boost_mode") or "multiply"
    by = {"multiply": lambda: own * together, "sum": lambda: own + together, "replace": lambda: together, "max": lambda: F.greatest(own, together), "min": lambda: F.least(own, together)}
    if mode not in by:
        raise RequestError(f"unknown boost_mode {mode}")
    out = F.when(some, by[mode]()).otherwise(own)
    if spec.get("max_boost") is not None:
        out = F.least(out, F.lit(_finite(spec["max_boost"], "max_boost")))
    if spec.get("min_score") is not None:
        out = F.when(out >= _finite(spec["min_score"], "min_score"), out)
    return F.when(base.isNotNull(), out * boost)


def null_sum(values: list[Column]) -> Column:
    """The sum of those that aren't null; null if all are."""
    return F.when(F.coalesce(*values).isNotNull(), sum_of(values)) if values else F.lit(0.0)


def dis_max(values: list[Column], tie: float) -> Column:
    """The greatest, and `tie` times the rest."""
    if not values:
        return F.lit(0.0)
    top = values[0] if len(values) == 1 else F.greatest(*values)
    return F.when(F.coalesce(*values).isNotNull(), top + tie * (sum_of(values) - top))
