"""The aggregation tree: one grouping for each level of buckets, with the pipelines over finished buckets as windows.

A level is a DataFrame keyed by the path of bucket keys (_b0, _b1, ...), with doc_count, one column for each metric and
the position of each bucket in its parent (_ord). Results are assembled on the driver from at most MAX_BUCKETS rows a level.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AggregationError
from ..functions.columns import date_ms, utc_date
from ..schema import Field, Schema
from .filters import compile_filter
from .highlight import highlighted
from .script import compile_script
from .sorting import SortPlan

MAX_BUCKETS = 10_000
BUCKETS = {"terms", "significant_terms", "rare_terms", "range", "date_range", "histogram", "date_histogram", "filter", "composite"}
METRICS = {"stats", "extended_stats", "value_count", "cardinality", "percentiles", "percentile_ranks", "top_hits"}
PIPELINES = {"bucket_sort", "avg_bucket", "sum_bucket", "derivative", "moving_avg", "bucket_script"}
PERCENTS = [1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0]
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
CALENDAR = {"day": "day", "1d": "day", "week": "week", "1w": "week", "month": "month", "1M": "month", "quarter": "quarter", "1q": "quarter", "year": "year", "1y": "year"}


def bad(message: str) -> AggregationError:
    return AggregationError("invalid_config", message)


def duration_ms(text: str) -> int:
    m = re.fullmatch(r"(-?)(\d+(?:\.\d+)?)(ms|s|m|h|d|w)", text.strip())
    if not m:
        raise bad(f"not an interval: {text}")
    return int(float(m.group(2)) * UNITS[m.group(3)]) * (-1 if m.group(1) else 1)


def instant_ms(x) -> int:
    """Epoch milliseconds of a number or an RFC 3339 text."""
    if isinstance(x, (int, float)):
        return int(x)
    try:
        return int(float(x))
    except ValueError:
        pass
    try:
        d = dt.datetime.fromisoformat(x.replace("Z", "+00:00"))
    except ValueError:
        raise bad(f"not a date: {x}") from None
    d = d if d.tzinfo else d.replace(tzinfo=dt.UTC)
    return (d - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(milliseconds=1)


def any_within(vals: Column, low: float | None, high: float | None) -> Column:
    return F.exists(vals, lambda v: (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v <= high))


def floored(vals: Column, step: float, off: float) -> Column:
    return F.transform(vals, lambda v: F.floor((v - off) / step) * F.lit(step) + F.lit(off))


@dataclass
class Level:
    """One bucket aggregation: how rows get their key, and what to do with the finished buckets."""

    name: str
    kind: str
    spec: dict
    depth: int
    parents: list[str]
    metrics: dict[str, tuple[str, dict]] = field(default_factory=dict)
    pipelines: dict[str, tuple[str, dict]] = field(default_factory=dict)
    children: list["Level"] = field(default_factory=list)
    rows: DataFrame | None = None
    frame: DataFrame | None = None

    @property
    def key(self) -> str:
        return f"_b{self.depth}"

    @property
    def path(self) -> list[str]:
        return [*self.parents, self.key]


class Aggregator:
    """Aggregates over `matched` rows; `background` is the whole snapshot, for significant_terms."""

    def __init__(self, schema: Schema, background: DataFrame) -> None:
        self.schema, self.background = schema, background

    # ---- what a request may ask for

    def kind_of(self, name: str, spec: dict) -> tuple[str, dict, dict]:
        """(kind, options, sub-aggregations) of {"type": kind, ...} or {kind: {...}, "aggs": ...}."""
        if "type" in spec:
            kind, x = spec["type"], {k: v for k, v in spec.items() if k != "type"}
        else:
            kinds = [k for k in spec if k not in ("aggs", "aggregations", "sampling")]
            if len(kinds) != 1:
                raise bad(f"{name} must have one kind")
            kind, x = kinds[0], dict(spec[kinds[0]]) | {k: v for k, v in spec.items() if k == "sampling"}
            x.setdefault("aggs", spec.get("aggs") or spec.get("aggregations") or {})
        if kind not in BUCKETS | METRICS | PIPELINES:
            raise bad(f"unknown aggregation {kind}")
        return kind, x, x.get("aggs") or {}

    def field(self, name: str, *kinds: str) -> Field:
        f = self.schema.fields.get(name)
        if f is None:
            raise AggregationError("unknown_field", f"there is no field {name}")
        if f.kind not in kinds or not f.fast:
            raise AggregationError("wrong_type", f"{name} must be a fast {' or '.join(kinds)} field")
        return f

    def values(self, f: Field, missing=None, kind: str | None = None) -> Column:
        """The distinct places of a document's values as an array; `missing` stands in where there is none."""
        kind = kind or ("string" if f.kind == "keyword" else "double")
        c = F.col(f"`{f.name}`")
        own = F.filter(c.cast(f"array<{kind}>"), lambda x: x.isNotNull()) if f.many else F.when(c.isNotNull(), F.array(c.cast(kind)))
        own = F.when(F.size(own) > 0, own)
        empty = F.array().cast(f"array<{kind}>") if missing is None else F.array(F.lit(missing).cast(kind))
        return F.coalesce(own, empty)

    def levels(self, aggs: dict, parents: list[str], depth: int) -> tuple[list[Level], dict, dict]:
        levels, metrics, pipelines = [], {}, {}
        for name in sorted(aggs):
            kind, x, subs = self.kind_of(name, aggs[name])
            if kind in METRICS:
                metrics[name] = (kind, x)
            elif kind in PIPELINES:
                pipelines[name] = (kind, x)
            else:
                level = Level(name, kind, x, depth, parents)
                level.children, level.metrics, level.pipelines = self.levels(subs, level.path, depth + 1)
                if any(k == "bucket_sort" and not (p.get("sort") or p.get("size") is not None or p.get("from")) for k, p in level.pipelines.values()):
                    raise bad("bucket_sort needs sort, from or size")
                levels.append(level)
        if pipelines and not parents:
            raise bad("pipeline aggregations belong inside a bucket aggregation")
        return levels, metrics, pipelines

    # ---- running

    def run(self, matched: DataFrame, aggs: dict) -> dict:
        levels, metrics, _ = self.levels(aggs, [], 0)
        out = {}
        if metrics:
            row = self.grouped(matched, [], metrics).first().asDict(True)
            out = {n: self.metric_result(k, x, row[f"_m_{n}"]) for n, (k, x) in metrics.items()}
        for level in levels:
            self.build(level, matched)
            out[level.name] = self.assemble(level, self.collect(level), ())
        return out

    def frame(self, matched: DataFrame, aggs: dict, name: str) -> DataFrame:
        """The finished buckets of one top-level aggregation: key, doc_count, its metrics and pipelines, and _ord."""
        levels, _, _ = self.levels({name: aggs[name]}, [], 0)
        self.build(levels[0], matched)
        f = levels[0].frame
        return f.select(F.col("_b0").alias("key"), "doc_count", *[F.col(c).alias(c[3:]) for c in f.columns if c.startswith("_m_")], "_ord")

    def build(self, level: Level, rows: DataFrame) -> None:
        rows = self.sampled(rows, level.spec.get("sampling"))
        level.rows = self.keyed(level, rows)
        frame = self.grouped(level.rows, level.path, level.metrics)
        frame = self.finish(level, frame, rows)
        level.frame = self.piped(level, frame)
        for child in level.children:
            self.build(child, level.rows)

    def sampled(self, rows: DataFrame, spec: dict | None) -> DataFrame:
        if not spec:
            return rows
        size, p = spec.get("size"), spec.get("probability")
        if (size is None) == (p is None):
            raise bad("sampling needs either size or probability")
        h = F.xxhash64(F.lit(int(spec.get("seed") or 0)), F.col(self.schema.doc_id_field))
        if size is not None:
            if size < 1:
                raise bad("sampling size must be at least 1")
            return rows.orderBy(h, self.schema.doc_id_field).limit(int(size))
        if not 0 < p <= 1:
            raise bad("sampling probability must lie between 0 and 1")
        return rows.where(F.pmod(h, F.lit(1 << 30)) < int(p * (1 << 30)))

    # ---- keys

    def keyed(self, level: Level, rows: DataFrame) -> DataFrame:
        """Rows with the key of the bucket they fall in, as often as they fall in one."""
        x, kind = level.spec, level.kind
        if kind in ("terms", "significant_terms", "rare_terms"):
            keys = F.array_distinct(self.values(self.field(x["field"], "keyword"), x.get("missing")))
        elif kind in ("range", "date_range"):
            f = self.field(x["field"], "i64", "f64")
            missing = x.get("missing")
            vals = self.values(f, instant_ms(missing) if kind == "date_range" and missing is not None else missing)
            if not x.get("ranges"):
                raise bad("range needs ranges")
            hits = []
            for i, r in enumerate(x["ranges"]):
                low, high = (self._bound(r.get(b), kind) for b in ("from", "to"))
                if low is not None and high is not None and low > high:
                    raise bad("a range must not end before it begins")
                # Both ends belong to the range.
                hits.append(F.when(any_within(vals, low, high), F.lit(i)))
            keys = F.array_compact(F.array(*hits))
        elif kind == "histogram":
            step, off = float(x["interval"]), float(x.get("offset") or 0.0)
            if not step > 0 or not math.isfinite(step):
                raise bad("interval must be above 0")
            self._check_bounds(x, float)
            hard = x.get("hard_bounds")
            vals = self.values(self.field(x["field"], "i64", "f64"), x.get("missing"))
            if hard:
                vals = F.filter(vals, lambda v: (v >= float(hard["min"])) & (v <= float(hard["max"])))
            keys = F.array_distinct(floored(vals, step, off))
        elif kind == "date_histogram":
            self._check_bounds(x, instant_ms)
            vals = self.values(self.field(x["field"], "i64"), instant_ms(x["missing"]) if x.get("missing") is not None else None, "bigint")
            hard = x.get("hard_bounds")
            if hard:
                vals = F.filter(vals, lambda v: (v >= instant_ms(hard["min"])) & (v <= instant_ms(hard["max"])))
            keys = F.array_distinct(F.transform(vals, self._date_key(x)))
        elif kind == "filter":
            cond = compile_filter(x["filter"], self.schema.fields)
            return rows.where(cond).withColumn(level.key, F.lit("filter"))
        else:
            return self._composite(level, rows)
        return rows.withColumn(level.key, F.explode(keys))

    @staticmethod
    def _bound(x, kind: str) -> float | None:
        return None if x is None else float(instant_ms(x)) if kind == "date_range" else float(x)

    @staticmethod
    def _check_bounds(x: dict, read) -> None:
        ext, hard = ({k: read(v) for k, v in b.items()} if (b := x.get(n)) else None for n in ("extended_bounds", "hard_bounds"))
        for b in (ext, hard):
            if b and b["min"] > b["max"]:
                raise bad("bounds must not end before they begin")
        if ext and hard and (ext["min"] < hard["min"] or ext["max"] > hard["max"]):
            raise bad("extended_bounds must lie inside hard_bounds")

    def _date_key(self, x: dict):
        off = duration_ms(x["offset"]) if x.get("offset") else 0
        if x.get("calendar_interval"):
            unit = CALENDAR.get(x["calendar_interval"])
            if unit is None:
                raise bad(f"unknown calendar interval {x['calendar_interval']}")
            return lambda v: date_ms(utc_date(v - off) if unit == "day" else F.trunc(utc_date(v - off), unit)) + off
        if not x.get("fixed_interval"):
            raise bad("date_histogram needs an interval")
        step = duration_ms(x["fixed_interval"])
        if step <= 0:
            raise bad("interval must be above 0")
        # A key is the upper edge of its bucket.
        return lambda v: F.ceil((v - off) / F.lit(step)) * step + off

    def _composite(self, level: Level, rows: DataFrame) -> DataFrame:
        """A key for each combination of a document's values; documents that lack a source are left out."""
        x, parts = level.spec, []
        if not x.get("sources") or x.get("size", 10) < 1:
            raise bad("composite needs sources and a size above 0")
        for i, s in enumerate(x["sources"]):
            kind = s.get("type") or next(k for k in s if k in ("terms", "histogram"))
            o = s.get(kind, s)
            if kind == "terms":
                vals = F.array_distinct(self.values(self.field(o["field"], "keyword")))
            else:
                step = float(o["interval"])
                if step <= 0:
                    raise bad("interval must be above 0")
                vals = F.array_distinct(floored(self.values(self.field(o["field"], "i64", "f64")), step, 0.0))
            rows = rows.withColumn(f"_c{i}", F.explode(vals))
            parts.append(F.col(f"_c{i}").alias(s.get("name") or o.get("name")))
        return rows.withColumn(level.key, F.struct(*parts)).drop(*[f"_c{i}" for i in range(len(parts))])

    # ---- metrics

    def grouped(self, rows: DataFrame, path: list[str], metrics: dict) -> DataFrame:
        """doc_count and _m_<name> for each path, in one grouping; lists that need their values apart are grouped beside it."""
        plain, apart = [F.count("*").alias("doc_count")], []
        for name, (kind, x) in metrics.items():
            if kind == "top_hits":
                apart.append(self._top_hits(rows, path, name, x))
                continue
            f = self.field(x["field"], "i64", "f64", *(["keyword"] if kind == "cardinality" else []))
            if kind == "percentiles":
                c = F.explode(self.values(f, x.get("missing"))) if f.many else F.coalesce(F.col(f"`{f.name}`").cast("double"), F.lit(x.get("missing")).cast("double"))
                apart.append(self._percentiles(rows.select(*path, c.alias("_v")).withColumn("_v", F.col("_v").cast("double")), path, name, x))
            elif f.many and kind in ("percentile_ranks", "cardinality"):
                single = rows.select(*path, F.explode(self.values(f, x.get("missing"))).alias("_v"))
                apart.append(single.groupBy(*path).agg(self._metric(kind, x, F.col("_v")).alias(f"_m_{name}")))
            elif f.many:
                plain.append(self._list_metric(kind, self.values(f, x.get("missing"))).alias(f"_m_{name}"))
            else:
                c = F.col(f"`{f.name}`").cast("string" if f.kind == "keyword" else "double")
                plain.append(self._metric(kind, x, c if x.get("missing") is None else F.coalesce(c, F.lit(x["missing"]).cast("string" if f.kind == "keyword" else "double"))).alias(f"_m_{name}"))
        out = rows.groupBy(*path).agg(*plain)
        for other in apart:
            if path:
                renamed = other.select(*[F.col(p).alias(f"_j{p}") for p in path], *[c for c in other.columns if c not in path])
                on = None
                for p in path:
                    e = out[p].eqNullSafe(renamed[f"_j{p}"])
                    on = e if on is None else on & e
                out = out.join(renamed, on, "left").drop(*[f"_j{p}" for p in path])
            else:
                out = out.crossJoin(other)
        for name, (kind, x) in metrics.items():
            if kind == "percentiles":
                out = out.withColumn(f"_m_{name}", F.coalesce(f"_m_{name}", F.array(*[F.lit(0.0) for _ in x.get("percents") or PERCENTS])))
        return out

    @staticmethod
    def _percentiles(values: DataFrame, path: list[str], name: str, x: dict) -> DataFrame:
        """Exact ones, interpolated between the two values around each place. Equal values are counted before they are sorted, and nothing holds a bucket's values at once."""
        ps = x.get("percents") or PERCENTS
        if any(not 0 <= p <= 100 for p in ps):
            raise bad("percents must lie between 0 and 100")
        counted = values.where("_v is not null").groupBy(*path, "_v").agg(F.count("*").alias("_many"))
        of = Window.partitionBy(*[F.col(p) for p in path]) if path else Window.partitionBy(F.lit(0))
        placed = counted.withColumn("_upto", F.sum("_many").over(of.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_many").over(of))
        at = [(F.lit(p / 100) * (F.col("_all") - 1)) for p in ps]
        value = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
        ends = [c for i, a in enumerate(at) for c in (value(F.floor(a)).alias(f"_lo{i}"), value(F.ceil(a)).alias(f"_hi{i}"), F.max(a - F.floor(a)).alias(f"_share{i}"))]
        found = placed.groupBy(*path).agg(*ends)
        between = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_share{i}") for i in range(len(ps))]
        whole = F.when(F.col("_lo0").isNotNull(), F.array(*between)) if ps else F.array().cast("array<double>")
        return found.select(*path, whole.alias(f"_m_{name}"))

    def _metric(self, kind: str, x: dict, c: Column) -> Column:
        n = F.count(c)
        zero = lambda e: F.coalesce(e, F.lit(0.0))
        if kind in ("stats", "extended_stats"):
            parts = [n.alias("count"), zero(F.min(c)).alias("min"), zero(F.max(c)).alias("max"), zero(F.sum(c)).alias("sum"), zero(F.avg(c)).alias("avg")]
            if kind == "extended_stats":
                parts += [zero(F.var_pop(c)).alias("variance"), zero(F.stddev_pop(c)).alias("std_deviation")]
            return F.struct(*parts)
        if kind == "value_count":
            return n
        if kind == "cardinality":
            return F.count_distinct(c)
        if kind == "percentiles":
            ps = x.get("percents") or PERCENTS
            if any(not 0 <= p <= 100 for p in ps):
                raise bad("percents must lie between 0 and 100")
            return F.coalesce(F.percentile(c, [p / 100 for p in ps]), F.array(*[F.lit(0.0) for _ in ps]))
        if not x.get("values"):
            raise bad("percentile_ranks needs values")
        return F.array(*[zero(F.try_divide(100.0 * F.sum((c <= float(v)).cast("double")), n.cast("double"))) for v in x["values"]])

    @staticmethod
    def _list_metric(kind: str, vals: Column) -> Column:
        total = lambda f: F.sum(F.aggregate(vals, F.lit(0.0), lambda s, v: s + f(v)))
        n, s = F.sum(F.size(vals)).cast("long"), total(lambda v: v)
        if kind == "value_count":
            return F.coalesce(n, F.lit(0))
        zero = lambda e: F.coalesce(e, F.lit(0.0))
        mean = F.try_divide(s, n.cast("double"))
        parts = [F.coalesce(n, F.lit(0)).alias("count"), zero(F.min(F.array_min(vals))).alias("min"), zero(F.max(F.array_max(vals))).alias("max"), zero(s).alias("sum"), zero(mean).alias("avg")]
        if kind == "extended_stats":
            var = F.greatest(F.try_divide(total(lambda v: v * v), n.cast("double")) - mean * mean, F.lit(0.0))
            parts += [zero(var).alias("variance"), zero(F.sqrt(var)).alias("std_deviation")]
        return F.struct(*parts)

    def _top_hits(self, rows: DataFrame, path: list[str], name: str, x: dict) -> DataFrame:
        order = SortPlan(x.get("sort"), self.schema)
        if "_score" not in rows.columns:
            rows = rows.withColumn("_score", F.lit(1.0))
        first, size = int(x.get("from") or 0), int(x.get("size", 3))
        id_ = self.schema.doc_id_field
        keyed = rows.select(*path, id_, "_score", "_gen", *order.columns(), *[F.col(f"`{n}`").alias(f"_f_{n}") for n in {*(x.get("fields") or []), *([x["highlight_field"]] if x.get("highlight_field") else [])}])
        w = Window.partitionBy(*[F.col(p) for p in path]) if path else Window.partitionBy(F.lit(0))
        ranked = keyed.withColumn("_rn", F.row_number().over(w.orderBy(*order.order())))
        top = ranked.where((F.col("_rn") > first) & (F.col("_rn") <= first + size))
        shown = [F.col(f"_f_{n}").alias(n) for n in x.get("fields") or []]
        if x.get("highlight_field"):
            shown.append(F.get(highlighted(F.col(f"_f_{x['highlight_field']}"), x.get("_words", []), [], "**", "**", 120, 1), F.lit(0)).alias("snippet"))
        hit = F.struct(F.col("_rn").alias("rank"), F.col(id_).alias("id"), F.col("_score").alias("score"), *shown)
        return top.groupBy(*path).agg(F.array_sort(F.collect_list(hit)).alias(f"_m_{name}"))

    # ---- finished buckets

    def finish(self, level: Level, frame: DataFrame, rows: DataFrame) -> DataFrame:
        """Fills gaps, drops what is below the least count, orders (_ord) and cuts to size."""
        x, kind = level.spec, level.kind
        count, key = F.col("doc_count"), F.col(level.key)
        cut, least = x.get("size"), None
        if kind == "terms":
            least, order, cut = x.get("min_doc_count", 1), [count.desc(), key.asc()], cut or MAX_BUCKETS
        elif kind == "rare_terms":
            most = x.get("max_doc_count") or 1
            frame, order, cut = frame.where(count <= most), [count.asc(), key.asc()], cut or MAX_BUCKETS
        elif kind == "significant_terms":
            frame = self._significance(level, frame, rows)
            least, order, cut = x.get("min_doc_count", 1), [F.col("score").desc(), count.desc(), key.asc()], cut or 10
        elif kind in ("range", "date_range"):
            frame, order, cut = self._filled(level, frame, F.array(*[F.lit(i) for i in range(len(x["ranges"]))])), [key.asc()], None
        elif kind in ("histogram", "date_histogram"):
            bounds = x.get("extended_bounds") or x.get("hard_bounds")
            least = x.get("min_doc_count")
            if least is None:
                least = 0 if bounds or kind == "date_histogram" else 1
            if bounds and least == 0:
                frame = self._filled(level, frame, self._bucket_keys(x, kind, bounds))
            order, cut = [key.asc()], None
        elif kind == "composite":
            names = [f.name for f in frame.schema[level.key].dataType.fields]
            order = [key[n].asc() for n in names]
            if x.get("after"):
                frame = frame.where(self._beyond(key, names, x["after"]))
            cut = x.get("size", 10) + 1
        else:
            order, cut = [key.asc()], None
            if not level.parents:
                frame = self._filled(level, frame, F.array(F.lit("filter")))
        if least:
            frame = frame.where(count >= least)
        if kind == "significant_terms":
            first = self._window(level).orderBy(count.desc(), key.asc())
            frame = frame.withColumn("_ord", F.row_number().over(first)).where(F.col("_ord") <= min(cut, MAX_BUCKETS))
        w = self._window(level).orderBy(*order)
        if cut and not level.parents:
            frame = frame.orderBy(*order).limit(min(cut, MAX_BUCKETS))  # so that every task keeps its first ones only
        frame = frame.withColumn("_ord", F.row_number().over(w))
        return frame.where(F.col("_ord") <= min(cut, MAX_BUCKETS)) if cut else frame

    def _window(self, level: Level):
        return Window.partitionBy(*[F.col(p) for p in level.parents]) if level.parents else Window.partitionBy(F.lit(0))

    def _bucket_keys(self, x: dict, kind: str, bounds: dict) -> Column:
        if kind == "histogram":
            step, off = float(x["interval"]), float(x.get("offset") or 0.0)
            first, last = (math.floor((float(bounds[b]) - off) / step) for b in ("min", "max"))
            if last - first >= MAX_BUCKETS:
                raise bad(f"more than {MAX_BUCKETS} buckets")
            return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: i * F.lit(step) + F.lit(off))
        low, high = instant_ms(bounds["min"]), instant_ms(bounds["max"])
        to_key = self._date_key(x)
        if x.get("calendar_interval"):
            off = duration_ms(x["offset"]) if x.get("offset") else 0
            unit = CALENDAR[x["calendar_interval"]]
            step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[unit]
            ends = [utc_date(to_key(F.lit(v)) - off) for v in (low, high)]
            return F.transform(F.sequence(*ends, F.expr(step)), lambda t: date_ms(t) + off)
        step = duration_ms(x["fixed_interval"])
        if (high - low) // step >= MAX_BUCKETS:
            raise bad(f"more than {MAX_BUCKETS} buckets")
        return F.sequence(to_key(F.lit(low)), to_key(F.lit(high)), F.lit(step).cast("long"))

    def _filled(self, level: Level, frame: DataFrame, keys: Column) -> DataFrame:
        """Each key for each parent bucket; the added ones have count 0 and the metrics of nothing."""
        spark = frame.sparkSession
        parents = frame.select(*level.parents).distinct() if level.parents else spark.range(1).select()
        wanted = parents.withColumn(level.key, F.explode(keys.cast(T.ArrayType(frame.schema[level.key].dataType))))
        out = wanted.join(frame, level.path, "full").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
        for name, (kind, x) in level.metrics.items():
            if kind != "top_hits":
                # What the metric is over no rows at all.
                empty = self._metric(kind, x, F.col("_v"))
                value = spark.createDataFrame([], "_v double").agg(empty.alias("_e")).first()["_e"]
                of = frame.schema[f"_m_{name}"].dataType
                lit = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(of.fields, value)]) if isinstance(of, T.StructType) else F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
                out = out.withColumn(f"_m_{name}", F.coalesce(f"_m_{name}", lit.cast(of)))
        return out

    def _significance(self, level: Level, frame: DataFrame, rows: DataFrame) -> DataFrame:
        """(fg / fg total) / (bg / bg total); the background counts the raw values of all live documents that its filter passes."""
        x = level.spec
        f = self.field(x["field"], "keyword")
        back = self.background
        if x.get("background_filter"):
            back = back.where(compile_filter(x["background_filter"], self.schema.fields))
        keys = back.select(F.explode(F.array_distinct(self.values(f))).alias("_bk")).groupBy("_bk").agg(F.count("*").alias("bg_count"))
        total = back.agg(F.count("*").alias("bg_total"))
        has = rows.where(F.size(self.values(f)) > 0)
        own = has.groupBy(*level.parents).agg(F.count("*").alias("fg_total"))
        out = frame.join(keys, frame[level.key] == keys["_bk"], "left").drop("_bk").crossJoin(F.broadcast(total))
        out = out.join(own, level.parents) if level.parents else out.crossJoin(F.broadcast(own))
        ratio = F.try_divide(F.col("doc_count") / F.col("fg_total"), F.try_divide(F.col("bg_count"), F.col("bg_total")))
        return out.withColumn("bg_count", F.coalesce("bg_count", F.lit(0))).withColumn("score", F.coalesce(ratio, F.lit(0.0)))

    @staticmethod
    def _beyond(key: Column, names: list[str], after: dict) -> Column:
        tail = F.lit(False)
        for n in reversed(names):
            tail = (key[n] > F.lit(after[n])) | ((key[n] == F.lit(after[n])) & tail)
        return tail

    # ---- pipelines

    def piped(self, level: Level, frame: DataFrame) -> DataFrame:
        """bucket_sort first, then the rest by name; each adds a column that later ones can read."""
        ordered = sorted(level.pipelines.items(), key=lambda p: (p[1][0] != "bucket_sort", p[0]))
        for name, (kind, x) in ordered:
            within = self._window(level)
            rows = within.orderBy("_ord")
            if kind == "bucket_sort":
                keys = []
                for s in x.get("sort") or []:
                    ((target, direction),) = s.items()
                    c = self.key_text(level) if target in ("key", "_key") else self.metric_at(level, frame, target)
                    keys.append(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last())
                frame = frame.withColumn("_ord", F.row_number().over(within.orderBy(*keys, self.key_text(level).asc())))
                first = int(x.get("from") or 0)
                frame = frame.where(F.col("_ord") > first)
                if x.get("size") is not None:
                    frame = frame.where(F.col("_ord") <= first + int(x["size"]))
                continue
            if kind == "bucket_script":
                value = compile_script(x["script"], lambda v, x=x, frame=frame: self.metric_at(level, frame, x["buckets_path"][v]) if v in x["buckets_path"] else F.lit(None).cast("double"), 1e-12)
                for path in x["buckets_path"].values():
                    value = F.when(self.metric_at(level, frame, path).isNotNull(), value)
                frame = frame.withColumn(f"_m_{name}", value)
                continue
            own = self.metric_at(level, frame, x["buckets_path"])
            if kind in ("avg_bucket", "sum_bucket"):
                total = F.avg(own) if kind == "avg_bucket" else F.sum(own)
                frame = frame.withColumn(f"_m_{name}", F.coalesce(total.over(within), F.lit(0.0)))
                continue
            if x.get("gap_policy") == "insert_zeros":
                own = F.coalesce(own, F.lit(0.0))
            frame = frame.withColumn("_own", own)
            before = rows.rowsBetween(Window.unboundedPreceding, -1)
            if kind == "derivative":
                frame = frame.withColumn(f"_m_{name}", (F.col("_own") - F.last("_own", ignorenulls=True).over(before)) / F.lit(max(float(x.get("unit") or 1.0), 2.220446049250313e-16)))
            else:
                # The mean of the last `window` values that are there: each value's own, carried on over gaps.
                there = Window.partitionBy(*level.parents, F.col("_own").isNull()).orderBy("_ord").rowsBetween(1 - max(1, int(x["window"])), 0)
                frame = frame.withColumn("_mean", F.avg("_own").over(there))
                frame = frame.withColumn(f"_m_{name}", F.last("_mean", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0))).drop("_mean")
            frame = frame.drop("_own")
        return frame

    def key_text(self, level: Level) -> Column:
        key = F.col(level.key)
        return F.to_json(key) if level.kind == "composite" else key.cast("string")

    def metric_at(self, level: Level, frame: DataFrame, path: str) -> Column:
        """What a buckets_path points at, as a double; null where there is no such thing."""
        if path == "_count":
            return F.col("doc_count").cast("double")
        name, _, part = path.partition(".")
        none = F.lit(None).cast("double")
        if f"_m_{name}" not in frame.columns:
            return none
        c = F.col(f"_m_{name}")
        kind, x = level.metrics.get(name) or level.pipelines[name]
        if kind in ("stats", "extended_stats"):
            fields = {f.name for f in frame.schema[f"_m_{name}"].dataType.fields}
            part = part or "avg"
            return c[part].cast("double") if part in fields else none
        if kind in ("percentiles", "percentile_ranks"):
            asked = [number(v) for v in (x.get("percents") or PERCENTS if kind == "percentiles" else x["values"])]
            return F.get(c, F.lit(asked.index(part))) if part in asked else none
        return none if kind == "top_hits" else c.cast("double")

    # ---- results

    def collect(self, level: Level) -> dict:
        """Parent path -> its buckets in order, for this level and those below."""
        out: dict = {}
        rows = level.frame.orderBy(*level.parents, "_ord").limit(MAX_BUCKETS + 1).collect()
        if len(rows) > MAX_BUCKETS:
            raise bad(f"{level.name} has more than {MAX_BUCKETS} buckets")
        for r in rows:
            out.setdefault(tuple(r[p] for p in level.parents), []).append(r.asDict(True))
        return {"rows": out, "children": {c.name: self.collect(c) for c in level.children}}

    def assemble(self, level: Level, data: dict, path: tuple) -> dict:
        x, rows = level.spec, data["rows"].get(path, [])
        cut = level.kind == "composite" and len(rows) > x.get("size", 10)
        rows = rows[: x.get("size", 10)] if level.kind == "composite" else rows
        buckets = []
        for r in rows:
            raw = r[level.key]
            b: dict = {"key": self._shown_key(level, raw), "doc_count": r["doc_count"]}
            if level.kind == "significant_terms":
                b |= {"bg_count": r["bg_count"], "score": r["score"]}
            for n, (kind, m) in level.metrics.items():
                b[n] = self.metric_result(kind, m, r[f"_m_{n}"]) | ({"total": r["doc_count"]} if kind == "top_hits" else {})
            for n, (kind, _) in level.pipelines.items():
                if kind in ("derivative", "moving_avg", "bucket_script"):
                    b[n] = {"value": r[f"_m_{n}"]}
            for c in level.children:
                b[c.name] = self.assemble(c, data["children"][c.name], (*path, _hashable(raw)))
            buckets.append(b)
        out: dict = {"buckets": buckets}
        if level.kind == "filter":
            out = buckets[0] if buckets else {"key": "filter", "doc_count": 0}
        elif level.kind in ("range", "date_range") and x.get("keyed"):
            out = {"buckets": {b["key"]: b for b in buckets}}
        if level.kind == "significant_terms" and rows:
            out |= {"doc_count": rows[0]["fg_total"], "bg_count": rows[0]["bg_total"]}
        if cut:
            out["after_key"] = buckets[-1]["key"]
        if level.spec.get("sampling"):
            out["sampled"] = True
        for n, (kind, p) in level.pipelines.items():
            if kind in ("avg_bucket", "sum_bucket"):
                out[n] = {"value": rows[0][f"_m_{n}"] if rows else 0.0}
            elif kind == "moving_avg":
                last = rows[-1][f"_m_{n}"] if rows else None
                out[n] = {"value": last, "predictions": [last] * int(p.get("predict") or 0) if last is not None else []}
            elif kind == "bucket_script":
                out[n] = {"value": next((r[f"_m_{n}"] for r in reversed(rows) if r[f"_m_{n}"] is not None), None)}
            elif kind == "derivative":
                out[n] = {"value": None}
            else:
                out[n] = {"from": int(p.get("from") or 0), "size": p.get("size")}
        return out

    def _shown_key(self, level: Level, raw):
        if level.kind in ("range", "date_range"):
            r = level.spec["ranges"][raw]
            return r.get("key") or {"from": r.get("from"), "to": r.get("to")}
        return raw

    @staticmethod
    def metric_result(kind: str, x: dict, value):
        if kind in ("value_count", "cardinality"):
            return {"value": value}
        if kind in ("percentiles", "percentile_ranks"):
            asked = (x.get("percents") or PERCENTS) if kind == "percentiles" else x["values"]
            return {"values": {number(p): v for p, v in zip(asked, value)}}
        if kind == "top_hits":
            return {"hits": [{k: v for k, v in h.items() if k != "rank"} for h in value or []]}
        return value


def number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def _hashable(x):
    return tuple(x.values()) if isinstance(x, dict) else x
