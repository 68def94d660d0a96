"""From a query tree to columns: what a document must match, and what it scores.

Words become keys (field, term). Each key is a column with the positions of the term in the document, made once for
all nodes; matching and scoring are expressions over these columns and the document's own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.analysis import ascii_lower
from ..operators import scoring
from ..operators.filters import all_of, compile_filter
from ..operators.script import compile_script, finite
from ..schema import Schema
from .grammar import parse_query

Key = tuple[str, str]
#: kind, field, value, options -> terms of the dictionary
Expand = Callable[[str, str, str, dict], list]


@dataclass
class Node:
    match: Callable[[], Column]
    score: Callable[[], Column] | None  # None: the node adds nothing to a sum, and is 1 alone
    needs: frozenset | None = None  # keys of which every match has one; None: a match may have no word


@dataclass
class Plan:
    """keys: what must be looked up; scored: key -> (leaf, weight), one leaf for each key."""

    schema: Schema
    keys: dict[Key, int] = field(default_factory=dict)
    scored: dict[Key, list] = field(default_factory=dict)
    text_fields: set[str] = field(default_factory=set)
    leaves: int = 0
    functions: list = field(default_factory=list)  # (match of its query, type, field, value) of each score function
    root: Node | None = None

    def key(self, name: str, term: str) -> int:
        if self.schema.fields[name].kind == "text":
            self.text_fields.add(name)
        return self.keys.setdefault((name, term), len(self.keys))

    def positions(self, key: Key) -> Column:
        return F.col(f"_k{self.keys[key]}")

    def present(self, key: Key) -> Column:
        return F.coalesce(F.size(self.positions(key)) > 0, F.lit(False))

    @property
    def needs(self) -> frozenset | None:
        return self.root.needs if self.root else None

    def leaf(self) -> int:
        self.leaves += 1
        return self.leaves - 1

    def leaf_score(self, leaf: int) -> Column:
        parts = []
        for key, (owner, weight) in self.scored.items():
            if owner != leaf:
                continue
            text = self.schema.fields[key[0]].kind == "text"
            tf = F.coalesce(F.size(self.positions(key)), F.lit(0)) if text else self.present(key).cast("int")
            length, average = (F.col(f"_len_{key[0]}"), F.col(f"_avg_{key[0]}")) if text else (None, None)
            parts.append(scoring.bm25(tf, F.col(f"_df{self.keys[key]}"), F.col("_n"), length, average, weight))
        return scoring.sum_of(parts) if parts else F.lit(0.0)

    def candidates(self) -> Column | None:
        """Where words are scored, only documents with one of them are looked at."""
        if not self.scored:
            return None
        out = F.lit(False)
        for key in self.scored:
            out = out | self.present(key)
        return out


def boost_of(spec: dict) -> float:
    b = spec.get("boost")
    b = 1.0 if b is None else float(b)
    if not 0 <= b < float("inf"):
        raise RequestError("boost must be finite and not negative")
    return b


def tie_of(spec: dict) -> float:
    t = float(spec.get("tie_breaker") or 0.0)
    if not 0 <= t <= 1:
        raise RequestError("tie_breaker must lie between 0 and 1")
    return t


def required(spec, n: int, every: bool) -> int:
    """minimum_should_match of n terms: a number, or a share that is rounded up."""
    if spec is None:
        return n if every else min(1, n)
    if isinstance(spec, str):
        if not re.fullmatch(r"[0-9.]+%", spec) or not 0 <= float(spec[:-1]) <= 100:
            raise RequestError("minimum_should_match must be a number or a share between 0% and 100%")
        return min(n, -int(-(float(spec[:-1]) / 100 * n) // 1))
    if spec < 0:
        raise RequestError("minimum_should_match must not be negative")
    return min(int(spec), n)


class Planner:
    def __init__(self, schema: Schema, expand: Expand, default_fields: list[str] | None = None, fuzzy: dict | None = None) -> None:
        self.schema, self.expand, self.fuzzy = schema, expand, fuzzy
        self.default_fields = default_fields if default_fields is not None else schema.text_fields()
        self.plan = Plan(schema)

    def build(self, query) -> Plan:
        if isinstance(query, str):
            query = {"type": "query_string", "query": query}
        self.plan.root = self.node(query, True, 1.0)
        return self.plan

    # ---- words

    def terms_of(self, name: str, value: str) -> list[str]:
        """The terms that a word stands for in a field; none in numeric fields."""
        f = self.schema.fields.get(name)
        if f is None or not f.indexed or f.kind not in ("text", "keyword"):
            return []
        if f.kind == "keyword":
            return [ascii_lower(value)]
        return list(dict.fromkeys(self.schema.search_analyzer(name).terms(value)))

    def expansions(self, name: str, value: str, kind: str, options: dict, scored: bool) -> list[tuple[str, float]]:
        f = self.schema.fields.get(name)
        if f is None or not f.indexed or f.kind not in ("text", "keyword"):
            return []
        if kind != "exact":
            pattern = self.schema.search_analyzer(name).pattern(value) if f.kind == "text" else ascii_lower(value)
            return [(t, 1.0) for t in self.expand(kind, name, pattern, options)]
        out = [(t, 1.0) for t in self.terms_of(name, value)]
        if scored and self.fuzzy and f.kind == "text":
            for t, _ in list(out):
                out += [(u, 1.0 / (d + 1)) for u, d in self.expand("fuzzy", name, t, self.fuzzy) if u != t]
        return out

    def group(self, fields: list[tuple[str, float, int | None]], value: str, kind: str, options: dict, boost: float, scored: bool) -> Callable[[], Column]:
        """A word in any of the fields (name, weight, leaf): registers its keys and returns whether one is there."""
        keys = []
        for name, weight, leaf in fields:
            for term, share in self.expansions(name, value, kind, options, scored):
                self.plan.key(name, term)
                keys.append((name, term))
                if scored and leaf is not None:
                    # A term that occurs twice in a query counts twice, in the leaf that has it first.
                    self.plan.scored.setdefault((name, term), [leaf, 0.0])[1] += weight * boost * share
        unique = list(dict.fromkeys(keys))

        def match() -> Column:
            out = F.lit(False)
            for k in unique:
                out = out | self.plan.present(k)
            return out

        match.needs = frozenset(unique)
        return match

    def phrase(self, fields: list[str], words: list[str], slop: int) -> Callable[[], Column]:
        variants: list = []
        for name in fields:
            f = self.schema.fields.get(name)
            if f is None or not f.indexed:
                continue
            if f.kind == "keyword":
                key = (name, ascii_lower(" ".join(words)))
                self.plan.key(*key)
                variants.append([[key]])
            elif f.kind == "text":
                at: dict[int, list[Key]] = {}
                for term, p in self.schema.search_analyzer(name).run(" ".join(words)):
                    self.plan.key(name, term)
                    at.setdefault(p, []).append((name, term))
                if at:
                    variants.append([at[p] for p in sorted(at)])

        def match() -> Column:
            out = F.lit(False)
            for variant in variants:
                spots = []
                for keys in variant:
                    p = F.coalesce(self.plan.positions(keys[0]), F.array().cast("array<int>"))
                    for k in keys[1:]:
                        p = F.array_union(p, F.coalesce(self.plan.positions(k), F.array().cast("array<int>")))
                    spots.append(p)
                out = out | F.coalesce(in_order(spots, slop), F.lit(False))
            return out

        match.needs = frozenset(k for variant in variants for keys in variant for k in keys)
        return match

    # ---- nodes

    def node(self, q, scored: bool, boost: float) -> Node:
        if isinstance(q, str):
            q = {"type": "query_string", "query": q}
        kind = q.get("type")
        f = getattr(self, f"_{kind}", None) if isinstance(kind, str) and kind in KINDS else None
        if f is None:
            raise RequestError(f"unknown query type {kind!r}")
        return f(q, scored, boost)

    def _specs(self, fields) -> list[tuple[str, float]]:
        if fields is None:
            return [(n, 1.0) for n in self.default_fields]
        return [(x, 1.0) if isinstance(x, str) else (x["field"], boost_of(x)) for x in fields]

    def _leaf_node(self, match, leaf: int | None) -> Node:
        return Node(match, None if leaf is None else lambda: self.plan.leaf_score(leaf), getattr(match, "needs", None))

    def _match_all(self, q, scored, boost) -> Node:
        boost_of(q)
        return Node(lambda: F.lit(True), None)

    def _vector(self, q, scored, boost) -> Node:
        return Node(lambda: F.lit(True), None)

    def _query_string(self, q, scored, boost) -> Node:
        specs, own = self._specs(q.get("fields")), boost_of(q) * boost
        leaf = self.plan.leaf() if scored else None
        return self._leaf_node(self._parsed(q["query"], [(n, w, leaf) for n, w in specs], own, scored, None, False), leaf)

    def _parsed(self, text: str, fields, boost: float, scored: bool, minimum, every: bool) -> Callable[[], Column]:
        parsed = parse_query(text)
        of = lambda name: fields if name is None else [(name, 1.0, next((x[2] for x in fields), None))]
        words = [self.group(of(n), w, "exact", {}, boost, scored) for n, w in parsed.terms]
        phrases = [self.phrase([x[0] for x in of(n)], w, 0) for n, w in parsed.phrases]
        gone = [self.group([(x[0], x[1], None) for x in of(n)], w, "exact", {}, boost, False) for n, w in parsed.excluded]
        least = required(minimum, len(words), every)

        def match() -> Column:
            if not words and not phrases and not gone:
                return F.lit(False)
            out = F.lit(True)
            for g in gone:
                out = out & ~g()
            for p in phrases:
                out = out & p()
            return out & (count_of([w() for w in words]) >= least) if words else out

        match.needs = phrases[0].needs if phrases else any_of([w.needs for w in words]) if words and least > 0 else None
        return match

    def _multi_match(self, q, scored, boost) -> Node:
        own, tie, kind = boost_of(q) * boost, tie_of(q), q.get("match_type", "best_fields")
        specs = self._specs(q["fields"])
        every = (q.get("operator") or "or").lower() == "and"
        if kind == "best_fields":
            fields = [(n, w, self.plan.leaf()) for n, w in specs]
            match = self._parsed(q["query"], fields, own, scored, q.get("minimum_should_match"), every)
            score = (lambda: scoring.dis_max([self.plan.leaf_score(x[2]) for x in fields], tie)) if scored and fields else None
            return Node(match, score)
        if kind not in ("most_fields", "cross_fields"):
            raise RequestError(f"unknown match_type {kind}")
        leaf = self.plan.leaf() if scored else None
        return self._leaf_node(self._parsed(q["query"], [(n, w, leaf) for n, w in specs], own, scored, q.get("minimum_should_match"), every), leaf)

    def _dis_max(self, q, scored, boost) -> Node:
        own, tie = boost_of(q) * boost, tie_of(q)
        children = [self.node(c, scored, own) for c in q["queries"]]
        scores = [c.score for c in children if c.score]

        def match() -> Column:
            out = F.lit(False)
            for c in children:
                out = out | c.match()
            return out

        return Node(match, (lambda: scoring.dis_max([s() for s in scores], tie)) if scores else None, any_of([c.needs for c in children]))

    def _word(self, q, scored, boost, kind: str, cap: int) -> Node:
        leaf = self.plan.leaf() if scored else None
        value = q["value"] if isinstance(q["value"], str) else str(q["value"])
        return self._leaf_node(self.group([(q["field"], 1.0, leaf)], value, kind, {"max_expansions": q.get("max_expansions") or cap}, boost_of(q) * boost, scored), leaf)

    def _term(self, q, scored, boost) -> Node:
        return self._word(q, scored, boost, "exact", 0)

    def _prefix(self, q, scored, boost) -> Node:
        return self._word(q, scored, boost, "prefix", 50)

    def _wildcard(self, q, scored, boost) -> Node:
        return self._word(q, scored, boost, "wildcard", 100)

    def _regex(self, q, scored, boost) -> Node:
        try:
            re.compile(q["value"])
        except re.error as e:
            raise RequestError(f"regex: {e}") from None
        return self._word(q, scored, boost, "regex", 100)

    def _phrase(self, q, scored, boost) -> Node:
        boost_of(q)
        fields = [q["field"]] if q.get("field") else self.default_fields
        match = self.phrase(fields, q["terms"], int(q.get("slop") or 0))
        return Node(match, None, match.needs)

    def _bool(self, q, scored, boost) -> Node:
        own = boost_of(q) * boost
        must = [self.node(c, scored, own) for c in q.get("must") or []]
        should = [self.node(c, scored, own) for c in q.get("should") or []]
        must_not = [self.node(c, False, own) for c in q.get("must_not") or []]
        filters = q.get("filter") or []
        scores = [c.score for c in [*must, *should, *must_not] if c.score]
        least = q.get("minimum_should_match")
        if least is None:
            least = 1 if should and not must and not filters else 0

        def match() -> Column:
            out = all_of(filters, self.schema.fields)
            for c in must:
                out = out & c.match()
            for c in must_not:
                out = out & ~c.match()
            return out & (count_of([c.match() for c in should]) >= least) if least else out

        needs = next((c.needs for c in must if c.needs is not None), any_of([c.needs for c in should]) if should and least else None)
        return Node(match, (lambda: scoring.null_sum([s() for s in scores])) if scores else None, needs)

    def _constant_score(self, q, scored, boost) -> Node:
        value, cond = boost_of(q) * boost, q["filter"]
        match = lambda: compile_filter(cond, self.schema.fields)
        return Node(match, lambda: F.when(match(), F.lit(value)).otherwise(0.0))

    def _function_score(self, q, scored, boost) -> Node:
        own = boost_of(q)
        inner = self.node(q["query"], scored, boost)
        for f in q.get("functions", []):
            kind = f.get("type") or next((k for k in ("weight", "field_value_factor", "decay") if k in f), None)
            at = f[kind] if isinstance(f.get(kind), dict) else f
            self.plan.functions.append((inner.match, kind, at.get("field"), lambda f=f: scoring.function_value(f, self.schema)))

        def score() -> Column:
            base = inner.score() if inner.score else F.lit(1.0)
            return F.when(inner.match(), scoring.function_score(base, q, self.schema, boost * own)).otherwise(0.0)

        return Node(inner.match, score, inner.needs)

    def _rank_feature(self, q, scored, boost) -> Node:
        own = boost_of(q) * boost
        raw = lambda: F.coalesce(scoring.first_value(self.schema, q["field"]), F.lit(float(q.get("missing") or 0.0)))
        return Node(lambda: F.lit(True), lambda: finite(scoring.modified(raw(), q.get("modifier")) * own))

    def _script_score(self, q, scored, boost) -> Node:
        own, params = boost_of(q), q.get("params") or {}
        inner = self.node(q["query"], scored, boost)

        def score() -> Column:
            base = inner.score() if inner.score else F.lit(1.0)

            def variable(name: str) -> Column:
                if name == "_score":
                    return base
                if name in params:
                    return F.lit(float(params[name]))
                f = self.schema.fields.get(name)
                if f is None or f.kind not in ("i64", "f64") or not f.fast:
                    raise RequestError(f"script: unknown variable {name}")
                return F.coalesce(scoring.first_value(self.schema, name), F.lit(0.0))

            return F.when(inner.match(), finite(compile_script(q["script"], variable) * (boost * own))).otherwise(0.0)

        score()
        return Node(inner.match, score, inner.needs)


KINDS = {"match_all", "query_string", "multi_match", "dis_max", "term", "prefix", "wildcard", "regex", "phrase", "bool", "constant_score", "function_score", "rank_feature", "script_score", "vector"}


def any_of(needs: list[frozenset | None]) -> frozenset | None:
    """What a match of one of several nodes has a key of."""
    return None if any(n is None for n in needs) else frozenset().union(*needs)


def count_of(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for c in conditions:
        out = out + c.cast("int")
    return out


def in_order(spots: list[Column], slop: int) -> Column:
    """Whether positions p1 < p2 < ... exist with at most `slop` positions between them in all."""
    n = len(spots)

    def after(i: int, first: Column, last: Column) -> Column:
        if i == n:
            return F.lit(True)
        if slop == 0:
            return F.array_contains(spots[i], first + i) & after(i + 1, first, last)
        return F.exists(spots[i], lambda p: (p > last) & (p - first - i <= slop) & after(i + 1, first, p))

    return F.size(spots[0]) > 0 if n == 1 else F.exists(spots[0], lambda p: after(1, p, p))
