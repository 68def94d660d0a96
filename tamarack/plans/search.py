"""Runs search requests: match, score, filter, sort, rescore, collapse, page, highlight, suggest and aggregate."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.analysis import ascii_lower
from ..operators import vector
from ..operators.aggregations import Aggregator
from ..operators.filters import compile_filter
from ..operators.highlight import highlighted
from ..operators.scoring import sum_of
from ..operators.sorting import SortPlan
from ..schema import Schema
from .features import Postings, dictionary, expand, head_of, matching_terms, with_features
from .grammar import parse_query
from .planner import Plan, Planner

MAX_CANDIDATES, MAX_CURSOR = 20_000, 50_000


@dataclass
class Result:
    """hits: a DataFrame in order; aggregations and suggestions: plain objects; total counts all matches."""

    hits: DataFrame
    matched: DataFrame
    order: SortPlan
    size: int
    generation: int
    returned: int = 0
    aggregations: dict = field(default_factory=dict)
    suggest: dict = field(default_factory=dict)
    profile: dict | None = None
    groups: DataFrame | None = None

    @property
    def total(self) -> int:
        return self.matched.count()

    @property
    def total_groups(self) -> int | None:
        return None if self.groups is None else self.groups.count()

    def page(self) -> tuple[list[dict], str | None]:
        """The hits of this page as dicts, and the cursor of the next one if there is more."""
        rows = self.hits.limit(self.size + 1).collect()
        more, rows = len(rows) > self.size, rows[: self.size]
        shown = [{k: v for k, v in r.asDict(True).items() if not k.startswith("_s") or not k[2:].isdigit()} for r in rows]
        seen = self.returned + len(rows)
        return shown, self.order.cursor(rows[-1], self.generation, seen) if more and seen < MAX_CURSOR else None


    def response(self) -> dict:
        """The whole answer as plain objects, as it is written in JSON: hits of this page, cursor, totals, aggregations, suggestions and profile."""
        hits, cursor = self.page()
        out = {"total_hits": self.total, "hits": hits, "next_cursor": cursor, "total_groups": self.total_groups, "aggregations": self.aggregations, "suggest": self.suggest, "profile": self.profile}
        return {k: v for k, v in out.items() if v or k in ("total_hits", "hits")}

    def write(self, path: str) -> None:
        """All hits that the request's limit allows as JSON lines, by the executors."""
        self.hits.limit(self.size).drop(*self.order.names()).write.json(path)


class Searcher:
    """Answers requests over one snapshot: documents with _gen and the id, and their schema."""

    def __init__(self, docs: DataFrame, schema: Schema, generation: int = 1, postings: DataFrame | None = None, stored: dict | None = None, buckets: dict | None = None) -> None:
        self.docs = docs if "_gen" in docs.columns else docs.withColumn("_gen", F.lit(1))
        self.schema, self.generation, self.id_ = schema, generation, schema.doc_id_field
        self.postings = Postings(postings, buckets or {}, stored) if postings is not None else None
        self._terms: dict[str, DataFrame] = {}

    def terms(self, name: str, head: str = "") -> DataFrame:
        """(term, df) of a field of this snapshot; with a head, where the texts are scanned, of terms that begin with it alone."""
        if head and not self.postings:
            return dictionary(self.docs, self.schema, name, head)
        if name not in self._terms and self.postings and self.schema.fields[name].kind == "text":
            self._terms[name] = self.postings.dictionary(self.docs, self.id_, name)
        if name not in self._terms:
            self._terms[name] = dictionary(self.docs, self.schema, name)
        return self._terms[name]

    def _expand(self, kind: str, name: str, pattern: str, options: dict) -> list:
        return expand(self.terms(name, head_of(kind, pattern, options)), kind, pattern, options)

    def plan(self, query, fields: list[str] | None = None, fuzzy: dict | None = None) -> Plan:
        return Planner(self.schema, self._expand, fields, fuzzy).build(query)

    def matches(self, request: dict, need_score: bool = True) -> tuple[DataFrame, Plan]:
        """All matching documents with _score; documents whose score is dropped are not among them."""
        plan = self.plan(request["query"], request.get("fields"), request.get("fuzzy"))
        df = with_features(self.docs, plan, self.postings, wanted=(plan.scored, plan.needs))
        candidates = plan.candidates()
        if candidates is not None:
            df = df.where(candidates)
        df = df.where(plan.root.match())
        if request.get("filter"):
            df = df.where(compile_filter(request["filter"], self.schema.fields, exact=False))
        score = plan.root.score() if plan.root.score else F.lit(1.0)
        df = df.withColumn("_score", score.cast("double")).where("_score is not null") if need_score or plan.root.score else df.withColumn("_score", F.lit(0.0))
        if request.get("explain"):
            df = df.withColumn("_base", sum_of([plan.leaf_score(i) for i in range(plan.leaves)]) if plan.leaves else F.lit(0.0))
            parts = [F.struct(F.lit(kind).alias("type"), F.lit(name).cast("string").alias("field"), F.when(match(), value()).alias("value")) for match, kind, name, value in plan.functions]
            df = df.withColumn("_functions", F.filter(F.array(*parts), lambda x: x["value"].isNotNull()) if parts else F.lit(None).cast("array<struct<type:string,field:string,value:double>>"))
        return df.drop(*[c for c in df.columns if c.startswith(("_k", "_df", "_avg_", "_len_", "_tok_")) and (c not in self.docs.columns or c.startswith(("_len_", "_tok_")))] + ["_n"]), plan

    def search(self, request: dict) -> Result:
        began = time.time()
        limit = request.get("limit", 10)
        if limit < 1:
            raise RequestError("limit must be at least 1; use return_hits: false for aggregations alone")
        order = SortPlan(request.get("sort"), self.schema)
        collapse = request.get("collapse")
        if collapse:
            f = self.schema.fields.get(collapse["field"])
            if f is None or f.kind != "keyword" or not f.fast:
                raise RequestError(f"can't collapse on {collapse['field']}: it must be a fast keyword field")
            if f.many:
                raise RequestError("can't collapse on a field with several values")
        window = min(max(request.get("candidate_size") or limit, limit), MAX_CANDIDATES)
        specs = vector.clauses_in(request["query"]) if isinstance(request["query"], dict) else []
        if request.get("vector_query"):
            if specs:
                raise RequestError("vector clauses in the query and in vector_query")
            given = request["vector_query"]
            specs = [vector.clause_of(c) for c in (given if isinstance(given, list) and given and isinstance(given[0], (dict, list, tuple)) else [given])]
        clauses = vector.checked(specs, self.schema, limit)
        if clauses and vector.only_vectors(request["query"]):
            pool = self.docs.where(compile_filter(request["filter"], self.schema.fields, exact=False)) if request.get("filter") else self.docs
            found, plan = vector.vector_only(pool, clauses, self.schema, self.id_, request.get("vector_filter")), None
        else:
            found, plan = self.matches(request, order.by_score or not request.get("sort"))
            if clauses:
                found = vector.blended(found, clauses, self.schema, self.id_, request.get("vector_filter"))
        found = found.select("*", *order.columns())
        result = Result(found, found, order, limit, self.generation)
        aggregated = found
        if request.get("cursor"):
            at = order.read_cursor(request["cursor"], self.generation)
            aggregated = found.where(order.after(at["v"], *at["k"]))
            result.returned = at["n"]
        hits = aggregated.orderBy(*order.order())
        if request.get("rescore"):
            hits = self._rescored(hits, request["rescore"], order, max(window, request["rescore"]["window_size"]))
        if collapse:
            hits, result.groups = self._collapsed(hits.limit(max(window, limit) + 1), collapse, order)
        if request.get("explain"):
            base = F.col("_base") if "_base" in hits.columns else F.lit(None).cast("double")
            functions = F.col("_functions") if "_functions" in hits.columns else F.lit(None).cast("array<struct<type:string,field:string,value:double>>")
            again = F.col("_rescore") if "_rescore" in hits.columns else F.lit(None).cast("struct<rescore_score:double,combined_score:double>")
            hits = hits.withColumn("_explanation", F.struct(base.alias("base_score"), functions.alias("functions"), again.alias("rescore"), F.col("_score").alias("final_score")))
        result.hits = self._shown(hits, request, plan).limit(limit + 1)
        if request.get("aggs"):
            result.aggregations = Aggregator(self.schema, self.docs).run(aggregated, request["aggs"])
        for name, s in (request.get("suggest") or {}).items():
            result.suggest[name] = [r.asDict() for r in self.suggest(s).collect()]
        if request.get("profile"):
            result.profile = {"planning_ms": round(1000 * (time.time() - began)), "scored_terms": len(plan.scored) if plan else 0, "looked_up_terms": len(plan.keys) if plan else 0, "from_postings": bool(plan and self.postings and (plan.scored or plan.needs))}
        return result

    # ---- after ranking

    def _rescored(self, hits: DataFrame, spec: dict, order: SortPlan, window: int) -> DataFrame:
        """Scores the first window_size hits again and orders these anew; the others follow as they were."""
        n = int(spec["window_size"])
        if n < 1:
            raise RequestError("window_size must be at least 1")
        top = hits.limit(window + 1).withColumn("_rank", F.row_number().over(Window.orderBy(*order.order())))
        # Only the window's documents are looked at again.
        again, _ = self.matches_all(spec["query"], top.where(F.col("_rank") <= n).select(self.id_))
        both = top.join(again, self.id_, "left").withColumn("_in", F.col("_rank") <= n)
        a, b = F.col("_score"), F.col("_again")
        mode = spec.get("score_mode", "total")
        by = {"total": a + b, "sum": a + b, "multiply": a * b, "max": F.greatest(a, b), "min": F.least(a, b)}
        if mode not in by:
            raise RequestError(f"unknown rescore mode {mode}")
        both = both.where(~F.col("_in") | F.col("_hit").isNull() | b.isNotNull())
        told = F.col("_in") & F.col("_hit").isNotNull()
        if "_base" in hits.columns:
            both = both.withColumn("_rescore", F.when(told, F.struct(b.alias("rescore_score"), by[mode].alias("combined_score"))))
        both = both.withColumn("_score", F.when(told, by[mode]).otherwise(a))
        s = [F.col("_score").alias(x) if order.keys[i][2] == "_score" else F.col(x) for i, x in enumerate(order.names())]
        both = both.select(*[c for c in both.columns if c not in (*order.names(), "_again", "_hit", "_in", "_rank")], *s, "_in", "_rank")
        within = [F.when(F.col("_in"), F.col(x)) for x in order.names()]
        keys = [c.asc_nulls_last() if up else c.desc_nulls_last() for c, (_, up, _) in zip(within, order.keys)]
        return both.orderBy(F.desc("_in"), *keys, F.when(~F.col("_in"), F.col("_rank")), "_gen", self.id_).drop("_in", "_rank")

    def matches_all(self, query, within: DataFrame) -> tuple[DataFrame, Plan]:
        """(id, _hit, _again) of those documents of `within` (ids) that the query matches; a null score says that it drops the document."""
        plan = self.plan(query)
        # A document without the words that every match has is no match, but one without those that are scored may be.
        postings = self.postings if plan.needs else None
        df = with_features(self.docs, plan, postings, within, (plan.needs,)).where(plan.root.match())
        score = plan.root.score() if plan.root.score else F.lit(1.0)
        return df.select(self.id_, F.lit(True).alias("_hit"), score.cast("double").alias("_again")), plan

    def _collapsed(self, hits: DataFrame, spec: dict, order: SortPlan) -> tuple[DataFrame, DataFrame]:
        """The best hit of each value; inner_hits holds the rest of its group in their own order."""
        f = F.col(f"`{spec['field']}`")
        ranked = hits.where(f.isNotNull()).withColumn("_rn", F.row_number().over(Window.partitionBy(f).orderBy(*order.order())))
        best = ranked.where("_rn = 1").drop("_rn")
        if spec.get("inner_hits") is not None:
            inner = spec["inner_hits"] or {}
            own = SortPlan(inner.get("sort"), self.schema)
            skip, size = int(inner.get("from") or 0), int(inner.get("size") if inner.get("size") is not None else 3)
            rest = ranked.where("_rn > 1").select(f.alias("_group"), self.id_, "_score", "_gen", *own.columns())
            rest = rest.withColumn("_rn", F.row_number().over(Window.partitionBy("_group").orderBy(*own.order()))).where((F.col("_rn") > skip) & (F.col("_rn") <= skip + size))
            lists = rest.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct(F.col("_rn").alias("rank"), F.col(self.id_).alias("id"), F.col("_score").alias("score")))).alias("inner_hits"))
            best = best.join(lists, best[spec["field"]] == lists["_group"], "left").drop("_group")
        return best.orderBy(*order.order()), best

    def _shown(self, hits: DataFrame, request: dict, plan: Plan | None) -> DataFrame:
        """Stored fields where asked for, without the parts of objects that aren't stored, and highlights."""
        keep = [self.id_, "_gen", "_score", *[c for c in hits.columns if c in ("inner_hits", "_explanation")], *SortPlan(request.get("sort"), self.schema).names()]
        columns = [F.col(c) for c in keep]
        if request.get("return_stored"):
            columns += [stored(f, F.col(f"`{n}`")).alias(n) for n, f in self.schema.fields.items() if f.stored and f.kind != "vector" and n in hits.columns]
        marks = dict((request.get("highlight") or {}).get("fields") or {})
        words, phrases = self._words(request)
        limited = hits.limit(request.get("limit", 10) + 1) if marks or request.get("highlight_field") else hits
        if request.get("highlight_field"):
            name = request["highlight_field"]
            columns.append(F.get(highlighted(F.col(f"`{name}`"), words, phrases, "**", "**", 120, 1), F.lit(0)).alias("snippet"))
        if marks:
            each = [highlighted(F.col(f"`{n}`"), words, phrases, o.get("pre_tag", "<em>"), o.get("post_tag", "</em>"), o.get("fragment_size", 160), o.get("number_of_fragments", 1)).alias(n) for n, o in marks.items()]
            columns.append(F.struct(*each).alias("highlights"))
        return limited.select(*columns)

    def _words(self, request: dict) -> tuple[list[str], list[list[str]]]:
        words: list[str] = []
        phrases: list[list[str]] = []

        def walk(q) -> None:
            if isinstance(q, str):
                q = {"type": "query_string", "query": q}
            if not isinstance(q, dict):
                return
            kind = q.get("type")
            if kind in ("query_string", "multi_match"):
                p = parse_query(q["query"])
                words.extend(ascii_lower(w) for _, w in p.terms)
                phrases.extend([ascii_lower(w) for w in ws] for _, ws in p.phrases)
            elif kind == "term":
                words.append(ascii_lower(str(q["value"])))
            elif kind == "phrase":
                phrases.append([ascii_lower(w) for w in q["terms"]])
            for k in ("must", "should", "queries"):
                for c in q.get(k) or []:
                    walk(c)
            if kind in ("function_score", "script_score"):
                walk(q["query"])

        walk(request["query"])
        return words, phrases

    def suggest(self, spec: dict) -> DataFrame:
        """(text, score, doc_freq): completions of the last word of a prefix."""
        f = self.schema.fields.get(spec["field"])
        if f is None or f.kind not in ("text", "keyword"):
            raise RequestError(f"can't suggest from {spec['field']}")
        got = self.schema.search_analyzer(f.name).terms(spec["prefix"]) if f.kind == "text" else [ascii_lower(spec["prefix"])]
        size = int(spec.get("size", 5))
        scan = min(max(5 * size, 64), 256)
        last = got[-1] if got else ""
        terms = lambda kind, o: matching_terms(self.terms(f.name, head_of(kind, last, o)), kind, last, o)
        found = terms("prefix", {}).orderBy("term").limit(scan) if last else matching_terms(self.terms(f.name), "prefix", "￿", {}).limit(0)
        if spec.get("fuzzy") is not None and last:
            o = {"max_edits": 1, "prefix_length": 1, "min_length": 3} | (spec["fuzzy"] or {})
            near = terms("fuzzy", o).orderBy("term").limit(int(o.get("max_expansions", 50)))
            found = found.unionByName(near).groupBy("term", "df").agg(F.min("distance").alias("distance"))
        scored = found.select(F.col("term").alias("text"), (F.col("df") / (F.col("distance") + 1)).cast("double").alias("score"), F.col("df").alias("doc_freq"))
        return scored.orderBy(F.desc("score"), "text").limit(size)


def stored(f, c):
    """A value without the parts that aren't stored."""
    if f.kind != "nested":
        return c
    inner = [g for g in f.fields.values() if g.stored]
    if f.many:
        return F.transform(c, lambda o: F.struct(*[stored(g, o[g.name]).alias(g.name) for g in inner]))
    return F.when(c.isNotNull(), F.struct(*[stored(g, c[g.name]).alias(g.name) for g in inner]))
