"""Looks up a plan's keys: documents with the positions of each term, lengths of fields, and the corpus' statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer, Filter, stems
from ..functions.columns import once
from ..functions.stemmer import kept
from ..schema import Schema
from .planner import Plan

NO_POSITIONS = "cast(array() as array<int>)"


def tokens(schema: Schema, name: str) -> Column:
    """Tokens of a text field as it is indexed; values of a list follow each other, an empty one leaves a gap."""
    f, analyzer = schema.fields[name], schema.index_analyzer(name)
    c = F.col(f"`{name}`")
    if not f.many:
        return analyzer.column(c)
    if analyzer.stacked or analyzer.needs_python:
        return analyzer.column(F.array_join(c, " "))
    kind = "array<string>"
    each = F.transform(c, lambda v: F.when(F.size(analyzer.column(v)) == 0, F.array(F.lit(None).cast("string"))).otherwise(analyzer.column(v)))
    return F.coalesce(F.flatten(each), F.array().cast(kind))


def keyword_terms(schema: Schema, name: str) -> Column:
    """Distinct values with ASCII letters lowered."""
    from ..functions.analysis import LOWER, UPPER

    f, c = schema.fields[name], F.col(f"`{name}`")
    values = c if f.many else F.array(c)
    return F.array_distinct(F.transform(values, lambda v: F.translate(v, UPPER, LOWER)))


def analyzed(docs: DataFrame, schema: Schema, fields: list[str]) -> DataFrame:
    """Adds _tok_<field> for each text field that hasn't got it yet."""
    for name in fields:
        if f"_tok_{name}" not in docs.columns:
            docs = docs.withColumn(f"_tok_{name}", tokens(schema, name))
    return docs


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings_of(docs: DataFrame, schema: Schema) -> DataFrame | None:
    """(id, field, term, positions) of documents that have their _tok_ columns; None without text fields."""
    out, id_ = None, schema.doc_id_field
    for name in schema.text_fields():
        toks = F.col(f"_tok_{name}")
        if schema.index_analyzer(name).stacked:
            one = docs.select(id_, F.explode(toks).alias("x")).select(id_, F.col("x.t").alias("term"), F.col("x.p").alias("p"))
        else:
            one = docs.select(id_, F.posexplode(toks).alias("p", "term")).where("term is not null")
        lists = one.groupBy(id_, "term").agg(F.sort_array(F.collect_list("p")).alias("positions")).withColumn("field", F.lit(name))
        out = lists if out is None else out.unionByName(lists)
    return out


@dataclass
class Postings:
    """rows: (id, _gen, field, bucket, term, positions). buckets: their number by generation. stored: the snapshot's statistics, where a commit has stored them; all rows are live then."""

    rows: DataFrame
    buckets: dict[int, int]
    stored: dict | None = None

    def of(self, wanted: dict[str, list[str]]) -> DataFrame:
        """The rows of some terms by field: only their buckets are read."""
        sizes, cond = sorted(set(self.buckets.values())), F.lit(False)
        spark = self.rows.sparkSession
        every = [t for terms in wanted.values() for t in terms]
        at = {r["t"]: [r[f"b{n}"] for n in sizes] for r in spark.createDataFrame([(t,) for t in every], "t string").select("t", *[bucket_of(F.col("t"), n).alias(f"b{n}") for n in sizes]).collect()} if every else {}
        for name, terms in wanted.items():
            inside = F.lit(False)
            for i, n in enumerate(sizes):
                gens = [g for g, m in self.buckets.items() if m == n]
                inside = inside | (F.col("_gen").isin(gens) & F.col("bucket").isin(sorted({at[t][i] for t in terms})))
            cond = cond | ((F.col("field") == name) & inside & F.col("term").isin(terms))
        return self.rows.where(cond)

    def dictionary(self, docs: DataFrame, id_: str, name: str) -> DataFrame:
        """(term, df) of a text field over the live documents."""
        rows = self.rows.where(F.col("field") == name)
        if self.stored is None:
            rows = rows.join(docs.select(id_, "_gen"), [id_, "_gen"], "left_semi")
        return rows.groupBy("term").agg(F.count("*").alias("df"))


def from_postings(docs: DataFrame, postings: Postings, plan: Plan, within: DataFrame | None = None) -> DataFrame:
    """As with_features(), for plans whose matches all have a word of a text field: reads the wanted terms' buckets, and of the documents those with such a term.

    `within`: ids that alone are wanted, in a column of the id's name; the statistics are those of all documents.
    """
    schema, id_ = plan.schema, plan.schema.doc_id_field
    wanted: dict[str, dict[str, int]] = {}
    for (name, term), i in plan.keys.items():
        if schema.fields[name].kind == "text":
            wanted.setdefault(name, {})[term] = i
    spots = [F.first(F.when((F.col("field") == n) & (F.col("term") == t), F.col("positions")), ignorenulls=True).alias(f"_k{i}") for n, own in wanted.items() for t, i in own.items()]
    rows = postings.of({n: list(own) for n, own in wanted.items()}).groupBy(F.col(id_).alias("_pid"), F.col("_gen").alias("_pgen")).agg(*spots)
    df_of = lambda rows: rows.agg(*[F.coalesce(F.sum((F.size(f"_k{plan.keys[k]}") > 0).cast("double")), F.lit(0.0)).alias(f"_df{plan.keys[k]}") for k in plan.scored])
    dfs = df_of(rows) if postings.stored and plan.scored else None
    if within is not None and dfs is not None:
        docs = docs.join(F.broadcast(within), id_, "left_semi")  # as many as a window holds
    out = docs.join(rows, (docs[id_] == rows["_pid"]) & (docs["_gen"] == rows["_pgen"])).drop("_pid", "_pgen")
    for (name, term), i in plan.keys.items():
        if schema.fields[name].kind == "keyword":
            out = out.withColumn(f"_k{i}", F.when(F.array_contains(keyword_terms(schema, name), term), F.array(F.lit(0))).otherwise(F.expr(NO_POSITIONS)))
    if not plan.scored:
        return out
    if dfs is not None:
        at = postings.stored
        known = {"_n": float(at["docs"])} | {f"_avg_{n}": at["lengths"][n][0] / at["lengths"][n][1] if at["lengths"][n][1] else None for n in sorted(wanted)}
        return out.crossJoin(F.broadcast(dfs)).select("*", *[F.lit(v).cast("double").alias(k) for k, v in known.items()])
    stats = docs.agg(F.count("*").cast("double").alias("_n"), *[F.avg(f"_len_{n}").alias(f"_avg_{n}") for n in sorted(wanted)])
    out = out.crossJoin(F.broadcast(stats.crossJoin(df_of(out))))  # one row
    return out if within is None else out.join(F.broadcast(within), id_, "left_semi")


@dataclass
class Reading:
    """How a field's terms are found in a scan: in the tokens before a last filter that puts several at a position or stems, which is applied to those alone that may be meant."""

    analyzer: Analyzer
    last: Filter | None = None

    @classmethod
    def of(cls, analyzer: Analyzer) -> "Reading":
        *first, last = analyzer.filters or (None,)
        base = Analyzer(analyzer.tokenizer, tuple(first))
        simple = last is not None and not base.stacked and (last.kind == "edge_ngram" or last.kind == "synonyms" and all(len(r[0]) < 2 for r in last.rules) or last.kind == "stemmer" and base.tokenizer == "default")
        return cls(base, last) if simple else cls(analyzer)

    def has(self, t: Column, term: str) -> list[Column]:
        """One condition for each time that a token stands for the term; of a stemmer, what its words begin with."""
        if self.last is None:
            return [t == term]
        if self.last.kind == "stemmer":
            return [t.startswith(kept(term))]
        if self.last.kind == "edge_ngram":
            gram = t.startswith(term) if self.last.low <= len(term) <= self.last.high else F.lit(False)
            return [gram | (t == term) if len(term) < self.last.low else gram]
        return [t == term, *[t == first for first, rules in self.last.by_first().items() for x in rules[0][1] if x == term]]

    def count(self, tokens: Column) -> Column:
        if self.last is None or self.last.kind == "stemmer":
            return F.size(tokens)
        if self.last.kind == "edge_ngram":
            low, high = self.last.low, self.last.high
            return F.aggregate(tokens, F.lit(0), lambda n, t: n + F.greatest(F.least(F.length(t), F.lit(high)) - (low - 1), F.lit(1)))
        out = F.size(tokens)
        for first, rules in self.last.by_first().items():
            out = out + F.size(F.filter(tokens, (lambda f: lambda t: t == f)(first))) * len(rules[0][1])
        return out

    def lengths(self, text: Column) -> Column:
        """Tokens of a text; those filters that change no count are left out."""
        filters = list(self.analyzer.filters)
        while self.last is None and filters and filters[-1].kind in ("lowercase", "stemmer"):
            filters.pop()
        return self.count(Analyzer(self.analyzer.tokenizer, tuple(filters)).column(text))


def may_have(schema: Schema, key: tuple[str, str]) -> Column | None:
    """Holds for all documents that have a word and for few others, without their tokens; None where nothing is known."""
    name, term = key
    if schema.fields[name].kind == "keyword":
        return F.coalesce(F.array_contains(keyword_terms(schema, name), term), F.lit(False))
    analyzer, seeds = schema.index_analyzer(name), [term]
    for i, f in enumerate(analyzer.filters):
        if f.kind in ("stemmer", "synonyms") and i + 1 < len(analyzer.filters):
            return None
        if f.kind == "stemmer":
            if analyzer.tokenizer != "default" or not kept(term):
                return None
            seeds = [kept(term)]
        if f.kind == "synonyms":
            seeds += [r[0][0] for r in f.rules if r[0] and term in r[1]]
    if schema.fields[name].many or analyzer.tokenizer == "unicode" or not all(x.isascii() for x in seeds):
        return None
    # ASCII words are in the lowered text in whatever case they are.
    out = F.lit(False)
    for x in dict.fromkeys(x.lower() for x in seeds):
        out = out | F.lower(F.col(f"`{name}`")).contains(x)
    return F.coalesce(out, F.lit(False))


def places_of(hits: Column, reading: Reading, term: str) -> Column:
    """Positions of a term among tokens (t, p)."""
    times = len(reading.has(F.lit(""), term))
    spots = [F.transform(F.filter(hits, (lambda n: lambda x: reading.has(x["t"], term)[n])(n)), lambda x: x["p"]) for n in range(times)]
    return spots[0] if times == 1 else F.sort_array(F.concat(*spots))


def narrowed(docs: DataFrame, schema: Schema, keys) -> DataFrame:
    """Without documents that can't have any of the keys."""
    each = [may_have(schema, k) for k in keys]
    return docs if not each or any(c is None for c in each) else docs.where(reduce(lambda a, b: a | b, each))


def with_keys(docs: DataFrame, plan: Plan, lengths: bool) -> DataFrame:
    """The documents with _k<i>, and _len_<field> where asked for, from their tokens."""
    schema = plan.schema
    for name in sorted(plan.text_fields):
        f, analyzer = schema.fields[name], schema.index_analyzer(name)
        own = {term: i for (n, term), i in plan.keys.items() if n == name}
        known = f"_tok_{name}" in docs.columns
        reading = Reading(analyzer) if known or f.many else Reading.of(analyzer)
        if not known:
            docs = docs.withColumn(f"_tok_{name}", once(tokens(schema, name) if f.many else reading.analyzer.column(F.col(f"`{name}`"))))
        toks, stacked = F.col(f"_tok_{name}"), reading.analyzer.stacked
        some = lambda t: reduce(lambda a, b: a | b, [c for term in own for c in reading.has(t, term)]) if reading.last else t.isin(list(own))
        if stacked:
            hits = F.filter(toks, lambda x: some(x["t"]))
        else:
            hits = F.filter(F.transform(toks, lambda t, i: F.when(some(t), F.struct(t.alias("t"), i.alias("p")))), lambda x: x.isNotNull())
        size = F.size(F.array_compact(toks)) if f.many and not stacked else reading.count(toks)
        docs = docs.withColumn(f"_hits_{name}", once(F.struct(*([size.alias("n")] if lengths else []), hits.alias("hits"))))
        if lengths:
            docs = docs.withColumn(f"_len_{name}", F.col(f"_hits_{name}.n"))
        hits = F.col(f"_hits_{name}.hits")
        if reading.last and reading.last.kind == "stemmer":
            docs = docs.withColumn(f"_stems_{name}", once(stems(F.transform(hits, lambda x: x["t"]))))
            hits, reading = F.transform(hits, lambda x, i: F.struct(F.get(F.col(f"_stems_{name}"), i).alias("t"), x["p"].alias("p"))), Reading(analyzer)
        for term, i in own.items():
            docs = docs.withColumn(f"_k{i}", places_of(hits, reading, term))
        docs = docs.drop(f"_tok_{name}", f"_hits_{name}", f"_stems_{name}")
    for (name, term), i in plan.keys.items():
        if schema.fields[name].kind == "keyword":
            docs = docs.withColumn(f"_k{i}", F.when(F.array_contains(keyword_terms(schema, name), term), F.array(F.lit(0))).otherwise(F.expr(NO_POSITIONS)))
    return docs


def statistics(docs: DataFrame, plan: Plan) -> list[DataFrame]:
    """One row each: _n and _avg_<field>, which depend on no word and so are found once for all queries of a plan, and _df<i>."""
    schema, texts = plan.schema, sorted({n for n, _ in plan.scored} & plan.text_fields)
    stored, lengths = [n for n in texts if f"_tok_{n}" in docs.columns], []
    for name in texts:
        f, c = schema.fields[name], F.col(f"`{name}`")
        if f.many or name in stored:
            toks = F.col(f"_tok_{name}") if name in stored else tokens(schema, name)
            size = F.size(F.array_compact(toks)) if f.many and not schema.index_analyzer(name).stacked else F.size(toks)
        else:
            size = Reading.of(schema.index_analyzer(name)).lengths(c)
        lengths.append(F.avg(size).alias(f"_avg_{name}"))
    dfs = [F.sum((F.size(f"_k{plan.keys[k]}") > 0).cast("double")) for k in plan.scored]
    dfs = [F.coalesce(c, F.lit(0.0)).alias(f"_df{plan.keys[k]}") for k, c in zip(plan.scored, dfs)]
    return [docs.agg(F.count("*").cast("double").alias("_n"), *lengths), with_keys(narrowed(docs, schema, plan.scored), plan, False).agg(*dfs)]


def with_features(docs: DataFrame, plan: Plan, postings: Postings | None = None, within: DataFrame | None = None, wanted: tuple = ()) -> DataFrame:
    """The documents with _k<i>, _len_<field> and, where words are scored, the statistics _n, _df<i> and _avg_<field>.

    `wanted`: sets of keys; documents without any of a set's aren't wanted. The statistics are those of all.
    """
    schema = plan.schema
    needed = plan.scored or plan.needs
    if postings is not None and needed and all(schema.fields[n].kind == "text" for n, _ in needed):
        return from_postings(docs, postings, plan, within)
    out = docs if within is None else docs.join(F.broadcast(within), schema.doc_id_field, "left_semi")
    for keys in wanted:
        out = narrowed(out, schema, keys or ())
    out = with_keys(out, plan, bool(plan.scored))
    if plan.scored:
        for one in statistics(docs, plan):
            out = out.crossJoin(F.broadcast(one))
    return out


def dictionary(docs: DataFrame, schema: Schema, name: str, head: str = "") -> DataFrame:
    """(term, df) of a field, of the terms that begin with `head`."""
    if schema.fields[name].kind == "keyword":
        terms = keyword_terms(schema, name)
    else:
        docs = analyzed(docs, schema, [name])
        terms = F.transform(f"_tok_{name}", lambda x: x["t"]) if schema.index_analyzer(name).stacked else F.col(f"_tok_{name}")
        terms = F.array_distinct(F.filter(terms, lambda t: t.startswith(head)) if head else terms)
    return docs.select(F.explode(terms).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def wildcard_pattern(pattern: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def literal_prefix(pattern: str) -> str:
    """What every match of a regular expression begins with, as far as plain signs go."""
    m = re.match(r"[\w ]*", pattern)
    head, rest = m.group(0), pattern[m.end() :]
    if "|" in pattern:
        return ""
    return head[:-1] if rest[:1] in ("*", "?", "{") else head


def head_of(kind: str, pattern: str, options: dict) -> str:
    """What all terms that a pattern stands for begin with."""
    if kind == "prefix":
        return pattern
    if kind == "wildcard":
        return re.match(r"[^*?]*", pattern).group(0)
    return literal_prefix(pattern) if kind == "regex" else pattern[: int(options.get("prefix_length", 1))]


def matching_terms(terms: DataFrame, kind: str, pattern: str, options: dict) -> DataFrame:
    """(term, df, distance) of the terms a pattern stands for; distance is 0 but for `fuzzy`."""
    c = F.col("term")
    zero = F.lit(0)
    if kind == "prefix":
        return terms.where(c.startswith(pattern)).withColumn("distance", zero)
    head = head_of(kind, pattern, options)
    if kind == "wildcard":
        return terms.where(c.startswith(head) & c.rlike(f"(?s)^(?:{wildcard_pattern(pattern)})$")).withColumn("distance", zero)
    if kind == "regex":
        return terms.where(c.startswith(head) & c.rlike(f"^(?:{pattern})$")).withColumn("distance", zero)
    edits = min(int(options.get("max_edits", 1)), 2)
    if len(pattern) < int(options.get("min_length", 3)) or edits == 0:
        return terms.where(F.lit(False)).withColumn("distance", zero)
    near = terms.where(c.startswith(head) & F.length(c).between(len(pattern) - edits, len(pattern) + edits))
    return near.withColumn("distance", F.levenshtein(c, F.lit(pattern), edits)).where(f"distance between 1 and {edits}")


def expand(terms: DataFrame, kind: str, pattern: str, options: dict) -> list:
    """At most max_expansions terms in byte order: for `fuzzy` with their distances."""
    cap = int(options.get("max_expansions", 50))
    rows = matching_terms(terms, kind, pattern, options).orderBy("term").limit(cap).collect()
    return [(r["term"], r["distance"]) for r in rows] if kind == "fuzzy" else [r["term"] for r in rows]
