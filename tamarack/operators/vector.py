"""Vector similarity as array expressions, exact nearest neighbours and blends with text scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..schema import Schema
from .filters import compile_filter

MAX_CLAUSES, MAX_K, MAX_CANDIDATES = 8, 1024, 10_000


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def similarity(v: Column, query: list[float], metric: str) -> Column:
    """Cosine, 0 for a vector of zeros; or the negative Euclidean distance."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.transform(v, lambda x: x.cast("double"))
    if metric == "L2":
        return -F.sqrt(_sum(F.zip_with(d, q, lambda x, y: (x - y) * (x - y))))
    norm = math.sqrt(sum(x * x for x in query))
    dot = _sum(F.zip_with(d, q, lambda x, y: x * y))
    own = F.sqrt(_sum(F.transform(d, lambda x: x * x)))
    return F.coalesce(F.try_divide(dot, own * F.lit(norm)), F.lit(0.0))


def clause_of(spec) -> dict:
    """The tuple form [field, vector, alpha] as well as the object form."""
    if isinstance(spec, (list, tuple)):
        return {"field": spec[0], "vector": spec[1], **({"alpha": spec[2]} if len(spec) > 2 else {})}
    return dict(spec)


def clauses_in(query) -> list[dict]:
    """Vector nodes anywhere in a query tree."""
    if not isinstance(query, dict):
        return []
    if query.get("type") == "vector":
        return [clause_of({k: v for k, v in query.items() if k != "type"})]
    out = []
    for k in ("must", "should", "queries"):
        for c in query.get(k) or []:
            out += clauses_in(c)
    return out + (clauses_in(query["query"]) if isinstance(query.get("query"), dict) else [])


def only_vectors(query) -> bool:
    """Whether nothing but vector clauses selects documents."""
    if not isinstance(query, dict):
        return False
    kind = query.get("type")
    if kind == "vector":
        return True
    if kind == "bool":
        children = [c for k in ("must", "should") for c in query.get(k) or []]
        return bool(children) and not query.get("must_not") and not query.get("filter") and all(only_vectors(c) for c in children)
    return False


def checked(clauses: list[dict], schema: Schema, limit: int) -> list[dict]:
    if len(clauses) > MAX_CLAUSES:
        raise RequestError(f"more than {MAX_CLAUSES} vector clauses")
    out = []
    for c in clauses:
        f = schema.fields.get(c["field"])
        if f is None or f.kind != "vector":
            raise RequestError(f"{c['field']} isn't a vector field")
        if len(c["vector"]) != f.dim:
            raise RequestError(f"{f.name} needs {f.dim} numbers")
        k = int(c.get("k") or limit)
        if not 1 <= k <= MAX_K:
            raise RequestError(f"k must lie between 1 and {MAX_K}")
        alpha = 0.5 if c.get("alpha") is None else float(c["alpha"])
        if not 0 <= alpha <= 1:
            raise RequestError("alpha must lie between 0 and 1")
        wanted = c.get("candidate_size") or 2 * max(k, limit, 10)
        out.append({"field": f.name, "vector": c["vector"], "metric": f.metric, "k": k, "alpha": alpha, "boost": float(c.get("boost") or 1.0), "candidates": min(max(wanted, k), MAX_CANDIDATES)})
    return out


def scored(docs: DataFrame, clause: dict) -> DataFrame:
    """Adds _v, the clause's similarity times its boost; null where there is no vector."""
    v = F.col(f"`{clause['field']}`")
    return docs.withColumn("_v", F.when(v.isNotNull(), similarity(v, clause["vector"], clause["metric"]) * clause["boost"]))


def nearest(docs: DataFrame, clause: dict, id_: str, n: int) -> DataFrame:
    """(id, _v) of the n most similar documents: each task keeps its own n, no shuffle of the rest."""
    ranked = scored(docs, clause).where("_v is not null").select(id_, "_v")
    return ranked.orderBy(F.desc("_v"), id_).limit(n)


def vector_only(docs: DataFrame, clauses: list[dict], schema: Schema, id_: str, where: dict | None) -> DataFrame:
    """Documents among some clause's candidates with _score, the mean over the clauses that found them."""
    if where:
        docs = docs.where(compile_filter(where, schema.fields))
    found = None
    for c in clauses:
        one = nearest(docs, c, id_, c["candidates"] if len(clauses) > 1 else c["k"])
        found = one if found is None else found.unionByName(one)
    means = found.groupBy(F.col(id_).alias("_vid")).agg(F.avg("_v").alias("_score"))
    return docs.join(means, F.col(f"`{id_}`") == F.col("_vid")).drop("_vid")


def blended(docs: DataFrame, clauses: list[dict], schema: Schema, id_: str, where: dict | None) -> DataFrame:
    """_score becomes the mean over clauses of alpha * text + (1 - alpha) * vector.

    Only a clause's candidates have a vector score; the others count as -1 for Cosine, and as the least number for L2.
    """
    live = [c for c in clauses if c["alpha"] < 1.0]
    if not live:
        return docs
    out, total = docs, None
    pool = docs.where(compile_filter(where, schema.fields)) if where else docs
    for i, c in enumerate(live):
        got = nearest(pool, c, id_, c["candidates"]).select(F.col(id_).alias("_vid"), F.col("_v").alias(f"_v{i}"))
        out = out.join(got, F.col(f"`{id_}`") == F.col("_vid"), "left").drop("_vid")
        absent = -1.0 if c["metric"] == "Cosine" else -3.4028234663852886e38
        part = c["alpha"] * F.col("_score") + (1 - c["alpha"]) * F.coalesce(F.col(f"_v{i}"), F.lit(absent))
        total = part if total is None else total + part
    return out.withColumn("_score", total / len(live)).drop(*[f"_v{i}" for i in range(len(live))])
