"""Hierarchical weighted hash tree: each key descends region, rack and shard levels by weighted hash draws.

At a node every child draws -ln(u) / weight with u from the hash of (seed, child's path, key); the least draw wins, so
a child is chosen in proportion to its weight. A draw depends on nothing but the key, the child's path and its weight:
a changed weight moves keys only into or out of that child, and inside the other subtrees nothing moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table, unused

#: name -> (weight, children) at inner levels, name -> weight at the last one.
TREE = {
    "eu": (3.0, {"eu-a": (2.0, {"eu-a-0": 1.0, "eu-a-1": 1.0, "eu-a-2": 2.0}), "eu-b": (1.0, {"eu-b-0": 1.0, "eu-b-1": 1.0})}),
    "us": (4.0, {"us-a": (1.0, {"us-a-0": 1.0, "us-a-1": 1.0}), "us-b": (1.0, {"us-b-0": 3.0, "us-b-1": 1.0}), "us-c": (2.0, {"us-c-0": 1.0, "us-c-1": 1.0, "us-c-2": 1.0, "us-c-3": 1.0})}),
    "ap": (1.0, {"ap-a": (1.0, {"ap-a-0": 1.0, "ap-a-1": 2.0})}),
}
LEVELS = ("region", "rack", "shard")
SEED = "tamarack"


def weight_of(node) -> float:
    return float(node[0] if isinstance(node, tuple) else node)


def draw(key: Column, path: str, weight: float, seed: str) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/{path}/"), key)), 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(weight)


def chosen(key: Column, children: dict, prefix: str, seed: str) -> Column:
    live = {n: weight_of(c) for n, c in children.items() if weight_of(c) > 0}
    if not live:
        return F.lit(None).cast("string")
    if len(live) == 1:
        return F.lit(next(iter(live)))
    draws = [F.struct(draw(key, f"{prefix}{n}", w, seed).alias("d"), F.lit(n).alias("n")) for n, w in sorted(live.items())]
    return F.array_min(F.array(*draws))["n"]


def assign(df: DataFrame, key: str, tree: dict | None = None, levels: tuple[str, ...] = LEVELS, seed: str = SEED) -> DataFrame:
    """Adds a column for each level with the node that the row's key falls to; one projection for each level, no shuffle.

    Equal keys always fall together. A null key has null levels, an empty text is a key like any other. Children of
    weight 0 get nothing; where no child has a weight, that level and those below are null. Levels replace columns of
    the same names; all other columns are kept. Negative weights are an error.
    """
    tree = TREE if tree is None else tree
    at = {"": tree}
    for _, subtree in list(_walk(tree)):
        if weight_of(subtree) < 0:
            raise ValueError("weights must not be negative")
    key_, at_, path_ = unused([*df.columns, *levels], "_key", "_at", "_path")
    out = df.withColumn(key_, col(key).cast("string"))
    for k, level in enumerate(levels):
        picks = [(path, chosen(col(key_), children, path, seed)) for path, children in at.items()]
        if k == 0:
            pick = picks[0][1]
        else:
            pick = F.lit(None).cast("string")
            for path, p in picks:
                pick = F.when(col(path_) == path, p).otherwise(pick)
        out = out.withColumn(at_, F.when(col(key_).isNotNull(), pick))
        out = out.withColumn(path_, F.concat(col(path_) if k else F.lit(""), col(at_), F.lit("/"))).withColumn(level, col(at_))
        at = {f"{path}{n}/": c[1] for path, children in at.items() for n, c in children.items() if isinstance(c, tuple)}
    return out.drop(key_, at_, path_)


def _walk(children: dict):
    for n, c in children.items():
        yield n, c
        if isinstance(c, tuple):
            yield from _walk(c[1])


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def _sql(tree: dict, seed: str = SEED) -> str:
    nodes = []

    def walk(children: dict, prefix: str, depth: int) -> None:
        for n, c in children.items():
            nodes.append(f"({depth}, '{prefix}', '{n}', {weight_of(c)}::DOUBLE)")
            if isinstance(c, tuple):
                walk(c[1], f"{prefix}{n}/", depth + 1)

    walk(tree, "", 0)
    step = "(SELECT arg_min(n.name, -ln((('0x' || substr(md5('{seed}/' || n.parent || n.name || '/' || {k}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / n.weight) FROM nodes n WHERE n.parent = {p} AND n.weight > 0)"
    one = lambda p: step.format(seed=seed, k="doc_id::VARCHAR", p=p)
    return f"""
WITH nodes(depth, parent, name, weight) AS (VALUES {', '.join(nodes)}),
a AS (SELECT doc_id, {one("''")} AS region FROM documents),
b AS (SELECT doc_id, region, {one("region || '/'")} AS rack FROM a)
SELECT doc_id, region, rack, {one("region || '/' || rack || '/'")} AS shard FROM b
"""


QUERIES = {"op2_hash_tree": op2_hash_tree}
ORACLES = {"op2_hash_tree": _sql(TREE)}
