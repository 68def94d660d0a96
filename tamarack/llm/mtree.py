"""Exact top-k neighbours by best-first search in an M-tree.

The vectors hang on routing vectors taken from the table, each below the nearest; a router with its vectors is a subtree
and one row of a table. Inside, nodes of at most FANOUT children end in leaf pages of at most PAGE vectors. Every node
is routed by one of its own vectors, with a covering radius and the distance to its parent's router; every entry of a
page stores its distance to the page's router.

Queries descend a subtree in batches, best first: a queue holds nodes by the least lower bound of the queries that are
still open there. The stored distances give |d(q, parent) - d(router, parent)| - radius before d(q, router) is computed,
and |d(q, router) - d(entry, router)| before d(q, entry) is; what these bounds exclude is never computed. The search
ends when the least bound in the queue exceeds the distance of every query's k-th neighbour. Each query is first
answered in the subtree of its own router, which bounds its k-th distance, and then goes to those subtrees only whose
balls come within that bound. Bounds err on the side of looking, and the distances that count are computed in double
precision: the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, materialize, table

K = 10
#: The registered query asks for the neighbours of the rows whose id is divisible by this.
EVERY = 50
PAGE = 64
FANOUT = 16
SUBTREE = 65_536
SUBTREES = 6
#: Queries that descend together, and queries that one copy of a subtree answers.
BATCH = 64
ASKED = 16_384
#: Single-precision distances are trusted to this relative error.
EPS = 1e-4


def halves(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves by the difference of distances to two far vectors."""
    y = x[rows]
    a = int(((y - y[0]) ** 2).sum(1).argmax())
    b = int(((y - y[a]) ** 2).sum(1).argmax())
    order = np.argsort(y @ (y[b] - y[a]), kind="stable")
    return rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, in single precision with an absolute error far below EPS times the vectors' size."""
    d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)
    return np.sqrt(d)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows a[i] and b[i], summed coordinate by coordinate in double precision."""
    d = a.astype(np.float64) - b.astype(np.float64)
    total = np.zeros(len(d))
    for k in range(d.shape[1]):
        total += d[:, k] * d[:, k]
    return np.sqrt(total)


class Subtree:
    """Vectors ordered by page. For each node: its children [lo, hi) (vectors in a leaf), router, covering radius and distance to the parent's router; for each vector its distance to its page's router. Node 0 is the root."""

    FIELDS = {"vectors": np.float32, "ids": np.int64, "lo": np.int64, "hi": np.int64, "leaf": np.bool_, "router": np.int64, "radius": np.float32, "to_parent": np.float32, "to_router": np.float32}

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> "Subtree":
        levels: list[list[list[np.ndarray]]] = []  # by level, the children's rows of each node

        # Rows of each node, level by level: every node is split into FANOUT parts until it fits a page.
        level = [np.arange(len(x))]
        while any(len(rows) > PAGE for rows in level):
            parts = []
            for rows in level:
                mine = [rows]
                while len(mine) < FANOUT and max(map(len, mine)) > PAGE:
                    mine = [h for part in mine for h in (halves(x, part) if len(part) > PAGE else (part,))]
                parts.append(mine)
            levels.append(parts)
            level = [rows for mine in parts for rows in mine]
        order = np.concatenate(level)
        self = cls()
        self.vectors, self.ids = np.ascontiguousarray(x[order], np.float32), ids[order]
        # Rows lie in the order of the leaves, so every node is a range of them.
        sizes = [np.array([len(rows) for mine in parts for rows in mine], np.int64) for parts in levels] or []
        sizes = [np.array([len(x)], np.int64), *sizes]
        nodes = {f: [] for f in ("lo", "hi", "leaf", "router", "radius", "to_parent")}
        self.to_router = np.zeros(len(x), np.float32)
        first, above = 0, None
        for depth, size in enumerate(sizes):
            begin = np.cumsum(size) - size
            child = first + len(size)  # number of the first node of the next level
            routers = np.zeros(len(size), np.int64)
            for i, (a, n) in enumerate(zip(begin, size)):
                y = self.vectors[a : a + n]
                r = int(((y - y.mean(0)) ** 2).sum(1).argmin())
                d = distances(y[r : r + 1], y)[0]
                routers[i] = a + r
                last = depth == len(sizes) - 1
                many = 0 if last else len(levels[depth][i])
                nodes["lo"].append(a if last else child)
                nodes["hi"].append(a + n if last else child + many)
                nodes["leaf"].append(last)
                nodes["router"].append(a + r)
                nodes["radius"].append(d.max())
                if last:
                    self.to_router[a : a + n] = d
                child += many
            if above is None:
                nodes["to_parent"] += [0.0]
            else:
                parent = np.repeat(np.arange(len(levels[depth - 1])), [len(mine) for mine in levels[depth - 1]])
                gaps = [distances(self.vectors[r][None], self.vectors[above[p]][None])[0, 0] for r, p in zip(routers, parent)]
                nodes["to_parent"] += gaps
            above, first = routers, first + len(size)
        for f, v in nodes.items():
            setattr(self, f, np.array(v, self.FIELDS[f]))
        return self

    def to_bytes(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f), k).tobytes() for f, k in self.FIELDS.items()]

    @classmethod
    def of(cls, raw: list[bytes]) -> "Subtree":
        self = cls()
        for (f, k), r in zip(cls.FIELDS.items(), raw):
            setattr(self, f, np.frombuffer(r, k))
        self.vectors = self.vectors.reshape(len(self.ids), -1)
        return self

    def search(self, queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, k: int):
        """(query row, id, distance) of up to k entries for each query, within its bound (inclusive), of other ids; ties by the lower id."""
        rows, ids, dist = [], [], []
        order = np.argsort(distances(queries, self.vectors[self.router[:1]])[:, 0], kind="stable") if len(queries) else np.zeros(0, np.int64)
        for a in range(0, len(queries), BATCH):
            at = order[a : a + BATCH]
            i, n, d = self._search(queries[at], query_ids[at], bound[at], k)
            rows.append(at[i])
            ids.append(n)
            dist.append(d)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(rows), np.concatenate(ids), np.concatenate(dist)

    def _search(self, queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, k: int):
        n = len(queries)
        best_d, best_id = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        limit = bound.astype(np.float64).copy()
        slack = EPS * float(1 + np.abs(queries).max() + np.abs(self.vectors).max()) * max(1, self.vectors.shape[1]) ** 0.5
        d = distances(queries, self.vectors[self.router[:1]])[:, 0]
        queue, pushed = [(float(d.min()) - float(self.radius[0]), 0, 0, np.arange(n), d)], 0
        while queue:
            least, _, node, q, d = heapq.heappop(queue)
            if least > limit.max() + slack:
                break
            open_ = d - self.radius[node] <= limit[q] + slack
            q, d = q[open_], d[open_]
            if not len(q):
                continue
            lo, hi, reach = self.lo[node], self.hi[node], limit[q] + slack
            if self.leaf[node]:
                near = np.abs(d[:, None] - self.to_router[None, lo:hi]) <= reach[:, None]
                e = np.flatnonzero(near.any(0))
                if not len(e):
                    continue
                x = distances(queries[q], self.vectors[lo + e])
                i, j = np.nonzero((x <= reach[:, None]) & near[:, e] & (query_ids[q][:, None] != self.ids[lo + e][None, :]))
                if len(i):
                    rows, entries = q[i], lo + e[j]
                    self._merge(best_d, best_id, limit, rows, self.ids[entries], exact(queries[rows], self.vectors[entries]), k)
                continue
            # The first bound costs no distance: those to the parent's router are stored.
            near = np.abs(d[:, None] - self.to_parent[None, lo:hi]) - self.radius[None, lo:hi] <= reach[:, None]
            c = np.flatnonzero(near.any(0))
            if not len(c):
                continue
            x = distances(queries[q], self.vectors[self.router[lo + c]])
            low = x - self.radius[None, lo + c]
            near = near[:, c] & (low <= reach[:, None])
            for j in np.flatnonzero(near.any(0)):
                pushed += 1
                mine = near[:, j]
                heapq.heappush(queue, (float(low[mine, j].min()), pushed, int(lo + c[j]), q[mine], x[mine, j]))
        i, j = np.nonzero(np.isfinite(best_d))
        return i, best_id[i, j], best_d[i, j]

    @staticmethod
    def _merge(best_d, best_id, limit, rows, ids, d, k) -> None:
        touched, at = np.unique(rows, return_inverse=True)
        allr = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
        alld = np.concatenate([best_d[touched].ravel(), d])
        alli = np.concatenate([best_id[touched].ravel(), ids])
        order = np.lexsort((alli, alld, allr))
        allr, alld, alli = allr[order], alld[order], alli[order]
        rank = np.arange(len(allr)) - np.searchsorted(allr, allr)
        keep = rank < k
        best_d[touched], best_id[touched] = alld[keep].reshape(-1, k), alli[keep].reshape(-1, k)
        limit[touched] = np.minimum(limit[touched], best_d[touched, k - 1])


TREE = "tree string, root int, far double, " + ", ".join(f"{f} binary" for f in Subtree.FIELDS)
ASK = "tree string, id long, v binary, bound double"


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _assign_batches(shared):
    """Each vector below its nearest router, found in an M-tree of the routers."""

    def run(batches):
        roots = shared.value
        tree = Subtree.build(np.arange(len(roots)), roots)
        for batch in batches:
            x = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(np.float32) if batch.num_rows else np.zeros((0, roots.shape[1]), np.float32)
            near = np.zeros(len(x), np.int32)
            row, root, _ = tree.search(x, np.full(len(x), -1), np.full(len(x), np.inf), 1)
            near[row] = root
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(near)], ["id", "v", "root"])

    return run


def _build(shared):
    def run(key, t):
        root = shared.value[key[0].as_py()]
        ids, x = t.column("id").to_numpy(), _matrix(t.column("v"), len(root))
        order = np.argsort(ids, kind="stable")
        s = Subtree.build(ids[order], x[order])
        cols = {"tree": [f"{key[0].as_py()}.{key[1].as_py()}"], "root": pa.array([key[0].as_py()], pa.int32()), "far": [float(distances(root[None], x).max())]}
        return pa.table(cols | {f: pa.array([b], pa.binary()) for f, b in zip(Subtree.FIELDS, s.to_bytes())})

    return run


def _answer(k: int):
    """The queries of a group answered by its subtree."""

    def run(key, asks, trees):
        if not asks.num_rows or not trees.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        s = Subtree.of([trees.column(f)[0].as_py() for f in Subtree.FIELDS])
        ids, x = asks.column("id").to_numpy(), _matrix(asks.column("v"), s.vectors.shape[1])
        q, n, d = s.search(x, ids, asks.column("bound").to_numpy(), k)
        return pa.table({"id": ids[q], "neighbour": n, "distance": d})

    return run


def _reach_batches(shared):
    """(tree, id, v, bound) for each subtree whose ball a query's bound reaches, but for the one it was answered in."""

    def run(batches):
        roots, trees, root, far = shared.value
        width = roots.shape[1]
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            bound, home = batch.column("bound").to_numpy(), np.array(batch.column("tree").to_pylist(), object)
            for a in range(0, len(x), 1024):
                y = x[a : a + 1024]
                slack = EPS * float(1 + np.abs(y).max() + np.abs(roots).max()) * width**0.5
                near = distances(y, roots)[:, root] - far[None, :] <= bound[a : a + 1024, None] + slack
                i, j = np.nonzero(near & (home[a : a + 1024, None] != trees[None, :]))
                i = pa.array(a + i)
                yield pa.RecordBatch.from_arrays([pa.array(trees[j], pa.string()), batch.column("id").take(i), batch.column("v").take(i), batch.column("bound").take(i)], ["tree", "id", "v", "bound"])

    return run


def _search(asks: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, distance) of asks (tree, id, v, bound); a subtree that many queries ask is copied for each ASKED of them."""
    per = asks.groupBy("tree").agg(F.count("*").alias("n"))
    copies = per.select("tree", F.ceil(F.col("n") / F.lit(ASKED)).cast("int").alias("parts"))
    spread = asks.join(copies, "tree").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    there = trees.join(copies, "tree").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = spread.select("tree", "part", "id", "v", "bound").groupBy("tree", "part")
    return left.cogroup(there.select("tree", "part", *Subtree.FIELDS).groupBy("tree", "part")).applyInArrow(_answer(k), "id long, neighbour long, distance double")


def neighbours(df: DataFrame, k: int = K, id_: str = "vec_id", vector: str = "embedding", every: int = 1) -> DataFrame:
    """(id, rank, neighbour, distance): the k nearest other ids of every id that `every` divides, by Euclidean distance; ties go to the lower id.

    All rows are searched. Rows without an id, and those whose vector is null, empty or has a null, NaN or infinite
    element, are left out. Of several rows of one id the least vector counts. Vectors are compared with those of the
    same length only. Where there are fewer than k others, all of them are returned; an empty table gives an empty
    result. Other columns are ignored.
    """
    spark = df.sparkSession
    v = col(vector).cast("array<float>")
    rows = df.select(col(id_).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0").where(F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)))
    unique = materialize(rows.groupBy("id").agg(F.min("v").alias("v")))
    sizes = [(r["m"], r["n"]) for r in unique.groupBy(F.size("v").alias("m")).agg(F.count("*").alias("n")).orderBy("m").collect()]
    out = spark.createDataFrame([], "id long, rank int, neighbour long, distance double")
    for m, n in sizes:
        out = out.unionByName(_of_one_length(unique.where(F.size("v") == m), n, k, every))
    return out


def _of_one_length(unique: DataFrame, n: int, k: int, every: int) -> DataFrame:
    spark = unique.sparkSession
    # One router for each SUBTREE vectors: a 65,536th of the table is what the workers hold of it.
    count = max(min(SUBTREES, n), -(-n // SUBTREE))
    first = unique.orderBy(F.xxhash64("id"), "id").limit(count).toArrow()
    roots = np.stack(first.column("v").to_numpy()).astype(np.float32)
    shared = spark.sparkContext.broadcast(roots)
    near = materialize(unique.mapInArrow(_assign_batches(shared), "id long, v binary, root int"))
    # A router that drew more than a subtree holds gets several subtrees.
    parts = near.groupBy("root").agg(F.ceil(F.count("*") / F.lit(SUBTREE)).cast("int").alias("parts"))
    placed = near.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    trees = materialize(placed.select("id", "v", "root", "part").groupBy("root", "part").applyInArrow(_build(shared), TREE))
    spots = trees.select("tree", "root", "far").toArrow()
    asked = placed.where(F.pmod("id", F.lit(every)) == 0).select(F.concat_ws(".", "root", "part").alias("tree"), "id", "v", F.lit(float("inf")).alias("bound"))
    home = materialize(_search(asked, trees, k))
    bounds = home.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("kth"))
    bounded = asked.join(bounds, "id", "left").select("tree", "id", "v", F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
    upper = spark.sparkContext.broadcast((roots, np.array(spots.column("tree").to_pylist(), object), spots.column("root").to_numpy(), spots.column("far").to_numpy()))
    abroad = _search(materialize(bounded.mapInArrow(_reach_batches(upper), ASK)), trees, k)
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return home.unionByName(abroad).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "distance")


def op4_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, rank, neighbour, distance): the ten nearest, among all embeddings, of each whose id is divisible by EVERY; distances to 5 places."""
    x = neighbours(table(spark, sf_dir, "embeddings"), every=EVERY)
    return x.select(F.col("id").alias("vec_id"), "rank", "neighbour", F.round("distance", 5).alias("distance"))


ORACLE = f"""
WITH e AS (SELECT vec_id, min(embedding)::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d)
SELECT vec_id, rank::INTEGER AS rank, neighbour, round(distance, 5) AS distance FROM r WHERE rank <= {K}
"""

QUERIES = {"op4_mtree_topk": op4_mtree_topk}
ORACLES = {"op4_mtree_topk": ORACLE}
