"""Suffix sorting of many strings by the difference-cover algorithm, every step of it spread over the cluster.

Of each string the positions 1 and 2 modulo 3 are the sample. Their triples are sorted by ranges and named by their
number in that order; the names, those of positions 1 modulo 3 and those of 2 modulo 3 of a string as two strings, are
sorted by recursion. The other suffixes are then told from the sample by (symbol, rank of the next) and (symbol, next
symbol, rank of the one after), and merged with it: a suffix' rank is the number of suffixes below it, which running
counts over the sorted keys give for each class of positions. Recursion ends when all names differ, or when a name
stands for `depth` symbols, as deeper order isn't asked for. Keys are counted before they are sorted, so that a triple
however frequent is one row of the sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions


def _prefix_batches(sums: list[str]):
    def run(batches):
        part, totals = TaskContext.get().partitionId(), [0] * len(sums)
        for batch in batches:
            before = []
            for j, s in enumerate(sums):
                c = np.cumsum(batch.column(s).to_numpy())
                before.append(pa.array(totals[j] + c - batch.column(s).to_numpy()))
                totals[j] += int(c[-1]) if len(c) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *before, pa.array(np.full(batch.num_rows, part, np.int64))], [*batch.schema.names, *[f"{s}_before" for s in sums], "part"])

    return run


def running(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Adds <s>_before, the sum of s over the rows with lesser keys. Keys are distinct and all columns longs; they are sorted by ranges."""
    spark = df.sparkSession
    columns = [*keys, *sums]
    kinds = ", ".join(f"{c} long" for c in [*columns, *[f"{s}_before" for s in sums], "part"])
    ranged = df.select(*columns).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.mapInArrow(_prefix_batches(sums), kinds))
    seen, offsets = [0] * len(sums), []
    for r in placed.groupBy("part").agg(*[F.sum(s).alias(s) for s in sums]).orderBy("part").collect():  # a row for each partition
        offsets.append((r["part"], *seen))
        seen = [a + r[s] for a, s in zip(seen, sums)]
    shift = spark.createDataFrame(offsets, ", ".join(f"{c} long" for c in ["part", *[f"_{s}" for s in sums]]))
    return placed.join(F.broadcast(shift), "part").select(*columns, *[(F.col(f"{s}_before") + F.col(f"_{s}")).alias(f"{s}_before") for s in sums])


def ranks(text: DataFrame, depth: int) -> DataFrame:
    """(s, i, r) from (s, i, c): the number of suffixes below that of string s at i, the same for suffixes that are equal, or are so for `depth` symbols at least.

    All are longs; symbols are positive, positions count from 0 without gaps. A string's end is below all symbols.
    """
    of = Window.partitionBy("s").orderBy("i")
    after = lambda c, n: F.coalesce(F.lead(c, n).over(of), F.lit(0))
    t = materialize(text.select("s", "i", "c", after("c", 1).alias("c1"), after("c", 2).alias("c2")))
    sample = t.where("i % 3 <> 0")
    triples = running(sample.groupBy("c", "c1", "c2").agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("one")), ["c", "c1", "c2"], ["one", "n"])
    named = materialize(sample.join(triples, ["c", "c1", "c2"]).select("s", "i", (F.col("one_before") + 1).alias("r")))
    if depth > 3 and triples.where("n > 1").limit(1).count():
        below = named.select((F.col("s") * 2 + (F.col("i") % 3 - 1)).alias("s"), F.floor(F.col("i") / 3).alias("i"), F.col("r").alias("c"))
        deeper = ranks(below, -(-depth // 3))
        named = deeper.select(F.shiftright("s", 1).alias("s"), (F.col("i") * 3 + 1 + F.col("s") % 2).alias("i"), (F.col("r") + 1).alias("r"))
    joined = t.join(named, ["s", "i"], "left").select("s", "i", "c", "c1", F.coalesce("r", F.lit(0)).alias("r"))
    e = materialize(joined.select("*", after("r", 1).alias("r1"), after("r", 2).alias("r2"), (F.col("i") % 3).alias("class")))
    in_class = lambda k: F.count(F.when(F.col("class") == k, 1))
    one = running(e.where("class <> 2").groupBy("c", "r1").agg(in_class(0).alias("n0"), in_class(1).alias("n1")), ["c", "r1"], ["n0", "n1"])
    two = running(e.where("class <> 1").groupBy("c", "c1", "r2").agg(in_class(0).alias("n0"), in_class(2).alias("n2")), ["c", "c1", "r2"], ["n0", "n2"])
    own = running(e.where("class <> 0").groupBy("r").agg(F.count("*").alias("n")), ["r"], ["n"])
    one, two = one.select("c", "r1", F.col("n0_before").alias("a0"), F.col("n1_before").alias("a1")), two.select("c", "c1", "r2", F.col("n0_before").alias("b0"), F.col("n2_before").alias("b2"))
    own = own.select("r", F.col("n_before").alias("below"))
    e0 = e.where("class = 0").join(one, ["c", "r1"]).join(two, ["c", "c1", "r2"]).select("s", "i", (F.col("a0") + F.col("a1") + F.col("b2")).alias("r"))
    e1 = e.where("class = 1").join(one, ["c", "r1"]).join(own, "r").select("s", "i", (F.col("below") + F.col("a0")).alias("r"))
    e2 = e.where("class = 2").join(two, ["c", "c1", "r2"]).join(own, "r").select("s", "i", (F.col("below") + F.col("b0")).alias("r"))
    return materialize(e0.unionByName(e1).unionByName(e2))


def _group_batches(batches):
    """Rows in the order of their suffixes: a group begins where a prefix differs from the one before."""
    part, group, last = TaskContext.get().partitionId(), -1, None
    for batch in batches:
        prefixes, groups = batch.column("prefix").to_pylist(), []
        for p in prefixes:
            if p != last:
                group, last = group + 1, p
            groups.append(part << 33 | group)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("start"), pa.array(groups, pa.int64()), batch.column("prefix")], ["doc", "start", "g", "prefix"])


def equal_prefixes(windows: DataFrame) -> DataFrame:
    """(doc, start, first) from (r, doc, start, prefix binary): the windows whose prefix occurs more than once, with the least (doc, start) of its group.

    Suffixes that share a prefix follow each other in the order of r, so each is compared with the one before alone.
    """
    spark = windows.sparkSession
    ranged = windows.repartitionByRange(partitions(spark), "r").sortWithinPartitions("r").select("doc", "start", "prefix")
    grouped = materialize(ranged.mapInArrow(_group_batches, "doc long, start int, g long, prefix binary"))
    # Groups that go on in the next partition: the first and the last of each are looked at.
    part = F.shiftright("g", 33)
    edges = grouped.groupBy(part.alias("part")).agg(F.min("g").alias("a"), F.min_by("prefix", "g").alias("pa"), F.max("g").alias("b"), F.max_by("prefix", "g").alias("pb")).orderBy("part").collect()  # a row for each partition
    moved, last, at = [], None, None
    for e in edges:
        if e["pa"] == last:
            moved.append((e["a"], at))
        at = at if e["a"] == e["b"] and e["pa"] == last else e["b"]
        last = e["pb"]
    to = spark.createDataFrame(moved, "g long, same long")
    one = grouped.join(F.broadcast(to), "g", "left").select("doc", "start", F.coalesce("same", "g").alias("g"))
    heads = one.groupBy("g").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return one.join(heads, "g").select("doc", "start", "first")
