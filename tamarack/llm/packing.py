"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction.

Which documents share a sequence depends on their lengths alone, so the instance that is solved is the histogram of
lengths: at most `capacity` numbers on the driver, however many documents there are.

1. A document longer than the capacity fills whole sequences; its remainder is packed with the rest.
2. Reduction: for a length j, longest first, a set of at most three documents is fixed as a sequence where it dominates
   every other feasible set with j. That is so if nothing fits beside j; if the longest that fits fills it up
   exactly; if two more never fit; and, if two fit but not three, if one document is as long as any pair, or the best
   pair holds the longest document that fits and no pair avoids its partner. As all documents of a length are
   alike, a set is fixed as often as its lengths last. Each fix shrinks the instance, and the scan begins again until none is found.
3. The rest is packed best-fit, longest first, again whole lengths at a time.
4. Every decision is a range of ranks within a length that goes to a range of sequences; documents are ranked in Spark
   and joined with these ranges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, materialize, md5_bucket, row_digest, running_sum, table, word_count

CAPACITY = 2048
SEED = "pack"
#: Ranges are at most about capacity * log(capacity); beyond this many they are joined without broadcast.
BROADCAST_RANGES = 1_000_000


class Packer:
    """Packs counts[l] documents of each length l into sequences of `capacity`; runs hold (length, rank, end, first sequence, documents in each, offset)."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.capacity, self.counts = capacity, counts.astype(np.int64).copy()
        self.counts[0] = 0
        self.next_rank = np.zeros(len(counts), np.int64)
        self.bins, self.fixed, self.runs = 0, 0, []

    def take(self, length: int, first: int, bins: int, each: int, offset: int) -> None:
        """`each` documents of this length go into each of `bins` sequences from `first` on."""
        n, rank = bins * each, int(self.next_rank[length])
        self.counts[length] -= n
        self.next_rank[length] += n
        self.runs.append((length, rank, rank + n, first, each, offset))

    def fix(self, lengths: list[int], bins: int) -> None:
        offset = 0
        for x in lengths:
            self.take(x, self.bins, bins, 1, offset)
            offset += x
        self.bins += bins
        self.fixed += bins

    def _times(self, lengths: list[int]) -> int:
        return min(int(self.counts[x]) // lengths.count(x) for x in lengths)

    def largest(self, most: int, without: int = 0) -> int:
        """The greatest length up to `most` of which there is one beside the document of length `without`; 0 if none."""
        c = self.counts[: most + 1]
        for x in np.flatnonzero(c)[::-1]:
            if x != without or c[x] > 1:
                return int(x)
        return 0

    def smallest(self, n: int, without: int) -> list[int]:
        """The n least lengths beside one document of length `without`."""
        out = []
        for x in np.flatnonzero(self.counts):
            out += [int(x)] * int(min(n - len(out), self.counts[x] - (x == without)))
            if len(out) >= n:
                break
        return out

    def dominating(self, j: int) -> list[int] | None:
        """The lengths of a set that dominates all feasible sets with j, or None where none is proved to."""
        room = self.capacity - j
        least = self.smallest(3, j)
        k = sum(1 for n in range(1, len(least) + 1) if sum(least[:n]) <= room)
        if k == 0:
            return [j]
        top = self.largest(room, j)
        if k == 1 or top == room:
            return [j, top]
        if k > 2:
            return None
        left = self.counts.copy()
        left[j] -= 1
        a = b = best = 0
        for x in np.flatnonzero(left[: room + 1])[::-1]:
            x = int(x)
            if 2 * x <= best:
                break
            left[x] -= 1
            y = np.flatnonzero(left[: min(x, room - x) + 1])
            if len(y) and x + int(y[-1]) > best:
                a, b, best = x, int(y[-1]), x + int(y[-1])
            left[x] += 1
        if top >= best:
            return [j, top]
        if a == top:
            above = []
            for x in np.flatnonzero(left[b + 1 :])[:2] + b + 1:
                above += [int(x)] * int(min(2, left[x]))
            if len(above) < 2 or j + above[0] + above[1] > self.capacity:
                return [j, a, b]
        return None

    def reduce(self) -> None:
        found = True
        while found:
            found = False
            for j in np.flatnonzero(self.counts)[::-1]:
                while self.counts[j] and (group := self.dominating(int(j))):
                    # It dominates as long as one of each length is left: taking documents away only narrows the alternatives.
                    self.fix(group, self._times(group))
                    found = True

    def best_fit(self) -> None:
        room: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, how many)
        spaces = np.zeros(self.capacity + 1, bool)
        for x in np.flatnonzero(self.counts)[::-1]:
            x = int(x)
            while n := int(self.counts[x]):
                fits = np.flatnonzero(spaces[x:])
                if len(fits):
                    space = int(fits[0]) + x
                    first, bins = room[space].pop()
                    if not room[space]:
                        spaces[space] = False
                else:
                    space, first, bins = self.capacity, self.bins, -(-n // (self.capacity // x))
                    self.bins += bins
                each = space // x
                full = min(bins, n // each)
                parts = [(first, full, each)] if full else []
                if full < bins and n % each and n // each == full:
                    parts.append((first + full, 1, n % each))
                used = 0
                for f, b, e in parts:
                    self.take(x, f, b, e, self.capacity - space)
                    used += b
                    if rest := space - e * x:
                        room.setdefault(rest, []).append((f, b))
                        spaces[rest] = True
                if used < bins:
                    room.setdefault(space, []).append((first + used, bins - used))
                    spaces[space] = True

    def pack(self) -> "Packer":
        self.reduce()
        self.best_fit()
        return self


def packed(docs: DataFrame, capacity: int = CAPACITY, id_: str = "doc_id", text: str = "text", length=None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin, position): which tokens of a document lie where in which sequence.

    `length` is a column with the number of tokens, by default that of words. Documents of no token (null, empty or
    blank texts) have no row. Each of several equal rows is packed on its own; a null id is an id like any other. Which of the documents of one
    length goes where is settled by a hash, so that a result is always the same. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = word_count(col(text)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    rows = docs.select(col(id_).alias("doc_id"), n.alias("_n"), row_digest(SEED, col(id_), F.md5(col(text).cast("string"))).alias("_digest"))
    units = rows.groupBy("doc_id", "_n", "_digest").agg(F.count("*").alias("_copies"))
    units = materialize(units.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("doc_id", "_n", "_digest", "_copy", (F.col("_n") % capacity).cast("int").alias("_rest"), F.floor(F.col("_n") / F.lit(capacity)).cast("long").alias("_full")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in units.groupBy("_rest").count().collect():  # as many rows as the capacity, at most
        counts[r["_rest"]] = r["count"]
    solved = Packer(counts, capacity).pack()
    ranges = spark.createDataFrame([tuple(map(int, r)) for r in solved.runs] or [(0, 0, 0, 0, 1, 0)], "_rest int, _lo long, _hi long, _first long, _each long, _offset long")
    if len(solved.runs) <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    bucketed = units.withColumn("_bucket", md5_bucket(F.col("_digest"), 3))
    order = [F.col("_digest"), F.col("_copy")]
    ranked = running_sum(bucketed.where("_rest > 0").select("doc_id", "_rest", "_full", "_digest", "_copy", "_bucket"), ["_rest"], "_bucket", order, F.lit(1), "_rank")
    place = F.col("_rank") - F.col("_lo")
    rest = ranked.join(ranges, "_rest").where("_rank >= _lo and _rank < _hi").select(
        "doc_id", F.col("_full").alias("piece"), (F.col("_full") * capacity).alias("start"), F.col("_rest").alias("n_tokens"),
        (F.col("_first") + F.floor(place / F.col("_each"))).alias("bin"), (F.col("_offset") + (place % F.col("_each")) * F.col("_rest")).cast("int").alias("position"),
    )
    long = running_sum(bucketed.where("_full > 0").select("doc_id", "_full", "_digest", "_copy", "_bucket").withColumn("_all", F.lit(0)), ["_all"], "_bucket", order, F.col("_full"), "_seen")
    pieces = long.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
    whole = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).alias("n_tokens"), (F.lit(solved.bins).cast("long") + F.col("_seen") + F.col("piece")).alias("bin"), F.lit(0).alias("position"))
    return rest.unionByName(whole)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES: dict[str, str] = {}
