"""SimHash near-duplicates by exact search in blocks of the signature.

Each document gets a 128-bit SimHash of its word pairs. Equal signatures are joined at once. A signature has 8 blocks of
16 bits, and limits() shares the radius out among them: signatures within 26 bits of each other differ by at most 13 in
their first half or by at most 12 in the second, and in that half by at most 3 (or 2) in one of its four blocks. So for
each block, every signature is compared with those whose block is one of the 697 (or 137) values that near, about 4 % of
all pairs together where values are spread evenly. No pair within the radius is left out: recall is 1 for the stated radius.
Signatures that found links hold together aren't compared again, so that a large group of near copies isn't compared pair by pair.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLD, Tokenizer, chunks, col, materialize, mix64, partitions, row_bounds, release, table, text_buffers, unused, written

RADIUS = 26
BLOCKS, BLOCK_BITS = 8, 16
#: Values of a block that are looked up at a time, and the signatures, more or less, that rows are compared with at a time.
VALUES, NEAR = 256, 1 << 15
#: A value with so many signatures near it, or so many comparisons, is compared by itself. A signature with more links than DENSE is the centre of a group.
WIDE, MANY, DENSE = 1 << 12, 1 << 16, 64
#: Signatures of a cell, twice as many at most; their number decides by how many leading bits a block's values are dealt out.
CELL_ROWS = 1 << 20
CELL_BITS = 6
#: Comparisons there are at least, for small tables to use all cores.
TASKS = 24


def signatures_of(data: np.ndarray, offsets: np.ndarray, words: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """(has, signature as two uint64) for each text. A text of one word has that word as its feature, an empty one none."""
    n = len(offsets) - 1
    row, _, _, h = words.words(data, offsets)
    bounds = row_bounds(row, n)
    count = np.diff(bounds)
    with np.errstate(over="ignore"):
        if len(h) > 1:
            same = row[:-1] == row[1:]
            feature, of = mix64(h[:-1] * GOLD + h[1:])[same], row[:-1][same]
            if (count == 1).any():
                feature, of = np.concatenate([feature, h[bounds[:-1][count == 1]]]), np.concatenate([of, np.flatnonzero(count == 1)])
                order = np.argsort(of, kind="stable")
                feature, of = feature[order], of[order]
        else:
            feature, of = h, row
        bits = np.stack([feature, mix64(feature ^ GOLD)], 1)
    out = np.zeros((n, 2), np.uint64)
    if not len(feature):
        return count > 0, out
    fb = row_bounds(of, n)
    size = np.diff(fb)
    live = np.flatnonzero(size)
    # One-byte counters hold 255 features, so each text is summed in blocks of as many.
    blocks = (size[live] + 254) // 255
    first = np.cumsum(blocks) - blocks
    at = np.repeat(fb[live], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    sums = np.empty((len(at), 128), np.uint8)
    for g in range(0, len(at), 512):
        to = at[g + 512] if g + 512 < len(at) else len(bits)
        lanes = np.unpackbits(bits[at[g] : to].view(np.uint8), axis=1).view(np.uint64)  # 16 words of 8 one-byte counters
        sums[g : g + 512] = np.add.reduceat(lanes, at[g : g + 512] - at[g], axis=0).view(np.uint8)
    ones = np.add.reduceat(sums.astype(np.int32), first, axis=0)
    out[live] = np.packbits(ones * 2 > size[live, None], axis=1).view(np.uint64)
    return count > 0, out


def _signature_batches(batches):
    words = Tokenizer()
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        has, sig = [np.zeros(0, bool)], [np.zeros((0, 2), np.uint64)]
        for a, b in chunks(offsets, 1 << 18):
            x, y = signatures_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
            has.append(x)
            sig.append(y)
        has, sig = np.concatenate(has), np.concatenate(sig).view(np.int64)
        ids = batch.column("doc_id").filter(pa.array(has))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sig[has, 0]), pa.array(sig[has, 1])], ["doc_id", "hi", "lo"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo) of each document that has an id and a word; letter case is ignored."""
    narrow = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return narrow.mapInArrow(_signature_batches, "doc_id long, hi long, lo long")


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's connected component."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        live = label[u] != label[v]
        u, v = u[live], v[live]
    return label


def limits(radius: int) -> list[tuple[int, int]]:
    """For each block, how many bits its half and it may differ by; a pair within the radius keeps both limits of some block. One below 0 is not needed."""

    def shared(n: int, parts: int) -> list[int]:
        return [(n + 1) // parts + (k < (n + 1) % parts) - 1 for k in range(parts)]

    return [(half, block) for half in shared(radius, 2) for block in shared(half, BLOCKS // 2)]


def block_values(sig: np.ndarray, block: int) -> np.ndarray:
    return (sig[:, block // 4] >> np.uint64(BLOCK_BITS * (block % 4)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


def _value_pairs(rows: range, at: np.ndarray, sides: tuple, label: tuple, most: int, radius: int, forest: bool):
    """Of one value's rows and those near it, NEAR at most: pairs within the radius, as close_pairs() has them, by their places in the order of values.

    label: of each signature on both sides, 0 or the centre to which pairs that were yielded tie it. A row with a label is not
    compared with those of the same one; a row with many links gives its label, or a new one, to those without.
    """
    xs, ys, xo, yo = sides
    la, lb = label
    same = la is lb
    near, left = ys[at], {}
    x, c = np.empty(NEAR, np.uint64), np.empty(NEAR, np.uint8)

    def hits(r: int, end: int, those: np.ndarray) -> np.ndarray:
        m = (end - r) * len(those)
        np.bitwise_xor(xs[r:end, None], those, out=x[:m].reshape(end - r, len(those)))
        return np.flatnonzero(np.bitwise_count(x[:m], out=c[:m]) <= most)

    def within(i, j) -> np.ndarray:
        return np.bitwise_count(xs[i] ^ ys[j]) + np.bitwise_count(xo[i] ^ yo[j]) <= radius

    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = NEAR // len(at)
    for first in range(rows.start, rows.stop, step):
        end = min(first + step, rows.stop)
        if not (forest and la[first:end].any()):
            k = hits(first, end, near)
            if not (forest and len(k) > DENSE * (end - first)):
                us.append(first + k // len(at))
                vs.append(at[k % len(at)])
                continue
        for r in range(first, end):
            mine = int(la[r])
            if mine and mine not in left:
                to = at[lb[at] != mine]
                left[mine] = to, ys[to]
            to, those = left[mine] if mine else (at, near)
            j = to[hits(r, r + 1, those)]
            if len(j) > DENSE:
                j = j[within(r, j) & (j != r if same else True)]
                if len(j) > DENSE:
                    known = lb[j]
                    if not mine:
                        la[r] = mine = int(known.max()) or r + 1
                    lb[j[known == 0]] = mine
                    # Of those that have a label, one of each is enough.
                    j = np.concatenate([j[known == 0], j[np.unique(known, return_index=True)[1]]])
                    yield np.full(len(j), r), j
                    continue
            us.append(np.full(len(j), r))
            vs.append(j)
    i, j = np.concatenate(us), np.concatenate(vs)
    close = within(i, j)
    if same:  # two of one value meet twice, and each meets itself
        close &= i < j if not forest else i != j
    yield i[close], j[close]


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, blocks=range(BLOCKS), part: int = 0, parts: int = 1, forest: bool = False):
    """Yields index pairs (i, j) with Hamming distance of a[i] and b[j] within the radius, those of i < j if a is b.

    Each pair comes once for each of `blocks` whose limits it keeps. Of several parts, one takes the values of a's block that leave it as a remainder.
    With `forest`, a pair that other pairs of its block hold together may be left out or come again.
    """
    for block in blocks:
        most, limit = limits(radius)[block]
        if limit < 0 or not len(a) or not len(b):
            continue
        va, vb = block_values(a, block), block_values(b, block)
        oa, ob = (np.argsort(v.astype(np.uint16), kind="stable") for v in (va, vb))
        va, vb = va[oa], vb[ob]
        half = block // 4
        xs, ys, xo, yo = a[oa, half], b[ob, half], a[oa, 1 - half], b[ob, 1 - half]
        turn = np.array([sum(1 << i for i in c) for n in range(min(limit, BLOCK_BITS) + 1) for c in combinations(range(BLOCK_BITS), n)], np.int64)
        # Bits that all of a's and all of b's values have in common are turned in one way only.
        fixed = int(va[0] ^ va[-1] | vb[0] ^ vb[-1]).bit_length()
        turn = turn[turn >> fixed == (va[0] ^ vb[0]) >> fixed]
        label = (np.zeros(len(a), np.int64),) * 2 if a is b else (np.zeros(len(a), np.int64), np.zeros(len(b), np.int64))
        bounds = np.searchsorted(vb, np.arange((1 << BLOCK_BITS) + 1))
        values, first, rows = np.unique(va, return_index=True, return_counts=True)
        mine = values % parts == part
        values, first, rows = values[mine], first[mine], rows[mine]
        for s in range(0, len(values), VALUES):
            v = values[s : s + VALUES, None]
            to = turn ^ v
            lo = bounds[to]
            n = bounds[to + 1] - lo
            if a is b:
                n[to < v] = 0
            width = n.sum(1)
            wide = (width >= WIDE) | (width * rows[s : s + VALUES] >= MANY)
            for g in np.flatnonzero(wide).tolist():
                at = np.repeat(lo[g] - np.cumsum(n[g]) + n[g], n[g]) + np.arange(width[g])
                of = range(first[s + g], first[s + g] + rows[s + g])
                for k in range(0, len(at), NEAR):
                    for i, j in _value_pairs(of, at[k : k + NEAR], (xs, ys, xo, yo), label, most, radius, forest):
                        i, j = oa[i], ob[j]
                        if len(i):
                            yield (np.minimum(i, j), np.maximum(i, j)) if a is b else (i, j)
            narrow = np.flatnonzero(~wide)
            for group in np.split(narrow, np.flatnonzero(np.diff(np.cumsum(width[narrow]) // NEAR)) + 1):
                # Values with many rows come first, so that those with an r-th row are always the first few.
                group = group[np.argsort(-rows[s + group], kind="stable")]
                w, starts, height = width[group], first[s + group], rows[s + group]
                ends, each = np.cumsum(w), n[group].ravel()
                if not len(ends) or not ends[-1]:
                    continue
                at = np.repeat(lo[group].ravel() - np.cumsum(each) + each, each) + np.arange(ends[-1])
                near = ys[at]
                for r, m in enumerate(np.searchsorted(-height, -np.arange(height[0])).tolist()):
                    d = np.bitwise_count(np.repeat(xs[starts[:m] + r], w[:m]) ^ near[: ends[m - 1]])
                    k = np.flatnonzero(d <= most)
                    if not len(k):
                        continue
                    i, j = starts[np.searchsorted(ends[:m], k, side="right")] + r, at[k]
                    close = d[k].astype(np.int64) + np.bitwise_count(xo[i] ^ yo[j]) <= radius
                    if a is b:  # two of one value meet twice, and each meets itself
                        close &= i < j
                    i, j = oa[i[close]], ob[j[close]]
                    if len(i):
                        yield (np.minimum(i, j), np.maximum(i, j)) if a is b else (i, j)


def _deal(bits: int, first: np.ndarray, splits: np.ndarray):
    """Signatures and ids by cell: a block, the leading bits of its value and, where these have too many rows, a split by hash."""

    def run(batches):
        held, size = [], 0

        def flush():
            sig = np.stack([np.concatenate([x[k] for x in held]) for k in (0, 1)], 1).view(np.uint64)
            ids = np.concatenate([x[2] for x in held])
            cells, sigs, reps = [], [], []
            for block in range(BLOCKS):
                g = block_values(sig, block) >> (BLOCK_BITS - bits)
                cell = first[block][g] + (mix64(sig[:, 0] ^ mix64(sig[:, 1])) % splits[block][g].astype(np.uint64)).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                used, start = np.unique(cell[order], return_index=True)
                for c, o in zip(used.tolist(), np.split(order, start[1:])):
                    cells.append(c)
                    sigs.append(sig[o].tobytes())
                    reps.append(ids[o].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(sigs, pa.binary()), pa.array(reps, pa.binary())], ["cell", "sig", "ids"])

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("hi", "lo", "rep")])
            size += batch.num_rows
            if size > 200_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _compare(radius: int, parts: int):
    def run(key, t):
        block, one, other, part = (k.as_py() for k in key)
        cell, sigs, reps = (t.column(c).to_pylist() for c in ("cell", "sig", "ids"))
        sides = [[k for k, c in enumerate(cell) if c == side] for side in ([one] if one == other else [one, other])]
        a, b = (np.frombuffer(b"".join(sigs[k] for k in side), np.uint64).reshape(-1, 2) for side in (sides[0], sides[-1]))
        ids = np.frombuffer(b"".join(reps[k] for side in sides for k in side), np.int64)
        del sigs, reps
        shift = len(a) if len(sides) > 1 else 0
        if not shift:
            b = a
        us, vs, held = [], [], 0

        def reduce() -> None:
            # Only a spanning forest is kept, however many pairs a large group of copies has.
            nonlocal us, vs, held
            u, v = np.concatenate(us or [np.zeros(0, np.int64)]), np.concatenate(vs or [np.zeros(0, np.int64)])
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = nodes[components(len(nodes), at[: len(u)], at[len(u) :])] if len(nodes) else nodes
            us, vs = [nodes[label != nodes]], [label[label != nodes]]
            held = len(us[0])

        for r, c in close_pairs(a, b, radius, [block], part, parts, forest=True):
            us.append(r)
            vs.append(c + shift)
            held += len(r)
            if held > 2_000_000:
                reduce()
        reduce()
        return pa.table({"u": ids[us[0]], "v": ids[vs[0]]})

    return run


def close_edges(unique: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): ids of signatures that hold together all groups of signatures within the radius; unique: (hi, lo, rep), distinct signatures."""
    spark = unique.sparkSession
    leading = [F.shiftrightunsigned("hi" if k < 4 else "lo", BLOCK_BITS * (k % 4) + BLOCK_BITS - CELL_BITS).bitwiseAND(F.lit((1 << CELL_BITS) - 1)) + F.lit(k << CELL_BITS) for k in range(BLOCKS)]
    counts = np.zeros(BLOCKS << CELL_BITS, np.int64)
    for r in unique.select(F.explode(F.array(*leading)).alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect():  # 512 rows at most
        counts[r["at"]] = r["n"]
    bits = min(CELL_BITS, max(0, int(-(-int(counts.sum()) // (BLOCKS * CELL_ROWS)) - 1).bit_length()))
    splits = np.maximum(1, -(-counts.reshape(BLOCKS, 1 << bits, -1).sum(2) // (2 * CELL_ROWS)))
    first = (np.cumsum(splits) - splits.ravel()).reshape(splits.shape)
    cells = [[(g, int(first[k, g]) + s) for g in range(1 << bits) for s in range(splits[k, g])] for k in range(BLOCKS)]
    meet = [(k, a, b) for k, (_, limit) in enumerate(limits(radius)) for i, (g, a) in enumerate(cells[k]) for h, b in cells[k][i:] if (g ^ h).bit_count() <= limit]
    parts = -(-TASKS // max(1, len(meet)))
    tasks = [(c, k, a, b, part) for k, a, b in meet for c in {a, b} for part in range(parts)]
    tasks = spark.createDataFrame(tasks, "cell int, block int, a int, b int, part int")
    dealt = unique.select("hi", "lo", "rep").mapInArrow(_deal(bits, first, splits), "cell int, sig binary, ids binary").join(F.broadcast(tasks), "cell")
    # Where tasks are few, there are more partitions, so that hardly any two share one.
    spread = dealt.repartition(max(partitions(spark), len(meet) * parts * (4 if len(meet) < 100 else 1)), "block", "a", "b", "part")
    return spread.groupBy("block", "a", "b", "part").applyInArrow(_compare(radius, parts), "u long, v long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large and small stars until nothing changes."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        mark = written()
        edges = materialize(small.where("u <> v").distinct())
        release(mark - 1, mark)  # the edges before
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, kept_id): every document that a lower doc_id of its group makes superfluous, with the one that stays.

    Groups are the connected components of pairs within `radius` bits of 128. Documents without an id, and those whose
    text is null, empty or only white space, are compared with nothing. Rows that repeat a doc_id count as one document.
    Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    # A doc_id that comes with several texts has several signatures, all of them compared.
    sig = materialize(signatures(docs).distinct())
    unique = sig.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    unique = materialize(unique)
    edges = close_edges(unique, radius)
    # The same doc_id under two signatures joins their groups.
    split = sig.join(sig.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "doc_id").join(unique, ["hi", "lo"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    member = connected(edges.unionByName(split))
    of = sig.join(unique, ["hi", "lo"]).join(member, F.col("rep") == F.col("node"), "left")
    kept = of.groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("kept_id"))
    return kept.where("doc_id <> kept_id")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without those that near_duplicates() names; rows without an id stay."""
    (gone,) = unused(docs.columns, "_gone")
    return docs.join(near_duplicates(docs, radius).select(F.col("doc_id").alias(gone)), col("doc_id") == col(gone), "left_anti")


QUERIES = {"op5_simhash_dedup": op5_simhash_dedup}
ORACLES: dict[str, str] = {}
