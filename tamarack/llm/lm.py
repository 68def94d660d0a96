"""Stupid-backoff language-model scores over n-gram counts of the whole corpus, computed relationally.

The model is of order 3. Pairs and triples of words are counted in all other documents (a document's own occurrences
are taken off, else every text would predict itself); single words are counted in all documents. A word's score is

    count(u v w) / count(u v)       if u v w occurs elsewhere, else
    ALPHA * count(v w) / count(v)   if v w occurs elsewhere, else
    ALPHA^2 * count(w) / words of the corpus;

the first two words of a document start at the order that they have words for. The document's score is the sum of
natural logarithms.

1. Words are counted: hashes with partial counts go to partitions of the hash, where they are added. So are pairs of
   words, by PAIR_BUCKETS buckets of their hash.
2. The documents are exploded into n-grams, a row (u, v, w, x) for each word w, with the two words before it and the one
   after, partitioned by the hash of the pair (v, w). So one shuffle brings together all that the counts of v w, u v w
   and v w x need: they are counts over groups of that partitioning, joined to the rows that they are counted from, and
   the word after x finds its denominator, count(v w), in the same place. Rows travel as arrays. A partition's groups are
   sorted and counted in numpy, in the worker's memory. Pairs with a rare word, and those of a bucket with over HEAVY_PAIR
   words, which could be too many for that, are unpacked by a generator and counted by windows, which spill.
3. Counts of single words are joined by word. The HOT_WORDS most frequent words have numbers of 20 bits and their counts
   are broadcast, which is a fixed bound; all other words are 63 bits of their hash. Pairs with such a rare word are
   partitioned by it, where its occurrences are counted; of a pair of two rare words that occurs elsewhere, the first
   word goes through a join with the counts of rare words, which no frequent word is in.
4. The documents' parts are added.

What is broadcast is never more than HOT_WORDS words. Which pairs take which way is a matter of their own counts, and
both ways give the same scores; the more words a corpus has, the more of its pairs are counted by windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GOLD, Tokenizer, local, materialize, mix64, partitions, spans, table, text_buffers

ALPHA = 0.4
#: Words that have a number; the highest one stands for all others.
HOT_WORDS = (1 << 20) - 2
RARE = (1 << 20) - 1
#: Words of the corpus for each partition of n-grams, words exploded at a time, and n-grams counted at a time: what bounds a worker's memory.
PART_WORDS = 1_500_000
FLUSH_WORDS = 400_000
SLICE_WORDS = 250_000
#: Pairs are counted by buckets of their hash; those of a bucket with more words than HEAVY_PAIR are counted by windows.
PAIR_BUCKETS = 1 << 16
HEAVY_PAIR = 500_000
SIGN = -(1 << 63)
RESULT = "doc_id long, n_words long, log_score double, mean_log_score double"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))


def labels(spark: SparkSession, parts: int) -> np.ndarray:
    """A number for each partition that Spark's hash sends there, so that partitions are filled evenly; one that no small number falls to shares another's."""
    n = F.col("id").cast("int")
    found = spark.range(32 * parts).groupBy(F.pmod(F.hash(n), F.lit(parts)).alias("to")).agg(F.min(n).alias("n")).collect()  # a row for each partition
    out = np.arange(32 * parts, 33 * parts)
    for r in found:
        out[r["to"]] = r["n"]
    return out.astype(np.int32)


def _lists(p: np.ndarray, order: np.ndarray, label: np.ndarray, whole: dict, some: dict | None = None) -> pa.RecordBatch:
    """A row for each p in use, under its label, with the columns' values of that p as arrays; p[order] ascends.

    Columns in `some` come with the number of leading values of each p that they have at all: (values, has).
    """
    bounds = np.searchsorted(p[order], np.arange(len(label) + 1))
    used = np.flatnonzero(np.diff(bounds))
    ends, arrays = np.append(bounds[used], bounds[-1]), {"p": pa.array(label[used])}
    for name, c in whole.items():
        arrays[name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c[order]))
    for name, (c, has) in (some or {}).items():
        kept = has[order]
        counted = np.append(0, np.cumsum(kept))
        arrays[name] = pa.ListArray.from_arrays(pa.array(counted[ends], pa.int32()), pa.array(c[order][kept]))
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def _pair_buckets(row: np.ndarray, h: np.ndarray, before: np.uint64 | None) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word's pair with the word before it, and whether its text has one; `before` is the one before the first, if that one's text goes on."""
    pair = np.empty(len(h), bool)
    pair[:1], pair[1:] = before is not None, row[1:] == row[:-1]
    previous = np.append(np.uint64(before or 0), h[:-1])
    return (mix64(previous * GOLD + h) % np.uint64(PAIR_BUCKETS)).astype(np.int64), pair


def _count_batches(label: np.ndarray):
    """Counts of words, and those of pairs by bucket, whose p are negative."""

    def run(batches):
        words, kept, n, before = Tokenizer(), [], 0, None
        pairs = np.zeros(PAIR_BUCKETS, np.int64)

        def flush():
            h, at = np.unique(np.concatenate([x[0] for x in kept]), return_inverse=True)
            c = np.bincount(at, np.concatenate([x[1] for x in kept]), len(h)).astype(np.int64)
            p = ((h >> np.uint64(20)) % np.uint64(len(label))).astype(np.int64)
            return _lists(p, np.lexsort((c, p)), label, {"h": h.view(np.int64), "c": c})  # counts in order take next to no space

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b, lo, hi, ends in spans(data, offsets):
                row, _, _, h = words.words(data[lo:hi], local(offsets, a, b, lo, hi))
                if len(h):
                    bucket, pair = _pair_buckets(row, h, before)
                    pairs += np.bincount(bucket[pair], minlength=PAIR_BUCKETS)
                    before = h[-1]
                before = None if ends else before
                h, c = np.unique(h, return_counts=True)
                kept.append((h, c))
                n += len(h)
                if n > 1_000_000:
                    yield flush()
                    kept, n = [], 0
        if n:
            yield flush()
        met = np.flatnonzero(pairs)
        if len(met):
            yield _lists(met >> 8, np.arange(len(met)), -1 - np.arange(-(-PAIR_BUCKETS >> 8), dtype=np.int32), {"h": met, "c": pairs[met]})

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c, pairs): 64-bit hash of each word and its count over all documents; where `pairs` is true, each bucket of pairs and its words."""
    parts = partitions(docs.sparkSession)
    packed = _texts(docs).mapInArrow(_count_batches(labels(docs.sparkSession, parts)), "p int, h array<long>, c array<long>").repartition(parts, "p")
    rows = packed.select("p", "c", F.posexplode("h").alias("i", "h")).select("p", "h", F.get("c", F.col("i")).alias("n"))
    return rows.groupBy("h", "p").agg(F.sum("n").alias("c")).select("h", "c", (F.col("p") < 0).alias("pairs"))


def frequent(counts: DataFrame) -> DataFrame:
    """(id, h, c): the words above a count that at most HOT_WORDS words have, numbered by count from 1."""
    level = F.floor(F.log2("c") * 16).cast("int")
    held, least = 0, 1 << 30
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # 1,000 rows at most
        held += r["n"]
        if held > HOT_WORDS:
            break
        least = r["level"]
    return counts.where(level >= least).select(F.row_number().over(Window.orderBy(F.desc("c"), "h")).cast("long").alias("id"), "h", "c")


def _explode_batches(shared, label: np.ndarray, rare: bool, heavy: np.ndarray | None = None, wanted: bool = False):
    """The n-grams whose pair has no rare word, or those whose pair has one; of the former, where `heavy` tells them apart by their buckets, those that are heavy as `wanted`."""

    def run(batches):
        known, ids = shared.value  # sorted hashes and their numbers
        words, held, size, texts, skip, before = Tokenizer(), [], 0, 0, 0, None

        def number(h: np.ndarray) -> np.ndarray:
            unique, at = np.unique(h, return_inverse=True)
            i = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
            found = known[i] == unique if len(known) else np.zeros(len(unique), bool)
            other = (unique >> np.uint64(1)).view(np.int64) | np.int64(SIGN)
            return np.where(found, ids[i] if len(known) else 0, other)[at]

        def flush(ends: bool):
            """The rows of the words held. Where the last text goes on, its last three words stay for the next time, when only the last is still to come."""
            nonlocal held, size, skip
            doc, w, text, often = (np.concatenate([x[k] for x in held]) for k in range(4))
            done, todo = skip, len(w) if ends else len(w) - 1
            held, size = ([], 0) if ends else ([(doc[-3:], w[-3:], text[-3:], often[-3:])], 0)
            skip = 0 if ends else min(3, len(w)) - 1
            same, n = text[1:] == text[:-1], len(w)
            v, u, x = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            v[1:] = np.where(same, w[:-1], 0)
            u[2:] = np.where(same[1:] & same[:-1], w[:-2], 0)
            x[:-1] = np.where(same, w[1:], 0)
            mine = done + np.flatnonzero(((((v < 0) | (w < 0)) == rare) & (often == wanted))[done:todo])
            if not len(mine):
                return
            doc, u, v, w, x = doc[mine], u[mine], v[mine], w[mine], x[mine]
            cu, cv, cw, cx = (np.where(y < 0, RARE, y).view(np.uint64) for y in (u, v, w, x))
            small = (cu | cv | cw | cx) < 1 << 16
            a = np.where(small, cv << np.uint64(48) | cw << np.uint64(32) | cu << np.uint64(16) | cx, cv << np.uint64(44) | cw << np.uint64(24) | cu << np.uint64(4) | cx >> np.uint64(16)).view(np.int64)
            tail = (cx & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)
            # First words of documents have no pair; they are spread by document, as many may begin alike.
            r = np.where(w < 0, w, v)
            key = r.view(np.uint64) if rare else np.where(v == 0, doc, v).view(np.uint64) * GOLD + w.view(np.uint64)
            p = (mix64(key * GOLD) % np.uint64(len(label))).astype(np.int64)
            second = np.where(w < 0, np.minimum(v, 0), 0)
            full = (u < 0) | (x < 0) | (second < 0)
            sparse = {"b": (tail, ~small), "ru": (u, full), "rx": (x, full)} | ({"rv": (second, full)} if rare else {})
            yield _lists(p, np.lexsort((small, ~full, p)), label, {"doc": doc, "a": a} | ({"r": r} if rare else {}), sparse)

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, lo, hi, ends in spans(data, offsets):
                row, _, _, h = words.words(data[lo:hi], local(offsets, a, b, lo, hi))
                if len(h):
                    often = np.zeros(len(h), bool)
                    if heavy is not None and not rare:
                        bucket, pair = _pair_buckets(row, h, before)
                        often = heavy[bucket] & pair
                        before = h[-1]
                    held.append((doc_ids[a + row], number(h), texts + row, often))
                    size += len(h)
                before = None if ends else before
                texts += ends * (b - a)
                if size > FLUSH_WORDS:
                    yield from flush(ends)
        if held:
            yield from flush(True)

    return run


def _packed(docs: DataFrame, shared, parts: int, rare: bool, heavy: np.ndarray | None = None, wanted: bool = False) -> DataFrame:
    """The n-grams of _explode_batches() as arrays, partitioned by p.

    Values of 16 bits each fill one number, a; others have 20 bits, of which the last 16 are in b, and come first in a
    row's arrays, those with further rare words before all.
    """
    kinds = {"doc": "bigint", "a": "bigint", "b": "smallint", "ru": "bigint", "rx": "bigint"} | ({"r": "bigint", "rv": "bigint"} if rare else {})
    kinds = {"p": "int"} | {c: f"array<{kinds[c]}>" for c in ["doc", "a", *(["r"] if rare else []), "b", "ru", "rx", *(["rv"] if rare else [])]}
    explode = _explode_batches(shared, labels(docs.sparkSession, parts), rare, heavy, wanted)
    return _texts(docs).mapInArrow(explode, ", ".join(f"{c} {k}" for c, k in kinds.items())).repartition(parts, "p")


def _exploded(packed: DataFrame, rare: bool) -> DataFrame:
    """A row for each n-gram: (p, doc, vw, u, x), vw being the pair, or (p, doc, r, v, w, u, x) where r is its rare word, the second one if both are.

    Words are numbers, those of rare ones negative, 0 for none.
    """
    rows = packed.select(*[c for c in packed.columns if c != "a"], F.posexplode("a").alias("i", "a"))
    at = lambda c: F.get(c, F.col("i"))
    bits = lambda shift, mask: F.shiftrightunsigned("a", shift).bitwiseAND(F.lit(mask))
    small = F.col("i") >= F.size("b")
    code = lambda short, long: F.when(small, bits(short, 0xFFFF)).otherwise(bits(long, RARE))
    v, w, u = code(48, 44), code(32, 24), code(16, 4)
    x = F.when(small, bits(0, 0xFFFF)).otherwise(F.shiftleft(bits(0, 15), 16).bitwiseOR(at("b").cast("int").bitwiseAND(F.lit(0xFFFF)).cast("long")))
    word = lambda c, full: F.when(c == RARE, full).otherwise(c)
    if rare:
        second = F.coalesce(at("rv"), F.lit(0))
        pair = [at("r").alias("r"), word(v, F.when(second < 0, second).otherwise(at("r"))).alias("v"), word(w, at("r")).alias("w")]
    else:
        pair = [F.shiftleft(v, 20).bitwiseOR(w).alias("vw")]
    return rows.select("p", at("doc").alias("doc"), *pair, word(u, at("ru")).alias("u"), word(x, at("rx")).alias("x"))


def _scored(rows: DataFrame, rare: bool, total: int, alpha: float) -> DataFrame:
    """(doc, s, need, times) of each row: its part of the score, but for `times` the logarithm of the count of the word `need`."""
    pair = ["v", "w"] if rare else ["vw"]

    def elsewhere(df: DataFrame, name: str, *more: str) -> DataFrame:
        # One window, all of whose frames spill: rows of the group, and those up to the row's document without those before it.
        group = Window.partitionBy(*pair, "p", *more).orderBy("doc")
        count = lambda until: F.count("*").over(group.rangeBetween(Window.unboundedPreceding, until))
        return df.withColumn(name, count(Window.unboundedFollowing) - count(Window.currentRow) + F.rank().over(group) - 1)

    # Whether a triple occurs elsewhere is told by the least and the greatest document of its places.
    places = Window.partitionBy(*pair, "p", "x")
    rows = rows.withColumn("next", (F.col("x") != 0) & (F.min("doc").over(places) < F.max("doc").over(places))).drop("x")
    rows = elsewhere(elsewhere(rows, "c2"), "c3", "u")
    v, w = (F.col("v"), F.col("w")) if rare else (F.shiftrightunsigned("vw", 20), F.col("vw").bitwiseAND(F.lit(RARE)))
    has_u, has_v = F.col("u") != 0, v != 0
    log_a = float(np.log(alpha))
    third, second = has_u & (F.col("c3") > 0), has_v & (F.col("c2") > 0)
    unseen = F.when(has_u, 2 * log_a).when(has_v, log_a).otherwise(0.0) - float(np.log(total))
    s = F.when(third, F.log("c3")).when(second, F.log("c2") + F.when(has_u, log_a).otherwise(0.0)).otherwise(unseen)
    # The denominator of the word after this pair, if that triple occurs elsewhere.
    s = s - F.when(has_v & F.col("next"), F.log("c2")).otherwise(0.0)
    need, times = F.when(~third & second, v).otherwise(w), F.when(third, 0).when(second, -1).otherwise(1)
    if rare:
        # All rows of the rare word r are here, and each of its occurrences is w in one of them.
        rows = rows.withColumn("c1", F.count(F.when(F.col("w") == F.col("r"), 1)).over(Window.partitionBy("r", "p")))
        s = s + F.when(need == F.col("r"), times * F.log("c1")).otherwise(0.0)
        times = F.when(need == F.col("r"), 0).otherwise(times)
    return rows.select("doc", s.alias("s"), need.alias("need"), times.alias("times"))


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(doc, vw, u, x) of the n-grams in the arrays, as _exploded() has them."""

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(name)
        return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())

    (doc, n), (a, _), (b, long), (ru, full), (rx, _) = (flat(c) for c in ("doc", "a", "b", "ru", "rx"))
    a = a.view(np.uint64)
    at = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    is_long, is_full = at < np.repeat(long, n), at < np.repeat(full, n)
    tail = np.zeros(len(a), np.uint64)
    tail[is_long] = b.view(np.uint16)

    def code(short: int, more: int) -> np.ndarray:
        return np.where(is_long, a >> np.uint64(more) & np.uint64(RARE), a >> np.uint64(short) & np.uint64(0xFFFF)).view(np.int64)

    vw, u = code(48, 44) << 20 | code(32, 24), code(16, 4)
    x = np.where(is_long, (a & np.uint64(15)) << np.uint64(16) | tail, a & np.uint64(0xFFFF)).view(np.int64)
    u[is_full], x[is_full] = ru, rx
    return doc, vw, u, x


def _order(*keys: np.ndarray) -> np.ndarray:
    """The order by non-negative keys, as one packed number where 64 bits hold them."""
    bits = [int(k.max()).bit_length() for k in keys]
    if sum(bits) > 64:
        return np.lexsort(keys[::-1])
    packed = np.zeros(len(keys[0]), np.uint64)
    for k, n in zip(keys, bits):
        packed = packed << np.uint64(n) | k.view(np.uint64)
    return np.argsort(packed)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, and the end."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _elsewhere(group: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each row its group's rows without those of its own run, from the starts of both."""
    n = np.diff(group)
    own_n = np.diff(own)
    return np.repeat(n, n) - np.repeat(own_n, own_n)


def _small(y: np.ndarray) -> np.ndarray:
    """Numbers for words, with those of rare words after all others."""
    rare = y < 0
    if rare.any():
        y = y.copy()
        y[rare] = RARE + 1 + np.unique(y[rare], return_inverse=True)[1]
    return y


def _parts(vw: np.ndarray, d: np.ndarray, u: np.ndarray, x: np.ndarray, logs: np.ndarray, log_total: float, log_a: float) -> np.ndarray:
    """The parts of scores that _scored() tells, with logarithms of words' counts by their numbers, of all n-grams of some pairs, in the order of (vw, d)."""
    v, w = vw >> 20, vw & RARE
    pairs = _starts(vw)
    c2 = _elsewhere(pairs, _starts(vw, d))
    c2[v == 0] = 0
    g = np.repeat(np.arange(len(pairs) - 1), np.diff(pairs))
    c3, following = np.zeros(len(vw), np.int64), np.zeros(len(vw), bool)
    # A triple can only occur elsewhere where its pair does.
    at = np.flatnonzero((c2 > 0) & (u != 0))
    if len(at):
        gu, uu, du = g[at], _small(u[at]), d[at]
        by = _order(gu, uu, du)
        gu, uu, du = gu[by], uu[by], du[by]
        c3[at[by]] = _elsewhere(_starts(gu, uu), _starts(gu, uu, du))
    at = np.flatnonzero((c2 > 0) & (x != 0))
    if len(at):
        gx, xx, dx = g[at], _small(x[at]), d[at]
        by = _order(gx, xx, dx)
        gx, xx, dx = gx[by], xx[by], dx[by]
        places = _starts(gx, xx)
        following[at[by]] = np.repeat(dx[places[:-1]] < dx[places[1:] - 1], np.diff(places))
    third, second, has_u = c3 > 0, c2 > 0, u != 0
    log2 = np.log(np.maximum(c2, 1))
    unseen = np.where(has_u, 2 * log_a, np.where(v != 0, log_a, 0.0)) - log_total + logs[w]
    s = np.where(third, np.log(np.maximum(c3, 1)), np.where(second, log2 + np.where(has_u, log_a, 0.0) - logs[v], unseen))
    return s - np.where(following, log2, 0.0)


def _sums(doc: np.ndarray, vw: np.ndarray, u: np.ndarray, x: np.ndarray, logs: np.ndarray, log_total: float, log_a: float) -> tuple[np.ndarray, ...]:
    """(doc, s, n): parts of scores and words, added by document. Pairs are sorted at once and counted some at a time, about SLICE_WORDS."""
    runs = _starts(doc)
    docs, d = np.unique(doc[runs[:-1]], return_inverse=True)
    d = np.repeat(d, np.diff(runs))
    order = _order(vw, d)
    pairs = _starts(vw[order])
    cuts = np.unique(np.append(pairs[np.searchsorted(pairs, np.arange(0, len(vw), SLICE_WORDS))], len(vw)))
    del pairs
    s = np.zeros(len(docs))
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = order[a:b]
        s += np.bincount(d[at], _parts(vw[at], d[at], u[at], x[at], logs, log_total, log_a), len(docs))
    return docs, s, np.bincount(d, minlength=len(docs))


def _sum_batches(counts: np.ndarray, words: np.ndarray, total: int, alpha: float):
    """The n-grams of a partition, added by document. Words have numbers by descending count: `counts`, and how many words have each."""

    def run(batches):
        logs = np.append(0.0, np.repeat(np.log(counts), words))

        def added(*columns: np.ndarray) -> pa.RecordBatch:
            sums = _sums(*columns, logs, float(np.log(total)), float(np.log(alpha)))
            return pa.RecordBatch.from_arrays([pa.array(y) for y in sums], ["doc", "s", "n"])

        held = []
        for batch in batches:
            columns = _unpacked(batch)
            first = columns[1] <= RARE  # these have no pair to be counted, and there is no bound on those of a doc_id that many rows have
            if first.any():
                yield added(*(y[first] for y in columns))
            held.append([y[~first] for y in columns])
        if any(len(x[0]) for x in held):
            columns = [np.concatenate(y) for y in zip(*held)]
            del held
            yield added(*columns)

    return run


def stupid_backoff(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of each document that has a word.

    Words are lower-cased and split at ASCII white space. Documents without an id and those that are null, empty or only white space have no
    row. Rows that repeat a doc_id count as one document that has the words of all of them; unlike a word of another
    document they don't predict each other. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    counted = materialize(word_counts(docs))
    counts = counted.where(~F.col("pairs")).drop("pairs")
    size, total = counts.agg(F.count("*"), F.sum("c")).first()
    if not total:
        return spark.createDataFrame([], RESULT)
    hot = materialize(frequent(counts))
    t = hot.toArrow()
    h = t.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((h[order], t.column("id").to_numpy()[order]))
    levels, words = (y[::-1] for y in np.unique(t.column("c").to_numpy(), return_counts=True))
    parts = max(partitions(spark), -(-int(total) // PART_WORDS))
    logs = F.broadcast(hot.select(F.col("id").alias("need"), F.log("c").alias("log_c")))
    heavy = np.zeros(PAIR_BUCKETS, bool)
    heavy[[r["h"] for r in counted.where(F.col("pairs") & (F.col("c") > HEAVY_PAIR)).select("h").collect()]] = True
    heavy = heavy if heavy.any() else None

    def numbered(rare: bool) -> DataFrame:
        rows = _scored(_exploded(_packed(docs, shared, parts, rare, None if rare else heavy, not rare), rare), rare, int(total), alpha)
        return rows.join(logs, "need", "left").withColumn("s", F.col("s") + F.col("times") * F.coalesce("log_c", F.lit(0.0)))

    out = _packed(docs, shared, parts, False, heavy).mapInArrow(_sum_batches(levels, words, int(total), alpha), "doc long, s double, n long")
    if heavy is not None:
        out = out.unionByName(numbered(False).select("doc", "s", F.lit(1).cast("long").alias("n")))
    if len(h) < size:
        # What needs no rare word's count meets none in the join, and is spread by document.
        key = F.when((F.col("need") < 0) & (F.col("times") != 0), F.col("need")).otherwise(F.shiftrightunsigned(F.xxhash64("doc"), 1))
        needed = numbered(True).withColumn("need", key).groupBy("doc", "need").agg(F.sum("s").alias("s"), F.sum("times").alias("times"), F.count("*").alias("n"))
        rest = counts.where(F.col("c") < min(t.column("c").to_pylist(), default=total + 1)).select(F.shiftrightunsigned("h", 1).bitwiseOR(F.lit(SIGN)).alias("need"), F.log("c").alias("log_c"))
        out = out.unionByName(needed.join(rest, "need", "left").select("doc", (F.col("s") + F.col("times") * F.coalesce("log_c", F.lit(0.0))).alias("s"), "n"))
    out = out.groupBy(F.col("doc").alias("doc_id")).agg(F.sum("n").alias("n_words"), F.sum("s").alias("log_score"))
    return out.withColumn("mean_log_score", F.col("log_score") / F.col("n_words"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to 4 places: they are sums of floating-point numbers in no fixed order."""
    x = stupid_backoff(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


ORACLE = f"""
WITH tok AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT doc_id,
    list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
rows AS (SELECT doc_id, pos, w, lag(w, 1) OVER g AS v, lag(w, 2) OVER g AS u FROM tok WINDOW g AS (PARTITION BY doc_id ORDER BY pos)),
x AS (SELECT doc_id, u, v, w,
    count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY u, v, w, doc_id) AS c3,
    count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY v, w, doc_id) AS c2,
    count(*) OVER (PARTITION BY w) AS c1, count(*) OVER () AS n FROM rows),
pairs AS (SELECT v, w, doc_id, any_value(c2) AS cuv FROM x WHERE v IS NOT NULL GROUP BY ALL),
ones AS (SELECT w, any_value(c1) AS cv FROM x GROUP BY w),
scored AS (SELECT x.doc_id, CASE WHEN x.u IS NOT NULL AND c3 > 0 THEN ln(c3 / cuv)
    WHEN x.v IS NOT NULL AND c2 > 0 THEN ln(c2 / cv) + CASE WHEN x.u IS NULL THEN 0 ELSE ln({ALPHA}) END
    ELSE ln(c1 / n) + CASE WHEN x.u IS NOT NULL THEN 2 * ln({ALPHA}) WHEN x.v IS NOT NULL THEN ln({ALPHA}) ELSE 0 END END AS s
  FROM x LEFT JOIN pairs p ON p.v = x.u AND p.w = x.v AND p.doc_id = x.doc_id LEFT JOIN ones ON ones.w = x.v)
SELECT doc_id, count(*) AS n_words, round(sum(s), 4) AS log_score, round(sum(s) / count(*), 4) AS mean_log_score FROM scored GROUP BY doc_id
"""

QUERIES = {"op7_lm_score": op7_lm_score}
ORACLES = {"op7_lm_score": ORACLE}
