"""Removal of passages that repeat across documents, by difference-cover suffix sorting.

1. Every window of PASSAGE words has an anchor, the leftmost of its 25-word runs with the least hash. Equal windows
   have equal anchors at the same place, so suffixes that share a passage always meet in the bucket of its anchor:
   the suffix array is sorted bucket by bucket, with no comparison lost and no text sent that occurs once.
2. Occurrences of an anchor whose windows are all the same are settled by their fingerprint, all but the first going.
3. In each bucket the remaining stretches are sorted by the difference-cover algorithm: triples at positions 1 and 2
   modulo 3 are sorted and named, the names are sorted by recursion, the other suffixes are sorted from the ranks of
   their followers, and both are merged. The recursion ends once a name stands for at least PASSAGE words, as deeper
   order cannot matter. Neighbours in the suffix array are then compared over their first PASSAGE words.
4. Anchors whose stretches hold more than HOT_WORDS words are no bucket of one worker: their suffixes are sorted by
   dcsort, the same algorithm with every step of it distributed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dcsort
from .common import Tokenizer, chunks, col, materialize, mix64, partitions, row_bounds, table, text_buffers, unused

PASSAGE = 50
ANCHOR = 25
#: Words of differing stretches in a bucket, about; and of one anchor, beyond which its suffixes are sorted by the whole cluster.
BUCKET_WORDS, HOT_WORDS = 1 << 19, 1 << 19


class Runs:
    """Hashes of runs of words from one running sum: a polynomial modulo 2**64, divided by the power of its start."""

    def __init__(self, h: np.ndarray) -> None:
        base = np.uint64(0xC2B2AE3D27D4EB4F)
        up = np.full(len(h) + 1, base, np.uint64)
        down = np.full(len(h) + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sum = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * np.multiply.accumulate(up)[:-1], out=self.sum[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sum[b] - self.sum[a]) * self.down[a])


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value of each window, by doubling."""
    at, span = np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[left] <= x[right], left, right)
        span += step
    return at


def anchors_of(row: np.ndarray, h: np.ndarray, passage: int, anchor: int):
    """(row, hash, fingerprint, first start, last start) of each anchor; starts are counted over all words given."""
    n = len(h) - passage + 1
    if n < 1:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z, z
    runs, s = Runs(h), np.arange(len(h) - anchor + 1)
    g = runs.of(s, s + anchor)
    at = sliding_argmin(g, passage - anchor + 1)[:n]
    start = np.flatnonzero(row[:n] == row[passage - 1 :])
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z, z
    at = at[start]
    new = np.empty(len(start), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (row[start[1:]] != row[start[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, b, p = start[first], start[last], at[first]
    fingerprint = mix64(runs.of(a, b + passage) ^ (p - a).astype(np.uint64))
    return row[a], g[p], fingerprint, a, b


def _anchor_batches(passage: int, anchor: int):
    def run(batches):
        words = Tokenizer()
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for x, y in chunks(offsets):
                row, _, _, h = words.words(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                r, g, f, a, b = anchors_of(row, h, passage, anchor)
                base = row_bounds(row, y - x)[r]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(f.view(np.int64)), pa.array(ids[x + r]), pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], ["h", "f", "doc", "a", "b"])

    return run


def _stretch_batches(passage: int):
    def run(batches):
        words = Tokenizer()
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids, spots = batch.column("doc").to_pylist(), batch.column("spots").to_pylist()
            for x, y in chunks(offsets):
                row, _, _, h = words.words(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                bounds, h = row_bounds(row, y - x), (h >> np.uint64(32)).astype(np.uint32)
                out = {"h": [], "doc": [], "a": [], "words": []}
                for i in range(x, y):
                    mine = h[bounds[i - x] : bounds[i - x + 1]]
                    for s in spots[i]:
                        if s["b"] + passage <= len(mine):  # else a row of the same id has another text
                            out["h"].append(s["h"])
                            out["doc"].append(ids[i])
                            out["a"].append(s["a"])
                            out["words"].append(mine[s["a"] : s["b"] + passage].tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("a", pa.int32()), ("words", pa.binary())]))

    return run


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of s (positive integers, zeros as ends of strings) in the order of their suffixes, exact for at least `depth` symbols."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.concatenate([s, np.zeros(5, s.dtype)])
    sample = np.concatenate([np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)])
    _, names = np.unique(t[sample] * (int(t.max()) + 1) + t[sample + 1], return_inverse=True)
    _, names = np.unique(names * (int(t.max()) + 1) + t[sample + 2], return_inverse=True)
    if depth > 3 and names.max() + 1 < len(sample):
        order = suffix_order(names + 1, -(-depth // 3))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
    else:
        rank = names + 1
    r = np.zeros(n + 6, np.int64)
    r[sample] = rank
    m = int(r.max()) + 1
    sampled = sample[sample < n]
    sampled = sampled[np.argsort(r[sampled], kind="stable")]
    other = np.arange(0, n, 3)
    other = other[np.lexsort((r[other + 1], t[other]))]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    k1 = t[:n].astype(np.int64) * m + r[1 : n + 1]
    _, pair = np.unique(t[:n].astype(np.int64) * (int(t.max()) + 1) + t[1 : n + 1], return_inverse=True)
    k2 = pair * m + r[2 : n + 2]
    before = np.searchsorted(np.sort(k1[one]), k1[other]) + np.searchsorted(np.sort(k2[two]), k2[other])
    place = np.maximum.accumulate(before) + np.arange(len(other))
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place], out[~taken] = other, sampled
    return out


def repeated_windows(strings: list[np.ndarray], doc: np.ndarray, at: np.ndarray, passage: int):
    """(doc, start, first doc, first start) of each window of `passage` words that occurred before, in the order (doc, start)."""
    size = np.array([len(x) for x in strings], np.int64)
    begin = np.cumsum(size + 3) - (size + 3)
    flat = np.zeros(int((size + 3).sum()), np.int64)
    inside = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    _, symbol = np.unique(np.concatenate(strings), return_inverse=True)
    flat[inside] = symbol + 1
    windows = size - passage + 1
    is_start = np.zeros(len(flat), bool)
    starts = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    is_start[starts] = True
    order = suffix_order(flat, passage)
    order = order[is_start[order]]
    string = np.searchsorted(begin, order, side="right") - 1
    where_doc, where = doc[string], at[string] + order - begin[string]
    same = np.arange(len(order) - 1)
    for k in range(passage):
        same = same[flat[order[same] + k] == flat[order[same + 1] + k]]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    group = np.cumsum(new)
    sort = np.lexsort((where, where_doc, group))
    group, where_doc, where = group[sort], where_doc[sort], where[sort]
    head = np.searchsorted(group, group)
    later = (where_doc != where_doc[head]) | (where != where[head])
    return where_doc[later], where[later], where_doc[head][later], where[head][later]


def spans_of(doc: np.ndarray, start: np.ndarray, first_doc: np.ndarray, first: np.ndarray, passage: int):
    """Word ranges to cut, joined where starts follow each other; what belongs to the window's own first occurrence stays."""
    overlap = (doc == first_doc) & (start - first < passage)
    begin = np.where(overlap, first + passage, start)
    end = start + passage
    order = np.lexsort((end, begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if not len(doc):
        return doc, begin, end
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])
    head = np.flatnonzero(new)
    return doc[head], begin[head], np.maximum.reduceat(end, head)


def _sort_bucket(passage: int):
    def run(key, t):
        strings = [np.frombuffer(x, np.uint32) for x in t.column("words").to_pylist()]
        found = repeated_windows(strings, t.column("doc").to_numpy(), t.column("a").to_numpy().astype(np.int64), passage)
        doc, begin, end = spans_of(*found, passage)
        return pa.table({"doc": doc, "begin": begin.astype(np.int32), "end": end.astype(np.int32)})

    return run


def _symbol_batches(batches):
    for batch in batches:
        words = [np.frombuffer(x, np.uint32) for x in batch.column("words").to_pylist()]
        size = np.array([len(x) for x in words], np.int64)
        i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        c = np.concatenate(words).astype(np.int64) + 1 if len(words) else i
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("s").to_numpy(), size)), pa.array(i), pa.array(c)], ["s", "i", "c"])


def _later_spans(passage: int):
    def run(key, t):
        doc, begin, end = spans_of(*(t.column(c).to_numpy().astype(np.int64) for c in ("doc", "start", "fd", "fs")), passage)
        return pa.table({"doc": doc, "begin": begin.astype(np.int32), "end": end.astype(np.int32)})

    return run


def _sorted_by_all(stretches: DataFrame, passage: int) -> DataFrame:
    """(doc, begin, end) as _sort_bucket() has them, from (doc, a, words)."""
    strings = materialize(stretches.select(F.monotonically_increasing_id().alias("s"), "doc", "a", "words"))
    order = dcsort.ranks(strings.mapInArrow(_symbol_batches, "s long, i long, c long"), passage)
    windows = order.join(strings, "s").where(F.col("i") * 4 + 4 * passage <= F.length("words"))
    windows = windows.select("r", "doc", (F.col("a") + F.col("i")).cast("int").alias("start"), F.expr(f"substring(words, cast(i * 4 + 1 as int), {4 * passage})").alias("prefix"))
    later = dcsort.equal_prefixes(windows).where(F.struct("doc", "start") > F.col("first"))
    return later.select("doc", "start", F.col("first.doc").alias("fd"), F.col("first.start").alias("fs")).groupBy("doc").applyInArrow(_later_spans(passage), "doc long, begin int, end int")


def repeated_spans(docs: DataFrame, passage: int = PASSAGE, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, begin, end): the word ranges to cut, disjoint and as long as possible.

    Words are split at ASCII white space and compared exactly (by 32 bits of each word's hash, over whole windows). Of
    equal windows of `passage` words the first by (doc_id, position) stays and the others are cut; a window that overlaps its own first
    occurrence loses only what is not part of it. Documents that are null, empty or shorter than `passage` words
    have no ranges, nor have rows without a doc_id. Rows that repeat a doc_id count as one document, so a repeated row
    is no repetition. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchors = texts.mapInArrow(_anchor_batches(passage, anchor), "h long, f long, doc long, a int, b int").repartition(partitions(spark), "h")
    same = Window.partitionBy("h", "f").orderBy("doc", "a")
    ranked = anchors.select("*", F.first(F.struct("doc", "a")).over(same).alias("first"), F.row_number().over(same).alias("rn"))
    marked = ranked.withColumn("kinds", F.sum(F.when(F.col("rn") == 1, 1).otherwise(0)).over(Window.partitionBy("h")))
    marked = materialize(marked.where("rn > 1 or kinds > 1").select("h", "doc", "a", "b", "first", "rn", "kinds"))
    begin = F.when((F.col("first.doc") == F.col("doc")) & (F.col("a") - F.col("first.a") < passage), F.col("first.a") + passage).otherwise(F.col("a"))
    copies = marked.where(F.col("rn") > 1).where(F.struct("doc", "a") > F.col("first")).select("doc", begin.cast("int").alias("begin"), (F.col("b") + passage).cast("int").alias("end"))
    differing = marked.where((F.col("rn") == 1) & (F.col("kinds") > 1)).select("h", "doc", "a", "b")
    sizes = materialize(differing.groupBy("h").agg(F.sum(F.col("b") - F.col("a") + passage).alias("words")))
    hot = sizes.where(F.col("words") > HOT_WORDS).select("h")
    words, heavy = sizes.agg(F.sum(F.when(F.col("words") <= HOT_WORDS, F.col("words"))), F.count(F.when(F.col("words") > HOT_WORDS, 1))).first()

    def stretches(of: DataFrame) -> DataFrame:
        spots = of.groupBy("doc").agg(F.collect_list(F.struct("h", "a", "b")).alias("spots"))
        return texts.join(spots, texts["doc_id"] == spots["doc"]).select("doc", "text", "spots").mapInArrow(_stretch_batches(passage), "h long, doc long, a int, words binary")

    buckets = max(partitions(spark), -(-(words or 0) // BUCKET_WORDS))
    small = stretches(differing.join(hot, "h", "left_anti") if heavy else differing)
    parts = [copies, small.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("bucket").applyInArrow(_sort_bucket(passage), "doc long, begin int, end int")]
    if heavy:
        parts.append(_sorted_by_all(stretches(differing.join(hot, "h", "left_semi")).drop("h"), passage))
    lists = reduce(DataFrame.unionByName, parts).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("ranges"))
    empty = F.expr("cast(array() as array<struct<begin:int,end:int>>)")
    joined = F.aggregate(
        "ranges",
        empty,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["begin"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["begin"].alias("begin"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return lists.select(F.col("doc").alias("doc_id"), F.explode(joined).alias("r")).select("doc_id", "r.begin", "r.end")


def _cut_batches(columns: list[str], text: str):
    """Batches have the columns, `cuts` and `cut`; `cuts` is left out."""

    def run(batches):
        words = Tokenizer()
        for batch in batches:
            data, offsets = text_buffers(batch.column(text))
            cuts = batch.column("cuts").to_pylist()
            texts = batch.column(text).to_pylist()
            for i, ranges in enumerate(cuts):
                if not ranges or texts[i] is None:
                    continue
                raw = data[offsets[i] : offsets[i + 1]]
                _, start, _, _ = words.words(raw, np.array([0, len(raw)]))
                edge, keep, at = np.append(start, len(raw)), [], 0
                for r in sorted(ranges, key=lambda r: r["begin"]):
                    keep.append(raw[at : edge[min(r["begin"], len(start))]].tobytes())
                    at = edge[min(r["end"], len(start))]
                keep.append(raw[at:].tobytes())
                texts[i] = b"".join(keep).decode()
            arrays = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in (*columns, "cut")]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "cut"])

    return run


def cut_repeats(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """The documents with their repeated passages cut out of `text` (and n_chars, if there, counted anew).

    A document of which nothing is left goes; one that was empty or null before stays as it was.
    """
    (of,) = unused(docs.columns, "_doc")
    spans = repeated_spans(docs, passage).groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))
    code = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that need no quoting
    joined = docs.join(spans, docs["doc_id"].cast("long") == spans[of], "left").select(*[col(c).alias(n) for c, n in code.items()], spans["cuts"].alias("cuts"), spans["cuts"].isNotNull().alias("cut"))
    kinds = T.StructType([*[T.StructField(code[f.name], f.dataType) for f in docs.schema], T.StructField("cut", T.BooleanType())])
    text = code["text"]
    out = joined.mapInArrow(_cut_batches(list(code.values()), text), kinds).where(~F.col("cut") | (F.trim(F.translate(text, "\t\n\r\f", "    ")) != ""))
    n_chars = lambda c: F.length(text).cast(docs.schema["n_chars"].dataType) if c == "n_chars" else F.col(code[c])
    return out.select(*[n_chars(c).alias(c) for c in docs.columns])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH docs AS (SELECT DISTINCT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '^[ \\t\\n\\r\\f]+', ''), '[ \\t\\n\\r\\f]+$', ''), '[ \\t\\n\\r\\f]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT doc_id, i AS pos, array_to_string(w[i + 1 : i + {PASSAGE}], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(len(w) - {PASSAGE - 1})) AS i FROM docs WHERE len(w) >= {PASSAGE})),
firsts AS (SELECT doc_id, pos, first_value(doc_id) OVER g AS fd, first_value(pos) OVER g AS fp FROM win
  WINDOW g AS (PARTITION BY t ORDER BY doc_id, pos)),
cut AS (SELECT doc_id, CASE WHEN fd = doc_id AND pos - fp < {PASSAGE} THEN fp + {PASSAGE} ELSE pos END AS b, pos + {PASSAGE} AS e
  FROM firsts WHERE fd <> doc_id OR fp <> pos),
marked AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY doc_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM cut),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT doc_id, CAST(min(b) AS INTEGER) AS "begin", CAST(max(e) AS INTEGER) AS "end" FROM runs GROUP BY doc_id, run
"""

QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES = {"op10_suffix_dedup": ORACLE}
