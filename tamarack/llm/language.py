"""Language identification by nearest centroid.

A document is a vector of its byte trigrams (hashed to DIMENSIONS), each with weight (1 + ln count) * idf, normalised.
The idf counts all documents. Every language has several centroids, clustered by spherical k-means over a bounded
sample of labelled documents. The language is that of the centroid with the greatest cosine; a document further from
all centroids than documents of its size ever are is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, col, table, text_buffers

DIMENSIONS = 1 << 15
CENTROIDS = 3
#: A cluster has at least this share of an even part of its language's sample, and so many documents.
SHARE, LEAST = 0.2, 8
#: Labelled documents of different texts, for each language, that the centroids are fitted to, at most.
SAMPLE = 600
#: A document is rejected below this share of the least similarity (1 in 200 left out) among sampled documents of its size.
SLACK = 0.5
BANDS = 20
#: Bytes of a text that are looked at together.
PIECE = 1 << 20
#: Bytes as they count: letters, and all bytes of other scripts, as they are; digits, signs and white space as a space.
SIGNS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, count) of each distinct trigram of each text, in the order of rows; those with two spaces don't count."""
    keys, counts = [], []
    for a in range(0, len(data) - 2, PIECE):  # a long text is counted piece by piece
        d = SIGNS[data[a : a + PIECE + 2]].astype(np.uint32)
        code = ((d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 15)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, a, a + len(d))))
        gap = d == 32
        same = (row[:-2] == row[2:]) & ~(gap[1:-1] & (gap[:-2] | gap[2:]))
        key = np.sort((row[:-2][same] << 15) | code[same])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        keys.append(key[first])
        counts.append(np.diff(np.append(first, len(key))) if len(key) else first)
    if not keys:
        z = np.zeros(0, np.int64)
        return z, z, z
    key, count = keys[0], counts[0]
    if len(keys) > 1:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
    return key >> 15, key & (DIMENSIONS - 1), count


def _lowered(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(pc.utf8_lower(batch.column(name)))


def _frequency_batches(batches):
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        data, offsets = _lowered(batch, "text")
        for a, b in chunks(offsets, 1 << 18):
            row, dim, _ = trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            df += np.bincount(dim, minlength=DIMENSIONS)
            n += len(np.unique(row))
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], ["dim", "df"])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each trigram, and documents with any, over the whole table."""
    t = docs.select("text").mapInArrow(_frequency_batches, "dim long, df long").groupBy("dim").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(DIMENSIONS + 1, np.int64)
    df[t.column("dim").to_numpy()] = t.column("df").to_numpy()
    return df[:-1], int(df[-1])


def _sample_batches(batches):
    for batch in batches:
        data, offsets = _lowered(batch, "text")
        out = {"lang": [], "dims": [], "counts": []}
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            _, dim, count = trigrams(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            if len(dim):
                out["lang"].append(lang)
                out["dims"].append(dim.astype(np.uint16).tobytes())
                out["counts"].append(count.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("dims", pa.binary()), ("counts", pa.binary())]))


class Model:
    """idf, the centroids' columns scaled by it, their languages, and the least similarity for each band of sizes."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], floors: np.ndarray) -> None:
        self.idf, self.centroids, self.languages, self.floors = idf, centroids, languages, floors

    def similarities(self, row: np.ndarray, dim: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosines with each centroid, number of trigrams) of n texts."""
        out, size = np.zeros((n, len(self.languages)), np.float32), np.bincount(row, count, n)
        if len(row) and len(self.languages):
            value = ((1 + np.log(count)) * self.idf[dim]).astype(np.float32)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            norm = np.sqrt(np.add.reduceat(value * value, first))
            out[row[first]] = np.add.reduceat(self.centroids[dim] * value[:, None], first, axis=0) / np.maximum(norm, 1e-12)[:, None]
        return out, size

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language's centroid, similarity, accepted)."""
        n, best, sim, ok = len(offsets) - 1, [], [], []
        for a, b in chunks(offsets, 1 << 18):
            s, size = self.similarities(*trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a)
            k = s.argmax(1) if s.shape[1] else np.zeros(b - a, np.int64)
            top = s[np.arange(b - a), k] if s.shape[1] else np.zeros(b - a, np.float32)
            best.append(k)
            sim.append(top)
            ok.append((size > 0) & (top > 0) & (top >= self.floors[band(size)]))
        if not n:
            z = np.zeros(0, np.int64)
            return z, z.astype(np.float32), z.astype(bool)
        return np.concatenate(best), np.concatenate(sim), np.concatenate(ok)


def band(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), BANDS - 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids of unit rows by spherical k-means, the cluster of each row or -1).

    Seeds are drawn as in k-means++ from a fixed generator. A cluster of under LEAST rows, or `share` of an even part of
    them, is no kind of text but outliers: its rows are set aside and the rest is clustered anew. Once half of the rows
    are set aside, all rows are one cluster.
    """
    rng, of = np.random.default_rng(0), np.zeros(len(x), np.int64)
    rows, k = np.arange(len(x)), max(1, min(k, len(x) // LEAST))
    while 2 * len(rows) > len(x):
        y = x[rows]
        chosen = [int(rng.integers(len(y)))]
        while len(chosen) < min(k, len(y)):
            far = np.maximum(1 - (y @ y[chosen].T).max(1).astype(np.float64), 0)
            far[chosen] = 0
            if far.sum() < 1e-6 * len(y):
                break
            chosen.append(int(rng.choice(len(y), p=far / far.sum())))
        c = y[chosen].copy()
        for _ in range(rounds):
            near = (y @ c.T).argmax(1)
            for i in np.unique(near):
                m = y[near == i].mean(0)
                c[i] = m / max(np.linalg.norm(m), 1e-12)
        near = (y @ c.T).argmax(1)
        small = np.bincount(near, minlength=len(c)) < min(len(x), max(LEAST, share * len(x) / len(c)))
        if not small.any():
            of[:] = -1
            of[rows] = near
            return c, of
        if not small[near].any():  # an empty cluster has no rows to set aside
            k = int((~small).sum())
        rows = rows[~small[near]]
    m = x.mean(0)
    return (m / max(np.linalg.norm(m), 1e-12))[None], of


def fit(docs: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """Fits to rows with a text of three characters and a `lang`; frequencies count all rows. Without any such row all documents are rejected.

    Of each language's different texts those of the least hashes are the sample: every language with such a row has a
    centroid, a text counts once however often it is repeated, and no more than `sample` rows of a language leave the workers.
    """
    df, n = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    labelled = docs.where("lang is not null and length(text) > 2").select("lang", "text", F.xxhash64("text").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = labelled.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= sample).groupBy("lang").agg(F.max("h").alias("most"))
    most = {r["lang"]: r["most"] for r in least.collect()}  # a row for each language
    bound = F.lit(None).cast("long")
    for lang, h in most.items():
        bound = F.when(F.col("lang") == lang, F.lit(h)).otherwise(bound)
    picked = labelled.where(F.col("h") <= bound).dropDuplicates(["lang", "h"]).select("lang", "text")
    t = picked.mapInArrow(_sample_batches, "lang string, dims binary, counts binary").toArrow().sort_by([("lang", "ascending"), ("dims", "ascending"), ("counts", "ascending")])
    langs = np.array(t.column("lang").to_pylist(), object)
    dims = [np.frombuffer(x, np.uint16).astype(np.int64) for x in t.column("dims").to_pylist()]
    counts = [np.frombuffer(x, np.uint32).astype(np.int64) for x in t.column("counts").to_pylist()]
    columns, names = [], []
    for lang in sorted(most):
        own = np.flatnonzero(langs == lang)
        if not len(own):
            continue
        x = np.zeros((len(own), DIMENSIONS), np.float32)
        for i, j in enumerate(own):
            x[i, dims[j]] = (1 + np.log(counts[j])) * idf[dims[j]]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c, _ = cluster(x, centroids)
        columns.append(c)
        names += [lang] * len(c)
    matrix = np.ascontiguousarray((np.concatenate(columns) if columns else np.zeros((0, DIMENSIONS), np.float32)).T)
    model = Model(idf, matrix, names, np.zeros(BANDS, np.float32))
    if dims:
        row = np.repeat(np.arange(len(dims)), [len(x) for x in dims])
        s, size = model.similarities(row, np.concatenate(dims), np.concatenate(counts), len(dims))
        model.floors = floors(s.max(1), band(size))
    return model


def floors(similarity: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """For each band SLACK times its lowest similarities; bands with under 20 documents take the next lower band's, the first ones a share by size."""
    out = np.zeros(BANDS, np.float32)
    known = [b for b in range(BANDS) if (bands == b).sum() >= 20]
    for b in range(BANDS):
        below = [k for k in known if k <= b]
        if below:
            out[b] = SLACK * np.quantile(similarity[bands == below[-1]], 0.005)
        elif known:
            # Similarity grows with the root of the size.
            out[b] = SLACK * np.quantile(similarity[bands == known[0]], 0.005) * 2.0 ** ((b - known[0]) / 2)
    return np.minimum.accumulate(out[::-1])[::-1]


def _decide_batches(shared, text: str, columns: list[str], reject: bool):
    def run(batches):
        model = shared.value
        names = np.array([*model.languages, None], object)
        for batch in batches:
            k, sim, ok = model.decide(*_lowered(batch, text))
            lang = pa.array(np.where(ok, names[k] if len(model.languages) else None, None), pa.string())
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], lang, pa.array(np.where(ok, sim, 0).astype(np.float64))], [*columns, "lang", "similarity"])
            yield out.filter(pa.array(ok)) if reject else out

    return run


def identify(docs: DataFrame, model: Model | None = None, reject: bool = True, score: str = "similarity") -> DataFrame:
    """The rows with `lang` and the column `score` set to the language found and its cosine; columns of these names are replaced, all others stay.

    Rejected rows go, or have a null language and similarity 0 where `reject` is false. Null and empty texts, and those of
    under three bytes, are rejected. The model is fitted to `docs` where none is given. Equal texts fare alike; of
    equally near centroids that of the alphabetically first language decides.
    """
    if model is None:
        model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    code = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that need no quoting
    kept = [f for f in docs.schema if f.name not in ("lang", score)]
    columns = [code[f.name] for f in kept]
    kinds = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(columns, kept)], T.StructField("lang", T.StringType()), T.StructField("similarity", T.DoubleType())])
    out = docs.toDF(*code.values()).mapInArrow(_decide_batches(shared, code["text"], columns, reject), kinds)
    order = [c for c in docs.columns if c != score] + ["lang"] * ("lang" not in code)
    return out.select(*[F.col("lang" if c == "lang" else code[c]).alias(c) for c in order], F.col("similarity").alias(score))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, similarity) of each document whose language is told; rejected documents have no row."""
    x = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return x.select("doc_id", "lang", F.round("similarity", 4).alias("similarity"))


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
