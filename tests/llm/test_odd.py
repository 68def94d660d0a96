"""Clashing and odd column names, very long texts, repeated texts, and the operators' SQL on the smallest tables."""

import math
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamarack import llm
from tamarack.llm import language, lm, mixing, mtree, packing, quality, sharding, suffix, urls
from tamarack.llm.common import Tokenizer, col, unused

from ..test_queries import SF, TABLES, plain
from .test_ops import DOC

#: Every name that the operators use inside, and signs that need quoting.
NAMES = (
    "_maybe _hit _key _at _path _parts _metrics _keep _of _digest _cuts _cut _doc _gone _similarity similarity _source _block _slot _epoch _n _tokens _bucket _start _value _sum _before _inside "
    "_rest _full _copy _copies _rank _lo _hi _first _each _offset _seen _all _own _weight _p _x _cell h f p row doc rep strip node root u v w x k m a b c n s t i id key url bin slot block hi lo pc sig ids tree far bound part parts "
    "begin end ranges spots words first rn kinds bucket need times log_c vw region rack shard rank neighbour distance need dim df most piece position epoch"
).split() + ["my.col", "a`b", "with space"]


def clash(df, but=()):
    return df.select("*", *[F.lit(f"={n}").alias(n) for n in dict.fromkeys(NAMES) if n not in df.columns and n not in but])


def whole(df, columns):
    """Every added column is as it was."""
    extra = [c for c in columns if c in NAMES]
    assert df.columns == columns and len(extra) > 80
    rows = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(extra)]).distinct().collect()
    assert [tuple(r) for r in rows] == [tuple(f"={c}" for c in extra)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "house", "and", "window", "of", "stone", "is", "under", "light"]) + rng.choice(["", "s", "ing"])
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(60)
    rows = [(i, text(70), "en", f"s{i % 2}", 0) for i in range(24)] + [(30, f"{text(20)} {shared}", "en", "s0", 0), (31, f"{shared} {text(25)}", "en", "s1", 0), (32, None, "en", None, 0)]
    return spark.createDataFrame(rows, DOC)


def test_unused():
    assert unused(["_A", "b"], "_a", "c", "c") == ["__a", "c", "_c"]


def test_pages_keep_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/x"), (2, "http://ok.org/")], "page_id long, `my.url` string")
    df = clash(pages)
    out = urls.drop_listed(df, pages.where("page_id = 1").withColumnRenamed("my.url", "an.url"), "my.url", "an.url")
    whole(out, df.columns)
    assert [r.page_id for r in out.collect()] == [2]


@pytest.mark.parametrize("name", ["assign", "keep_good", "mix"])
def test_rows_keep_clashing_columns(docs, name):
    if name == "assign":
        df = clash(docs.withColumnRenamed("doc_id", "the.id"), sharding.LEVELS)
        whole(sharding.assign(df, "the.id").drop(*sharding.LEVELS), df.columns)
    elif name == "keep_good":
        df = clash(docs.withColumnRenamed("text", "the.text"))
        whole(quality.keep_good(df, text="the.text"), df.columns)
    else:
        df = clash(docs.withColumnRenamed("text", "the.text"))
        whole(mixing.mix(df, text="the.text"), df.columns)


def test_stages_keep_clashing_columns(spark, docs):
    df = clash(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        whole(stage(spark, df, ""), df.columns)


def test_results_with_clashing_columns(spark, docs):
    rows = lambda df: sorted(map(str, df.collect()))
    df = clash(docs)
    assert rows(packing.packed(docs, 64)) == rows(packing.packed(df, 64))
    assert rows(lm.stupid_backoff(docs).select("doc_id", F.round("log_score", 6))) == rows(lm.stupid_backoff(df).select("doc_id", F.round("log_score", 6)))
    assert rows(suffix.repeated_spans(docs)) == rows(suffix.repeated_spans(df)) != []
    vectors = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(12)], "vec_id long, embedding array<float>")
    assert rows(mtree.neighbours(vectors, 2)) == rows(mtree.neighbours(clash(vectors), 2))


# ---------------------------------------------------------------- long texts


def test_words_of_blocks():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  \n") for _ in range(rng.randint(0, 90))) for _ in range(40)] + ["x" * 100, "", " " * 40]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    want = [w for t in texts for w in t.split()]
    small = type("Small", (Tokenizer,), {"BLOCK": 16})
    for kind in (Tokenizer, small):
        row, start, end, h = kind().words(data, offsets)
        assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == want and [w for r in range(len(texts)) for w in texts[r].split()] == want
        assert list(row) == [i for i, t in enumerate(texts) for _ in t.split()]
        assert len({*zip(want, map(int, h))}) == len(set(want)) == len(set(map(int, h)))
        assert kind is Tokenizer or (h == Tokenizer().words(data, offsets)[3]).all()


def test_trigrams_of_pieces(monkeypatch):
    raw = [t.encode() for t in ("the house  is 12 old", "", "ab", "stone and stone and stone", "é ü")]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    whole_ = language.trigrams(data, offsets)
    monkeypatch.setattr(language, "PIECE", 5)
    assert all((a == b).all() for a, b in zip(whole_, language.trigrams(data, offsets)))


LONG = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {root!r})
from tamarack.llm import language, lm, simhash, suffix
class Shared:
    value = {shared}
rng = np.random.default_rng(0)
vocabulary = np.array(["w%05d" % i for i in range(40000)])
text = " ".join(rng.choice(vocabulary, {words}))
batch = pa.RecordBatch.from_pydict({{"doc_id": [1, 2], "text": [text, "a short text"], "lang": ["en", "en"]}})
del text
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = sum(b.num_rows for b in {call}(iter([batch])))
print(rows, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize(
    "call, shared",
    [
        ("simhash._signature_batches", "None"),
        ("suffix._anchor_batches(50, 25)", "None"),
        ("language._decide_batches(Shared, 'text', ['doc_id'], False)", "language.Model(np.ones(1 << 15, np.float32), np.ones((1 << 15, 3), np.float32), ['en'] * 3, np.zeros(20, np.float32))"),
        ("lm._explode_batches(Shared, np.arange(64, dtype=np.int32), True)", "(np.zeros(0, np.uint64), np.zeros(0, np.int64))"),
        ("lm._count_batches(np.arange(64, dtype=np.int32))", "None"),
    ],
)
def test_a_text_of_64_mb(call, shared):
    """More than the text itself, no worker takes over a gigabyte for it."""
    root = str(Path(__file__).parent.parent.parent)
    code = LONG.format(root=root, call=call, shared=shared, words=9_600_000)
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-1500:]
    rows, mb = map(int, said.stdout.split())
    assert rows and mb < 1000


# ---------------------------------------------------------------- language by its formulas


def test_repeated_texts_leave_every_language_its_centroids(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(language, "cluster", lambda x, k, f=language.cluster: (taken.append(len(x)), f(x, k))[1])
    rng = random.Random(2)
    french = [" ".join(rng.choice(["la", "maison", "est", "grande", "et", "vieille", "dans", "le", "jardin"]) for _ in range(30)) for _ in range(300)]
    rows = [(i, "the house is old and the garden is under the stone", "en", "s", 0) for i in range(3000)] + [(4000 + i, t, "fr", "s", 0) for i, t in enumerate(french)]
    df = spark.createDataFrame(rows, DOC)
    got = language.identify(df).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"en": 3000, "fr": 300}
    taken.clear()
    language.fit(df, sample=50)
    assert taken == [1, 50]


def test_language_by_its_formulas(spark):
    """idf, cosines and rejection, computed again text by text."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "fr"), (-3, "ab", "de"), (-4, "0 1 2 3", "en"), (-5, "zzqx jjkv wwqp " * 9, None)], df.schema)
    df = df.unionByName(odd)
    model = language.fit(df)

    def grams(text):
        out = {}
        raw = "".join(chr(b) if b >= 128 or chr(b).isalpha() else " " for b in (text or "").lower().encode())
        for i in range(len(raw) - 2):
            g = raw[i : i + 3]
            if "  " not in g:
                code = ord(g[0]) << 16 | ord(g[1]) << 8 | ord(g[2])
                d = (code * 2654435761 & 0xFFFFFFFF) >> 17
                out[d] = out.get(d, 0) + 1
        return out

    every = {r.doc_id: grams(r.text) for r in df.collect()}
    n = sum(1 for g in every.values() if g)
    seen = {}
    for g in every.values():
        for d in g:
            seen[d] = seen.get(d, 0) + 1
    assert all(abs(model.idf[d] - (math.log((1 + n) / (1 + c)) + 1)) < 1e-5 for d, c in seen.items())
    got = {r.doc_id: (r.lang, r.similarity) for r in language.identify(df, model, reject=False).collect()}
    for i, g in every.items():
        weight = {d: (1 + math.log(c)) * model.idf[d] for d, c in g.items()}
        norm = math.sqrt(sum(w * w for w in weight.values())) or 1.0
        cosine = [sum(w * float(model.centroids[d, k]) for d, w in weight.items()) / norm for k in range(len(model.languages))]
        best = max(range(len(cosine)), key=lambda k: cosine[k])
        size = sum(g.values())
        floor = float(model.floors[min(int(math.log2(max(size, 1))), language.BANDS - 1)])
        if abs(cosine[best] - floor) < 1e-4 or sorted(cosine)[-1] - sorted(cosine)[-2] < 1e-5 and size:
            continue
        ok = size > 0 and cosine[best] > 0 and cosine[best] >= floor
        assert got[i][0] == (model.languages[best] if ok else None)
        assert abs(got[i][1] - (cosine[best] if ok else 0)) < 1e-3
    assert all(got[-k][0] is None for k in (1, 2, 3, 4))


# ---------------------------------------------------------------- the SQL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_sql(spark, db, name):
    df = llm.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = db.sql(llm.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert ours == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
