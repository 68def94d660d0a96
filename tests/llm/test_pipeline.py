"""The stages on a small table: columns, what stays, that each decision takes effect, and all of it against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tamarack.llm import language, mixing, packing, simhash, suffix
from tamarack.llm.common import Tokenizer, materialize

from .test_ops import brute_spans, hamming

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["the", "house", "and", "window", "river", "of", "stone", "is", "under", "garden", "over", "light", "old"]) + rng.choice(["", "s", "ly", "ing", "ed"]) for _ in range(n))
    passage = text(70)
    rows = [(i, text(120), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, rows[1][1] + " end", "en", "s1", 0), (102, f"{text(30)} {passage} {text(90)}", "en", "s2", 0), (103, f"{text(100)} {passage} {text(60)}", "en", "s2", 0)]
    rows += [(104, None, "en", "s1", 0), (105, "", "en", None, 0), (106, "0 1 2 3", "en", "s3", 0), (107, text(3000), "en", None, 0), (None, text(50), "en", "s1", 0)]
    return spark.createDataFrame(rows, DOC), passage


def test_stages(spark, docs):
    docs, passage = docs
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = materialize(stage(spark, kept, ""))
        seen[name] = kept
        if name != "packing":
            assert kept.columns == docs.columns
    rows = {n: df.collect() for n, df in seen.items()}
    ids = {n: {r.doc_id for r in x} for n, x in rows.items()}
    assert not {104, 105} & ids["language_id"] and set(range(40)) <= ids["language_id"]
    assert not {100, 101} & ids["simhash_dedup"] and {102, 103, None} <= ids["simhash_dedup"]
    cut = {r.doc_id: r.text for r in rows["suffix_dedup"]}
    assert passage in cut[102] and passage not in cut[103]
    assert ids["mix"] == ids["suffix_dedup"] == ids["packing"]

    # Language: the model's decisions, text by text.
    model = language.fit(docs)
    told = {}
    for r in docs.collect():
        raw = (r.text or "").lower().encode()
        k, _, ok = model.decide(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if ok[0]:
            told[r.doc_id, r.text] = model.languages[k[0]]
    assert {(r.doc_id, r.text): r.lang for r in rows["language_id"]} == told

    # Near duplicates: all pairs of signatures.
    sig = {i: simhash.signatures_of(np.frombuffer(t.lower().encode(), np.uint8), np.array([0, len(t.encode())]), Tokenizer())[1][0] for i, t in told if i is not None}
    group = {i: i for i in sig}
    for _ in range(3):
        for i in sig:
            for j in sig:
                if hamming(sig[i], sig[j]) <= simhash.RADIUS:
                    group[i] = group[j] = min(group[i], group[j])
    alone = [(i, t) for i, t in told if i is None or group[i] == i]
    assert sorted((r.doc_id or -1, r.text) for r in rows["simhash_dedup"]) == sorted((i or -1, t) for i, t in alone)

    # Repeated passages: every window of 50 words.
    want = dict(alone)
    for i, a, b in sorted(brute_spans(alone, suffix.PASSAGE), key=lambda s: -s[1]):
        w = want[i].split()
        want[i] = " ".join(w[:a] + w[b:])
    assert {r.doc_id: " ".join(r.text.split()) for r in rows["suffix_dedup"]} == {i: t for i, t in want.items() if t}

    # The mixture: slots one by one.
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    null = lambda v: "\\N" if v is None else str(v)
    sources: dict = {}
    for r in rows["suffix_dedup"]:
        key = "null" if r.source is None else f"={r.source}"
        sources.setdefault(key, []).append((md5(f"mix/{null(r.source)}/{null(r.doc_id)}/{md5(r.text)}/"), len(r.text.split()), r.doc_id))
    blocks, weight = {}, {}
    for key, units in sources.items():
        at, blocks[key] = 0, {}
        for _, n, i in sorted(units):
            blocks[key].setdefault(at // mixing.BLOCK_TOKENS, []).append(i)
            at += n
        weight[key] = max(at, mixing.BLOCK_TOKENS) ** mixing.TEMPERATURE
    many, all_ = {k: max(b) + 1 for k, b in blocks.items()}, sum(weight.values())
    slots = max(math.ceil((many[k] + 2 + math.log(many[k] * all_ / weight[k] + 2)) * all_ / weight[k]) for k in many)
    rank, taken = Counter(), Counter()
    for s in range(slots):
        y, at = (s + 1) * mixing.GOLDEN % 2**53 / 2**53 * all_, 0.0
        for k in sorted(weight):
            at += weight[k]
            if y < at or k == max(weight):
                taken.update(blocks[k].get(rank[k] % many[k], []))
                rank[k] += 1
                break
    assert Counter(r.doc_id for r in rows["mix"]) == taken

    # Packing: as many sequences as the packer finds for these lengths, none of them over-full, no word lost.
    lengths = [len(r.text.split()) for r in rows["mix"]]
    counts = np.bincount([n % packing.CAPACITY for n in lengths], minlength=packing.CAPACITY + 1)
    solved = packing.Packer(counts, packing.CAPACITY).pack()
    assert len({r.bin for r in rows["packing"]}) == solved.bins + sum(n // packing.CAPACITY for n in lengths)
    assert sum(r.n_tokens for r in rows["packing"]) == sum(lengths)
    by: dict = {}
    for r in rows["packing"]:
        by.setdefault(r.bin, []).append((r.position, r.position + r.n_tokens))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= packing.CAPACITY and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_run(spark, docs, tmp_path):
    docs[0].write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.select("doc_id").collect()} >= {*range(40), 102, 103, None}


def test_registered():
    assert "pipeline" in entry.queries() and [n for n in entry.queries() if n.startswith("op")]
    assert len(corpus_pipeline.STAGES) == 5
