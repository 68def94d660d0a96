"""The ten operators against brute force, and on nulls, empty texts, ties, repeated rows, empty tables and extra columns."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tamarack.llm import language, lm, mixing, mtree, packing, quality, sharding, simhash, suffix, urls
from tamarack.llm.common import Tokenizer

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source="s", extra=False):
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", source, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    if extra:
        from pyspark.sql import functions as F

        for c in ("h", "f", "p", "row", "doc", "rep", "strip", "node", "root", "u", "v", "n", "begin", "end", "key", "bin", "slot", "block", "similarity", "a", "b", "id"):
            df = df.withColumn(c, F.lit("x"))
    return df


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(None, "a text without an id but with words"), (900, None), (901, ""), (902, " \n\t "), (903, "word"), (903, "word"), (904, "word"), (905, "é ü 中文 words " * 5)]


# ---------------------------------------------------------------- 1


def test_urls(spark):
    pages = spark.createDataFrame([(1, "HTTP://www.Bad.example.com:80/x/?utm_source=q&b=2&a=1#top"), (2, "https://sub.site.org/any"), (3, "https://site.org.example.com/"), (4, None), (5, " "), (6, "https://ok.example.com/y"), (7, "https://bad.example.com/x?a=1"), (1, "http://bad.example.com/x?b=2&a=1")], "page_id long, url string")
    listed = spark.createDataFrame([("bad.example.com/x?a=1&b=2",), ("SITE.org",), (None,), ("",)], "url string")
    kept = sorted(r.page_id for r in urls.drop_listed(pages, listed).collect())
    assert kept == [3, 4, 5, 6, 7]
    assert sorted(r.page_id for r in urls.drop_listed(pages, listed, filter_mb=0).collect()) == kept
    assert urls.drop_listed(pages, listed.limit(0)).count() == 8 and urls.drop_listed(pages.limit(0), listed).count() == 0


def test_bloom_has_no_false_negatives_and_few_hits(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    keys = spark.createDataFrame([(int(x),) for x in h[:10_000]], "h long")
    table = urls.bloom_filter(keys, 10_000)
    block, bits = urls._bits(h, len(table))
    hit = ((table[block] & bits) == bits).all(1)
    assert hit[:10_000].all() and hit[10_000:].mean() < 0.02


# ---------------------------------------------------------------- 2


def test_hash_tree_shares_and_movement(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit("x").alias("region"))
    before = {r.k: (r.region, r.rack, r.shard) for r in sharding.assign(df, "k").collect()}
    share = sum(v[0] == "us" for v in before.values()) / len(before)
    assert abs(share - 4 / 8) < 0.02
    eu = sharding.TREE["eu"]
    tree = sharding.TREE | {"eu": (eu[0], {"eu-a": (4.0, eu[1]["eu-a"][1]), "eu-b": eu[1]["eu-b"]})}
    after = {r.k: (r.region, r.rack, r.shard) for r in sharding.assign(df, "k", tree).collect()}
    for k, old in before.items():
        new = after[k]
        assert new[0] == old[0]
        if old != new:  # only towards the rack that grew
            assert old[:2] == ("eu", "eu-b") and new[:2] == ("eu", "eu-a")


def test_hash_tree_odd_cases(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("a",)], "k string")
    rows = [tuple(r) for r in sharding.assign(df, "k").collect()]
    assert rows[0] == (None, None, None, None) and rows[1][1] and rows[2] == rows[3]
    assert sharding.assign(df.limit(0), "k").count() == 0
    assert {r.region for r in sharding.assign(df, "k", {"a": (0.0, {}), "b": (1.0, {"c": (1.0, {"d": 1.0})})}).collect()} == {None, "b"}
    with pytest.raises(ValueError):
        sharding.assign(df, "k", {"a": -1.0})


# ---------------------------------------------------------------- 3


def test_quality(spark):
    good = "The cat and the dog went to the house of the man. It was a good day for all of them."
    texts = [good, "SHOUT!! LOUD!! WORDS!! HERE!!", "a*** b&&& c$$$ d%%%", "For For For For For For For", "De.", *ODD]
    kept = {(r.doc_id, r.text) for r in quality.keep_good(docs_of(spark, texts, extra=True)).collect()}
    ids = {i for i, _ in kept}
    assert {0, 4, 903, 904} <= ids and not ids & {1, 2, 3, 900, 901, 902}
    assert quality.keep_good(docs_of(spark, texts).limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.keep_good(docs_of(spark, texts), (quality.Rule("nothing", low=1),))


def test_each_quality_rule_rejects(spark):
    line = "The cat and the dog went to the house of the man."
    places = ["the hill", "a river", "the old town", "a stone", "the garden", "a tree"]
    texts = {
        "mean_word_length": "x" * 60,
        "symbol_ratio": "The cat is on the mat # * % & and the dog is with it.",
        "upper_ratio": "THE CAT IS ON THE MAT AND THE DOG is with it.",
        "exclamation_ratio": "The cat!! is on the mat!! and the dog!! is with it.",
        "stop_word_ratio": " ".join(f"wor{i}" for i in range(3000)),
        "repeated_word_ratio": "It was very very very very very good for the man.",
        "repeated_line_ratio": "\n".join([line] * 10),
        "bullet_line_ratio": "\n".join(f"- The cat is by {x}." for x in places),
        "ellipsis_line_ratio": "\n".join(f"The cat is by {x}..." for x in places),
    }
    assert {"n_words", *texts} == {r.metric for r in quality.RULES}
    rows = docs_of(spark, [*texts.values(), line])
    assert {r.doc_id for r in quality.keep_good(rows).collect()} == {len(texts)}
    for i, metric in enumerate(texts):
        others = [r for r in quality.RULES if r.metric != metric]
        assert i in {r.doc_id for r in quality.keep_good(rows.where(f"doc_id = {i}"), others).collect()}, metric
    blank = docs_of(spark, [" \n", None, "word"])
    assert {r.doc_id for r in quality.keep_good(blank, (quality.Rule("n_words", low=1),)).collect()} == {2}
    twice, nineteen, twenty = f"{line}\n{line}\n{line}\nIt is so.\nAll is well with it.", " ".join(f"wor{i}" for i in range(19)), " ".join(f"wor{i}" for i in range(20))
    assert {r.doc_id for r in quality.keep_good(docs_of(spark, [twice, nineteen, twenty])).collect()} == {0, 1}
    # Each bound from both sides.
    sides = {
        "mean_word_length high": ("a" * 20, "a" * 21),
        "mean_word_length low": (" ".join(["the", "on"] * 10), " ".join(["is", "on"] * 9 + ["the", "is"])),
        "symbol_ratio": ("the one is in the on# as", "the one is in the on## as"),
        "upper_ratio": ("ABcde", "ABCde"),
        "exclamation_ratio": ("the cat is on the mat no!", "the cat is on the mat n!"),
        "stop_word_ratio": (" ".join(["the", *nineteen.split()]), twenty),
        "repeated_word_ratio": ("on on it as we", "on on it as"),
        "repeated_line_ratio": ("a b\na b\na b\nc d\ne f", "a b\na b\na b\na b\nc d\ne f"),
        "bullet_line_ratio": ("\n".join([f"- the house{i}" for i in "abcdefghi"] + ["the end"]), "\n".join(f"- the house{i}" for i in "abcdefghij")),
        "ellipsis_line_ratio": ("\n".join([f"the house{i}..." for i in "abc"] + [f"the house{i}" for i in "defghij"]), "\n".join([f"the house{i}..." for i in "abcd"] + [f"the house{i}" for i in "efghij"])),
    }
    rows = docs_of(spark, [x for pair in sides.values() for x in pair])
    kept = {r.doc_id for r in quality.keep_good(rows).collect()}
    assert {k: (2 * i in kept, 2 * i + 1 in kept) for i, k in enumerate(sides)} == dict.fromkeys(sides, (True, False))


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize("page", [64, 8])
def test_neighbours(spark, monkeypatch, page):
    for name, value in {"PAGE": page, "FANOUT": 4, "SUBTREE": 60 if page == 8 else 65_536, "ASKED": 20 if page == 8 else 16_384}.items():
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.2, (60, 5)) for c in (0, 3, 9)]).astype(np.float32)
    x[7] = x[9] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, []), (502, [1.0, float("nan"), 0.0, 0.0, 0.0]), (None, x[0].tolist()), (503, [1.0, 2.0]), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in mtree.neighbours(df, k=4).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    for i in range(len(x)):
        want = sorted((round(d[i, j], 9), j) for j in range(len(x)) if j != i)[:4]
        assert got[i] == [j for _, j in want]
    assert set(got) == set(range(len(x)))
    some = mtree.neighbours(df.withColumnRenamed("embedding", "my.v"), k=4, vector="my.v", every=7)
    assert {(r.id, r.rank, r.neighbour) for r in some.collect()} == {(i, k + 1, j) for i in got if i % 7 == 0 for k, j in enumerate(got[i])}
    assert mtree.neighbours(df.limit(0)).count() == 0


def test_tree_bounds():
    x = np.random.default_rng(5).normal(size=(3000, 6)).astype(np.float32)
    t = mtree.Subtree.build(np.arange(3000) * 3, x)
    assert sorted(t.ids) == list(range(0, 9000, 3)) and (x[t.ids // 3] == t.vectors).all() and not t.leaf[0]
    reached, todo = [], [0]
    while todo:
        node = todo.pop()
        if t.leaf[node]:
            rows = np.arange(t.lo[node], t.hi[node])
            assert len(rows) <= mtree.PAGE and np.allclose(t.to_router[rows], mtree.exact(t.vectors[rows], np.repeat(t.vectors[t.router[node]][None], len(rows), 0)), atol=1e-2)
            reached += list(rows)
            continue
        below = []
        for c in range(t.lo[node], t.hi[node]):
            todo.append(c)
            assert abs(t.to_parent[c] - np.linalg.norm(t.vectors[t.router[c]] - t.vectors[t.router[node]])) < 1e-2
            assert np.linalg.norm(t.vectors[t.router[c]] - t.vectors[t.router[node]]) <= t.radius[node] + 1e-2
            below.append(c)
        assert 1 < len(below) <= mtree.FANOUT
    assert sorted(reached) == list(range(3000))


# ---------------------------------------------------------------- 5


def hamming(a, b):
    return sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a, b))


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [words(rng, 80) for _ in range(30)]
    near = [" ".join(["changed", *b.split()[1:]]) for b in base[:10]]
    texts = [*base, *near, base[0].upper(), *ODD]
    df = docs_of(spark, texts, extra=True)
    sig = {}
    for t, (i, text) in zip(texts, [(r.doc_id, r.text) for r in df.collect()]):
        raw = (text or "").lower().encode()
        has, s = simhash.signatures_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), Tokenizer())
        if i is not None and has[0]:
            sig[i] = s[0]
    group = {i: i for i in sig}
    for _ in range(len(sig)):
        for i in sig:
            for j in sig:
                if hamming(sig[i], sig[j]) <= simhash.RADIUS:
                    group[i] = group[j] = min(group[i], group[j])
    got = {r.doc_id: r.kept_id for r in simhash.near_duplicates(df).collect()}
    assert got == {i: g for i, g in group.items() if i != g}
    assert all(got[30 + i] == i for i in range(10)) and got[40] == 0 and got[904] == 903
    left = [r.doc_id for r in simhash.drop_near_duplicates(df).collect()]
    assert None in left and {900, 901, 902} <= set(left) and left.count(903) == 2 and not set(left) & set(got)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_all_close_pairs_are_found():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**63, (700, 2)).astype(np.uint64)
    a[350:] = a[:350] ^ (np.uint64(1) << rng.integers(0, 63, (350, 2)).astype(np.uint64))
    a = a[np.argsort(np.bitwise_count(a).sum(1), kind="stable")]
    got = {(int(i), int(j)) for r, c in simhash.close_pairs(a, a, 26) for i, j in zip(r, c)}
    d = np.bitwise_count(a[:, None] ^ a[None]).sum(2)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 26)) if i < j}


def test_few_pairs_are_compared(monkeypatch):
    rng = np.random.default_rng(11)
    a = rng.integers(0, 2**63, (20_000, 2)).astype(np.uint64)
    a[10_000:] = a[:10_000]
    for k in range(10_000):
        for bit in rng.choice(126, k % 28, replace=False):
            a[10_000 + k, bit // 63] ^= np.uint64(1) << np.uint64(bit % 63)
    a = a[np.argsort(np.bitwise_count(a).sum(1), kind="stable")]
    counted, count = [0], np.bitwise_count
    with monkeypatch.context() as m:
        m.setattr(np, "bitwise_count", lambda x, *more, **kw: (counted.__setitem__(0, counted[0] + x.size), count(x, *more, **kw))[1])
        got = {(int(i), int(j)) for r, c in simhash.close_pairs(a, a, 26) for i, j in zip(r, c)}
    want = set()
    for i in range(0, len(a), 500):
        d = np.bitwise_count(a[i : i + 500, None, 0] ^ a[None, :, 0]) + np.bitwise_count(a[i : i + 500, None, 1] ^ a[None, :, 1])
        want |= {(int(r) + i, int(c)) for r, c in zip(*np.nonzero(d <= 26)) if r + i < c}
    assert got == want and len(want) > 9_000
    assert counted[0] < 0.1 * len(a) * len(a) / 2


def test_large_groups_are_not_compared_pair_by_pair(monkeypatch):
    for name, n in (("WIDE", 64), ("MANY", 1024)):
        monkeypatch.setattr(simhash, name, n, raising=False)
    rng = np.random.default_rng(13)

    def turned(x, most):
        x = x.copy()
        for k in range(len(x)):
            for bit in rng.choice(128, rng.integers(0, most + 1), replace=False):
                x[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        return x

    centres = rng.integers(0, 2**63, (3, 2)).astype(np.uint64)
    a = np.concatenate([turned(centres[rng.integers(0, 3, 1500)], 16), turned(np.repeat(centres[:1], 300, 0), 40), rng.integers(0, 2**63, (300, 2)).astype(np.uint64)])
    a = rng.permutation(np.unique(a, axis=0))
    d = np.bitwise_count(a[:, None] ^ a[None]).sum(2)
    near = d <= 26
    want = simhash.components(len(a), *np.nonzero(near))
    assert near.sum() > 0.15 * near.size and len(set(want.tolist())) > 300
    half = len(a) // 2
    halves = [(0, np.arange(half)), (1, np.arange(half, len(a)))]
    counted, count = [0], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x, *more, **kw: (counted.__setitem__(0, counted[0] + x.size), count(x, *more, **kw))[1])

    def edges(cells, one, other):
        t = pa.table({"cell": [c for c, _ in cells], "sig": [a[i].tobytes() for _, i in cells], "ids": [i.tobytes() for _, i in cells]})
        found = [simhash._compare(26, 1)([pa.scalar(x) for x in (block, one, other, 0)], t) for block in range(8)]
        return np.concatenate([np.stack([f["u"].to_numpy(), f["v"].to_numpy()]) for f in found], 1)

    whole = edges([(0, np.arange(len(a)))], 0, 0)
    few = counted[0]
    split = np.concatenate([edges([x], x[0], x[0]) for x in halves] + [edges(halves, 0, 1)], 1)
    for u, v in (whole, split):
        assert np.array_equal(simhash.components(len(a), u, v), want)
    assert few < 2 * near.sum()


def test_cells_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 150)
    rng = np.random.default_rng(12)
    a = rng.integers(0, 2**63, (600, 2)).astype(np.uint64)
    a[100:400, 0] = a[0, 0]  # a cell with too many rows
    for k in range(400, 600):
        a[k] = a[k - 400]
        for bit in rng.choice(126, k % 29, replace=False):
            a[k, bit // 63] ^= np.uint64(1) << np.uint64(bit % 63)
    a = np.unique(a, axis=0)
    df = spark.createDataFrame([(int(h), int(lo), i) for i, (h, lo) in enumerate(a.view(np.int64))], "hi long, lo long, rep long")
    edges = simhash.close_edges(df).collect()
    d = np.bitwise_count(a[:, None] ^ a[None]).sum(2)
    u, v = np.nonzero(d <= 26)
    assert np.array_equal(simhash.components(len(a), *np.array([(e.u, e.v) for e in edges]).T), simhash.components(len(a), u, v))


# ---------------------------------------------------------------- 6


def best_fit_by_unit(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        at = min((r, i) for i, r in enumerate(room) if r >= x)[1] if any(r >= x for r in room) else None
        if at is None:
            room.append(capacity - x)
        else:
            room[at] -= x
    return len(room)


def fewest(lengths, capacity):
    """Exact, by branch and bound."""
    best = len(lengths)
    items = sorted(lengths, reverse=True)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(items):
            best = len(room)
            return
        for r in {r for r in room if r >= items[i]}:
            room.remove(r)
            room.append(r - items[i])
            go(i + 1, room)
            room.remove(r - items[i])
            room.append(r)
        room.append(capacity - items[i])
        go(i + 1, room)
        room.remove(capacity - items[i])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_packer(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    lengths = [rng.randint(1 if seed % 2 else capacity // 4, capacity - 1) for _ in range(rng.randint(1, 11))]
    counts = np.bincount(lengths, minlength=capacity + 1)
    p = packing.Packer(counts, capacity)
    p.reduce()
    rest = [x for x in range(capacity + 1) for _ in range(p.counts[x])]
    # What is fixed costs nothing: the fewest sequences stay the fewest.
    assert p.fixed + fewest(rest, capacity) == fewest(lengths, capacity)
    fixed = p.fixed
    p.best_fit()
    assert p.bins == fixed + best_fit_by_unit(rest, capacity) and not p.counts.any()
    held: dict[int, list] = {}
    for length, lo, hi, first, each, offset in p.runs:
        for r in range(lo, hi):
            held.setdefault(first + (r - lo) // each, []).append((offset + (r - lo) % each * length, length))
    assert sorted(x for b in held.values() for _, x in b) == sorted(lengths) and len(held) == p.bins
    for b in held.values():
        at = 0
        for start, length in sorted(b):
            assert start == at
            at += length
        assert at <= capacity


def test_packed_documents(spark):
    rng = random.Random(2)
    texts = [words(rng, n) for n in [5, 5, 5, 64, 65, 200, 1, 63, 32, 32] + [rng.randint(1, 90) for _ in range(60)]] + [t for t in ODD]
    df = docs_of(spark, texts, extra=True)
    rows = packing.packed(df, capacity=64).collect()
    total = {}
    for r in df.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + len((r.text or "").split())
    got: dict = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == {k: v for k, v in total.items() if v}
    by_bin: dict = {}
    for r in rows:
        by_bin.setdefault(r.bin, []).append((r.position, r.n_tokens))
    for b in by_bin.values():
        at = 0
        for start, n in sorted(b):
            assert start == at
            at += n
        assert at <= 64
    assert set(by_bin) == set(range(len(by_bin)))
    assert packing.packed(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("hot", [8, 1 << 20])
def test_backoff(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    monkeypatch.setattr(lm, "FLUSH_WORDS", 50 if hot == 8 else 1_000_000)
    rng = random.Random(4)
    texts = [words(rng, rng.randint(1, 30), 12) for _ in range(25)] + ODD
    df = docs_of(spark, texts, extra=True)
    fast = {r.doc_id: (r.n_words, round(r.log_score, 8)) for r in lm.stupid_backoff(df).collect()}
    seqs: dict = {}
    for r in df.collect():
        if r.doc_id is not None and (r.text or "").split():
            seqs.setdefault(r.doc_id, []).append(r.text.lower().split())
    count: dict = {}
    for d, ts in seqs.items():
        for t in ts:
            for n in (1, 2, 3):
                for i in range(len(t) - n + 1):
                    count.setdefault(tuple(t[i : i + n]), {}).setdefault(d, 0)
                    count[tuple(t[i : i + n])][d] += 1
    every = lambda g: sum(count[g].values())
    other = lambda g, d: every(g) - count[g].get(d, 0) if g in count else 0
    total = sum(len(t) for ts in seqs.values() for t in ts)
    for d, ts in seqs.items():
        s = 0.0
        for t in ts:
            for i, w in enumerate(t):
                u, v = (t[i - 2] if i > 1 else None), (t[i - 1] if i else None)
                if u and other((u, v, w), d):
                    s += math.log(other((u, v, w), d) / other((u, v), d))
                elif v and other((v, w), d):
                    s += math.log(other((v, w), d) / every((v,))) + (math.log(lm.ALPHA) if u else 0)
                else:
                    s += math.log(every((w,)) / total) + (2 if u else 1 if v else 0) * math.log(lm.ALPHA)
        assert fast[d][1] == pytest.approx(s, abs=1e-6)
    assert lm.stupid_backoff(df.limit(0)).count() == 0


def test_counts_of_ngrams_take_one_window_each(spark):
    rows = [(d, v << 20 | w, u, x) for d, v, w, u, x in [(1, 1, 2, 3, 4), (1, 1, 2, 3, 4), (1, 1, 2, 0, 5), (2, 1, 2, 3, 5), (3, 1, 2, 6, 0), (2, 7, 8, 3, 4), (2, 7, 8, 3, 4)]]
    df = spark.createDataFrame([(0, *r) for r in rows], "p int, doc long, vw long, u long, x long").repartition(2, "p")
    got = lm._scored(df, False, 100, 0.5)
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window [") == 3
    half = math.log(0.5)
    # (logarithm of the counts that a row has, the word whose count is still missing, how often): by hand, with counts in other documents only
    want = [(1, math.log(1), 2, 0), (1, math.log(1), 2, 0), (1, math.log(2) - math.log(2), 1, -1), (2, math.log(2) - math.log(4), 2, 0), (3, math.log(4) + half, 1, -1)] + [(2, 2 * half - math.log(100), 8, 1)] * 2
    assert sorted((r.doc, round(r.s, 9), r.need, r.times) for r in got.collect()) == sorted((d, round(s, 9), n, t) for d, s, n, t in want)


def test_only_heavy_pairs_are_counted_by_windows(spark, monkeypatch):
    rng = random.Random(9)
    texts = [words(rng, rng.randint(1, 40), 14) for _ in range(40)] + ["w1 w2 " * 60, "solo"] + ODD
    df = docs_of(spark, texts, extra=True)
    windows = lambda x: x._jdf.queryExecution().sparkPlan().toString().count("Window [")
    scores = lambda x: {r.doc_id: (r.n_words, round(r.log_score, 8)) for r in x.collect()}
    # In a corpus without rare words nothing takes a window: each partition is counted at once.
    plain = lm.stupid_backoff(df)
    assert windows(plain) == 0
    want = scores(plain)
    packed: list = []
    monkeypatch.setattr(lm, "_packed", lambda *a, f=lm._packed: packed.append(f(*a)) or packed[-1])
    n_grams = lambda x: sum(len(r.a) for r in x.select("a").collect())
    # Some pairs are heavy, then all of them; with few numbers most words are rare besides.
    for heavy, hot in [(15, 1 << 20), (15, 4), (0, 1 << 20)]:
        packed.clear()
        monkeypatch.setattr(lm, "HEAVY_PAIR", heavy)
        monkeypatch.setattr(lm, "HOT_WORDS", hot)
        got = lm.stupid_backoff(df)
        assert windows(got) >= 3 and scores(got) == want
        light, by_windows, *_ = map(n_grams, packed)
        assert sum(map(n_grams, packed)) == sum(n for n, _ in want.values())
        firsts = sum(bool((r.text or "").split()) for r in df.where("doc_id is not null").collect())
        assert by_windows and (light == firsts if not heavy else light > firsts or hot == 4)


def test_pairs_of_a_text_cut_in_pieces():
    """The pair across a cut is counted, and goes where the others of its bucket go."""
    text = "".join(f"x{i % 7} " for i in range(800_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [text, "y z", "z"]})
    rows = [(p, h, c) for b in lm._count_batches(np.arange(4, dtype=np.int32))(iter([batch])) for r in b.to_pylist() for p, h, c in zip([r["p"]] * len(r["h"]), r["h"], r["c"])]
    assert sum(c for p, _, c in rows if p >= 0) == 800_003 and sum(c for p, _, c in rows if p < 0) == 800_000
    heavy = np.zeros(lm.PAIR_BUCKETS, bool)
    heavy[[h for p, h, c in rows if p < 0 and c > 1000]] = True
    shared = type("Shared", (), {"value": (np.sort(Tokenizer().words(np.frombuffer(b"x0 x1 x2 x3 x4 x5 x6 y z", np.uint8), np.array([0, 24]))[3]), np.arange(1, 10))})
    size = lambda wanted: sum(len(a) for b in lm._explode_batches(shared, np.arange(4, dtype=np.int32), False, heavy, wanted)(iter([batch])) for a in b.column("a").to_pylist())
    assert (size(True), size(False)) == (799_999, 4)


@pytest.mark.parametrize("at_a_time", [70, 1 << 20])
def test_partition_of_ngrams_against_loops(monkeypatch, at_a_time):
    """Sums of a partition, counted once more by loops: more documents, pairs and rare words than small numbers hold, and keys of over 64 bits."""
    monkeypatch.setattr(lm, "SLICE_WORDS", at_a_time)
    rng = np.random.default_rng(3)
    n = 3000
    some = lambda k, top: rng.integers(0, 1 << 62, k)[rng.integers(0, k, n)] % top
    v, w = some(12, lm.RARE), 1 + some(8, lm.RARE - 1)
    u, x = np.where(rng.random(n) < 0.3, -1 - some(5, 1 << 62), some(5, lm.RARE)), np.where(rng.random(n) < 0.3, -1 - some(5, 1 << 62), some(4, 3))
    v[:50], u[:200], x[200:400] = 0, 0, 0
    u[v == 0] = 0
    doc = rng.integers(-30, 30, n) << 40
    logs = np.append(0.0, rng.random(lm.RARE))
    docs, s, size = lm._sums(doc, v << 20 | w, u, x, logs, 9.0, -0.5)
    rows, want = list(zip(doc.tolist(), v.tolist(), w.tolist(), u.tolist(), x.tolist())), {}
    two, three, after = {}, {}, {}
    for d, a, b, c, e in rows:
        for t, k in ((two, (a, b)), (three, (c, a, b)), (after, (a, b, e))):
            t.setdefault(k, {}).setdefault(d, 0)
            t[k][d] += 1
    other = lambda t, k, d: sum(t[k].values()) - t[k][d]
    for d, a, b, c, e in rows:
        c2, c3 = other(two, (a, b), d) if a else 0, other(three, (c, a, b), d) if a and c else 0
        part = math.log(c3) if c3 else math.log(c2) - logs[a] - 0.5 * bool(c) if c2 else logs[b] - 9.0 - (1.0 if c else 0.5 if a else 0)
        part -= math.log(c2) if c2 and e and other(after, (a, b, e), d) else 0
        want[d] = [want.get(d, [0, 0])[0] + part, want.get(d, [0, 0])[1] + 1]
    assert docs.tolist() == sorted(want) and size.tolist() == [want[d][1] for d in sorted(want)]
    assert s.tolist() == pytest.approx([want[d][0] for d in sorted(want)])
    wide = [np.array(k, np.int64) for k in ([1 << 40, 3, 3, 3], [5, 1 << 30, 9, 9], [0, 1, 2, 1])]
    assert lm._order(*wide).tolist() == [3, 2, 1, 0]


# ---------------------------------------------------------------- 8


def test_mixture(spark):
    rng = random.Random(6)
    a = docs_of(spark, [(i, words(rng, rng.randint(1, 120))) for i in range(300)], "a")
    b = docs_of(spark, [(1000 + i, words(rng, rng.randint(1, 120))) for i in range(60)], "b")
    df = a.unionByName(b)
    got = mixing.mix(df, {"a": 1.0, "b": 1.0}, block_tokens=256).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in df.collect()}
    tokens = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in "ab"}
    assert abs(tokens["a"] / sum(tokens.values()) - 0.5) < 0.06
    assert {r.source for r in mixing.mix(df, {"b": 1.0, "a": 0.0}).collect()} == {"b"}
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": -1.0})


def test_mixture_odd_cases(spark):
    from pyspark.sql import functions as F

    df = docs_of(spark, ODD, extra=True).withColumn("source", F.when(F.col("doc_id") > 903, "x"))
    got = mixing.mix(df)
    assert got.columns == df.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(r.doc_id, r.text) for r in df.collect()}


def test_mixture_keeps_sources_without_tokens(spark):
    df = docs_of(spark, [(1, "some words"), (2, None)], "a").unionByName(docs_of(spark, [(3, None), (4, " \n")], "b"))
    assert {r.doc_id for r in mixing.mix(df).collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in mixing.mix(df, {"a": 1.0, "b": 1.0}).collect()} == {1, 2, 3, 4}
    many = docs_of(spark, [(i, "word " * 1000) for i in range(40)], "a").unionByName(docs_of(spark, [(99, "word")], "b"))
    assert mixing.scheduled(many, block_tokens=100).select("_slot").distinct().count() <= 3 * 400


def test_schedule_is_even(spark):
    df = spark.createDataFrame([("=a", 0.0, 0.25), ("=b", 0.25, 1.0)], "_source string, _lo double, _hi double")
    rows = sorted((r._slot, r._source, r._rank) for r in mixing._slots(df, 400).collect())
    seen = {"=a": 0, "=b": 0}
    for slot, source, rank in rows:
        assert rank == seen[source]
        seen[source] += 1
        assert abs(seen["=a"] - 0.25 * (slot + 1)) < 3
    assert len(rows) == 400


# ---------------------------------------------------------------- 9


def test_language(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = df.where(F.col("doc_id") % 3 != 0), df.where((F.col("doc_id") % 3 == 0) & (F.col("n_chars") >= 60))
    model = language.fit(train)
    rows = language.identify(held.withColumnRenamed("lang", "true"), model).select("true", "lang").collect()
    assert len(rows) >= 0.99 * held.count()
    assert sum(r.true == r.lang for r in rows) / len(rows) > 0.97
    odd = [(1, None), (2, ""), (3, "ab"), (4, "ќўъщжэ йцукенгшщз фывапролд " * 10), (5, "0101110 101011 010111 " * 40)]
    got = language.identify(docs_of(spark, odd, extra=True), model).collect()
    assert not got
    assert language.identify(docs_of(spark, odd), model, reject=False).count() == 5
    assert language.identify(df.limit(0)).count() == 0


def test_language_clusters_hold_no_outliers():
    rng = np.random.default_rng(3)
    kinds = np.repeat(np.eye(40)[:3], 60, axis=0) + 0.1 * rng.random((180, 40))
    x = np.concatenate([kinds, np.eye(40)[10:14]])
    c, of = language.cluster((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), 3)
    assert sorted(c[:, :3].argmax(1)) == [0, 1, 2] and (c[:, 10:14] < 0.2).all() and np.bincount(of[of >= 0]).min() >= 60
    same = np.ones((30, 40), np.float32) / np.sqrt(np.float32(40))
    for rows in (same, same[:1], same[:9]):
        c, of = language.cluster(rows, 3)
        assert len(c) == 1 and np.allclose(c[0], same[0], atol=1e-5) and len(of) == len(rows)


def test_language_rejects_codes(spark, monkeypatch):
    rng, sizes, cluster = random.Random(4), [], language.cluster

    def counted(x, k):
        c, of = cluster(x, k)
        sizes.append(np.bincount((x @ c.T).argmax(1), minlength=len(c)) / len(x))
        return c, of

    monkeypatch.setattr(language, "cluster", counted)
    model = language.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert len(sizes) == 4 and all(len(x) == 3 and x.min() >= 0.05 for x in sizes)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    texts = [" ".join(f"{rng.getrandbits(128):032x}" for _ in range(n)) for n in (4, 30, 120) for _ in range(40)]
    texts += [" ".join("".join(rng.choice(signs) for _ in range(32)) for _ in range(n)) for n in (4, 30, 120) for _ in range(40)]
    assert language.identify(docs_of(spark, texts), model).count() == 0


# ---------------------------------------------------------------- 10


def brute_spans(rows, passage):
    texts = {}
    for i, t in rows:
        if i is not None and t:
            texts.setdefault(i, []).append(t.split())
    first, cut = {}, {}
    for i in sorted(texts):
        for w in texts[i]:
            for p in range(len(w) - passage + 1):
                g = tuple(w[p : p + passage])
                if g not in first:
                    first[g] = (i, p)
                elif first[g] != (i, p):
                    d, q = first[g]
                    begin = q + passage if d == i and p - q < passage else p
                    cut.setdefault(i, set()).update(range(begin, p + passage))
    out = set()
    for i, s in cut.items():
        run = sorted(s)
        start = prev = run[0]
        for x in run[1:] + [None]:
            if x is None or x != prev + 1:
                out.add((i, start, prev + 1))
                start = x
            prev = x
    return out


@pytest.mark.parametrize("hot", [1 << 19, 150])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_WORDS", hot)
    rng = random.Random(8)
    shared, other = words(rng, 60), words(rng, 75)
    texts = [f"{words(rng, 20)} {shared} {words(rng, 9)}", f"{words(rng, 5)} {shared} {other}", f"{other} {words(rng, 30)} {other}", "same " * 200, words(rng, 49), shared, shared, *ODD]
    df = docs_of(spark, texts, extra=True)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {(r.doc_id, r.begin, r.end) for r in suffix.repeated_spans(df).collect()}
    assert got == brute_spans(rows, suffix.PASSAGE)
    left = {r.doc_id: r.text for r in suffix.cut_repeats(df).where("doc_id is not null").collect()}
    assert left[0] == texts[0] and 5 not in left and 6 not in left and left[1].split() == texts[1].split()[:5] + other.split()
    assert left[900] is None and left[901] == ""
    assert suffix.repeated_spans(df.limit(0)).count() == 0 and suffix.cut_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_at_random(spark, seed):
    rng = random.Random(seed)
    pool = [words(rng, 12, 3).split() for _ in range(4)]
    texts = [" ".join(w for _ in range(rng.randint(1, 6)) for w in rng.choice(pool)) for _ in range(12)]
    df = docs_of(spark, texts)
    got = {(r.doc_id, r.begin, r.end) for r in suffix.repeated_spans(df, 8, 4).collect()}
    assert got == brute_spans([(r.doc_id, r.text) for r in df.collect()], 8)


def test_suffix_order():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 200):
        s = np.append(rng.integers(1, 4, n), [0, 0, 0])
        got = suffix.suffix_order(s, 300)
        want = sorted(range(len(s)), key=lambda i: tuple(s[i:]) + (0,) * i)
        assert [tuple(s[i:][: n]) for i in got if s[i]] == [tuple(s[i:][: n]) for i in want if s[i]]
