"""The distributed suffix sort against Python's own."""

import random

from tamarack.llm import dcsort


def test_ranks(spark):
    depth, rng = 100, random.Random(5)
    strings = [[rng.randint(1, 3) for _ in range(rng.randint(1, 25))] for _ in range(12)] + [[2] * 20, [2] * 17, [1]]
    rows = [(s, i, c) for s, x in enumerate(strings) for i, c in enumerate(x)]
    got = {(r.s, r.i): r.r for r in dcsort.ranks(spark.createDataFrame(rows, "s long, i long, c long"), depth).collect()}
    suffixes = {(s, i): tuple(strings[s][i:]) for s, i, _ in rows}
    assert set(got) == set(suffixes)
    order = sorted(suffixes.values())
    assert all(got[k] == order.index(v) for k, v in suffixes.items())


def test_equal_prefixes(spark, monkeypatch):
    monkeypatch.setattr(dcsort, "partitions", lambda s: 5)
    rows = [(r, d, 7 * d, p) for r, (d, p) in enumerate([(5, b"a"), (1, b"b"), (4, b"b"), (2, b"b"), (9, b"b"), (3, b"c"), (8, b"d"), (6, b"d")])]
    got = {(r.doc, r.start, r["first"].doc) for r in dcsort.equal_prefixes(spark.createDataFrame(rows, "r long, doc long, start int, prefix binary")).collect()}
    assert got == {(1, 7, 1), (4, 28, 1), (2, 14, 1), (9, 63, 1), (8, 56, 6), (6, 42, 6)}
