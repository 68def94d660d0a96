"""The aggregation tree on small fixtures."""

import pytest

from tamarack.errors import AggregationError
from tamarack.schema import Schema
from tamarack.sources.index import in_memory

SCHEMA = Schema.of(keyword="tag tags*", i64="views ts", f64="scores*")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("1", "tech", ["a", "b", "a"], 1, 0, [1.0, 3.0]), ("2", "tech", ["b"], 2, 501, [5.0]), ("3", "hobby", None, 7, 1600, None), ("4", "news", [], 11, None, []), ("5", "Tech", ["c"], 5, 500, [2.0])]
    return in_memory(spark.createDataFrame(rows, "_id string, tag string, tags array<string>, views long, ts long, scores array<double>"), SCHEMA)


def run(docs, aggs, **more):
    request = dict(aggs=aggs, query=dict(type="match_all"), **more)
    return docs.search(request).aggregations


def counts(x):
    return [(b["key"], b["doc_count"]) for b in x["buckets"]]


def test_terms(docs):
    x = run(docs, {"t": {"type": "terms", "field": "tag", "aggs": {"v": {"type": "stats", "field": "views"}}}})["t"]
    assert counts(x) == [("tech", 2), ("Tech", 1), ("hobby", 1), ("news", 1)]
    assert x["buckets"][0]["v"] == {"count": 2, "min": 1.0, "max": 2.0, "sum": 3.0, "avg": 1.5}
    assert counts(run(docs, {"t": {"terms": {"field": "tags", "missing": "none"}}})["t"]) == [("b", 2), ("none", 2), ("a", 1), ("c", 1)]
    assert counts(run(docs, {"t": {"type": "rare_terms", "field": "tag", "max_doc_count": 1, "size": 2}})["t"]) == [("Tech", 1), ("hobby", 1)]


def test_many_values(docs):
    x = run(docs, {"s": {"type": "extended_stats", "field": "scores", "missing": 9.0}, "p": {"type": "percentiles", "field": "scores", "percents": [50]}, "c": {"type": "cardinality", "field": "tags"}, "n": {"type": "value_count", "field": "scores"}})
    assert x["s"]["count"] == 6 and x["s"]["sum"] == 29.0 and x["s"]["max"] == 9.0
    assert x["p"]["values"] == {"50": 2.5} and x["c"]["value"] == 3 and x["n"]["value"] == 4


def test_percentiles(docs):
    x = run(docs, {"p": {"type": "percentiles", "field": "views", "percents": [50.0]}, "r": {"type": "percentile_ranks", "field": "views", "values": [5.0]}})
    assert x["p"]["values"] == {"50": 5.0} and x["r"]["values"] == {"5": 60.0}


def test_histograms(docs):
    assert counts(run(docs, {"h": {"type": "histogram", "field": "views", "interval": 5.0}})["h"]) == [(0.0, 2), (5.0, 2), (10.0, 1)]
    bounds = {"min": 0.0, "max": 15.0}
    assert counts(run(docs, {"h": {"type": "histogram", "field": "views", "interval": 5.0, "extended_bounds": bounds}})["h"])[-1] == (15.0, 0)
    hard = run(docs, {"h": {"type": "histogram", "field": "views", "interval": 5.0, "hard_bounds": {"min": 0.0, "max": 9.0}}})["h"]
    assert counts(hard) == [(0.0, 2), (5.0, 2)]


def test_date_histograms(docs):
    x = run(docs, {"d": {"type": "date_histogram", "field": "ts", "fixed_interval": "1s", "offset": "500ms", "missing": "500"}})["d"]
    assert counts(x) == [(500, 3), (1500, 1), (2500, 1)]


def test_calendar(spark):
    ms = [1704067200000, 1706659200000, 1706745600000]  # 1 and 31 January, 1 February 2024
    s = in_memory(spark.createDataFrame([(str(i), m) for i, m in enumerate(ms)], "_id string, ts long"), Schema.of(i64="ts"))
    x = run(s, {"d": {"type": "date_histogram", "field": "ts", "calendar_interval": "month", "extended_bounds": {"min": "2024-01-01T00:00:00Z", "max": "2024-03-10T00:00:00Z"}}})["d"]
    assert counts(x) == [(1704067200000, 2), (1706745600000, 1), (1709251200000, 0)]


def test_ranges(docs):
    rs = [{"key": "low", "to": 5.0}, {"from": 5.0, "to": 7.0}, {"from": 100.0}]
    x = run(docs, {"r": {"type": "range", "field": "views", "ranges": rs, "aggs": {"v": {"type": "stats", "field": "views"}}}})["r"]
    assert counts(x) == [("low", 3), ({"from": 5.0, "to": 7.0}, 2), ({"from": 100.0, "to": None}, 0)]
    assert x["buckets"][2]["v"]["count"] == 0
    assert run(docs, {"r": {"type": "range", "field": "views", "keyed": True, "ranges": rs[:1]}})["r"]["buckets"]["low"]["doc_count"] == 3


def test_composite_pages(docs):
    spec = {"type": "composite", "size": 2, "sources": [{"type": "terms", "name": "t", "field": "tag"}]}
    first = run(docs, {"c": spec})["c"]
    assert counts(first) == [({"t": "Tech"}, 1), ({"t": "hobby"}, 1)]
    rest = run(docs, {"c": spec | {"after": first["after_key"]}})["c"]
    assert counts(rest) == [({"t": "news"}, 1), ({"t": "tech"}, 2)] and "after_key" not in rest


def test_nested_tree_and_top_hits(docs):
    top = {"type": "top_hits", "size": 1, "sort": [{"field": "views", "order": "desc"}], "fields": ["views"]}
    x = run(docs, {"t": {"type": "terms", "field": "tag", "size": 1, "aggs": {"h": {"type": "histogram", "field": "views", "interval": 2.0}, "top": top}}})["t"]
    (b,) = x["buckets"]
    assert counts(b["h"]) == [(0.0, 1), (2.0, 1)]
    assert b["top"]["total"] == 2 and [(h["id"], h["views"]) for h in b["top"]["hits"]] == [("2", 2)]


def test_significant_and_filter(docs):
    flt = {"KeywordEq": {"field": "tag", "value": "tech"}}
    x = run(docs, {"s": {"type": "significant_terms", "field": "tag"}, "f": {"type": "filter", "filter": {"I64Range": {"field": "views", "min": 2, "max": 5}}, "aggs": {"n": {"type": "value_count", "field": "views"}}}}, filter=flt)
    assert x["s"]["doc_count"] == 3 and x["s"]["bg_count"] == 5
    assert [(b["key"], b["doc_count"], round(b["score"], 4)) for b in x["s"]["buckets"]] == [("tech", 2, 1.6667), ("Tech", 1, 1.6667)]
    assert x["f"]["doc_count"] == 2 and x["f"]["n"] == {"value": 2}


def test_pipelines(docs):
    subs = {
        "v": {"type": "stats", "field": "views"}, "d": {"type": "derivative", "buckets_path": "v.sum"}, "m": {"type": "moving_avg", "buckets_path": "v.sum", "window": 2, "predict": 2},
        "x": {"type": "bucket_script", "buckets_path": {"a": "v.sum", "n": "_count"}, "script": "a / (n - 1)"}, "s": {"type": "sum_bucket", "buckets_path": "_count"}, "a": {"type": "avg_bucket", "buckets_path": "v.sum"},
    }
    x = run(docs, {"h": {"type": "histogram", "field": "views", "interval": 5.0, "aggs": subs}})["h"]
    assert [b["d"]["value"] for b in x["buckets"]] == [None, 9.0, -1.0]
    assert [b["m"]["value"] for b in x["buckets"]] == [3.0, 7.5, 11.5]
    assert [b["x"]["value"] for b in x["buckets"]] == [3.0, 12.0, None]
    assert x["m"] == {"value": 11.5, "predictions": [11.5, 11.5]} and x["s"]["value"] == 5.0 and x["x"]["value"] == 12.0 and round(x["a"]["value"], 6) == 8.666667
    ranked = run(docs, {"h": {"type": "histogram", "field": "views", "interval": 5.0, "aggs": {"b": {"type": "bucket_sort", "sort": [{"_count": "desc"}, {"_key": "desc"}], "size": 2}}}})["h"]
    assert counts(ranked) == [(5.0, 2), (0.0, 2)]


def test_sampling(docs):
    x = run(docs, {"t": {"type": "terms", "field": "tag", "sampling": {"size": 2}}})["t"]
    assert x["sampled"] and sum(b["doc_count"] for b in x["buckets"]) == 2


@pytest.mark.parametrize(
    "spec, kind",
    [
        ({"type": "terms", "field": "nothing"}, "unknown_field"), ({"type": "stats", "field": "tag"}, "wrong_type"), ({"type": "histogram", "field": "views", "interval": 0}, "invalid_config"),
        ({"type": "derivative", "buckets_path": "x"}, "invalid_config"), ({"type": "date_histogram", "field": "ts", "fixed_interval": "5 years"}, "invalid_config"), ({"type": "odd"}, "invalid_config"),
        ({"type": "histogram", "field": "views", "interval": 1, "extended_bounds": {"min": 0, "max": 9}, "hard_bounds": {"min": 1, "max": 5}}, "invalid_config"),
    ],
)
def test_errors(docs, spec, kind):
    with pytest.raises(AggregationError) as e:
        run(docs, {"x": spec})
    assert e.value.kind == kind
