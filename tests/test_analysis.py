"""Analyzers: the driver's and the columns' results agree, and follow the rules."""

import pytest

from tamarack.errors import SchemaError
from tamarack.functions.analysis import Registry, search_as_you_type
from tamarack.functions.stemmer import stem
from tamarack.sources.index import in_memory

TEXTS = ["The Quick-brown fox's 2nd ÜBER naïve test", "", "  a  b\tc ", "New York city", "state of the art", "中文 words ΑΒΓ"]
DEFINITIONS = [
    {"name": "ws", "tokenizer": "whitespace", "filters": ["lowercase"]},
    {"name": "stop", "filters": [{"stopwords": "en"}]},
    {"name": "grams", "filters": [{"type": "edge_ngram", "min": 2, "max": 4}]},
    {"name": "both", "filters": ["stopwords", {"edge_ngram": {"min": 1, "max": 3}}]},
    {"name": "stems", "filters": ["lowercase", {"type": "stemmer", "language": "english"}]},
    {"name": "syn", "filters": [{"synonyms": [{"from": ["nyc"], "to": ["new", "york"]}, {"from": ["new", "york"], "to": ["nyc"]}]}]},
    {"name": "uni", "tokenizer": "unicode"},
]


@pytest.mark.parametrize("name", ["default", "whitespace", "unicode", *[d["name"] for d in DEFINITIONS]])
def test_columns_agree_with_the_driver(spark, name):
    analyzer = Registry(DEFINITIONS).get(name)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    from pyspark.sql import functions as F

    for r in df.select("t", analyzer.column(F.col("t")).alias("x")).collect():
        want = analyzer.run(r.t)
        assert [(x.t, x.p) for x in r.x] == want if analyzer.stacked else r.x == [t for t, _ in want]


def test_rules():
    r = Registry(DEFINITIONS)
    assert r.get("default").terms("Über-FAST") == ["Über", "fast"]
    assert r.get("stop").run("state of the art") == [("state", 0), ("art", 1)]
    assert r.get("grams").run("a test") == [("a", 0), ("te", 1), ("tes", 1), ("test", 1)]
    assert r.get("syn").run("in new york") == [("in", 0), ("new", 1), ("york", 2), ("nyc", 1)]
    assert search_as_you_type(r.get("default"), 1, 2).terms("abc") == ["a", "ab"]
    for bad in ([{"name": "default"}], [{"name": "x", "tokenizer": "odd"}], [{"name": "x", "filters": ["odd"]}], [{"name": "x"}, {"name": "x"}], [{"name": "x", "filters": [{"stopwords": "xx"}]}]):
        with pytest.raises(SchemaError):
            Registry(bad)


@pytest.mark.parametrize("word, want", [("running", "run"), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("national", "nation"), ("skies", "sky"), ("sensational", "sensat"), ("happy", "happi"), ("say", "say"), ("consisted", "consist"), ("knightly", "knight"), ("engines", "engin"), ("by", "by")])
def test_stemmer(word, want):
    assert stem(word) == want


def test_search_with_analyzers(spark):
    schema = {"analyzers": DEFINITIONS, "text_fields": [{"name": "body", "analyzer": "stems"}, {"name": "place", "analyzer": "syn"}, {"name": "title", "search_as_you_type": True}, {"name": "s", "analyzer": "stop"}]}
    df = spark.createDataFrame([("1", "Runners running", "nyc", "Rustacean", "state of the art"), ("2", "walk", "paris", "go", "art")], "_id string, body string, place string, title string, s string")
    s = in_memory(df, schema)
    found = lambda q: [h["_id"] for h in s.search({"query": q}).page()[0]]
    term = lambda f, v: {"type": "term", "field": f, "value": v}
    assert found(term("body", "run")) == ["1"] and found(term("place", "york")) == ["1"] and found(term("title", "rust")) == ["1"]
    assert found({"type": "phrase", "field": "s", "terms": ["state", "art"]}) == ["1"]


def test_synonyms_of_a_long_text_in_one_pass(spark):
    import time

    from pyspark.sql import functions as F

    words = ["w"] * 40_000 + ["new", "york", "nyc"]
    for rules in ([{"from": ["nyc"], "to": ["nyc", "city"]}], [{"from": ["new", "york"], "to": ["nyc"]}, {"from": ["nyc"], "to": ["city"]}]):
        analyzer = Registry([{"name": "x", "filters": [{"synonyms": rules}]}]).get("x")
        began = time.time()
        want = analyzer.run(" ".join(words))
        assert time.time() - began < 10
        got = spark.createDataFrame([(" ".join(words),), (None,)], "t string").select(analyzer.column(F.col("t")).alias("x")).collect()
        assert [(x.t, x.p) for x in got[0].x] == want and got[1].x == []


def test_filters_behind_stacked_tokens(spark):
    from pyspark.sql import functions as F

    filters = [{"synonyms": [{"from": "b", "to": ["bb", "c"]}, {"from": "b", "to": "never"}]}, {"stopwords": ["a", "b"]}, {"edge_ngram": {"min": 1, "max": 1}}]
    for analyzer in (Registry([{"name": "x", "filters": filters[:n]}]).get("x") for n in (1, 2, 3)):
        r = spark.createDataFrame([("a b d",)], "t string").select(analyzer.column(F.col("t")).alias("x")).first()
        assert [(x.t, x.p) for x in r.x] == analyzer.run("a b d")


@pytest.mark.parametrize("filters", [[{"edge_ngram": {"min": 2, "max": 4}}], [{"synonyms": [{"from": "b", "to": ["b", "cab", "cab"]}]}], ["lowercase", {"type": "stemmer", "language": "english"}], [{"stopwords": ["a"]}], [{"synonyms": [{"from": ["a", "b"], "to": ["cab"]}]}]])
def test_a_scan_finds_terms_without_all_tokens(spark, filters):
    from tamarack.plans.features import with_features
    from tamarack.plans.planner import Planner

    texts = ["a b CABS cab Ünder", "cabins b a b", "c ca cabbing", "", None]
    schema = {"analyzers": [{"name": "x", "filters": filters}], "text_fields": [{"name": "body", "analyzer": "x", "search_analyzer": "whitespace"}]}
    s = in_memory(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "_id string, body string"), schema)
    run = [s.schema.index_analyzer("body").run(t or "") for t in texts]
    for term in ("a", "b", "ca", "cab", "cabs", "cabbi", "cabin", "Ünd", "none"):
        plan = Planner(s.schema, None).build({"type": "term", "field": "body", "value": term})
        want = {str(i): ([p for t, p in x if t == term], len(x)) for i, x in enumerate(run)}
        df = with_features(s.docs, plan)
        assert {r["_id"]: (sorted(r["_k0"]), r["_len_body"]) for r in df.collect()} == want
        some = with_features(s.docs, plan, wanted=(plan.scored, plan.needs)).collect()
        found = {i: x for i, x in want.items() if x[0]}
        assert {r["_id"]: (sorted(r["_k0"]), r["_len_body"]) for r in some if r["_k0"]} == found
        average = sum(map(len, run)) / len(run)
        assert all((r["_n"], r["_df0"], round(r["_avg_body"], 9)) == (5.0, float(len(found)), round(average, 9)) for r in some)
        assert {r["term"]: r["df"] for r in s.terms("body", "ca").collect()} == {t: sum(t in dict(x) for x in run) for t in {t for x in run for t, _ in x} if t.startswith("ca")}


def test_what_a_stem_keeps():
    from tamarack.functions.stemmer import kept

    for w in "skies dying early happily relational possibilities agreed hoping conflated yes analogies knives idiotically".split():
        assert w.startswith(kept(stem(w)))
