"""Life of an index: upserts, deletes, commits, snapshots, compaction, files and streams."""

import json

import pytest

from tamarack.errors import SchemaError
from tamarack.schema import Schema
from tamarack.sources.index import Index
from tamarack.streaming.ingest import ingest

SCHEMA = {
    "text_fields": [{"name": "body"}], "keyword_fields": [{"name": "tag", "many": True}], "numeric_fields": [{"name": "rank", "i64": True}],
    "nested_fields": [{"name": "comment", "fields": [{"type": "keyword", "name": "author", "nullable": False}]}], "vector_fields": [{"name": "v", "dim": 2}],
}


def ids(index, query="harbour", **more):
    return sorted(h["_id"] for h in index.search({"query": query, "limit": 100} | more).page()[0])


def test_life(spark, tmp_path):
    index = Index.create(spark, f"{tmp_path}/i", SCHEMA)
    with pytest.raises(SchemaError):
        Index.create(spark, f"{tmp_path}/i", SCHEMA)
    index.add([{"_id": "1", "body": "harbour one", "tag": "x", "rank": 30}, {"_id": "2", "body": "harbour two", "rank": 10, "v": [1, 0]}, {"_id": "1", "body": "harbour again"}])
    assert ids(index) == []
    assert Index.open(spark, f"{tmp_path}/i").pending().count() == 3
    assert index.commit() == 1 and ids(index) == ["1", "2"] and ids(index, "one") == []
    before = index.reader()
    index.add([{"_id": "2", "body": "go"}, {"_id": "3", "body": "harbour three", "comment": [{"author": "a"}]}])
    index.delete(["1", "unknown"])
    index.commit()
    assert ids(index) == ["3"] and ids(index, "go") == ["2"]
    assert index.stats() == {"docs": 2, "deleted": 2, "generations": 2}
    assert sorted(h["_id"] for h in before.search({"query": "harbour"}).page()[0]) == ["1", "2"]
    cursor = index.search({"query": {"type": "match_all"}, "limit": 1}).page()[1]
    index.add([{"_id": "4", "body": "lost"}])
    index.rollback()
    assert index.commit() == 2
    assert index.compact() == 3 and index.compact() == 3
    assert ids(index) == ["3"] and index.inspect().collect()[0].docs == 2
    with pytest.raises(Exception, match="generation"):
        index.search({"query": {"type": "match_all"}, "cursor": cursor, "limit": 1})


@pytest.mark.parametrize("doc", [{"body": "x"}, {"_id": " "}, {"_id": "1", "other": 1}, {"_id": "1", "rank": "high"}, {"_id": "1", "rank": 1.5}, {"_id": "1", "v": [1.0]}, {"_id": "1", "comment": [{}]}, {"_id": "1", "comment": [{"author": "a", "x": 1}]}])
def test_bad_documents_keep_out_the_batch(spark, tmp_path, doc):
    index = Index.create(spark, f"{tmp_path}/i", SCHEMA)
    with pytest.raises(SchemaError):
        index.add([{"_id": "9", "body": "good"}, doc])
    assert index.pending() is None


def test_files(spark, tmp_path):
    (tmp_path / "docs.jsonl").write_text('{"_id": "a", "body": "harbour file"}\n\n{"_id": "b", "body": "plain"}\n')
    (tmp_path / "bad.jsonl").write_text('{"_id": "c", "oops": 1}\n')
    (tmp_path / "ids.txt").write_text(" a \n\n")
    index = Index.open(spark, f"{tmp_path}/i", create_if_missing=True)
    index.add_jsonl(str(tmp_path / "docs.jsonl"))
    index.commit()
    assert ids(index) == ["a"]
    with pytest.raises(Exception, match="oops"):
        index.add_jsonl(str(tmp_path / "bad.jsonl"))
    index.delete_from_file(str(tmp_path / "ids.txt"))
    index.commit()
    assert ids(index) == []


def test_stream(spark, tmp_path):
    index = Index.create(spark, f"{tmp_path}/i", {"text_fields": [{"name": "body"}]})
    (tmp_path / "in").mkdir()
    for i, docs in enumerate([[{"_id": "1", "body": "harbour old"}, {"_id": "2", "body": "harbour"}], [{"_id": "1", "body": "new"}]]):
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(map(json.dumps, docs)))
        ingest(spark, f"{tmp_path}/in", index, f"{tmp_path}/check").awaitTermination(120)
    assert ids(index) == ["2"] and ids(index, "new") == ["1"]


def test_schema_rules_and_round_trip():
    s = Schema.from_json(SCHEMA)
    assert Schema.from_json(s.to_json()).struct() == s.struct()
    for bad in ({"doc_id_field": "body"}, {"text_fields": [{"name": "body", "analyzer": "none"}]}, {"vector_fields": [{"name": "v", "dim": 0}]}, {"keyword_fields": [{"name": "body"}]}):
        with pytest.raises(SchemaError):
            Schema.from_json(SCHEMA | bad)


def test_postings_give_what_a_scan_gives(spark, tmp_path):
    from tamarack.sources.index import in_memory

    schema = {"text_fields": [{"name": "body"}, {"name": "title", "analyzer": "grams"}], "keyword_fields": [{"name": "tag"}], "analyzers": [{"name": "grams", "filters": [{"type": "edge_ngram", "min": 1, "max": 4}]}]}
    docs = [{"_id": str(i), "body": f"harbour w{i % 3} lantern {'quiet ' * (i % 4)}end", "title": f"name{i % 2}", "tag": "x"} for i in range(9)] + [{"_id": "e", "body": ""}]
    index = Index.create(spark, f"{tmp_path}/i", schema)
    index.add(docs)
    index.commit()
    index.add([{"_id": "3", "body": "harbour quiet quiet"}, {"_id": "1", "body": "nothing"}])
    index.delete(["2"])
    index.commit()
    live = index.reader()
    scan = in_memory(live.docs.drop("_tok_body", "_tok_title", "_len_body", "_len_title"), schema)
    term = lambda f, v: {"type": "term", "field": f, "value": v}
    queries = ["quiet lantern", "harbour -w0", '"quiet quiet" harbour', {"type": "bool", "must": [term("title", "name")], "must_not": [term("body", "w1")]}, {"type": "prefix", "field": "body", "value": "w"}, {"type": "bool", "should": [term("tag", "x"), term("body", "quiet")]}, "absent"]
    queries += [{"type": "phrase", "field": "body", "terms": ["quiet", "quiet"]}, {"type": "dis_max", "queries": [term("body", "w0"), {"type": "phrase", "field": "title", "terms": ["name1"]}]}, '"harbour w1"', "-quiet", {"type": "regex", "field": "body", "value": "w[12]"}]
    rescored = {"window_size": 4, "query": {"type": "bool", "must": [term("body", "quiet")], "should": [term("body", "w1")]}}

    def answers(s, q, **more):
        return [(h["_id"], round(h["_score"], 9)) for h in s.search({"query": q, "limit": 50} | more).page()[0]]

    for q in queries:
        assert answers(live, q) == answers(scan, q), q
    assert answers(live, "harbour", rescore=rescored) == answers(scan, "harbour", rescore=rescored)
    # One generation: the statistics are those that the commit has stored.
    index.compact()
    whole = index.reader()
    assert whole.postings.stored["docs"] == 9 and sorted(map(tuple, whole.terms("body").collect())) == sorted(map(tuple, scan.terms("body").collect()))
    for q in queries:
        assert answers(whole, q) == answers(scan, q), q
    assert answers(whole, "harbour", rescore=rescored) == answers(scan, "harbour", rescore=rescored)
