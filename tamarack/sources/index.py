"""An index in a folder: documents upserted by key, committed as immutable generations of Parquet files.

    schema.json, manifest.json         the manifest lists the committed generations with their statistics, and is replaced by a rename
    data/_gen=N                        documents of commit N with their tokens, one row a key
    postings/_gen=N/field=/bucket=     positions of each term in each document, by the hash of the term
    gone/_gen=N                        keys that commit N wrote or deleted: earlier rows of them are dead
    pending/<n>                        operations that are not committed yet; they survive a restart

A reader pins the generations it was opened with. What a failed commit has written is in no manifest, and the next commit
overwrites it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..plans.features import analyzed, bucket_of, postings_of
from ..plans.search import Result, Searcher
from ..schema import Schema
from .files import Folder, as_json_line, check_documents, parse_lines, read_ids, read_jsonl


#: Words for each bucket of postings, and for each file of a bucket: a frequent word's postings are spread over files.
BUCKET_WORDS, FILE_WORDS = 1 << 20, 1 << 24


class Index:
    def __init__(self, spark: SparkSession, path: str, schema: Schema) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.folder = Folder(spark, path)

    # ---- life of an index

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: Schema | dict) -> "Index":
        index = cls(spark, path, schema if isinstance(schema, Schema) else Schema.from_json(schema))
        if index.folder.exists("manifest.json"):
            raise SchemaError(f"there is an index in {path}")
        index.folder.write("schema.json", json.dumps(index.schema.to_json()))
        index._set_manifest([], 0)
        return index

    @classmethod
    def create_from_schema_file(cls, spark: SparkSession, path: str, schema_file: str) -> "Index":
        return cls.create(spark, path, Schema.from_file(schema_file))

    @classmethod
    def open(cls, spark: SparkSession, path: str, create_if_missing: bool = False) -> "Index":
        folder = Folder(spark, path)
        if not folder.exists("manifest.json"):
            if not create_if_missing:
                raise SchemaError(f"there is no index in {path}")
            return cls.create(spark, path, {"text_fields": [{"name": "body"}]})
        return cls(spark, path, Schema.from_json(json.loads(folder.read("schema.json"))))

    def manifest(self) -> dict:
        return json.loads(self.folder.read("manifest.json"))

    def _set_manifest(self, generations: list[int], last: int, statistics: dict | None = None) -> None:
        """statistics: by generation (as a text) its documents, buckets of postings, and [words, documents with the field] of each text field."""
        known = {k: v for k, v in (statistics or {}).items() if int(k) in generations}
        self.folder.write("manifest.json", json.dumps({"generations": generations, "last": last, "statistics": known}))

    # ---- pending operations

    def add(self, docs: list[dict]) -> None:
        """Checks all documents first: one that breaks the schema keeps out the others too."""
        if not docs:
            raise SchemaError("no documents")
        check_documents(docs, self.schema)
        rows = [(as_json_line(d, self.schema), i) for i, d in enumerate(docs)]
        self.add_frame(parse_lines(self.spark.createDataFrame(rows, "value string, _seq long"), self.schema))

    def add_jsonl(self, path: str) -> None:
        self.add_frame(read_jsonl(self.spark, path, self.schema))

    def add_frame(self, df: DataFrame) -> None:
        """Columns as declared; _seq, where given, orders rows of the same key."""
        seq = F.col("_seq") if "_seq" in df.columns else F.monotonically_increasing_id()
        tagged = df.withColumn("_seq", seq)
        shaped = self.schema.conform(tagged.drop("_seq", "_keys", "_doc"))
        ordered = tagged.select(*[F.col(f"`{c}`") for c in shaped.columns if c in tagged.columns], "_seq")
        for f in self.schema.struct():
            ordered = ordered.withColumn(f.name, F.col(f"`{f.name}`").cast(f.dataType) if f.name in ordered.columns else F.lit(None).cast(f.dataType))
        valid = ordered.where(F.assert_true(self.schema.problem(ordered).isNull(), F.coalesce(self.schema.problem(ordered), F.lit("")).cast("string")).isNull())
        self._append(valid.withColumn("_delete", F.lit(False)))

    def delete(self, ids: list[str]) -> None:
        self._delete(self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def delete_from_file(self, path: str) -> None:
        self._delete(read_ids(self.spark, path))

    def delete_frame(self, ids: DataFrame) -> None:
        """Deletes the keys in the column `id`."""
        self._delete(ids.select("id"))

    def _delete(self, ids: DataFrame) -> None:
        columns = [F.col("id").alias(f.name) if f.name == self.schema.doc_id_field else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.struct()]
        self._append(ids.select(*columns, F.lit(0).cast("long").alias("_seq"), F.lit(True).alias("_delete")))

    def _append(self, ops: DataFrame) -> None:
        done = self.folder.list("pending")
        number = int(done[-1]) + 1 if done else 0
        name = f"pending/{number:012d}"
        names = [f.name for f in self.schema.struct()]
        try:
            ops.select(*[F.col(f"`{n}`") for n in names], "_seq", "_delete").write.parquet(f"{self.path}/{name}")
        except Exception:
            self.folder.delete(name)
            raise

    def pending(self) -> DataFrame | None:
        """All operations since the last commit, with _batch and _seq in their order."""
        frames = [self.spark.read.parquet(f"{self.path}/pending/{n}").withColumn("_batch", F.lit(int(n))) for n in self.folder.list("pending") if self.folder.exists(f"pending/{n}/_SUCCESS")]
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out

    def rollback(self) -> None:
        self.folder.delete("pending")

    def commit(self) -> int:
        """The last operation on a key wins. Returns the generation, the old one where there was nothing to do."""
        state, ops = self.manifest(), self.pending()
        if ops is None:
            return state["last"]
        gen, id_ = state["last"] + 1, self.schema.doc_id_field
        # Rows are wide: the winner of each key is found over narrow ones.
        latest = Window.partitionBy(id_).orderBy(F.desc("_batch"), F.desc("_seq"))
        last = ops.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "_batch", "_seq")
        fresh = analyzed(last.where("not _delete").drop("_delete"), self.schema, self.schema.text_fields())
        written = self._write(fresh, gen)
        ops.select(id_).distinct().write.mode("overwrite").parquet(f"{self.path}/gone/_gen={gen}")
        self._set_manifest([*state["generations"], gen], gen, state.get("statistics", {}) | {str(gen): written})
        self.folder.delete("pending")
        return gen

    def _write(self, docs: DataFrame, gen: int) -> dict:
        for name in self.schema.text_fields():
            toks = F.col(f"_tok_{name}")
            alone = self.schema.fields[name].many and not self.schema.index_analyzer(name).stacked
            docs = docs.withColumn(f"_len_{name}", F.size(F.array_compact(toks)) if alone else F.size(toks))
        docs.write.mode("overwrite").parquet(f"{self.path}/data/_gen={gen}")
        written = self.spark.read.parquet(f"{self.path}/data/_gen={gen}")
        names = self.schema.text_fields()
        row = written.agg(F.count("*"), *[f(f"_len_{n}") for n in names for f in (F.sum, F.count)]).first()
        lengths = {n: [row[2 * i + 1] or 0, row[2 * i + 2]] for i, n in enumerate(names)}
        words = sum(n for n, _ in lengths.values())
        buckets, files = min(4096, max(8, -(-words // BUCKET_WORDS))), max(1, -(-words // FILE_WORDS))
        postings = postings_of(written, self.schema)
        if postings is not None:
            postings = postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
            tasks = min(len(names) * buckets * files, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), len(names) * files))
            spread = postings.repartition(tasks, "field", "bucket", F.pmod(F.xxhash64(self.schema.doc_id_field), F.lit(files))).sortWithinPartitions("field", "bucket", "term")
            spread.write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{self.path}/postings/_gen={gen}")
        return {"docs": row[0], "buckets": buckets, "lengths": lengths}

    def compact(self) -> int:
        """Rewrites the live documents as one generation; nothing to do for one or none."""
        state = self.manifest()
        if len(state["generations"]) <= 1:
            return state["last"]
        gen = state["last"] + 1
        written = self._write(self._live(state["generations"]).drop("_gen"), gen)
        empty = self.spark.createDataFrame([], f"`{self.schema.doc_id_field}` string")
        empty.write.mode("overwrite").parquet(f"{self.path}/gone/_gen={gen}")
        self._set_manifest([gen], gen, {str(gen): written})
        return gen

    # ---- reading

    def _live(self, generations: list[int]) -> DataFrame:
        id_ = self.schema.doc_id_field
        if not generations:
            return self.spark.createDataFrame([], self.schema.struct()).withColumn("_gen", F.lit(0))
        read = lambda kind: self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/_gen={g}" for g in generations])
        docs = read("data").withColumn("_gen", F.col("_gen").cast("int"))
        if len(generations) == 1:
            return docs
        # Only the last word on a key counts, so one row of each is enough.
        gone = read("gone").groupBy(F.col(id_).alias("_key")).agg(F.max("_gen").cast("int").alias("_last"))
        return docs.join(gone, (docs[id_] == gone["_key"]) & (docs["_gen"] < gone["_last"]), "left_anti")

    def _postings(self, generations: list[int]) -> DataFrame | None:
        """Of dead documents too: they meet no live row of their generation."""
        if not generations or not self.schema.text_fields():
            return None
        out = None
        kinds = f"`{self.schema.doc_id_field}` string, term string, positions array<int>, field string, bucket int"
        for g in generations:
            one = self.spark.read.schema(kinds).parquet(f"{self.path}/postings/_gen={g}").withColumn("_gen", F.lit(g))
            out = one if out is None else out.unionByName(one)
        return out

    def reader(self) -> Searcher:
        """A snapshot: later commits don't change what it sees."""
        state = self.manifest()
        known = state.get("statistics", {})
        buckets = {g: known[str(g)]["buckets"] for g in state["generations"] if str(g) in known}
        # Statistics stored at the commit are those of the snapshot where it is one generation: no row of it is dead.
        stored = known.get(str(state["generations"][0])) if len(state["generations"]) == 1 else None
        return Searcher(self._live(state["generations"]), self.schema, state["last"], self._postings(state["generations"]), stored, buckets)

    def search(self, request: dict) -> Result:
        return self.reader().search(request)

    def stats(self) -> dict:
        state = self.manifest()
        live = self._live(state["generations"]).count()
        written = sum(self.spark.read.parquet(f"{self.path}/data/_gen={g}").count() for g in state["generations"])
        return {"docs": live, "deleted": written - live, "generations": len(state["generations"])}

    def inspect(self) -> DataFrame:
        """(_gen, live documents) of each generation."""
        return self._live(self.manifest()["generations"]).groupBy("_gen").agg(F.count("*").alias("docs"))


def in_memory(docs: DataFrame, schema: Schema | dict) -> Searcher:
    """A reader over a DataFrame, with nothing written; keys must be unique."""
    return Searcher(docs, schema if isinstance(schema, Schema) else Schema.from_json(schema))
