"""Small files on whatever file system a path names, and readers for line-based inputs."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..schema import Schema


def workspace(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share. Where it is unset, in a local session, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="tamarack-")
        atexit.register(shutil.rmtree, made, True)
        folder = "file://" + made
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Folder:
    """A folder on a Hadoop file system: small texts are replaced by an atomic rename."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        self._fs.mkdirs(self._at(""))
        fresh = f".{name}.new"
        stream = self._fs.create(self._at(fresh), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri() if self._at("").toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._at(fresh), self._at(name), array)


def read_jsonl(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Documents of a file of JSON lines, in their order (_seq); blank lines are skipped. A line that isn't an object of the schema is an error that quotes it."""
    return parse_lines(spark.read.text(path).withColumn("_seq", F.monotonically_increasing_id()), schema)


def parse_lines(lines: DataFrame, schema: Schema) -> DataFrame:
    """From (value), and _seq where there is one."""
    lines = lines.withColumnRenamed("value", "_line").where(F.trim("_line") != "")
    declared = F.array(*[F.lit(n) for n in (schema.doc_id_field, *schema.fields)])
    parsed = lines.withColumn("_doc", F.from_json("_line", schema.struct(), {"mode": "PERMISSIVE"})).withColumn("_keys", F.json_object_keys("_line"))
    extra = F.array_except("_keys", declared)
    trouble = F.when(F.col("_keys").isNull(), F.lit("not a JSON object")).when(F.size(extra) > 0, F.concat(F.lit("undeclared fields: "), F.array_join(extra, ", ")))
    flat = parsed.select("_line", *[c for c in ("_seq",) if c in lines.columns], "_doc.*", trouble.alias("_trouble"))
    checked = flat.withColumn("_trouble", F.coalesce("_trouble", schema.problem(flat)))
    message = F.concat(F.col("_trouble"), F.lit(" in: "), F.substring("_line", 1, 200))
    # assert_true raises while the rows are read; its result is null, and the filter keeps it from being optimized away.
    return checked.where(F.assert_true(F.col("_trouble").isNull(), message).isNull()).drop("_line", "_trouble")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a file with one id a line: trimmed, blank lines skipped; control characters are an error."""
    ids = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    return ids.where(F.assert_true(~F.col("id").rlike("\\p{Cntrl}"), F.lit("an id holds a control character")).isNull())


def check_documents(docs: list[dict], schema: Schema) -> None:
    """The rules of a schema for documents that are still Python objects."""
    for d in docs:
        id_ = d.get(schema.doc_id_field)
        if not isinstance(id_, str) or not id_.strip():
            raise SchemaError(f"{schema.doc_id_field} must be a text that isn't blank")
        unknown = set(d) - {schema.doc_id_field, *schema.fields}
        if unknown:
            raise SchemaError(f"undeclared fields: {', '.join(sorted(unknown))}")
        for f in schema.fields.values():
            if f.name in d:
                _check_value(f, d[f.name], f.name)


def _check_value(f, v, where: str) -> None:
    if v is None:
        if not f.nullable:
            raise SchemaError(f"{where} must not be null")
        return
    if f.kind == "vector":
        if not isinstance(v, list) or len(v) != f.dim or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
            raise SchemaError(f"{where} must be {f.dim} numbers")
        return
    for x in v if isinstance(v, list) else [v]:
        if f.kind == "nested":
            if not isinstance(x, dict):
                raise SchemaError(f"{where} must be an object")
            if set(x) - set(f.fields):
                raise SchemaError(f"{where}: undeclared {', '.join(sorted(set(x) - set(f.fields)))}")
            for g in f.fields.values():
                if g.name not in x and not g.nullable:
                    raise SchemaError(f"{where}.{g.name} is missing")
                if g.name in x:
                    _check_value(g, x[g.name], f"{where}.{g.name}")
        elif isinstance(x, bool) or not isinstance(x, {"i64": int, "f64": (int, float)}.get(f.kind, str)):
            raise SchemaError(f"{where}: {x!r} isn't {f.kind}")


def as_json_line(doc: dict, schema: Schema) -> str:
    """A document with lone values of fields that hold several put into lists."""
    def shaped(f, v):
        if v is None:
            return None
        if f.kind == "nested":
            one = lambda o: {g.name: shaped(g, o.get(g.name)) for g in f.fields.values()}
            return [one(o) for o in (v if isinstance(v, list) else [v])] if f.many else one(v)
        return v if isinstance(v, list) or not f.many else [v]

    return json.dumps({schema.doc_id_field: doc[schema.doc_id_field]} | {n: shaped(f, doc[n]) for n, f in schema.fields.items() if n in doc}, ensure_ascii=False)

