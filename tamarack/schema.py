"""Declared fields of an index: their kinds, options and the rules that schemas and documents must meet."""

from __future__ import annotations

import json
from dataclasses import dataclass, field as default
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaError
from .functions.analysis import Analyzer, Registry, search_as_you_type

SPARK = {"text": T.StringType(), "keyword": T.StringType(), "i64": T.LongType(), "f64": T.DoubleType()}


def lacks(objects: Column, name: str) -> Column:
    return F.exists(objects, lambda o: o[name].isNull())


@dataclass
class Field:
    name: str
    kind: str  # text, keyword, i64, f64, nested or vector
    many: bool = False
    stored: bool = True
    indexed: bool = True
    fast: bool = False
    nullable: bool = True
    analyzer: str = "default"
    search_analyzer: str | None = None
    as_you_type: tuple[int, int] | None = None
    dim: int = 0
    metric: str = "Cosine"
    fields: dict[str, "Field"] = default(default_factory=dict)

    def spark_type(self) -> T.DataType:
        if self.kind == "vector":
            return T.ArrayType(T.FloatType())
        if self.kind == "nested":
            one = T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields.values()])
            return T.ArrayType(one) if self.many else one
        return T.ArrayType(SPARK[self.kind]) if self.many else SPARK[self.kind]


class Schema:
    """Fields by name in their order of declaration, with the analyzers they use."""

    def __init__(self, fields: list[Field], doc_id_field: str = "_id", analyzers: list[dict] | None = None) -> None:
        self.doc_id_field, self.definitions = doc_id_field, analyzers or []
        self.fields: dict[str, Field] = {}
        for f in fields:
            if f.name in self.fields:
                raise SchemaError(f"field {f.name} is declared twice")
            self.fields[f.name] = f
        self.registry = Registry(self.definitions)
        self.validate()

    # ---- JSON

    @classmethod
    def from_json(cls, spec: dict) -> "Schema":
        fields: list[Field] = []
        for x in spec.get("text_fields", []):
            as_you_type = x.get("search_as_you_type")
            if isinstance(as_you_type, dict):
                as_you_type = (as_you_type.get("min_gram", as_you_type.get("min", 1)), as_you_type.get("max_gram", as_you_type.get("max", 15)))
            elif as_you_type:
                as_you_type = (1, 15)
            fields.append(Field(x["name"], "text", x.get("many", False), x.get("stored", True), x.get("indexed", True), False, x.get("nullable", True), x.get("analyzer", x.get("tokenizer", "default")), x.get("search_analyzer", x.get("search_tokenizer")), as_you_type or None))
        for x in spec.get("keyword_fields", []):
            fields.append(cls._keyword(x))
        for x in spec.get("numeric_fields", []):
            fields.append(cls._numeric(x))
        fields += [cls._nested(x) for x in spec.get("nested_fields", [])]
        for x in spec.get("vector_fields", []):
            fields.append(Field(x["name"], "vector", nullable=x.get("nullable", True), dim=x["dim"], metric=x.get("metric", "Cosine")))
        return cls(fields, spec.get("doc_id_field", "_id"), spec.get("analyzers"))

    @classmethod
    def of(cls, id: str = "_id", text: str = "", keyword: str = "", i64: str = "", f64: str = "", more: list[Field] = ()) -> "Schema":
        """A schema with default options from names set apart by spaces; names that end in * hold several values."""
        fields = []
        for kind, names in (("text", text), ("keyword", keyword), ("i64", i64), ("f64", f64)):
            fields += [Field(n.rstrip("*"), kind, n.endswith("*"), fast=kind != "text", indexed=kind in ("text", "keyword")) for n in names.split()]
        return cls([*fields, *more], id)

    @staticmethod
    def _keyword(x: dict) -> Field:
        return Field(x["name"], "keyword", x.get("many", False), x.get("stored", True), x.get("indexed", True), x.get("fast", True), x.get("nullable", True))

    @staticmethod
    def _numeric(x: dict) -> Field:
        return Field(x["name"], "i64" if x.get("i64") else "f64", x.get("many", False), x.get("stored", True), False, x.get("fast", True), x.get("nullable", True))

    @classmethod
    def _nested(cls, x: dict) -> Field:
        inner = {}
        for y in x.get("fields", []):
            kind = y.get("type", "keyword")
            f = cls._nested(y) if kind in ("object", "nested") else cls._numeric(y) if kind == "numeric" else cls._keyword(y)
            inner[f.name] = f
        return Field(x["name"], "nested", x.get("many", True), nullable=x.get("nullable", True), fields=inner)

    @classmethod
    def from_file(cls, path: str) -> "Schema":
        return cls.from_json(json.loads(Path(path).read_text()))

    def to_json(self) -> dict:
        def nested(f: Field) -> dict:
            if f.kind == "nested":
                return {"type": "object", "name": f.name, "many": f.many, "nullable": f.nullable, "fields": [nested(g) for g in f.fields.values()]}
            plain = {"name": f.name, "many": f.many, "stored": f.stored, "fast": f.fast, "nullable": f.nullable}
            return plain | ({"type": "keyword", "indexed": f.indexed} if f.kind == "keyword" else {"type": "numeric", "i64": f.kind == "i64"})

        of = lambda *kinds: [f for f in self.fields.values() if f.kind in kinds]
        texts = []
        for f in of("text"):
            texts.append({"name": f.name, "many": f.many, "stored": f.stored, "indexed": f.indexed, "nullable": f.nullable, "analyzer": f.analyzer, "search_analyzer": f.search_analyzer, "search_as_you_type": {"min": f.as_you_type[0], "max": f.as_you_type[1]} if f.as_you_type else None})
        return {
            "doc_id_field": self.doc_id_field, "analyzers": self.definitions, "text_fields": texts,
            "keyword_fields": [nested(f) for f in of("keyword")], "numeric_fields": [nested(f) for f in of("i64", "f64")], "nested_fields": [nested(f) for f in of("nested")],
            "vector_fields": [{"name": f.name, "dim": f.dim, "metric": f.metric, "nullable": f.nullable} for f in of("vector")],
        }

    # ---- rules

    def validate(self) -> None:
        if not self.doc_id_field.strip():
            raise SchemaError("the id field needs a name")
        if self.doc_id_field in self.fields:
            raise SchemaError(f"the id field {self.doc_id_field} is declared as a field too")
        for f in self.fields.values():
            if f.kind == "text":
                self.index_analyzer(f.name), self.search_analyzer(f.name)
                if f.fast:
                    raise SchemaError(f"text field {f.name} can't be fast")
            if f.kind == "vector" and f.dim < 1:
                raise SchemaError(f"vector field {f.name} needs a dimension")
            if f.kind == "vector" and f.metric not in ("Cosine", "L2"):
                raise SchemaError(f"vector field {f.name}: unknown metric {f.metric}")

    def index_analyzer(self, name: str) -> Analyzer:
        f = self.fields[name]
        base = self.registry.get(f.analyzer)
        return search_as_you_type(base, *f.as_you_type) if f.as_you_type else base

    def search_analyzer(self, name: str) -> Analyzer:
        f = self.fields[name]
        return self.registry.get(f.search_analyzer or f.analyzer)

    def text_fields(self) -> list[str]:
        return [f.name for f in self.fields.values() if f.kind == "text"]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(self.doc_id_field, T.StringType()), *[T.StructField(f.name, f.spark_type()) for f in self.fields.values()]])

    def problem(self, df: DataFrame) -> Column:
        """What is wrong with a document, or null: a blank id, a null where none may be, a vector of another length."""
        id_ = F.col(f"`{self.doc_id_field}`")
        checks = [F.when(id_.isNull() | (F.trim(id_) == ""), F.lit(f"{self.doc_id_field} is missing or blank"))]
        for f in self.fields.values():
            c = F.col(f"`{f.name}`")
            if not f.nullable:
                checks.append(F.when(c.isNull(), F.lit(f"{f.name} must not be null")))
            if f.kind == "vector":
                checks.append(F.when(c.isNotNull() & (F.size(c) != f.dim), F.lit(f"{f.name} must have {f.dim} numbers")))
            if f.kind == "nested":
                for g in f.fields.values():
                    if not g.nullable:
                        bad = lacks(c, g.name) if f.many else c.isNotNull() & c[g.name].isNull()
                        checks.append(F.when(bad, F.lit(f"{f.name}.{g.name} must not be null")))
        return F.coalesce(*checks)

    def conform(self, df: DataFrame) -> DataFrame:
        """The declared columns in order, absent ones as nulls; an undeclared column is an error, as is a value that doesn't fit."""
        unknown = set(df.columns) - {self.doc_id_field, *self.fields}
        if unknown:
            raise SchemaError(f"undeclared fields: {', '.join(sorted(unknown))}")
        columns = []
        for f in self.struct():
            columns.append((F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name))
        return df.select(columns)
