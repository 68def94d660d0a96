"""Sort keys with missing values last, and the keyset predicate that continues after a cursor."""

from __future__ import annotations

import base64
import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError
from ..schema import Schema


class SortPlan:
    """Columns _s0, _s1, ... in their directions, then generation and id."""

    def __init__(self, specs: list[dict] | None, schema: Schema) -> None:
        self.keys: list[tuple[Column, bool, str]] = []  # value, ascending, field
        for s in specs or [{"field": "_score", "order": "desc"}]:
            name, order = s["field"], s.get("order")
            if order not in (None, "asc", "desc"):
                raise RequestError(f"unknown sort order {order}")
            if name == "_score":
                self.keys.append((F.col("_score"), order == "asc", name))
                continue
            f = schema.fields.get(name)
            if f is None or f.kind not in ("keyword", "i64", "f64") or not f.fast:
                raise RequestError(f"can't sort by {name}")
            up = order != "desc"
            c = F.col(f"`{name}`")
            self.keys.append(((F.array_min(c) if up else F.array_max(c)) if f.many else c, up, name))
        self.by_score = any(k[2] == "_score" for k in self.keys)
        self.id_ = schema.doc_id_field
        self.signature = zlib.crc32(json.dumps([[n, up] for _, up, n in self.keys]).encode())

    def names(self) -> list[str]:
        return [f"_s{i}" for i in range(len(self.keys))]

    def columns(self) -> list[Column]:
        return [c.alias(f"_s{i}") for i, (c, _, _) in enumerate(self.keys)]

    def order(self) -> list[Column]:
        out = [F.asc_nulls_last(f"_s{i}") if up else F.desc_nulls_last(f"_s{i}") for i, (_, up, _) in enumerate(self.keys)]
        return [*out, F.asc("_gen"), F.asc(self.id_)]

    def after(self, values: list, gen: int, id_: str) -> Column:
        """Rows strictly after the given ones in this order."""
        tail = (F.col("_gen") > gen) | ((F.col("_gen") == gen) & (F.col(f"`{self.id_}`") > id_))
        for i in reversed(range(len(self.keys))):
            c, v = F.col(f"_s{i}"), values[i]
            if v is None:
                tail = c.isNull() & tail
            else:
                beyond = c > F.lit(v) if self.keys[i][1] else c < F.lit(v)
                tail = c.isNull() | beyond | ((c == F.lit(v)) & tail)
        return F.coalesce(tail, F.lit(False))

    def cursor(self, row, generation: int, returned: int) -> str:
        data = {"g": generation, "s": self.signature, "v": [row[n] for n in self.names()], "k": [row["_gen"], row[self.id_]], "n": returned}
        return base64.urlsafe_b64encode(json.dumps(data).encode()).decode()

    def read_cursor(self, text: str, generation: int) -> dict:
        try:
            data = json.loads(base64.urlsafe_b64decode(text.encode()))
            if data["g"] != generation:
                raise RequestError("the cursor is of another generation of the index")
            if data["s"] != self.signature:
                raise RequestError("the cursor is of another sort order")
            return data
        except (ValueError, KeyError, TypeError) as e:
            raise e if isinstance(e, RequestError) else RequestError("not a cursor") from None
