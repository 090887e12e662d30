"""A table function over JSON payloads: any schema, items numbered within their partition."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegerType, IntegralType, LongType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _as_type(value: Any, kind: DataType) -> Any:
    """A JSON value as a Spark value; null where it doesn't fit."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(_as_type(value.get(f.name), f.dataType) for f in kind) if isinstance(value, dict) else None
    if isinstance(kind, ArrayType):
        return [_as_type(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, MapType):
        return {str(k): _as_type(v, kind.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool):
        return None
    if isinstance(kind, IntegralType):
        bits = 31 if isinstance(kind, IntegerType) else 63 if isinstance(kind, LongType) else 15
        return value if isinstance(value, int) and -(1 << bits) <= value < 1 << bits else None
    if isinstance(kind, FractionalType):
        return float(value) if isinstance(value, (int, float)) else None
    return None


class PayloadItems:
    """``payload_items(TABLE(t) PARTITION BY (key) ORDER BY (...), 'payload', schema)``, the schema as ``payload_schema`` writes it.

    A row for each object of the JSON payloads (an object, or an array of objects) in the named column: the partition's other columns as they
    are, ``item_index`` counted from 0 over the partition's payloads in order, and the fields of the schema. What is no object gives no
    row, but counts; null and broken payloads give nothing. The table should be partitioned: a partition's payloads are read one by one.
    """

    def __init__(self) -> None:
        self._next = 0
        self._kind: StructType | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or column.value is None or schema.value is None:
            raise ValueError("needs a table, the name of its payload column and a schema, as constants")
        fields = StructType.fromJson(json.loads(schema.value))
        rest = [f for f in rows.dataType if f.name != column.value]
        if len(rest) == len(rows.dataType.fields):
            raise ValueError(f"no column {column.value}")
        return AnalyzeResult(_joined(rest, fields))

    def eval(self, rows: Any, column: str, schema: str) -> Iterator[tuple]:
        if self._kind is None:
            self._kind = StructType.fromJson(json.loads(schema))
        rest = [v for k, v in rows.asDict(recursive=False).items() if k != column]
        try:
            found = json.loads(rows[column]) if rows[column] is not None else []
        except ValueError:
            return
        for item in found if isinstance(found, list) else [found]:
            at, self._next = self._next, self._next + 1
            if isinstance(item, dict):
                yield (*rest, at, *_as_type(item, self._kind))


def _joined(rest: list, fields: StructType) -> StructType:
    out = StructType(list(rest)).add("item_index", LongType())
    for f in fields:
        out = out.add(f.name, f.dataType, True)
    return out


def payload_schema(ddl: str) -> str:
    """A schema as the table function takes it."""
    return StructType.fromDDL(ddl).json()


def register_payload_items(spark: SparkSession, name: str = "payload_items") -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(PayloadItems))
