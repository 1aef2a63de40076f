"""JSON Schema documents as Spark types."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import types as T

SCALARS = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


def spark_type(spec: dict) -> T.DataType:
    """Type of one property; in ``[T, "null"]`` the first that is not null counts."""
    kind = spec.get("type")
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), None)
    if kind in SCALARS:
        return SCALARS[kind]
    if kind == "object":
        return struct_type(spec)
    if kind == "array" and "items" in spec:
        return T.ArrayType(spark_type(spec["items"]))
    raise ValueError(f"unsupported JSON Schema type: {kind}")


def struct_type(spec: dict) -> T.StructType:
    required = set(spec.get("required", ()))
    return T.StructType(
        [T.StructField(name, spark_type(prop), name not in required) for name, prop in spec.get("properties", {}).items()]
    )


def load_schema(spark: SparkSession, topic: str, folder: str) -> T.StructType:
    """Payload type of a topic from ``{folder}/{topic}.value.schema.json``, in any storage Spark reads.

    A contract that cannot be read, is empty or no object type is named in the error.
    """
    path = f"{folder.rstrip('/')}/{topic}.value.schema.json"
    try:
        text = "".join(row.value for row in spark.read.text(path, wholetext=True).collect())
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raise FileNotFoundError(f"no schema for topic {topic}: {path}") from error
    try:
        spec = json.loads(text)
    except ValueError as error:
        raise ValueError(f"no JSON in the schema of topic {topic}: {path}") from error
    if not isinstance(spec, dict) or not spec.get("properties"):
        raise ValueError(f"no properties in the schema of topic {topic}: {path}")
    return struct_type(spec)


def required_fields(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not f.nullable]
