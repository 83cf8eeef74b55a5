"""File sources and sinks: JSON documents, CSV tables (lists as JSON text), Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.sources.ledger import flat_csv


def write_json(df: DataFrame, path: str) -> None:
    """One document a line, so that a file can be split when it is read."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; list columns become JSON text, null and the empty string both stay what they are."""
    flat_csv(df).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, empty: str | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV of :func:`write_csv` or of any writer that quotes by doubling. List columns are read from their JSON text.

    Empty fields are null; ``empty`` names a value for those of string columns instead. Only without ``multi_line``
    (no line breaks inside values) is a file split among tasks.
    """
    kinds = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in kinds])
    rows = spark.read.schema(text).option("header", True).option("multiLine", multi_line).option("escape", '"').option("mode", "FAILFAST").csv(path)
    lists = [(F.from_json(f.name, f.dataType) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`")).alias(f.name) for f in kinds]
    out = rows.select(*lists)
    return out if empty is None else out.fillna(empty)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
