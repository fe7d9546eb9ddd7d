"""Users' inputs as DataFrames: record files and objects, columns of values, and named seeds."""

from __future__ import annotations

import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, data) -> DataFrame:
    """Records of a path (.csv, .json, .jsonl, .parquet), a list of dicts, a dict of lists or of records, pandas or Spark.

    A dict of records gets its keys as the column ``__id__``. CSV values stay text. Files go through Spark's
    readers, so any path that the cluster sees will do.
    """
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        kind = data.rstrip("/").rpartition(".")[2].lower()
        if kind == "csv":
            return spark.read.csv(data, header=True)
        if kind in ("jsonl", "ndjson"):
            return spark.read.json(data)
        if kind == "json":
            return spark.read.json(data, multiLine=True)
        if kind == "parquet":
            return spark.read.parquet(data)
        raise ValueError(f"records are read from .csv, .json, .jsonl or .parquet, not {data!r}")
    if hasattr(data, "to_arrow") and not hasattr(data, "iloc"):
        data = data.to_arrow().to_pandas()
    if hasattr(data, "iloc") and hasattr(data, "columns"):
        return spark.createDataFrame(data)
    if isinstance(data, dict):
        if data and all(isinstance(v, dict) for v in data.values()):
            data = [{"__id__": k} | v for k, v in data.items()]
        else:
            columns = list(data)
            data = [dict(zip(columns, row, strict=True)) for row in zip(*data.values(), strict=True)]
    if isinstance(data, (list, tuple)):
        if not data:
            raise ValueError("no records")
        if not all(isinstance(r, dict) for r in data):
            raise TypeError("records are dicts")
        columns = list(dict.fromkeys(k for r in data for k in r))
        text = lambda v: v if v is None or isinstance(v, str) else str(v)
        return spark.createDataFrame([tuple(text(r.get(c)) for c in columns) for r in data], ", ".join(f"`{c}` string" for c in columns))
    raise TypeError(f"can't read records from {type(data).__name__}")


def value_text(v) -> str | None:
    """A value as text: integral numbers without a fraction, nulls and not-a-numbers as null, no booleans."""
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool):
        raise TypeError("a boolean is no name or code")
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


def values(spark: SparkSession, data, column: str = "value") -> DataFrame:
    """(row_id, value) of a list, tuple, dict, array or pandas column; one-shot iterators and whole frames are refused."""
    if isinstance(data, (types.GeneratorType, map, filter, zip)):
        raise TypeError("an iterator can be read once only: pass a list")
    if hasattr(data, "columns"):
        raise TypeError("pass one column, not a frame")
    if isinstance(data, (str, bytes)):
        raise TypeError("pass a list of texts, not one text")
    items = list(data.values()) if isinstance(data, dict) else data.tolist() if hasattr(data, "tolist") else list(data)
    return spark.createDataFrame([(i, value_text(v)) for i, v in enumerate(items)], f"row_id long, {column} string")


def seed_relations(spark: SparkSession, rows: list[tuple], relation: str) -> DataFrame:
    """Relations of literal (entity_id, target_id, valid_from, valid_until) rows; dates are ISO text or None."""
    df = spark.createDataFrame(rows, "entity_id string, target_id string, valid_from string, valid_until string")
    return df.select("entity_id", F.lit(relation).alias("relation_type"), "target_id", F.to_date("valid_from").alias("valid_from"), F.to_date("valid_until").alias("valid_until"))
