"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.session import scratch, workers_see_package

#: Bits of ``monotonically_increasing_id`` below the partition's number.
PARTITION_BITS = 33
#: Text bytes worked on at once in a Python worker; bounds its memory whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a few very long texts don't fill a worker's memory; settings of the user's stay.

    Plans read these settings when they run, so they can't be put back before the caller runs them.
    """
    workers_see_package(spark)
    own = spark.conf.getAll
    for name, value in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        if f"spark.sql.execution.arrow.{name}" not in own:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """An Arrow file system and the path in it, for a path or URI of the shared folder."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array and the n + 1 offsets into them; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, rows) of consecutive slices of about ``most`` bytes, one row at least."""
    _, ends = string_buffer(column)
    row, n = 0, len(column)
    while row < n:
        last = int(np.searchsorted(ends, ends[row] + most, side="right")) - 1
        last = min(max(last, row + 1), n)
        yield row, last - row
        row = last


def pieces(batches: Iterator[pa.RecordBatch], place: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their text column holds about ``most`` bytes, or one row."""
    for batch in batches:
        for row, rows in slices(batch.column(place), most):
            yield batch.slice(row, rows)


def binary_array(raw: np.ndarray, starts: np.ndarray, end: int) -> pa.BinaryArray:
    """A binary array of the pieces of ``raw`` that begin at ``starts``; the last one stops at ``end``."""
    offsets = np.append(starts, end).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def keep_columns(df: DataFrame, *reserved: str) -> DataFrame:
    """``df`` without columns whose names an operator's own columns take (names compare without case)."""
    taken = {name.lower() for name in reserved}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def with_plain_names(docs: DataFrame, operator, *used: str) -> DataFrame:
    """``operator`` on ``docs`` with all columns but ``used`` renamed out of its way; returns the columns of ``docs``."""
    other = {c: f"_x{i}" for i, c in enumerate(docs.columns) if c not in used}
    out = operator(docs.toDF(*[other.get(c, c) for c in docs.columns]))
    return out.select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns])


def numbered(rows: DataFrame, number: str = "_row") -> DataFrame:
    """``rows`` with a unique number; its high bits name the partition, for ``looked_up``. Write it before use."""
    return rows.withColumn(number, F.monotonically_increasing_id())


def looked_up(rows: DataFrame, found: DataFrame, into: str, number: str = "_row") -> DataFrame:
    """``rows`` with the struct ``into`` of the other columns (longs) of ``found``, which has a row for some numbers; else null.

    A join that leaves ``rows`` where they are, whatever the sizes: ``found`` is written by the high bits of
    ``number``, one file for each partition that ``numbered`` saw, and a task loads the files of the partitions
    that its rows came from. A file has at most a row for each row of its partition. Only the number goes to Python.
    """
    spark = rows.sparkSession
    workers_see_package(spark)
    path = scratch(spark, "lookup")
    names = [c for c in found.columns if c != number]
    placed = found.select(number, *[F.col(c).cast("long").alias(c) for c in names], F.shiftright(number, PARTITION_BITS).alias("part"))
    placed.repartition("part").write.partitionBy("part").parquet(path)
    kind = pa.struct([(c, pa.int64()) for c in names])

    def load(part: int) -> pa.Table:
        files, root = file_system(f"{path}/part={part}")
        there = [f.path for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
        return pa.concat_tables(pq.read_table(files.open_input_file(f), columns=[number, *names]) for f in there) if there else None

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, held = None, None
        for column in columns:
            out, start = [], 0
            parts = column.to_numpy() >> PARTITION_BITS
            for end in [*(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]:
                if end == start:
                    continue
                if at != parts[start]:
                    at = parts[start]
                    held = load(int(at))
                piece = column.slice(start, end - start)
                if held is None:
                    out.append(pa.nulls(len(piece), kind))
                else:
                    place = pc.index_in(piece, value_set=held[number])
                    values = [held[c].take(place).combine_chunks() for c in names]
                    out.append(pa.StructArray.from_arrays(values, fields=list(kind), mask=place.is_null()))
                start = end
            yield pa.concat_arrays(out) if out else pa.nulls(0, kind)

    find = F.arrow_udf(run, "struct<" + ", ".join(f"{c}: long" for c in names) + ">").asNondeterministic()
    return rows.withColumn(into, find(number))
