"""Jump consistent hashing in native expressions.

The walk multiplies 64-bit keys modulo 2**64. Under ANSI rules a long product that overflows is an error, so
keys are kept as two 32-bit halves and multiplied in 16-bit limbs, whose products stay below 2**50.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.llm.common import keep_columns, text_or_empty
from oriel.session import materialise

MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF
#: Rows of one numbering group; groups of a shard are numbered side by side.
SLOT_GROUP_ROWS = 1 << 16


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of key * MULTIPLIER + 1 modulo 2**64."""
    m = [(MULTIPLIER >> s) & 0xFFFF for s in (0, 16, 32, 48)]
    low = lambda c: c.bitwiseAND(F.lit(LOW32))
    up16 = lambda c: F.shiftleft(c.bitwiseAND(F.lit(0xFFFF)), 16)
    first = lo * F.lit(m[0]) + 1
    second = F.shiftright(first, 16) + lo * F.lit(m[1])
    new_lo = up16(second) + first.bitwiseAND(F.lit(0xFFFF))
    cross = low(lo * F.lit(m[2])) + up16(lo * F.lit(m[3])) + low(hi * F.lit(m[0])) + up16(hi * F.lit(m[1]))
    return low(F.shiftright(second, 16) + cross), new_lo


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): buckets of a 64-bit key among ``shards`` and among one more.

    A walk makes ``shards`` + 1 steps at most since each goes to a later bucket. Both numbers come from the same
    walk, so the second differs from the first only where it is the new bucket.
    """
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW32)).alias("lo"),
        F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"), F.lit(0).cast("long").alias("shard"),
    )

    def step(state: Column, _: Column) -> Column:
        hi, lo = _next_key(state["hi"], state["lo"])
        at = state["next"]
        there = F.floor((at + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), at.alias("at"), there.alias("next"), F.when(at < shards, at).otherwise(state["shard"]).alias("shard"))
        return F.when(state["next"] <= shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["at"].cast("int").alias("grown")))


def shard_rows(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place rows in shards by key: key, size, text_crc32, law, shard, slot, grown_shard; other columns follow.

    Columns of ``docs`` with the names of new ones are dropped. A null text has size 8; a null key counts as
    the key 0. Rows with equal keys share a shard and get different slots. Slots are gapless from 0 in each
    shard: a shard's rows are split into groups by hash, groups are counted, and rows numbered in their group,
    so that no task holds a shard. Only narrow rows are grouped and sorted when ``docs`` has no more columns.
    """
    long_key = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    rows = keep_columns(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "_jump", "_group", "_salt", "_salts", "_before", "_rows")
    body = F.encode(text_or_empty(text), "UTF-8")
    jump = F.col("_jump")
    placed = (
        rows.withColumn("size", (F.octet_length(text_or_empty(text)) + 8).cast("long"))
        .withColumn("text_crc32", F.crc32(body))
        .drop(text)
        .withColumn("_jump", jump_shards(long_key, shards))
        .withColumn("law", F.lit("key"))
        .withColumn("shard", jump["shard"])
        .withColumn("grown_shard", jump["grown"])
        .drop("_jump")
    )
    # the number of groups follows the number of rows, read from the table's footers
    groups = max(1, docs.count() // (shards * SLOT_GROUP_ROWS) + 1)
    placed = placed.withColumn("_group", F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(groups)).cast("int"))
    counts = placed.groupBy("shard", "_group").agg(F.count("*").alias("_rows"))
    # a group that is far too large can only hold rows of one key and text: any order among them will do
    heavy = counts.where(F.col("_rows") > 4 * SLOT_GROUP_ROWS).select("shard", "_group", F.ceil(F.col("_rows") / SLOT_GROUP_ROWS).cast("int").alias("_salts"))
    heavy = materialise(heavy, "heavy")
    if heavy.isEmpty():
        placed = placed.withColumn("_salt", F.lit(0))
    else:
        placed = placed.withColumn("_salt", F.monotonically_increasing_id()).join(heavy, ["shard", "_group"], "left")
        placed = placed.withColumn("_salt", F.pmod("_salt", F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    counts = placed.groupBy("shard", "_group", "_salt").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("shard").orderBy("_group", "_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "_group", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("shard", "_group", "_salt").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")) - 1
    out = placed.join(offsets, ["shard", "_group", "_salt"]).withColumn("slot", F.col("_before") + number)
    first = [key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return out.select(*first, *[c for c in rows.columns if c not in {key, text}])
