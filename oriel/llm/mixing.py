"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.llm.common import keep_columns, text_or_empty
from oriel.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose rate table is broadcast; with more, rows are joined on salted sources instead.
BROADCAST_SOURCES = 100_000
SALTS = 64
CAP = 3


def words(text: Column) -> Column:
    """Number of words: maximal runs of characters other than ASCII white space."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_rates(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """Targets and repetition rates of sources from (source, size) rows.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes. A target stops at
    ``cap`` times its source's size and the excess goes to the others by weight until none is above. That is
    filling to one level: with sources in order of cap * size / weight, the first k are full, and k is the
    first number for which the level of the rest is within the next one's cap. One pass over sources, whose
    number is small beside the documents'; sums are of integers, so reruns agree exactly.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    full_at = Window.orderBy(F.col("full_level"), F.col("source").isNull(), F.col("source"))
    before = full_at.rowsBetween(Window.unboundedPreceding, -1)
    every = full_at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = weighed.withColumn("full_level", F.col("source_size").cast("double") * cap / F.col("weight"))
    filled = (
        filled.withColumn("rest", F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("rest").cast("double") / F.col("rest_weight"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_level"), F.struct("full_level", "level"))).over(every)["level"])
    )
    most = (F.col("source_size") * cap).cast("double")
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("level") * F.col("weight"), most))
    out = filled.withColumn("target", target)
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= most, F.lit(float(cap))).otherwise(F.col("target") / F.col("source_size"))
    return out.select("source", "source_size", "weight", "target", rate.alias("rate"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1") -> DataFrame:
    """``docs`` with its mix: size, source_size, target, rate, copies, taken (words taken, repeats counted).

    A row is taken floor(rate) times, and once more with probability rate - floor(rate), decided by a hash of
    seed, key and text: reruns agree, and rows with equal keys but other texts are independent. Null texts
    have size 0 and may be taken too. Rows keep all columns but those whose names the mix takes.
    """
    rows = keep_columns(docs, "size", "source_size", "target", "rate", "copies", "taken", "_salt", "_u")
    sized = rows.withColumn("size", words(F.col(text)))
    rates = materialise(source_rates(sized.select(F.col(source).cast("string").alias("source"), "size")), "rates")
    rates = rates.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    same = sized[source].cast("string").eqNullSafe(rates["_source"])
    if rates.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(rates), same)
    else:
        salted = sized.withColumn("_salt", F.pmod(F.xxhash64(key, text), F.lit(SALTS)).cast("int"))
        spread = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, salted[source].cast("string").eqNullSafe(spread["_source"]) & (salted["_salt"] == spread["_salt"])).drop("_salt")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(text_or_empty(text))))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") / float(1 << 48)
    copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    return joined.drop("_source").withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy: documents that aren't taken go, others come ``copies`` times."""
    copies = F.when(F.col("copies") > 0, F.array_repeat(F.lit(1), F.col("copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return mixed.withColumn("_copy", F.explode(copies)).drop("_copy")
