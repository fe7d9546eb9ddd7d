"""A corpus pipeline: toxicity, near-duplicates, benchmark leaks, source weights, token ids.

Each stage is written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm import idfile, jaccard, mixing, tiling, toxicity
from oriel.llm.common import looked_up, numbered, with_plain_names
from oriel.llm.queries import tokenizer_path
from oriel.session import materialise, release, step, table, workers_see_package


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model fitted on the labels of ``sf_dir``."""
    workers_see_package(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return with_plain_names(docs, lambda d: toxicity.score(d, model, whole_rows=True).where("score < 0.5"), "doc_id", "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one row, that with the smallest id (then text hash); rows without an id stay.

    Texts are linked when their sets of 5-word shingles have a Jaccard similarity of 0.8 or more; equal ids link nothing.
    SimHash's covering masks and MinHash bands find the pairs that are compared.
    """
    workers_see_package(spark)

    def choose(docs: DataFrame) -> DataFrame:
        rows = materialise(numbered(docs), "rows")
        order = F.struct(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("hash"), F.col("_row").alias("row"))
        placed = materialise(rows.where("doc_id is not null").select("_row", order.alias("o")).join(jaccard.groups(rows).withColumnRenamed("row", "_row"), "_row"), "placed")
        first = placed.groupBy("component").agg(F.min("o").alias("first"))
        others = placed.join(first, "component").where("o.row <> first.row").select("_row", F.lit(1).alias("other"))
        return looked_up(rows, others, "_other").where("_other is null").drop("_row", "_other")

    return with_plain_names(docs, choose, "doc_id", "text")


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no test item."""
    workers_see_package(spark)
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    workers_see_package(spark)
    return with_plain_names(docs, lambda d: mixing.emit(mixing.mix(d)), "doc_id", "text", "source")


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in plane files, and what reading them back gives: doc_id, start, n_tokens, ids_crc32."""
    workers_see_package(spark)
    return idfile.roundtrip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", one_of_each_group),
    ("decontamination", without_leaks),
    ("mixing", to_target_weights),
    ("token_ids", to_token_ids),
]

#: Fingerprints, tiles, scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = None
    for name, stage in STAGES[:-1]:
        with step(spark) as kept:
            docs, before = materialise(stage(spark, docs, sf_dir), f"stage-{name}"), done
            kept.append(docs)
        if before is not None:
            release(before)
        done = docs
    name, stage = STAGES[-1]  # its files of ids stay
    docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    release(done)
    return docs
