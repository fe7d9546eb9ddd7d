"""Staged builds with resume, merges into a shared store, and discovery level by level."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.operators import etl
from oriel.operators.numbering import numbered
from oriel.session import materialise
from oriel.sources.graph import EntityGraph

Stage = tuple[str, Callable[[EntityGraph], EntityGraph]]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_stages(g: EntityGraph, stages: list[Stage], path: str) -> tuple[EntityGraph, list[str]]:
    """Apply stages in order, each one's graph written below ``path``; returns the last and the names that ran.

    A stage whose mark is there isn't run again: a build that failed goes on where it stopped. The mark is
    written last.
    """
    spark, ran = g.entities.sparkSession, []
    for i, (name, stage) in enumerate(stages):
        at = f"{path}/{i:02d}-{name}"
        if not exists(spark, f"{at}/done"):
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(at)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
            stage(g).write(at)
            spark.range(0).write.parquet(f"{at}/done")
            ran.append(name)
        g = EntityGraph.read(spark, at)
    return g, ran


def fetch_all(ids: DataFrame, fetch: Callable[[DataFrame], DataFrame], most_retries: int = 5, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame, str]:
    """(rows, ids without rows, why it ended) of ``fetch`` asked again and again for the ids it gave nothing for.

    ``fetch`` takes (entity_id) and returns rows with that column; how it cuts ids into requests is the affair of its
    partitions, which Spark runs in parallel and repeats where a task fails. Waits double with each round. It ends
    when nothing is left (done), a round gives nothing new (no_progress), or after ``most_retries`` (retries).
    """
    left, rows = materialise(ids.select("entity_id").distinct(), "asked"), None
    for n in range(most_retries + 1):
        if n:
            sleep(wait * 2 ** (n - 1))
        got = materialise(fetch(left).join(left, "entity_id", "left_semi"), "fetched")
        if got.isEmpty():
            return (rows if rows is not None else got), left, "no_progress"
        rows = got if rows is None else rows.unionByName(got)
        left = materialise(left.join(got.select("entity_id"), "entity_id", "left_anti"), "asked")
        if left.isEmpty():
            return rows, left, "done"
    return rows, left, "retries"


def merge_types(store: EntityGraph, new: EntityGraph, types: list[str]) -> EntityGraph:
    """A shared store whose entities of ``types`` are replaced by those of ``new``; relations left without an end go."""
    gone = store.entities.where(F.col("entity_type").isin(types)).select("entity_id")
    ids = new.entities.where(F.col("entity_type").isin(types)).select("entity_id")
    kept = store.map(lambda _, t: t.join(gone, "entity_id", "left_anti"))
    own = etl.subset(new, ids)
    out = EntityGraph(**{k: t.unionByName(own.tables()[k]) for k, t in kept.tables().items()})
    target = out.entities.select(F.col("entity_id").alias("target_id"))
    return out.with_tables(relations=out.relations.join(target, "target_id", "left_semi").select(*store.relations.columns))


def discover(children: DataFrame, seeds: DataFrame, most_levels: int = 8) -> DataFrame:
    """(entity_id, level, place) walking (parent_id, entity_id) from seeds, level by level, each entity once.

    ``place`` is the order of discovery in a level: by the place of the parent, then by id. Levels are tables in
    the shared folder; the numbering of a level goes through ranges, not through one task.
    """
    level = materialise(numbered(seeds.select("entity_id").distinct(), [F.col("entity_id")]).withColumn("level", F.lit(0)), "level")
    out, seen = level.select("entity_id", "level", "place"), level.select("entity_id")
    for n in range(1, most_levels + 1):
        found = children.join(level.select(F.col("entity_id").alias("parent_id"), F.col("place").alias("_p")), "parent_id").groupBy("entity_id").agg(F.min("_p").alias("_p"))
        found = found.join(seen, "entity_id", "left_anti")
        level = materialise(numbered(found, [F.col("_p"), F.col("entity_id")]).drop("_p").withColumn("level", F.lit(n)), "level")
        if level.isEmpty():
            break
        seen, out = seen.union(level.select("entity_id")), out.union(level.select("entity_id", "level", "place"))
    return out


def org_rows(orgs: DataFrame) -> EntityGraph:
    """A graph of organisation records: id, name, acronym, short, legal, parent_id, country, and codes (a map)."""
    none = lambda t: F.lit(None).cast(t)
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    entities = orgs.select(F.col("id").alias("entity_id"), F.lit("org.company").alias("entity_type"), F.col("name").alias("canonical_name"), norm("name").alias("canonical_name_norm"), none("date").alias("valid_from"), none("date").alias("valid_until"), none("double").alias("prominence"), F.col("country").alias("country_code"))
    kinds = F.array(*[F.struct(F.lit(k).alias("name_kind"), F.col(c).alias("value")) for k, c in (("canonical", "name"), ("acronym", "acronym"), ("short", "short"), ("legal", "legal"))])
    names = orgs.select(F.col("id").alias("entity_id"), F.explode(kinds).alias("x")).select("entity_id", "x.*").where("value is not null")
    names = names.select("*", norm("value").alias("value_norm"), F.lit("").alias("lang"), F.lit("").alias("script"), (F.col("name_kind") == "canonical").alias("is_preferred"))
    codes = orgs.select(F.col("id").alias("entity_id"), F.explode("codes").alias("system", "value")).withColumn("value_norm", F.lower("value"))
    relations = orgs.where("parent_id is not null").select(F.col("id").alias("entity_id"), F.lit("subsidiary_of").alias("relation_type"), F.col("parent_id").alias("target_id"), none("date").alias("valid_from"), none("date").alias("valid_until"))
    return EntityGraph(entities, names, codes, relations)
