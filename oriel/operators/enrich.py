"""Enrichers: steps that add to a built graph, each seeing what those before it left."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.functions.text import squeeze
from oriel.operators import closure, constraints, etl
from oriel.session import materialise
from oriel.sources.graph import KEYS, EntityGraph

Enricher = Callable[[EntityGraph], EntityGraph]


def enrich(g: EntityGraph, steps: list[tuple[str, Enricher]], only: list[str] | None = None) -> EntityGraph:
    """``g`` after the steps in order; with ``only``, after those named. A name given twice is an error."""
    names = [n for n, _ in steps]
    if len(set(names)) < len(names) or not set(only or names) <= set(names):
        raise ValueError(f"steps are told by distinct names, of {names}")
    return reduce(lambda out, step: step[1](out) if only is None or step[0] in only else out, steps, g)


def with_names(rows: DataFrame, kind: str = "alias", lang: str = "") -> Enricher:
    """Names (entity_id, value) of entities that are loaded; those that exist stay as they are."""

    def step(g: EntityGraph) -> EntityGraph:
        new = rows.join(g.entities.select("entity_id"), "entity_id", "left_semi").where(F.trim("value") != "")
        new = new.select("entity_id", F.lit(kind).alias("name_kind"), "value", squeeze(F.col("value")).alias("value_norm"), F.lit(lang).alias("lang"), F.lit("").alias("script"), F.lit(False).alias("is_preferred"))
        new = new.groupBy(*KEYS["names"]).agg(F.min("value").alias("value"), F.first("is_preferred").alias("is_preferred")).join(g.names, KEYS["names"], "left_anti")
        return g.with_tables(names=g.names.unionByName(new.select(*g.names.columns)))

    return step


def formal_names(rows: DataFrame) -> Enricher:
    """Long forms of names, and those of them after a comma turned round: "Korea, Republic of" is "Republic of Korea" too."""
    turned = rows.where(F.size(F.split("value", ", ")) == 2).select("entity_id", F.concat(F.split("value", ", ")[1], F.lit(" "), F.split("value", ", ")[0]).alias("value"))
    return with_names(rows.select("entity_id", "value").union(turned), "alias", "en")


def saint_aliases(g: EntityGraph) -> EntityGraph:
    """"St. X" and "St X" for names that begin with "Saint "."""
    saints = g.names.where(F.lower("value").startswith("saint "))
    rows = saints.select("entity_id", F.explode(F.array(*[F.concat(F.lit(p), F.expr("substring(value, 7)")) for p in ("St. ", "St ")])).alias("value"))
    return with_names(rows)(g)


def groups(rows: DataFrame, snapshots: tuple[str, ...] = ()) -> Enricher:
    """Memberships (entity_id, target_id, valid_from, valid_until) of loaded entities in loaded groups; snapshots have no dates."""

    def step(g: EntityGraph) -> EntityGraph:
        ids = g.entities.select("entity_id")
        new = rows.join(ids, "entity_id", "left_semi").join(ids.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
        day = lambda c: F.when(~F.col("target_id").isin(*snapshots), F.col(c).cast("date")) if snapshots else F.col(c).cast("date")
        new = new.select("entity_id", F.lit("member_of").alias("relation_type"), "target_id", day("valid_from").alias("valid_from"), day("valid_until").alias("valid_until"))
        old = g.relations.join(new.select(*KEYS["relations"]), KEYS["relations"], "left_anti").select(*g.relations.columns)
        return g.with_tables(relations=old.union(new.dropDuplicates(KEYS["relations"])))

    return step


def validity(rows: DataFrame) -> Enricher:
    """(entity_id, valid_from, valid_until) of loaded entities; both bounds are set."""
    return lambda g: etl.apply_contribution(g, etl.Contribution(validity=rows))


def without_noise(id_like: list[str], name_like: list[str]) -> Enricher:
    return lambda g: constraints.drop_noise(g, id_like, name_like)


def containment(kinds: list[str], depth: int = 10) -> Enricher:
    """Prominence of containers of some types from that of what they contain."""

    def step(g: EntityGraph) -> EntityGraph:
        # the walk up reads these tables once a level
        g = g.with_tables(entities=materialise(g.entities, "entities"), relations=materialise(g.relations, "relations"))
        of = etl.containment_prominence(g, closure.ancestors(g, g.entities.select("entity_id"), depth))
        own = of.join(g.entities.where(F.col("entity_type").isin(kinds)).select("entity_id"), "entity_id", "left_semi")
        return etl.apply_contribution(g, etl.Contribution(prominence=own))

    return step
