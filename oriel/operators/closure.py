"""Graph questions: membership, containment, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriel.operators.lookup import active
from oriel.session import materialise
from oriel.sources.graph import EntityGraph

GROUP_TYPES = ("geo.organization", "geo.continental_union")


def members_of(g: EntityGraph, group: str, as_of: Column | None = None, snapshots: tuple[str, ...] = (), code_system: str | None = None) -> DataFrame:
    """Distinct members of a group on a day (today, if none is given); snapshot groups are frozen."""
    day = None if group in snapshots else (F.current_date() if as_of is None else as_of)
    ids = g.relations.where((F.col("relation_type") == "member_of") & (F.col("target_id") == group)).where(active(day)).select("entity_id").distinct()
    if code_system is None:
        return ids
    return ids.join(g.codes.where(F.col("system") == code_system), "entity_id").select(F.col("value").alias("code")).distinct()


def is_member(g: EntityGraph, pairs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``pairs`` (entity_id, group_id) with is_member on a day (today, if none is given)."""
    edges = g.relations.where("relation_type = 'member_of'").where(active(F.current_date() if as_of is None else as_of))
    edges = edges.select("entity_id", F.col("target_id").alias("group_id"), F.lit(True).alias("is_member")).distinct()
    return pairs.join(edges, ["entity_id", "group_id"], "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))


def known_groups(g: EntityGraph) -> DataFrame:
    return g.entities.where(F.col("entity_type").isin(*GROUP_TYPES)).select("canonical_name").distinct().orderBy("canonical_name")


def within(g: EntityGraph, container: str, entity_type: str | None = None, max_depth: int | None = None, as_of: Column | None = None, relation: str = "contained_in") -> DataFrame:
    """(entity_id, depth) below a container, breadth first; each entity once, the container never.

    The type filter is on what comes out, so paths go through other types. Frontiers are tables in the shared
    folder: a level is one join, cycles end since visited entities are left out.
    """
    edges = g.relations.where(F.col("relation_type") == relation).where(active(as_of)).select("entity_id", "target_id").distinct()
    spark = g.entities.sparkSession
    seen = frontier = spark.createDataFrame([(container, 0)], "entity_id string, depth int")
    depth, levels = 0, []
    while max_depth is None or depth < max_depth:
        depth += 1
        found = edges.join(frontier.select(F.col("entity_id").alias("target_id")), "target_id").select("entity_id").distinct()
        frontier = materialise(found.join(seen.select("entity_id"), "entity_id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        levels.append(frontier)
    out = spark.createDataFrame([], "entity_id string, depth int")
    for level in levels:
        out = out.union(level)
    if entity_type is not None:
        out = out.join(g.entities.where(F.col("entity_type") == entity_type), "entity_id", "left_semi")
    return out


def ancestors(g: EntityGraph, ids: DataFrame, depth: int, relation: str = "contained_in") -> DataFrame:
    """(entity_id, ancestor_id, depth) up to a fixed depth: that many joins, smallest depth of each pair."""
    edges = g.relations.where(F.col("relation_type") == relation).select(F.col("entity_id").alias("_from"), F.col("target_id").alias("_to")).distinct()
    level = ids.select("entity_id", F.col("entity_id").alias("ancestor_id")).distinct()
    out = None
    for d in range(1, depth + 1):
        level = level.join(edges, level["ancestor_id"] == edges["_from"]).select("entity_id", F.col("_to").alias("ancestor_id")).distinct()
        own = level.withColumn("depth", F.lit(d))
        out = own if out is None else out.union(own)
    return out.groupBy("entity_id", "ancestor_id").agg(F.min("depth").alias("depth"))


def related(g: EntityGraph, relation: str, as_of: Column | None = None) -> DataFrame:
    """Forward edges whose target is loaded."""
    edges = g.relations.where(F.col("relation_type") == relation).where(active(as_of)).select("entity_id", "target_id").distinct()
    return edges.join(g.entities.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi").select("entity_id", "target_id")


def unresolved_relations(g: EntityGraph) -> DataFrame:
    """Edges whose target isn't loaded."""
    return g.relations.join(g.entities.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti").select("entity_id", "relation_type", "target_id")


def country_of(g: EntityGraph, most: int = 5) -> DataFrame:
    """(entity_id, iso2) of the nearest ancestor with a two-letter code; null for countries and others without."""
    iso2 = g.codes.where("system = 'iso2' and length(value) = 2").select(F.col("entity_id").alias("ancestor_id"), F.col("value").alias("iso2"))
    near = ancestors(g, g.entities.where("entity_type <> 'geo.country'").select("entity_id"), most).join(iso2, "ancestor_id")
    best = near.groupBy("entity_id").agg(F.min(F.struct("depth", "iso2"))["iso2"].alias("iso2"))
    return g.entities.select("entity_id").join(best, "entity_id", "left")


def parent_context(g: EntityGraph) -> DataFrame:
    """(entity_id, parent_name, parent_country) for display: the first parent by id, and its own or its parent's country code."""
    parent = g.relations.where(F.col("relation_type").isin("contained_in", "part_of")).groupBy("entity_id").agg(F.min("target_id").alias("parent_id"))
    up = parent.select(F.col("entity_id").alias("parent_id"), F.col("parent_id").alias("grand_id"))
    iso2 = g.codes.where("system = 'iso2'").select(F.col("entity_id").alias("_i"), F.col("value").alias("iso2"))
    named = g.entities.select(F.col("entity_id").alias("parent_id"), F.col("canonical_name").alias("parent_name"))
    own, of_parent, of_grand = (iso2.select(F.col("_i").alias(k), F.col("iso2").alias(v)) for k, v in (("entity_id", "c0"), ("parent_id", "c1"), ("grand_id", "c2")))
    rows = g.entities.select("entity_id", "country_code").join(parent, "entity_id", "left").join(up, "parent_id", "left").join(named, "parent_id", "left")
    rows = rows.join(own, "entity_id", "left").join(of_parent, "parent_id", "left").join(of_grand, "grand_id", "left")
    return rows.select("entity_id", "parent_name", F.coalesce("c0", "country_code", "c1", "c2").alias("parent_country"))
