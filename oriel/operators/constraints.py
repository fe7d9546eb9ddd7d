"""Constraints on candidates. Hard ones filter; soft ones add a nullable column that scoring reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriel.operators.closure import ancestors
from oriel.operators.lookup import active
from oriel.session import materialise
from oriel.sources.graph import EntityGraph

COMPATIBLE = {
    "geo.city": ["geo.admin1", "geo.admin2", "geo.admin3", "geo.admin4", "geo.admin5"],
    "geo.continental_union": ["geo.organization"],
    "geo.region": ["geo.organization"],
}


def type_filter(candidates: DataFrame, g: EntityGraph, requested: list[str]) -> DataFrame:
    """Candidates of a requested or compatible type, with type_pass; entities that aren't loaded stay with null."""
    allowed = sorted({*requested, *(t for r in requested for t in COMPATIBLE.get(r, []))})
    types = g.entities.select("entity_id", F.col("entity_type").alias("_type"))
    out = candidates.join(types, "entity_id", "left").withColumn("type_pass", F.col("_type").isin(allowed))
    return out.where(F.col("type_pass").isNull() | F.col("type_pass")).drop("_type")


def temporal_filter(candidates: DataFrame, g: EntityGraph, as_of: Column) -> DataFrame:
    """Candidates valid on a day, with temporal_pass."""
    dates = g.entities.select("entity_id", "valid_from", "valid_until")
    out = candidates.join(dates, "entity_id", "left").withColumn("temporal_pass", active(as_of))
    return out.where("temporal_pass").drop("valid_from", "valid_until")


def containment_filter(candidates: DataFrame, g: EntityGraph, parent_ids: list[str], depth: int = 3) -> DataFrame:
    """Candidates with a given ancestor within ``depth`` levels; a parent isn't its own descendant."""
    below = ancestors(g, candidates.select("entity_id"), depth).where(F.col("ancestor_id").isin(parent_ids)).select("entity_id")
    return candidates.join(below, "entity_id", "left_semi").withColumn("containment_pass", F.lit(True))


def membership_flag(candidates: DataFrame, g: EntityGraph, group: str, as_of: Column | None = None, name: str = "membership_pass") -> DataFrame:
    members = g.relations.where((F.col("relation_type") == "member_of") & (F.col("target_id") == group)).where(active(as_of)).select("entity_id", F.lit(True).alias(name)).distinct()
    return candidates.join(members, "entity_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def parent_org_flag(candidates: DataFrame, g: EntityGraph, parent_ids: list[str]) -> DataFrame:
    """parent_org_match: a subsidiary or member of one of the given organisations."""
    kin = g.relations.where(F.col("relation_type").isin("subsidiary_of", "member_of") & F.col("target_id").isin(parent_ids)).select("entity_id", F.lit(True).alias("parent_org_match")).distinct()
    return candidates.join(kin, "entity_id", "left").withColumn("parent_org_match", F.coalesce("parent_org_match", F.lit(False)))


def country_flag(candidates: DataFrame, g: EntityGraph, country: str) -> DataFrame:
    """country_match: null where an entity has no country; three-letter hints go by their code table."""
    own = g.entities.select("entity_id", "country_code")
    if len(country) == 3:
        iso3 = g.codes.where((F.col("system") == "iso3") & (F.col("value_norm") == country.lower())).select("entity_id")
        hint = g.codes.where("system = 'iso2'").join(iso3, "entity_id", "left_semi").agg(F.min("value").alias("_hint"))
    else:
        hint = g.entities.sparkSession.range(1).select(F.lit(country.upper()).alias("_hint"))
    return candidates.join(own, "entity_id", "left").crossJoin(F.broadcast(hint)).withColumn("country_match", F.col("country_code") == F.col("_hint")).drop("country_code", "_hint")


def select_entities(g: EntityGraph, include_types: list[str] | None = None, include_ids: list[str] | None = None, exclude_ids: list[str] | None = None, expand: str | None = None) -> DataFrame:
    """Ids an export takes: by type or id, without some, and the targets of one relation of those."""
    keep = F.lit(True)
    if include_types:
        keep = F.col("entity_type").isin(include_types)
    if include_ids:
        keep = keep | F.col("entity_id").isin(include_ids) if include_types else F.col("entity_id").isin(include_ids)
    ids = g.entities.where(keep).select("entity_id")
    if expand:
        ids = ids.union(g.relations.where(F.col("relation_type") == expand).join(ids, "entity_id", "left_semi").select(F.col("target_id").alias("entity_id")))
    out = ids.distinct().join(g.entities.select("entity_id"), "entity_id", "left_semi")
    return out.where(~F.col("entity_id").isin(exclude_ids)) if exclude_ids else out


def drop_noise(g: EntityGraph, id_like: list[str], name_like: list[str]) -> EntityGraph:
    """Without entities whose id or name is like a pattern, and all rows of them in the other tables."""
    noisy = F.lit(False)
    for p in id_like:
        noisy = noisy | F.col("entity_id").like(p)
    for p in name_like:
        noisy = noisy | F.col("canonical_name").like(p)
    gone = materialise(g.entities.where(noisy).select("entity_id"), "noise")  # written, its size is known: a few ids move no other table
    out = g.map(lambda _, t: t.join(gone, "entity_id", "left_anti"))
    return out.with_tables(relations=out.relations.join(gone.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti").select(*g.relations.columns))
