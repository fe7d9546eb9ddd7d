"""Building graphs: contributions, canonical targets, closure, integrity, diffs, prominence, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.session import materialise
from oriel.sources.graph import KEYS, EntityGraph


@dataclass(frozen=True)
class Contribution:
    """Rows to add, ids to delete, validity to set; parts may be None."""

    rows: EntityGraph | None = None
    deletes: DataFrame | None = None
    validity: DataFrame | None = None
    prominence: DataFrame | None = None


def last_wins(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per key: the one with the largest order."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def apply_contribution(g: EntityGraph, c: Contribution) -> EntityGraph:
    """Delete with all rows of an entity, then insert (names and relations that exist stay, entities and codes are replaced), then patch."""
    out = g
    if c.deletes is not None:
        gone = c.deletes.select("entity_id").distinct()
        out = out.map(lambda _, t: t.join(gone, "entity_id", "left_anti"))
        out = out.with_tables(relations=out.relations.join(gone.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti").select(*g.relations.columns))
    if c.rows is not None:
        new = c.rows.tables()

        def insert(name: str, old: DataFrame) -> DataFrame:
            newest = name in ("entities", "codes")
            both = old.withColumn("_o", F.lit(0)).unionByName(new[name].withColumn("_o", F.lit(1)), allowMissingColumns=True)
            return last_wins(both, KEYS[name], F.col("_o") if newest else -F.col("_o")).drop("_o")

        out = out.map(insert)
    entities = out.entities
    if c.validity is not None:  # both bounds are set; unknown entities are passed over
        v = c.validity.select("entity_id", F.col("valid_from").alias("_f"), F.col("valid_until").alias("_u"), F.lit(True).alias("_set"))
        entities = entities.join(v, "entity_id", "left").withColumn("valid_from", F.when(F.col("_set"), F.col("_f")).otherwise(F.col("valid_from"))).withColumn("valid_until", F.when(F.col("_set"), F.col("_u")).otherwise(F.col("valid_until"))).drop("_f", "_u", "_set")
    if c.prominence is not None:
        p = c.prominence.select("entity_id", F.col("prominence").alias("_p"))
        entities = entities.join(p, "entity_id", "left").withColumn("prominence", F.coalesce("_p", "prominence")).drop("_p")
    return out.with_tables(entities=entities.select(*g.entities.columns))


def canonical_targets(relations: DataFrame, mapping: DataFrame, entities: DataFrame, prefixes: list[str]) -> DataFrame:
    """Targets rewritten by (alias, entity_id); loaded targets and those with a kept prefix stay, others go."""
    m = mapping.select(F.col("alias").alias("target_id"), F.col("entity_id").alias("_to"))
    loaded = entities.select(F.col("entity_id").alias("target_id"), F.lit(True).alias("_here"))
    rows = relations.join(m, "target_id", "left").join(loaded, "target_id", "left")
    keep = F.col("_to").isNotNull() | F.coalesce("_here", F.lit(False))
    for p in prefixes:
        keep = keep | F.col("target_id").startswith(p)
    return rows.where(keep).withColumn("target_id", F.coalesce("_to", "target_id")).select(*relations.columns).distinct()


def reconcile(g: EntityGraph, fetch, rounds: int = 4, budget: int = 250_000) -> tuple[EntityGraph, str]:
    """Fetch missing relation targets until none are missing; returns why it stopped: closed, no_progress or budget."""
    for _ in range(rounds):
        missing = materialise(missing_targets(g), "missing")
        n = missing.count()
        if n == 0:
            return g, "closed"
        if n > budget:
            return g, "budget"
        got = fetch(missing)
        if got is None or got.entities.limit(1).isEmpty():
            return g, "no_progress"
        merged = apply_contribution(g, Contribution(rows=got))
        g = merged.map(lambda name, t: materialise(t, f"reconciled-{name}"))
    return g, "closed" if missing_targets(g).limit(1).isEmpty() else "budget"


def missing_targets(g: EntityGraph) -> DataFrame:
    return g.relations.select(F.col("target_id").alias("entity_id")).distinct().join(g.entities.select("entity_id"), "entity_id", "left_anti")


def overlap(a: EntityGraph, b: EntityGraph) -> DataFrame:
    """Ids of entities that both graphs have."""
    return a.entities.select("entity_id").intersect(b.entities.select("entity_id"))


def integrity(g: EntityGraph) -> DataFrame:
    """(check, n): violations of each rule, one row each."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    own = g.entities.agg(F.count_if(blank("entity_id")).alias("blank_id"), F.count_if(blank("canonical_name")).alias("blank_name"), F.count_if(F.col("valid_from") >= F.col("valid_until")).alias("empty_validity"))
    twice = g.entities.groupBy("entity_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_id"))
    orphans = lambda t, k="entity_id": t.select(F.col(k).alias("entity_id")).join(g.entities.select("entity_id"), "entity_id", "left_anti").agg(F.count("*").alias("n"))
    flat = own.crossJoin(twice)
    rows = flat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in flat.columns])).alias("x")).select("x.*")
    for name, t, k in (("orphan_names", g.names, "entity_id"), ("orphan_codes", g.codes, "entity_id"), ("orphan_relations", g.relations, "entity_id"), ("missing_targets", g.relations, "target_id")):
        rows = rows.union(orphans(t, k).select(F.lit(name), "n"))
    return rows


def quality(g: EntityGraph) -> DataFrame:
    """One row: entities, names, codes, relations, names_coverage, codes_coverage, relations_density."""
    e = g.entities.agg(F.count("*").alias("entities"))
    n = g.names.agg(F.count("*").alias("names"), F.count_distinct("entity_id").alias("named"))
    c = g.codes.agg(F.count("*").alias("codes"), F.count_distinct("entity_id").alias("coded"))
    r = g.relations.agg(F.count("*").alias("relations"))
    row = e.crossJoin(n).crossJoin(c).crossJoin(r)
    return row.select("entities", "names", "codes", "relations", (F.col("named") / F.col("entities")).alias("names_coverage"), (F.col("coded") / F.col("entities")).alias("codes_coverage"), (F.col("relations") / F.col("entities")).alias("relations_density"))


def drift(now: DataFrame, before: DataFrame, policy: dict[str, float]) -> DataFrame:
    """(metric, before, now, drop, ok): relative drops of one-row metric tables against the largest allowed."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").cast("double").alias("before"), F.col(f"n.{m}").cast("double").alias("now"), F.lit(float(p)).alias("allowed")) for m, p in policy.items()]
    rows = now.alias("n").crossJoin(before.alias("b")).select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    drop = F.when(F.col("before") > 0, (F.col("before") - F.col("now")) / F.col("before")).otherwise(0.0)
    return rows.withColumn("drop", drop).select("metric", "before", "now", "drop", (F.col("drop") <= F.col("allowed")).alias("ok"))


def diff(new: EntityGraph, old: EntityGraph) -> DataFrame:
    """(table, added, removed, changed): by key; null equals empty; shared columns only."""
    out = None
    for name, key in KEYS.items():
        a, b = new.tables()[name], old.tables()[name]
        rest = [c for c in a.columns if c in b.columns and c not in key]
        flat = lambda t: F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rest]) if rest else F.lit(1)  # noqa: E731, B023
        left = a.select(*key, flat(a).alias("_a"), F.lit(True).alias("_in_a"))
        right = b.select(*key, flat(b).alias("_b"), F.lit(True).alias("_in_b"))
        both = left.join(right, key, "full").agg(F.count_if(F.col("_in_b").isNull()).alias("added"), F.count_if(F.col("_in_a").isNull()).alias("removed"), F.count_if(F.col("_in_a") & F.col("_in_b") & (F.col("_a") != F.col("_b"))).alias("changed"))
        row = both.select(F.lit(name).alias("table"), "added", "removed", "changed")
        out = row if out is None else out.union(row)
    return out


def changelog(changes: DataFrame) -> DataFrame:
    """One rendered line per table with changes."""
    return changes.where("added + removed + changed > 0").select("table", F.format_string("%s: +%d -%d ~%d", "table", "added", "removed", "changed").alias("line"))


def prominence(rows: DataFrame) -> DataFrame:
    """(entity_id, bucket, prominence) of (entity_id, bucket, sitelinks, population).

    Min-max of site links in a bucket; entities without links by log population over all of those; a single
    value gives 0.5.
    """
    links, people = F.col("sitelinks").cast("double"), F.log10(F.col("population") + 1)
    per = rows.groupBy("bucket").agg(F.min(links).alias("_lo"), F.max(links).alias("_hi"))
    rest = rows.where("sitelinks is null").agg(F.min(people).alias("_plo"), F.max(people).alias("_phi"))  # one row
    scaled = lambda x, lo, hi: F.when(F.col(hi) == F.col(lo), 0.5).otherwise((x - F.col(lo)) / (F.col(hi) - F.col(lo)))
    joined = rows.join(per, rows["bucket"].eqNullSafe(per["bucket"])).drop(per["bucket"]).crossJoin(F.broadcast(rest))
    value = F.when(F.col("sitelinks").isNotNull(), scaled(links, "_lo", "_hi")).otherwise(scaled(people, "_plo", "_phi"))
    return joined.select("entity_id", "bucket", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("prominence"))


def containment_prominence(g: EntityGraph, below: DataFrame) -> DataFrame:
    """(entity_id, prominence): sum of members' prominence, min-max per type of container.

    ``below``: (entity_id of a member, ancestor_id), each pair once.
    """
    member = g.entities.where("prominence is not null").select("entity_id", "prominence")
    total = below.select("entity_id", "ancestor_id").distinct().join(member, "entity_id").groupBy("ancestor_id").agg(F.sum("prominence").alias("total"))
    typed = total.join(g.entities.select(F.col("entity_id").alias("ancestor_id"), "entity_type"), "ancestor_id")
    per = typed.groupBy("entity_type").agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("total") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return typed.join(per, "entity_type").select(F.col("ancestor_id").alias("entity_id"), scaled.alias("prominence"))


def spelling_terms(g: EntityGraph) -> DataFrame:
    """(term, n): whole names by their count, and words of names with several, the larger of both counts."""
    whole = g.names.groupBy(F.col("value_norm").alias("term")).agg(F.count("*").alias("n"))
    words = g.names.where(F.instr("value_norm", " ") > 0).select(F.explode(F.split("value_norm", " ")).alias("term")).where(F.length("term") >= 2).groupBy("term").agg(F.count("*").alias("n"))
    return whole.union(words).groupBy("term").agg(F.max("n").alias("n"))


def subset(g: EntityGraph, ids: DataFrame) -> EntityGraph:
    """The graph's rows of some entities."""
    return g.map(lambda _, t: t.join(ids, "entity_id", "left_semi"))


def dependencies(g: EntityGraph, modules: DataFrame) -> DataFrame:
    """(module, needs): modules that relations of (entity_id, module) point into."""
    a = g.relations.join(modules, "entity_id").select("module", "target_id")
    b = modules.select(F.col("entity_id").alias("target_id"), F.col("module").alias("needs"))
    return a.join(b, "target_id").where("module <> needs").select("module", "needs").distinct()


def flatten_bundles(bundles: DataFrame) -> EntityGraph:
    """Nested raw entities (id, type, name, aliases array, codes map, parents array) to rows."""
    none = lambda t: F.lit(None).cast(t)
    entities = bundles.select(F.col("id").alias("entity_id"), F.col("type").alias("entity_type"), F.col("name").alias("canonical_name"), F.lower("name").alias("canonical_name_norm"), none("date").alias("valid_from"), none("date").alias("valid_until"), none("double").alias("prominence"), none("string").alias("country_code")).dropDuplicates(["entity_id"])
    listed = bundles.select(F.col("id").alias("entity_id"), F.lit("canonical").alias("name_kind"), F.col("name").alias("value")).union(bundles.select("id", F.lit("alias"), F.explode("aliases")))
    names = listed.select("*", F.lower("value").alias("value_norm"), F.lit("").alias("lang"), F.lit("").alias("script"), (F.col("name_kind") == "canonical").alias("is_preferred")).dropDuplicates(KEYS["names"])
    codes = bundles.select(F.col("id").alias("entity_id"), F.explode("codes").alias("system", "value")).withColumn("value_norm", F.lower("value")).dropDuplicates(KEYS["codes"])
    relations = bundles.select(F.col("id").alias("entity_id"), F.lit("contained_in").alias("relation_type"), F.explode("parents").alias("target_id"), none("date").alias("valid_from"), none("date").alias("valid_until")).dropDuplicates(KEYS["relations"])
    return EntityGraph(entities, names, codes, relations)
