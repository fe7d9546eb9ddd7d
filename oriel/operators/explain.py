"""What follows a decision: tie-breaks among candidates, their order, hints, and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.functions import scoring
from oriel.operators.closure import GROUP_TYPES, parent_context
from oriel.sources.graph import EntityGraph

#: Candidates of a pack and of a result where packs collide.
PER_PACK, AT_MOST = 3, 5


def group_preference(results: DataFrame) -> DataFrame:
    """An ambiguous result of whose first two candidates just one is a group resolves to that group."""
    top = F.slice("candidates", 1, 2)
    groups = F.filter(top, lambda c: c["entity_type"].isin(*GROUP_TYPES))
    wins = (F.col("status") == "ambiguous") & (F.size("candidates") >= 2) & (F.size(groups) == 1)
    wins = F.coalesce(wins, F.lit(False))
    won = results.withColumn("_w", F.when(wins, groups[0]))
    pick = lambda c, field: F.when(F.col("_w").isNotNull(), F.col(f"_w.{field}")).otherwise(F.col(c))
    out = won.withColumn("entity_id", pick("entity_id", "entity_id")).withColumn("confidence", pick("confidence", "confidence"))
    out = out.withColumn("status", F.when(F.col("_w").isNotNull(), "resolved").otherwise(F.col("status")))
    out = out.withColumn("reason", F.when(F.col("_w").isNotNull(), "group_preference_tiebreak").otherwise(F.col("reason")))
    return out.drop("_w")


def _specificity(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in scoring.SPECIFICITY.items() for x in (F.lit(k), F.lit(v))]), kind), F.lit(99))


def specific_first(candidates: Column) -> Column:
    """Candidates by confidence in thousandths, then the more specific type; only where both kinds of types are there."""
    rank = lambda c: F.when(c["entity_type"].isNull(), 99).otherwise(_specificity(c["entity_type"]))
    keyed = F.transform(candidates, lambda c, i: F.struct((-F.round(F.coalesce(c["confidence"], F.lit(0.0)), 3)).alias("k"), rank(c).alias("r"), i.alias("i"), c.alias("c")))
    both = F.exists(candidates, lambda c: rank(c) <= 1) & F.exists(candidates, lambda c: rank(c).between(2, 3))
    return F.when(both, F.transform(F.array_sort(keyed), lambda x: x["c"])).otherwise(candidates)


def interleave(results: DataFrame) -> DataFrame:
    """(qid, candidates) of several packs' results: the surest pack's first, the next one's first, then the seconds.

    ``results``: qid, pack, candidates, and common, the pack's confidence on the common scale. At most three of
    a pack and five in all.
    """
    packs = results.withColumn("_p", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("common").desc(), "pack")))
    each = packs.select("qid", "_p", F.posexplode(F.slice("candidates", 1, PER_PACK)).alias("_at", "c"))
    listed = F.sort_array(F.collect_list(F.struct("_at", "_p", "c")))
    return each.groupBy("qid").agg(F.transform(F.slice(listed, 1, AT_MOST), lambda x: x["c"]).alias("candidates"))


def enrich(g: EntityGraph, results: DataFrame) -> DataFrame:
    """Results whose candidates carry name, type, parent name and parent country; the lists are short, so joined flat."""
    flat = results.select("qid", F.posexplode("candidates").alias("at", "c")).select("qid", "at", F.col("c.entity_id").alias("entity_id"), F.col("c.confidence").alias("confidence"))
    named = flat.join(g.entities.select("entity_id", "canonical_name", "entity_type"), "entity_id", "left").join(parent_context(g), "entity_id", "left")
    listed = F.sort_array(F.collect_list(F.struct("at", "entity_id", "confidence", "canonical_name", "entity_type", "parent_name", "parent_country")))
    each = named.groupBy("qid").agg(F.transform(listed, lambda x: x.dropFields("at")).alias("candidates"))
    return results.drop("candidates").join(each, "qid", "left")


def hints(enriched: DataFrame, context: dict | None = None) -> DataFrame:
    """``enriched`` with refinement_hints: what context would tell apart the candidates of results that aren't resolved."""
    given = context or {}
    kinds = lambda f: F.size(F.array_distinct(F.filter(F.transform("candidates", lambda c: c[f]), lambda x: x.isNotNull())))
    want = [("entity_types", kinds("entity_type") > 1), ("parent_ids", kinds("parent_name") > 1), ("country", kinds("parent_country") > 1)]
    listed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in want if not given.get(name)]))
    none = F.array().cast("array<string>")
    return enriched.withColumn("refinement_hints", F.when((F.col("status") != "resolved") & (F.size("candidates") > 0), listed).otherwise(none))


FEATURES = ("exact_code_hit", "exact_name_hit", "acronym_hit", "fts_bm25_norm", "symspell_edit_norm", "fuzzy_edit_sim", "fuzzy_token_sim", "hierarchy_rank")


def scorecards(scored: DataFrame) -> DataFrame:
    """(qid, winner, alternatives, features) of scored candidates: at most five alternatives, eight features."""
    order = Window.partitionBy("qid").orderBy(F.col("confidence").desc(), "entity_id")
    ranked = scored.withColumn("_n", F.row_number().over(order)).where("_n <= 6")
    features = F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURES]), F.array(*[F.col(f).cast("double") for f in FEATURES]))
    top = F.max(F.when(F.col("_n") == 1, F.struct("entity_id", "confidence", "best_source")))
    others = F.sort_array(F.collect_list(F.when(F.col("_n") > 1, F.struct("_n", "entity_id", "confidence"))))
    of = F.max_by(F.when(F.col("_n") == 1, F.map_filter(features, lambda k, v: v.isNotNull())), -F.col("_n"))
    return ranked.groupBy("qid").agg(top.alias("winner"), F.transform(others, lambda x: x.dropFields("_n")).alias("alternatives"), of.alias("features"))


def render(cards: DataFrame) -> DataFrame:
    """(qid, line): a scorecard in words."""
    others = F.array_join(F.transform("alternatives", lambda a: F.concat(a["entity_id"], F.lit(" "), F.format_number(a["confidence"], 3))), ", ")
    line = F.concat(F.col("winner.entity_id"), F.lit(" "), F.format_number("winner.confidence", 3), F.lit(" by "), F.col("winner.best_source"), F.when(F.size("alternatives") > 0, F.concat(F.lit("; also "), others)).otherwise(F.lit("")))
    return cards.select("qid", line.alias("line"))
