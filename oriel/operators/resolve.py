"""The resolution cascade over a column of texts: generate, merge, rerank, score, decide, merge packs.

A batch is a DataFrame (qid, text); qid is distinct. Each pack's sources run in order of cost, and texts that
a source decides leave the batch before the next, so that fuzzy joins see what is left. Evidence rows carry
their source's place and their rank in it: order among equals is by those, never by arrival.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.functions import scoring, similarity, text
from oriel.operators import lookup
from oriel.session import materialise
from oriel.sources.graph import EntityGraph

EVIDENCE = ["qid", "source", "source_ord", "entity_id", "raw_score", "rank", "tier", "matched", "bm25", "edit_distance"]
STRUCTURED = ["iso2", "iso3", "iso_numeric", "wikidata", "suppkey", "custkey", "partkey"]


@dataclass(frozen=True)
class Pack:
    """A domain: which entities, how texts become queries, and how candidates are scored and decided."""

    name: str
    prefixes: tuple[str, ...]
    systems: tuple[str, ...]
    name_scores: dict[str, float]
    first_kind_only: bool = False
    acronyms: bool = False
    gated: bool = False
    stops_early: bool = False
    bm25_steps: tuple[float, ...] = (0.85, 0.75, 0.65, 0.55, 0.45)
    least_fts: int = 2
    rerank: tuple[float, float] = (0.6, 0.4)
    threshold: float = 0.7
    gap: float = 0.1
    early: float = 0.9
    calibrated: bool = False
    budget: int = 20
    prefix: int = 7
    snapshots: tuple[str, ...] = field(default=())


GEO = Pack("geo", ("geo.",), ("wikidata", "iso2", "iso3", "iso_numeric"), {"canonical": 1.0, "alias": 0.95, "endonym": 0.95, "exonym": 0.95}, gated=True, stops_early=True, gap=0.07, early=0.75, calibrated=True)
ORG = Pack("org", ("org.",), ("wikidata",), {"canonical": 1.0, "legal": 0.98, "short": 0.95}, first_kind_only=True, acronyms=True, bm25_steps=(0.8, 0.7, 0.6, 0.5, 0.5), least_fts=3, rerank=(0.4, 0.6), prefix=24)
CUSTOM = Pack("custom", ("custom",), (), {"canonical": 1.0, "alias": 0.95}, rerank=(0.5, 0.5))
PACKS = {p.name: p for p in (GEO, ORG, CUSTOM)}


def pack_graph(g: EntityGraph, pack: Pack) -> EntityGraph:
    """The graph's rows of a pack's entities."""
    ids = g.entities.where(lookup.any_prefix(F.col("entity_type"), list(pack.prefixes)))
    keys = ids.select("entity_id")
    return EntityGraph(ids, g.names.join(keys, "entity_id", "left_semi"), g.codes.join(keys, "entity_id", "left_semi"), g.relations)


#: The longest query that is looked at, a feature of its own: a text field pasted whole is no name. A setting of the call.
MOST_CHARACTERS = 1000


def prepare(queries: DataFrame, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """(qid, text, norm): texts cut at ``most_characters``, placeholders and blanks out."""
    cut = queries.select("qid", F.substring("text", 1, most_characters).alias("text"))
    return cut.where(F.trim("text") != "").where(~text.is_sentinel(F.col("text"))).withColumn("norm", text.normalise(F.col("text"))).where("norm is not null")


def gate(q: DataFrame, pack: Pack) -> DataFrame:
    if not pack.gated:
        return q
    t = F.col("text")
    return q.where(~text.is_degenerate(t) & text.short_input_passes(t) & ~text.is_punctuation_noise(t))


def exact_codes(g: EntityGraph, q: DataFrame, pack: Pack) -> DataFrame:
    """The first of the pack's systems with a hit; else any structured system."""
    keyed = q.select("qid", F.explode(text.lookup_values(F.col("text"))).alias("key"))
    hits = keyed.join(g.codes.select("entity_id", "system", "value", F.col("value_norm").alias("key")), "key")
    order = F.lit(len(pack.systems))
    for i, s in reversed(list(enumerate(pack.systems))):
        order = F.when(F.col("system") == s, i).otherwise(order)
    hits = hits.where(F.col("system").isin([*pack.systems, *STRUCTURED])).withColumn("ord", order)
    first = hits.withColumn("best", F.min("ord").over(Window.partitionBy("qid"))).where("ord = best")
    each = first.groupBy("qid", "entity_id").agg(F.min("value").alias("matched"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("entity_id"))
    return evidence(each.withColumn("rank", rank).where(F.col("rank") <= pack.budget), "exact_code", 0, F.lit(1.0), "exact_code")


def exact_names(g: EntityGraph, q: DataFrame, pack: Pack) -> DataFrame:
    """Equal names of the kinds that count, the more specific types and preferred kinds first, within budget."""
    kinds = list(pack.name_scores)
    hits = q.select("qid", "norm").join(g.names.where(F.col("name_kind").isin(kinds)).select("entity_id", "name_kind", "value", F.col("value_norm").alias("norm")), "norm")
    score, order = F.lit(0.0), F.lit(len(kinds))
    for i, k in reversed(list(enumerate(kinds))):
        score = F.when(F.col("name_kind") == k, pack.name_scores[k]).otherwise(score)
        order = F.when(F.col("name_kind") == k, i).otherwise(order)
    hits = hits.withColumn("raw_score", score).withColumn("ord", order)
    if pack.first_kind_only:
        hits = hits.withColumn("best", F.min("ord").over(Window.partitionBy("qid"))).where("ord = best")
    best = hits.groupBy("qid", "entity_id").agg(F.min(F.struct("ord", "value", "raw_score")).alias("b")).select("qid", "entity_id", "b.*")
    typed = best.join(g.entities.select("entity_id", "entity_type", "prominence"), "entity_id", "left")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(scoring.by_type(scoring.SPECIFICITY, 99), F.col("ord") > 0, F.coalesce("prominence", F.lit(0.5)).desc(), "entity_id"))
    return evidence(typed.withColumn("rank", rank).where(F.col("rank") <= pack.budget).withColumn("matched", F.col("value")), "exact_name", 1, F.col("raw_score"), "exact_name")


def acronyms(g: EntityGraph, q: DataFrame, pack: Pack) -> DataFrame:
    like = q.where(text.is_acronym_like(F.col("text")))
    hits = like.join(g.names.where("name_kind = 'acronym'").select("entity_id", "value", F.col("value_norm").alias("norm")), "norm")
    raw = F.when(F.upper("text") == F.col("text"), 1.0).otherwise(0.95)
    each = hits.groupBy("qid", "entity_id", raw.alias("raw_score")).agg(F.min("value").alias("matched"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("entity_id"))
    return evidence(each.withColumn("rank", rank).where(F.col("rank") <= pack.budget), "acronym", 2, F.col("raw_score"), "acronym")


def full_text(g: EntityGraph, q: DataFrame, pack: Pack) -> DataFrame:
    wanted = q.where((F.length("norm") >= pack.least_fts) & text.code_shape(F.col("text")).isNull())
    hits = lookup.full_text(g.names, wanted, pack.budget)
    return evidence(hits.withColumn("matched", F.lit(None).cast("string")), "fts", 3, lookup.bm25_score(F.col("rank"), pack.bm25_steps), "fts", bm25=F.col("bm25"))


#: Beginnings of the types of the small spelling index; the others (districts, cities) are the large one's.
SMALL_TYPES = ("geo.country", "geo.admin1", "geo.region", "geo.subregion", "geo.continent", "geo.continental_union")


def corrections(g: EntityGraph, q: DataFrame, pack: Pack, types: list[str] | None = None) -> DataFrame:
    """Names within two edits of the whole text; closer ones alone for texts of six characters or less.

    The closest are taken of small and of large geographic types each; of the small alone where ``types``, those
    that a query is about, are all small.
    """
    wanted = q.where((F.length("norm") >= 3) & text.code_shape(F.col("text")).isNull())
    tier = g.entities.select("entity_id", (~lookup.any_prefix(F.col("entity_type"), list(SMALL_TYPES)) & F.lit(pack.name == "geo")).alias("large"))
    if types is not None and pack.name == "geo" and all(t.startswith(SMALL_TYPES) for t in types):
        tier = tier.where("not large")
    named = g.names.join(tier, "entity_id").select("entity_id", "value", "large", F.col("value_norm").alias("term"))
    terms = named.select("term", "large").where(F.length("term") >= 2).distinct()
    # equal texts are corrected once, and of a name's entities only as many as the budget can take meet a text
    once = wanted.select("norm").distinct()
    close = lookup.edit_join(terms, once.withColumn("qid", F.col("norm")), exact_distance=similarity.osa_distance, prefix=pack.prefix, within="large").withColumnRenamed("qid", "norm").where("term <> norm and (distance <= 1 or length(norm) > 6)")
    first = named.select("term", "large", "entity_id").withColumn("at", F.dense_rank().over(Window.partitionBy("term", "large").orderBy("entity_id"))).where(F.col("at") <= pack.budget).drop("at")
    each = close.join(first, ["term", "large"]).groupBy("norm", "entity_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("norm").orderBy("distance", "entity_id"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= pack.budget)
    matched = best.join(close.select("norm", "term", "large"), "norm").join(named, ["entity_id", "term", "large"]).groupBy("norm", "entity_id", "distance", "rank").agg(F.min("value").alias("matched"))
    ranked = wanted.select("qid", "norm", F.length("norm").alias("len")).join(matched, "norm")
    raw = F.greatest(F.lit(0.5), 0.9 - 0.15 * F.col("distance"))
    plain = evidence(ranked, "symspell", 4, raw, "fts" if pack.name == "geo" else "fallback", distance=F.col("distance"))
    if pack.name != "geo":
        return plain
    near = ranked.where("distance <= 1 and len >= 5")
    return plain.union(evidence(near, "symspell_exact_name", 5, raw, "exact_name", distance=F.col("distance")))


def evidence(rows: DataFrame, source: str, order: int, raw: Column, tier: str, bm25: Column | None = None, distance: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        "qid", F.lit(source).alias("source"), F.lit(order).alias("source_ord"), "entity_id", raw.cast("double").alias("raw_score"), F.col("rank").cast("int").alias("rank"),
        F.lit(scoring.TIERS[tier]).alias("tier"), F.col("matched"), (none if bm25 is None else bm25).cast("double").alias("bm25"), (none if distance is None else distance).cast("int").alias("edit_distance"),
    )


def generate(g: EntityGraph, queries: DataFrame, pack: Pack, fuzzy: bool = True) -> DataFrame:
    """All evidence of a pack for prepared queries, with early stops."""
    q = gate(queries, pack)
    codes = materialise(exact_codes(g, q, pack), "evidence")
    rest = q.join(codes.where("raw_score >= 0.95").select("qid").distinct(), "qid", "left_anti") if pack.stops_early else q
    named = materialise(exact_names(g, rest, pack), "evidence")
    out = codes.union(named)
    single = named.groupBy("qid").agg(F.count("*").alias("n"), F.max("raw_score").alias("s")).where("n = 1 and s >= 0.9").select("qid")
    if pack.stops_early:
        rest = rest.join(single, "qid", "left_anti")
    if pack.acronyms:
        out = out.union(acronyms(g, rest, pack))
    if fuzzy:
        rest = materialise(rest, "rest")
        out = out.union(full_text(g, rest, pack)).union(corrections(g, rest, pack))
    return out


def candidates(ev: DataFrame) -> DataFrame:
    """One row per query and entity: best evidence (first among equals) and the features that evidence gives."""
    has = lambda *sources: F.max(F.col("source").isin(*sources))
    best = F.max(F.struct("raw_score", -F.col("source_ord"), -F.col("rank"), "source", "rank", "matched"))
    return ev.groupBy("qid", "entity_id").agg(
        best.alias("b"), F.max("tier").alias("tier"), F.max("bm25").alias("bm25"), has("exact_code").alias("exact_code_hit"), has("exact_name", "symspell_exact_name").alias("exact_name_hit"),
        has("acronym").alias("acronym_hit"), F.max((F.col("source") == "acronym") & (F.col("raw_score") == 1.0)).alias("acronym_exact"),
        F.max(F.when(F.col("source") == "fts", F.col("raw_score"))).alias("fts_bm25_norm"), F.max(F.when(F.col("source") == "symspell", F.col("raw_score"))).alias("symspell_edit_norm"),
        F.min("source_ord").alias("first_ord"),
    ).select("*", F.col("b.raw_score").alias("raw"), F.col("b.source").alias("best_source"), F.col("b.rank").alias("best_rank")).drop("b")


def rerank(g: EntityGraph, cands: DataFrame, queries: DataFrame, pack: Pack) -> DataFrame:
    """Best similarity of the query with a candidate's names, for those that no exact evidence decides."""
    open_ = cands.where("not exact_code_hit").select("qid", "entity_id").join(queries.select("qid", "norm"), "qid")
    pairs = open_.join(g.names.select("entity_id", "value_norm"), "entity_id").select("norm", "value_norm").distinct()
    we, wt = pack.rerank
    scored = pairs.withColumn("e", similarity.ratio(F.col("norm"), F.col("value_norm"))).withColumn("t", similarity.token_set_ratio(F.col("norm"), F.col("value_norm")))
    best = open_.join(g.names.select("entity_id", "value_norm"), "entity_id").join(scored, ["norm", "value_norm"]).groupBy("qid", "entity_id").agg(F.max(F.struct((we * F.col("e") + wt * F.col("t")).alias("s"), "e", "t")).alias("x"))
    return add_reranked(cands, best.select("qid", "entity_id", F.col("x.s").alias("rerank_score"), F.col("x.e").alias("fuzzy_edit_sim"), F.col("x.t").alias("fuzzy_token_sim")))


def add_reranked(cands: DataFrame, reranked: DataFrame) -> DataFrame:
    """Candidates with the reranker's similarities; its score replaces their best evidence only where it is greater."""
    rows = cands.join(reranked, ["qid", "entity_id"], "left")
    better = F.coalesce(F.col("rerank_score") > F.col("raw"), F.lit(False))
    rows = rows.withColumn("best_source", F.when(better, "fuzzy").otherwise(F.col("best_source"))).withColumn("best_rank", F.when(better, 1).otherwise(F.col("best_rank")))
    return rows.withColumn("raw", F.when(better, F.col("rerank_score")).otherwise(F.col("raw"))).drop("rerank_score")


def prefix_fallback(g: EntityGraph, q: DataFrame, pack: Pack, discount: float = 0.8) -> DataFrame:
    """Evidence by a text's first four characters, for use where there is no spelling index.

    Entities with a word that begins so, those with fewer words first, then by id, within budget.
    """
    heads = q.select("qid", F.rtrim(F.substring("norm", 1, 4)).alias("norm")).where("norm <> ''")
    # many texts begin alike: a beginning is looked up once
    once = heads.select("norm").distinct()
    hits = lookup.prefix_join(g.names, once).select("norm", "entity_id", "value_norm").union(lookup.infix_join(g.names, once).select("norm", "entity_id", "value_norm"))
    each = hits.groupBy("norm", "entity_id").agg(F.min(F.struct(F.size(F.split("value_norm", " ")).alias("n"), "value_norm")).alias("b")).select("norm", "entity_id", "b.n", F.col("b.value_norm").alias("matched"))
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy("norm").orderBy("n", "entity_id"))).where(F.col("rank") <= pack.budget)
    ranked = heads.join(best, "norm")
    return evidence(ranked, "symspell", 4, discount * lookup.bm25_score(F.col("rank"), pack.bm25_steps), "fts" if pack.name == "geo" else "fallback")


def score(g: EntityGraph, cands: DataFrame, queries: DataFrame, pack: Pack) -> DataFrame:
    """Raw score and confidence of candidates."""
    rows = cands.join(queries.select("qid", "text", "norm"), "qid").join(g.entities.select("entity_id", "entity_type", "prominence"), "entity_id", "left")
    for flag in ("containment_pass", "type_pass", "fuzzy_edit_sim", "fuzzy_token_sim"):
        if flag not in rows.columns:
            rows = rows.withColumn(flag, F.lit(None).cast("boolean" if flag.endswith("pass") else "double"))
    rows = (
        rows.withColumn("query_len", F.length("norm"))
        .withColumn("query_is_upper", F.trim("text").rlike("^[A-Z][A-Z ]*$"))
        .withColumn("hierarchy_rank", scoring.by_type(scoring.HIERARCHY))
        .withColumn("candidate_prominence", F.col("prominence") if pack.name == "geo" else F.lit(None).cast("double"))
    )
    raw = {"geo": scoring.geo_raw, "org": scoring.org_raw, "custom": scoring.custom_raw}[pack.name]()
    rows = rows.withColumn("raw_confidence", raw)
    return rows.withColumn("confidence", scoring.platt(F.col("raw_confidence")) if pack.calibrated else F.col("raw_confidence"))


def decide(scored: DataFrame, queries: DataFrame, pack: Pack) -> DataFrame:
    """(qid, status, entity_id, confidence, tier, reason, n_candidates, top) per query.

    Accepted early with an exact code; too low; a clear gap to the second; else a tie-break: for geography the
    top strictly outranks all close rivals, and a smaller gap does where all candidates are low in the
    hierarchy; for organisations the one close candidate with ``parent_org_match``, if that is given, wins. Ambiguous results have no confidence, too low ones keep theirs.
    """
    order = Window.partitionBy("qid").orderBy(F.col("confidence").desc(), F.col("raw").desc(), "first_ord", "best_rank", "entity_id")
    every = Window.partitionBy("qid")
    ranked = scored.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("confidence").over(order)).withColumn("n_candidates", F.count("*").over(every))
    top_rank = F.max(F.when(F.col("place") == 1, F.col("hierarchy_rank"))).over(every)
    top_conf = F.max(F.when(F.col("place") == 1, F.col("confidence"))).over(every)
    all_low = F.max(F.coalesce("hierarchy_rank", F.lit(1.0))).over(every) <= 0.7
    rival = F.max(F.when((F.col("place") > 1) & (top_conf - F.col("confidence") < pack.gap), F.coalesce("hierarchy_rank", F.lit(0.0)))).over(every)
    ranked = ranked.withColumn("gap_needed", F.when(all_low, 0.03).otherwise(pack.gap) if pack.name == "geo" else F.when(text.is_acronym_like(F.col("text")), 0.15).otherwise(pack.gap) if pack.name == "org" else F.lit(pack.gap))
    ranked = ranked.withColumn("outranks", F.coalesce(top_rank > rival, F.lit(False)) if pack.name == "geo" else F.lit(False))
    if pack.name == "org" and "parent_org_match" in scored.columns:
        # of the close candidates just one belongs to the parent that the context names
        close = (top_conf - F.col("confidence") < F.col("gap_needed")) & F.coalesce("parent_org_match", F.lit(False))
        ranked = ranked.withColumn("n_kin", F.count_if(close).over(every)).withColumn("kin", F.max(F.when(close, F.struct("entity_id", "confidence", "tier"))).over(every))
    else:
        ranked = ranked.withColumn("n_kin", F.lit(0)).withColumn("kin", F.struct("entity_id", "confidence", "tier"))
    listed = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("place", "entity_id", "confidence", "entity_type"))), lambda x: F.struct(x["entity_id"].alias("entity_id"), x["confidence"].alias("confidence"), x["entity_type"].alias("entity_type"))), 1, 10)
    near = ranked.where("place <= 10").groupBy("qid").agg(listed.alias("candidates"))
    top = ranked.where("place = 1")
    gap = F.col("confidence") - F.coalesce("second", F.lit(0.0))
    early = F.col("exact_code_hit") & (F.col("confidence") >= pack.early) & (F.col("n_candidates") == 1)
    status = (
        F.when(early, "resolved").when(F.col("confidence") < pack.threshold, "no_match")
        .when(gap >= F.col("gap_needed"), "resolved").when(F.col("outranks"), "resolved").when(F.col("n_kin") == 1, "kin").otherwise("ambiguous")
    )
    reason = (
        F.when(F.col("status") == "no_match", "below_threshold").when(F.col("status") == "kin", "parent_context").when(F.col("status") == "ambiguous", "low_gap")
        .when(F.col("exact_code_hit"), "exact_code_match").when(F.col("exact_name_hit"), "exact_name_match").when(F.col("acronym_hit"), "acronym_match").otherwise("fuzzy_match")
    )
    top = top.withColumn("status", status).withColumn("reason", reason)
    for c in ("entity_id", "confidence", "tier"):
        top = top.withColumn(c, F.when(F.col("status") == "kin", F.col(f"kin.{c}")).otherwise(F.col(c)))
    top = top.withColumn("status", F.when(F.col("status") == "kin", "resolved").otherwise(F.col("status")))
    out = queries.select("qid").join(top.join(near, "qid"), "qid", "left")
    return out.select(
        "qid", F.lit(pack.name).alias("pack"), F.coalesce("status", F.lit("no_match")).alias("status"), F.when(F.col("status") == "resolved", F.col("entity_id")).alias("entity_id"),
        F.when(F.col("status") != "ambiguous", F.col("confidence")).alias("confidence"), F.when(F.col("status") == "resolved", F.col("tier")).alias("tier"),
        F.coalesce("reason", F.lit("no_candidates")).alias("reason"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.col("confidence").alias("top_confidence"), "candidates",
    )


def resolve_pack(g: EntityGraph, queries: DataFrame, pack: Pack, fuzzy: bool = True, constrain=None) -> DataFrame:
    """One pack's result per prepared query; ``constrain`` filters or flags candidates."""
    own = pack_graph(g, pack)
    ev = materialise(generate(own, queries, pack, fuzzy), "evidence")
    cands = candidates(ev)
    if fuzzy:
        cands = rerank(own, cands, queries, pack)
    if constrain is not None:
        cands = constrain(cands)
    return decide(score(own, cands, queries, pack), queries, pack)


GEO_SUFFIXES = ("land", "stan", "ia", "ica", "ey", "ay")
ORG_WORDS = ("bank", "union", "organization", "foundation", "institute", "fund")


def route(queries: DataFrame) -> DataFrame:
    """(qid, packs): the domains that a text may belong to, within 0.2 of the likeliest."""
    t, low = F.col("text"), F.lower("text")
    upper_share = F.length(F.regexp_replace(t, "[^A-Z]", "")) / F.length(t)
    shape = (
        F.when(t.rlike("^[A-Za-z]{2}$"), 0.3).when(t.rlike("^[A-Za-z]{3}$"), 0.2).when(t.rlike("^[A-Z]{1,5}[0-9]{1,2}$"), 0.15)
        .when(t.rlike(r"^(?:[A-Za-z]\.){1,5}[A-Za-z]?$"), 0.15).when(t.rlike("^[A-Za-z]{4,10}$") & (upper_share >= 0.5), 0.15).otherwise(0.0)
    )
    suffix = F.when(low.rlike("(" + "|".join(GEO_SUFFIXES) + ")$"), 0.25).otherwise(0.0)
    several = F.when(F.instr(t, " ").cast("boolean") & (F.upper(t) != t), 0.1).otherwise(0.0)
    geo = F.least(0.5 + shape + suffix + several, F.lit(1.0))
    org = F.least(0.4 + F.when(text.is_acronym_like(t), 0.35).otherwise(0.0) + F.when(low.rlike("|".join(ORG_WORDS)), 0.2).otherwise(0.0), F.lit(1.0))
    rows = queries.select("qid", F.array(F.struct(F.lit("geo").alias("pack"), geo.alias("s")), F.struct(F.lit("org").alias("pack"), org.alias("s")), F.struct(F.lit("custom").alias("pack"), F.lit(0.05).alias("s"))).alias("x"))
    most = F.array_max(F.transform("x", lambda p: p["s"]))
    return rows.select("qid", F.transform(F.filter("x", lambda p: F.round(p["s"], 6) >= F.round(most - 0.2, 6)), lambda p: p["pack"]).alias("packs"))


def merge_packs(results: DataFrame) -> DataFrame:
    """One result per query of several packs' (qid, pack, status, entity_id, confidence, tier, ...).

    One resolved result wins, unless another pack's ambiguous top is as sure; of several the higher tier wins,
    else a gap of 0.1 is needed; without any, ambiguous goes before no match. Confidences compare on the
    common scale where a pack isn't calibrated.
    """
    own = F.col("top_confidence")
    common = F.when(F.col("pack") == "org", scoring.band(own, "org")).when(F.col("pack") == "custom", scoring.band(own, "custom")).otherwise(own)
    rows = results.withColumn("common", F.coalesce(common, F.lit(0.0)))
    kind = F.when(F.col("status") == "resolved", 0).when(F.col("status") == "ambiguous", 1).otherwise(2)
    order = Window.partitionBy("qid").orderBy(kind, F.coalesce("tier", F.lit(-1)).desc(), F.col("common").desc(), "pack")
    every = Window.partitionBy("qid")
    resolved = F.col("status") == "resolved"
    ranked = (
        rows.withColumn("place", F.row_number().over(order)).withColumn("n_resolved", F.sum(resolved.cast("int")).over(every))
        .withColumn("rival_ambiguous", F.max(F.when(F.col("status") == "ambiguous", F.col("common"))).over(every))
        .withColumn("next_tier", F.lead(F.when(resolved, F.col("tier"))).over(order)).withColumn("next_common", F.lead(F.when(resolved, F.col("common"))).over(order))
    )
    top = ranked.where("place = 1")
    collision = (
        F.when(F.col("n_resolved") == 1, F.coalesce(F.col("rival_ambiguous") >= F.col("common"), F.lit(False)))
        .when(F.col("n_resolved") > 1, (F.col("next_tier") == F.col("tier")) & (F.col("common") - F.col("next_common") < 0.1)).otherwise(F.lit(False))
    )
    top = top.withColumn("collision", F.coalesce(collision, F.lit(False)))
    return top.select(
        "qid", F.when(F.col("collision"), "ambiguous").otherwise(F.col("status")).alias("status"), F.when(~F.col("collision"), F.col("entity_id")).alias("entity_id"), F.when(~F.col("collision"), F.col("confidence")).alias("confidence"),
        F.when(~F.col("collision"), F.col("tier")).alias("tier"), F.when(F.col("collision"), "domain_collision").otherwise(F.col("reason")).alias("reason"), F.when(~F.col("collision") & resolved, F.col("pack")).alias("pack"), "candidates",
    )


def resolve(g: EntityGraph, queries: DataFrame, packs: list[str] | None = None, fuzzy: bool = True) -> DataFrame:
    """Results of (qid, text) over the packs that routing or the caller names."""
    ready = materialise(prepare(queries), "queries")
    routed = route(ready)
    parts = None
    for name, pack in PACKS.items():
        if packs is not None and name not in packs:
            continue
        own = ready if packs is not None else ready.join(routed.where(F.array_contains("packs", name)), "qid", "left_semi")
        result = resolve_pack(g, own, pack, fuzzy)
        parts = result if parts is None else parts.union(result)
    merged = merge_packs(parts)
    none = F.lit("no_match")
    return queries.select("qid", "text").join(merged, "qid", "left").withColumn("status", F.coalesce("status", none)).withColumn("reason", F.coalesce("reason", F.lit("no_candidates")))


def bulk(g: EntityGraph, values: DataFrame, column: str, packs: list[str] | None = None, to: str | None = None, fuzzy: bool = False, crosswalk: DataFrame | None = None, not_found: str = "null", on_ambiguous: str = "null") -> DataFrame:
    """``values`` with entity_id, status, confidence (and ``to``'s code as output), resolving distinct texts once.

    A crosswalk (value, entity_id; null ignores) goes first. ``on_ambiguous``: null, best or raise;
    ``not_found``: null, raise, or a literal for the output.
    """
    distinct = values.select(F.col(column).cast("string").alias("text")).where("text is not null").distinct()
    keyed = distinct.withColumn("qid", F.col("text"))
    decided = None
    if crosswalk is not None:
        given = crosswalk.select(F.col("value").alias("text"), F.col("entity_id"))
        decided = distinct.join(given, "text").select("text", "entity_id", F.when(F.col("entity_id").isNull(), "ignored").otherwise("resolved").alias("status"), F.lit(None).cast("double").alias("confidence"))
        keyed = keyed.join(given, "text", "left_anti")
    result = resolve(g, keyed, packs, fuzzy)
    best = F.col("candidates")[0]["entity_id"]
    chosen = F.when((F.col("status") == "ambiguous"), best if on_ambiguous == "best" else F.lit(None)).otherwise(F.col("entity_id"))
    found = result.select("text", chosen.alias("entity_id"), F.when((F.col("status") == "ambiguous") & chosen.isNotNull(), "resolved").otherwise(F.col("status")).alias("status"), "confidence")
    found = found if decided is None else found.union(decided)
    if on_ambiguous == "raise" and not found.where("status = 'ambiguous'").limit(1).isEmpty():
        raise ValueError("some values are ambiguous")
    if not_found == "raise" and not found.where("status = 'no_match'").limit(1).isEmpty():
        raise ValueError("some values have no match")
    if to is not None:
        codes = g.codes.where(F.col("system") == to).select("entity_id", F.col("value").alias("output"))
        found = found.join(codes, "entity_id", "left").select("text", "entity_id", "status", "confidence", "output")
        if not_found not in ("null", "raise"):
            found = found.withColumn("output", F.when(F.col("status") == "no_match", not_found).otherwise(F.col("output")))
    return values.join(found, values[column].cast("string") == found["text"], "left").drop("text")


def snap(g: EntityGraph, queries: DataFrame, allowed: DataFrame, packs: list[str], most_distance: float = 0.5) -> DataFrame:
    """(qid, entity_id, confidence) of the surest candidate among allowed ids, at least 1 - ``most_distance`` sure."""
    ready = materialise(prepare(queries), "queries")
    parts = None
    for name in packs:
        own = pack_graph(g, PACKS[name])
        limited = own.map(lambda k, t: t if k == "relations" else t.join(allowed, "entity_id", "left_semi"))
        cands = rerank(limited, candidates(materialise(generate(limited, ready, PACKS[name]), "evidence")), ready, PACKS[name])
        rows = score(limited, cands, ready, PACKS[name]).select("qid", "entity_id", "confidence")
        parts = rows if parts is None else parts.union(rows)
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("confidence").desc(), "entity_id"))
    return parts.where(F.col("confidence") >= 1 - most_distance).withColumn("n", best).where("n = 1").drop("n")
