"""Queries of single parts: similarities, offsets, evidence, decisions, and the steps of a build."""

from __future__ import annotations

from pyspark.sql import functions as F

from oriel.functions import scoring, similarity, text
from oriel.operators import build, constraints, enrich, etl, lookup, parse, spelling, suggest
from oriel.operators import resolve as cascade
from oriel.plans.oracle_graph import indel, lcs, partial, sql, squeeze, token_set
from oriel.plans.outputs import COUNTED, PLACES, custom_terms, part_typos, table_counts
from oriel.plans.queries import HITS, NORM, SUGGEST, TYPOS, graph, hits, query
from oriel.session import scratch, table
from oriel.sources import packs, records

# --- text --------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT w AS word, strip_accents(replace(lower(w), 'ß', 'ss')) AS folded, array_to_string(flatten(list_transform(range(1, length(w) + 1), lambda i: CASE WHEN w[i] = 'ß' THEN [i - 1, i - 1] ELSE [i - 1] END)), ',') AS offsets
FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}]+')) AS w FROM conversations UNION ALL SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}]+')) FROM documents)""")
def t6_fold_with_offsets(spark, d):
    words = lambda t: table(spark, d, t).select(F.explode(F.expr(r"regexp_extract_all(text, '[\\p{L}]+', 0)")).alias("word"))
    f = words("conversations").union(words("documents")).distinct().withColumn("f", text.fold_with_offsets(F.col("word")))
    return f.select("word", F.col("f.text").alias("folded"), F.array_join("f.offsets", ",").alias("offsets"))


RAGGED = "ragged AS (SELECT DISTINCT '  ' || replace(replace(value, ' ', '   '), '#', ' #') || ' ' AS raw FROM names)"


@query(sql(f"""SELECT raw, {squeeze('raw')} AS text, array_to_string(list_transform(k, lambda i: i - 1), ',') AS "start", array_to_string(list_concat(list_transform(range(2, len(k) + 1), lambda j: CASE WHEN raw[k[j - 1]] = ' ' THEN k[j] - 1 ELSE k[j - 1] END), [k[len(k)]]), ',') AS "end"
FROM (SELECT raw, list_filter(range(1, length(raw) + 1), lambda i: raw[i] <> ' ' OR (i > 1 AND raw[i - 1] <> ' ' AND trim(substr(raw, i)) <> '')) AS k FROM ragged)""", RAGGED))
def t7_aligned_text(spark, d):
    raw = graph(spark, d).names.selectExpr("concat('  ', replace(replace(value, ' ', '   '), '#', ' #'), ' ') as raw").distinct()
    a = raw.withColumn("a", text.align(F.col("raw")))
    return a.select("raw", "a.text", F.array_join("a.start", ",").alias("start"), F.array_join("a.end", ",").alias("end"))


@query(sql("SELECT raw, len(list_filter(string_split(raw, ' '), lambda x: x <> '')) AS n, array_to_string(list_filter(string_split(raw, ' '), lambda x: x <> ''), '|') AS tokens FROM ragged", RAGGED))
def t8_tokens(spark, d):
    raw = graph(spark, d).names.selectExpr("concat('  ', replace(replace(value, ' ', '   '), '#', ' #'), ' ') as raw").distinct()
    w = raw.withColumn("w", text.tokenise(F.col("raw")))
    return w.select("raw", F.size("w").cast("long").alias("n"), F.array_join("w", "|").alias("tokens"))


@query(sql("SELECT DISTINCT upper(a.value) AS iso3, upper(b.value) AS iso2 FROM codes a JOIN codes b ON a.entity_id = b.entity_id AND a.system = 'iso3' AND b.system = 'iso2'"))
def t17_iso3_to_iso2(spark, d):
    return lookup.iso3_to_iso2(graph(spark, d))


@query(sql("""SELECT value, query, fuzzy, CASE WHEN NOT fuzzy AND query <> '' AND strpos(lower(value), query) > 0 THEN (strpos(lower(value), query) - 1) || '-' || (strpos(lower(value), query) - 1 + length(query)) END AS range
FROM (SELECT DISTINCT value, CASE WHEN value LIKE '%9' THEN 'zz' ELSE lower(substr(value, 3, 5)) END AS query, value LIKE '%7' AS fuzzy FROM names)"""))
def t22_highlights(spark, d):
    n = graph(spark, d).names.selectExpr("value", "case when value like '%9' then 'zz' else lower(substr(value, 3, 5)) end as query", "value like '%7' as fuzzy").distinct()
    h = n.withColumn("h", text.highlight(F.col("query"), F.col("value"), F.col("fuzzy")))
    return h.select("value", "query", "fuzzy", F.concat("h.start", F.lit("-"), "h.end").alias("range"))


# --- similarities --------------------------------------------------------------------------------------------------

NEAR = "near AS (SELECT DISTINCT norm AS a, lower(p_name) AS b FROM typo JOIN part ON p_partkey BETWEEN qid AND qid + 3)"


def near(spark, d):
    """(a, b): each misspelt part name with the names of its part and of the three parts after it."""
    k = F.explode(F.sequence(F.col("qid"), F.col("qid") + 3)).alias("p_partkey")
    names = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("b"))
    return part_typos(spark, d).select(F.col("norm").alias("a"), k).join(names, "p_partkey").select("a", "b").distinct()


@query(sql(f"SELECT a, b, round({indel('a', 'b')}, 9) AS ratio FROM near", TYPOS, NEAR))
def f1_ratio(spark, d):
    return near(spark, d).withColumn("ratio", F.round(similarity.ratio(F.col("a"), F.col("b")), 9))


@query(sql(f"SELECT a, b, round(token_set, 9) AS ratio FROM ({token_set('near', 'a', 'b', 'a', 'b')})", TYPOS, NEAR))
def f2_token_set_ratio(spark, d):
    return near(spark, d).withColumn("ratio", F.round(similarity.token_set_ratio(F.col("a"), F.col("b")), 9))


@query(sql(f"SELECT a, b, round({partial('s', 'l')}, 9) AS ratio FROM (SELECT a, b, CASE WHEN length(a) > length(b) THEN b ELSE a END AS s, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l FROM near)", TYPOS, NEAR))
def f3_partial_ratio(spark, d):
    return near(spark, d).withColumn("ratio", F.round(similarity.partial_ratio(F.col("a"), F.col("b")), 9))


@query("SELECT DISTINCT l_extendedprice AS bm25, round(least(ln(1 + abs(l_extendedprice)) / ln(51), 1), 9)::DOUBLE AS feature FROM lineitem")
def f8_bm25_feature(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("bm25")).distinct().withColumn("feature", F.round(scoring.bm25_feature(F.col("bm25")), 9))


# --- joins and sets --------------------------------------------------------------------------------------------------


@query(sql("SELECT o_orderkey, entity_id, target_id FROM orders JOIN relations ON entity_id = 'org/cust-' || o_custkey WHERE relation_type IN ('member_of', 'contained_in') AND (valid_from IS NULL OR valid_from <= CAST(o_orderdate AS DATE) + 1) AND (valid_until IS NULL OR CAST(o_orderdate AS DATE) + 1 < valid_until)"))
def j17_valid_at(spark, d):
    """Orders with what held of their customer the day after: an interval join."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("org/cust-"), "o_custkey").alias("customer"), F.date_add(F.to_date("o_orderdate"), 1).alias("day"))
    rows = graph(spark, d).relations.where(F.col("relation_type").isin("member_of", "contained_in"))
    return lookup.valid_at(o, "customer", "day", rows).select("o_orderkey", "entity_id", "target_id")


@query(sql("""SELECT qid, entity_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY list, spot, entity_id) AS INT) AS place FROM (SELECT qid, entity_id, min(list) AS list, arg_min(spot, list) AS spot FROM (
SELECT p_type AS qid, 'custom/part-' || p_partkey AS entity_id, 0 AS list, p_size AS spot FROM part WHERE p_partkey % 3 < 2 UNION ALL SELECT p_type, 'custom/part-' || p_partkey, 1, p_partkey FROM part WHERE p_partkey % 3 > 0) GROUP BY 1, 2)"""))
def o2_first_seen(spark, d):
    part = table(spark, d, "part")
    own = lambda at, where: part.where(where).select(F.col("p_type").alias("qid"), F.concat(F.lit("custom/part-"), "p_partkey").alias("entity_id"), F.col(at).alias("place"))
    return lookup.union_first_seen(own("p_size", "p_partkey % 3 < 2"), own("p_partkey", "p_partkey % 3 > 0"))


@query(sql("SELECT DISTINCT target_id AS entity_id FROM relations WHERE target_id NOT IN (SELECT entity_id FROM entities WHERE entity_id NOT LIKE 'country/1%')"))
def o3_missing_targets(spark, d):
    g = graph(spark, d)
    return etl.missing_targets(g.with_tables(entities=g.entities.where("entity_id not like 'country/1%'")))


@query(sql("SELECT entity_id FROM entities WHERE entity_type LIKE 'geo.%' AND entity_id NOT LIKE '%/1%'"))
def o4_overlap(spark, d):
    g = graph(spark, d)
    return etl.overlap(cascade.pack_graph(g, cascade.GEO), g.with_tables(entities=g.entities.where("entity_id not like '%/1%'")))


@query(sql("SELECT qid, entity_id, true AS type_pass, true AS temporal_pass FROM hits JOIN entities USING (entity_id) WHERE entity_type = 'org.company' AND (valid_from IS NULL OR valid_from <= DATE '1991-06-01') AND (valid_until IS NULL OR DATE '1991-06-01' < valid_until)", NORM, HITS))
def p7_org_constraints(spark, d):
    g = graph(spark, d)
    rows = constraints.type_filter(hits(spark, d, g), g, ["org.company"])
    return constraints.temporal_filter(rows, g, F.lit("1991-06-01").cast("date")).select("qid", "entity_id", "type_pass", "temporal_pass")


@query(sql("SELECT DISTINCT entity_type, CASE WHEN entity_type IN ('geo.country', 'geo.region') THEN 'ranked' ELSE 'unranked' END AS quality FROM entities UNION ALL VALUES ('geo.admin1', 'ranked'), ('geo.admin1.x', 'ranked'), ('geo.countryside', 'unranked'), (NULL, 'unranked')"))
def u2_ranking_quality(spark, d):
    more = spark.createDataFrame([("geo.admin1",), ("geo.admin1.x",), ("geo.countryside",), (None,)], "entity_type string")
    kinds = graph(spark, d).entities.select("entity_type").distinct().union(more)
    return kinds.withColumn("quality", suggest.ranking_quality(F.col("entity_type")))


# --- evidence ----------------------------------------------------------------------------------------------------

EVIDENCE = """ev AS (SELECT l_orderkey AS qid, l_suppkey % 3 AS entity, ['exact_code', 'exact_name', 'acronym', 'fts', 'symspell', 'symspell_exact_name'][l_linenumber % 6 + 1] AS source, CAST(l_linenumber % 6 AS INT) AS ord, [5, 4, 3, 2, 0, 4][l_linenumber % 6 + 1] AS tier,
round(0.5 + CAST(l_quantity AS INT) % 3 * 0.2, 2)::DOUBLE AS raw, l_linenumber AS rank, CASE WHEN l_linenumber % 6 = 3 THEN l_extendedprice END AS bm25 FROM lineitem)"""
MERGED = """merged AS (SELECT qid, entity, max(raw) AS raw, CAST(max(tier) AS INT) AS tier, max(bm25) AS bm25, bool_or(source = 'exact_code') AS exact_code_hit, bool_or(source IN ('exact_name', 'symspell_exact_name')) AS exact_name_hit,
max(CASE WHEN source = 'symspell' THEN raw END) AS symspell_edit_norm, arg_min(source, (-raw, ord, rank)) AS best_source, arg_min(rank, (-raw, ord, rank)) AS best_rank FROM ev GROUP BY qid, entity)"""


def merged(spark, d):
    k = "cast(l_linenumber % 6 as int)"
    ev = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as qid", f"array('exact_code', 'exact_name', 'acronym', 'fts', 'symspell', 'symspell_exact_name')[{k}] as source", f"{k} as source_ord", "l_suppkey % 3 as entity_id", "round(0.5D + cast(l_quantity as int) % 3 * 0.2D, 2) as raw_score",
        "l_linenumber as rank", f"array(5, 4, 3, 2, 0, 4)[{k}] as tier", "cast(null as string) as matched", f"case when {k} = 3 then l_extendedprice end as bm25", "cast(null as int) as edit_distance",
    )
    return cascade.candidates(ev)


@query("WITH " + EVIDENCE + ", " + MERGED + " SELECT qid, entity AS entity_id, raw, tier, bm25, exact_code_hit, exact_name_hit, symspell_edit_norm, best_source, best_rank FROM merged")
def a1_merged_evidence(spark, d):
    return merged(spark, d).select("qid", "entity_id", "raw", "tier", "bm25", "exact_code_hit", "exact_name_hit", "symspell_edit_norm", "best_source", "best_rank")


@query("WITH " + EVIDENCE + ", " + MERGED + """, again AS (SELECT *, CASE WHEN qid % 4 > 0 THEN round(0.6 + (qid + entity) % 4 * 0.1, 2)::DOUBLE END AS s FROM merged)
SELECT qid, entity AS entity_id, CASE WHEN s > raw THEN s ELSE raw END AS raw, CASE WHEN s > raw THEN 'fuzzy' ELSE best_source END AS best_source, CASE WHEN s > raw THEN 1 ELSE best_rank END AS best_rank, s AS fuzzy_edit_sim FROM again""")
def a2_reranked_evidence(spark, d):
    rows = merged(spark, d)
    s = F.round(F.lit(0.6) + (F.col("qid") + F.col("entity_id")) % 4 * 0.1, 2)
    again = rows.where("qid % 4 > 0").select("qid", "entity_id", s.alias("rerank_score"), s.alias("fuzzy_edit_sim"), s.alias("fuzzy_token_sim"))
    return cascade.add_reranked(rows, again).select("qid", "entity_id", "raw", "best_source", "best_rank", "fuzzy_edit_sim")


NAMED = "named AS (SELECT DISTINCT p_name AS qid, lower(p_name) AS norm FROM part)"


def part_names(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("qid"), F.col("p_name").alias("text"), F.lower("p_name").alias("norm")).distinct()


@query(sql("""SELECT qid, entity_id, raw_score, CAST(rank AS INT) AS rank FROM (SELECT qid, entity_id, CASE WHEN alias THEN 0.95 ELSE 1 END::DOUBLE AS raw_score, row_number() OVER (PARTITION BY qid ORDER BY alias, coalesce(prominence, 0.5) DESC, entity_id) AS rank
FROM (SELECT qid, entity_id, bool_and(name_kind = 'alias') AS alias FROM named JOIN names ON value_norm = norm AND entity_id LIKE 'custom/%' GROUP BY 1, 2) JOIN entities USING (entity_id)) WHERE rank <= 20""", NAMED))
def w1_exact_name_cap(spark, d):
    g = cascade.pack_graph(graph(spark, d), cascade.CUSTOM)
    return cascade.exact_names(g, part_names(spark, d), cascade.CUSTOM).select("qid", "entity_id", "raw_score", "rank")


def full_text_sql(docs: str, wanted: str) -> tuple[str, ...]:
    """Table expressions up to ``sel`` (qid, entity_id, bm25): ``wanted`` (qid, q, a list of words) in the names of ``docs``."""
    return (
        f"docs AS ({docs})", f"wanted AS ({wanted})",
        "toks AS (SELECT entity_id, value_norm, list_filter(regexp_split_to_array(lower(entity_id || ' ' || value_norm), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM docs)",
        "stat AS (SELECT count(*) AS nd, avg(len(w)) AS al FROM toks)",
        "idf AS (SELECT tok, greatest(1e-6, ln((nd - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT tok, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS tok FROM toks) GROUP BY tok), stat)",
        "hit AS (SELECT qid, entity_id, value_norm, contains(' ' || array_to_string(list_filter(regexp_split_to_array(value_norm, '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') AS phrase, w, q, al FROM wanted, toks, stat WHERE list_has_all(w, q))",
        "scored AS (SELECT qid, entity_id, value_norm, phrase, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / al))) AS bm25 FROM (SELECT *, len(list_filter(w, lambda x: x = tok)) AS tf FROM (SELECT *, unnest(list_distinct(q)) AS tok FROM hit)) JOIN idf USING (tok) GROUP BY ALL)",
        "best AS (SELECT qid, entity_id, max(CASE WHEN phrase THEN bm25 END) AS pb, max(bm25) AS ab FROM scored GROUP BY 1, 2)",
        "sel AS (SELECT qid, entity_id, CASE WHEN max(pb IS NOT NULL) OVER (PARTITION BY qid) THEN pb ELSE ab END AS bm25 FROM best)",
    )


GEO_FTS = full_text_sql("SELECT DISTINCT entity_id, value_norm FROM names JOIN entities USING (entity_id) WHERE entity_type LIKE 'geo.%'", "SELECT DISTINCT n_name AS qid, ['nation', right(n_name, 1)] AS q FROM nation")


@query(sql("""SELECT qid, entity_id, CAST(rank AS INT) AS rank, CASE WHEN rank = 1 THEN 0.85 WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.65 ELSE 0.55 END::DOUBLE AS raw_score, 2 AS tier, round(bm25, 6) AS bm25
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, entity_id) AS rank FROM sel WHERE bm25 IS NOT NULL) WHERE rank <= 20""", *GEO_FTS))
def c3_geo_full_text(spark, d):
    g = cascade.pack_graph(graph(spark, d), cascade.GEO)
    q = table(spark, d, "nation").select(F.col("n_name").alias("qid"), F.col("n_name").alias("text"), F.concat(F.lit("nation "), F.expr("right(n_name, 1)")).alias("norm")).distinct()
    return cascade.full_text(g, q, cascade.GEO).select("qid", "entity_id", "rank", "raw_score", "tier", F.round("bm25", 6).alias("bm25"))


def corrected(select: str, terms: str, asked_: str, budget: int = 20) -> tuple[str, str]:
    """Table expressions of the closest names within two edits, in each part of the names, and of the evidence they give."""
    near_ = f"near AS (SELECT qid, norm, large, entity_id, value, levenshtein(norm, value_norm) AS dist FROM {asked_}, {terms} WHERE length(norm) >= 3 AND length(value_norm) >= 2 AND abs(length(norm) - length(value_norm)) <= 2 AND levenshtein(norm, value_norm) <= 2)"
    found = f"""found AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, entity_id) AS rank FROM (SELECT qid, entity_id, min(dist) AS distance, min(length(norm)) AS len FROM (SELECT *, min(dist) OVER (PARTITION BY qid, large) AS lo FROM near)
WHERE dist = lo AND dist > 0 AND (dist <= 1 OR length(norm) > 6) GROUP BY 1, 2) QUALIFY rank <= {budget})"""
    return near_, found


SYMSPELL = "SELECT qid, entity_id, source, CAST(rank AS INT) AS rank, greatest(0.5, 0.9 - 0.15 * distance)::DOUBLE AS raw_score, CAST(distance AS INT) AS edit_distance, tier FROM (SELECT *, 'symspell' AS source, {tier} AS tier FROM found{more})"
EXACT_TOO = " UNION ALL SELECT *, 'symspell_exact_name', 4 FROM found WHERE distance <= 1 AND len >= 5"
MISSPELT = "misspelt AS (SELECT DISTINCT 'n' || n_nationkey AS qid, lower(CASE n_nationkey % 3 WHEN 0 THEN replace(n_name, '_', '') WHEN 1 THEN n_name || 'x' ELSE replace(n_name, 'T', 'l') END) AS norm FROM nation)"


def misspelt(spark, d):
    return table(spark, d, "nation").selectExpr("concat('n', n_nationkey) as qid", "lower(case n_nationkey % 3 when 0 then replace(n_name, '_', '') when 1 then concat(n_name, 'x') else replace(n_name, 'T', 'l') end) as norm").distinct().withColumn("text", F.col("norm"))


def said(rows):
    return rows.select("qid", "entity_id", "source", "rank", F.round("raw_score", 9).alias("raw_score"), "edit_distance", "tier")


@query(sql("SELECT qid, entity_id, source, rank, round(raw_score, 9) AS raw_score, edit_distance, tier FROM (" + SYMSPELL.format(tier=2, more=EXACT_TOO) + ")", MISSPELT, "spelt AS (SELECT entity_id, value, value_norm, entity_type NOT LIKE 'geo.country%' AND entity_type NOT LIKE 'geo.region%' AND entity_type NOT LIKE 'geo.continent%' AS large FROM names JOIN entities USING (entity_id) WHERE entity_type LIKE 'geo.%')", *corrected("", "spelt", "misspelt")))
def c4_geo_corrections(spark, d):
    return said(cascade.corrections(cascade.pack_graph(graph(spark, d), cascade.GEO), misspelt(spark, d), cascade.GEO))


CITIES = "spelt AS (SELECT entity_id, value, value_norm, entity_id LIKE 'custom/%' OR entity_id LIKE 'groups/%' AS large FROM names WHERE entity_id NOT LIKE 'org/%')"
BOTH = "both_ AS (SELECT * FROM misspelt UNION ALL SELECT DISTINCT norm, norm FROM typo)"


def cities(spark, d):
    """The graph with parts as cities, and misspelt names of nations and parts."""
    g = graph(spark, d)
    g = g.with_tables(entities=g.entities.withColumn("entity_type", F.when(F.col("entity_type") == "custom", "geo.city").otherwise(F.col("entity_type"))))
    return cascade.pack_graph(g, cascade.GEO), misspelt(spark, d).union(part_typos(spark, d).selectExpr("norm as qid", "norm", "norm as text").distinct())


@query(sql("SELECT qid, entity_id, source, rank, round(raw_score, 9) AS raw_score, edit_distance, tier FROM (" + SYMSPELL.format(tier=2, more=EXACT_TOO) + ")", MISSPELT, TYPOS, BOTH, CITIES, *corrected("", "spelt", "both_")))
def c5_corrections_of_all_types(spark, d):
    """The closest names of the small types and of the large ones, for queries without a type."""
    g, q = cities(spark, d)
    return said(cascade.corrections(g, q, cascade.GEO))


@query(sql("SELECT qid, entity_id, source, rank, round(raw_score, 9) AS raw_score, edit_distance, tier FROM (" + SYMSPELL.format(tier=2, more=EXACT_TOO) + ")", MISSPELT, TYPOS, BOTH, CITIES + ", small AS (SELECT * FROM spelt WHERE NOT large)", *corrected("", "small", "both_")))
def c5_corrections_of_small_types(spark, d):
    g, q = cities(spark, d)
    return said(cascade.corrections(g, q, cascade.GEO, ["geo.country", "geo.region"]))


@query(sql("SELECT qid, entity_id, source, rank, round(raw_score, 9) AS raw_score, edit_distance, tier FROM (" + SYMSPELL.format(tier=0, more="") + ")", TYPOS, "asked_ AS (SELECT DISTINCT norm AS qid, norm FROM typo)", "spelt AS (SELECT entity_id, value, value_norm, false AS large FROM names WHERE entity_id LIKE 'custom/%')", *corrected("", "spelt", "asked_")))
def c12_custom_corrections(spark, d):
    q = part_typos(spark, d).selectExpr("norm as qid", "norm", "norm as text").distinct()
    return said(cascade.corrections(cascade.pack_graph(graph(spark, d), cascade.CUSTOM), q, cascade.CUSTOM))


SHORT = "short AS (SELECT s_suppkey AS qid, CASE s_suppkey % 3 WHEN 0 THEN 'SUPP' || s_suppkey WHEN 1 THEN 'SuPP' || s_suppkey ELSE 'supp' || s_suppkey END AS text FROM supplier)"


@query(sql("SELECT qid, n.entity_id, CASE WHEN upper(text) = text THEN 1 ELSE 0.95 END::DOUBLE AS raw_score, 3 AS tier FROM short JOIN names n ON value_norm = lower(text) AND name_kind = 'acronym' JOIN entities e ON e.entity_id = n.entity_id AND entity_type LIKE 'org.%' WHERE length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(text) >= 0.5 AND length(text) <= 10", SHORT))
def c10_org_acronyms(spark, d):
    g = cascade.pack_graph(graph(spark, d), cascade.ORG)
    q = table(spark, d, "supplier").selectExpr("s_suppkey as qid", "case s_suppkey % 3 when 0 then concat('SUPP', s_suppkey) when 1 then concat('SuPP', s_suppkey) else concat('supp', s_suppkey) end as text").withColumn("norm", F.lower("text"))
    return cascade.acronyms(g, q, cascade.ORG).select("qid", "entity_id", "raw_score", "tier")


@query(sql("""SELECT qid, entity_id, CAST(rank AS INT) AS rank, round(0.8 * CASE WHEN rank = 1 THEN 0.85 WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.65 ELSE 0.55 END, 9)::DOUBLE AS raw_score FROM (SELECT qid, entity_id, row_number() OVER (PARTITION BY qid ORDER BY n, entity_id) AS rank FROM (
SELECT qid, entity_id, min(len(string_split(value_norm, ' '))) AS n FROM misspelt JOIN (SELECT entity_id, value_norm, string_split(value_norm, ' ') AS ws FROM names JOIN entities USING (entity_id) WHERE entity_type LIKE 'geo.%') ON list_contains(list_transform(range(1, len(ws) + 1), lambda i: starts_with(array_to_string(ws[i:], ' '), rtrim(substr(norm, 1, 4)))), true) GROUP BY 1, 2)) WHERE rank <= 20""", MISSPELT))
def c13_prefix_fallback(spark, d):
    out = cascade.prefix_fallback(cascade.pack_graph(graph(spark, d), cascade.GEO), misspelt(spark, d), cascade.GEO)
    return out.select("qid", "entity_id", "rank", F.round("raw_score", 9).alias("raw_score"))


@query(sql("""SELECT source, count(*) AS n FROM (SELECT 'exact_code' AS source, qid FROM place p JOIN codes c ON NOT regexp_full_match(text, '[a-z]{1,3}') AND ((system = 'iso2' AND value_norm = lower(trim(text))) OR (system = 'iso_numeric' AND regexp_full_match(text, '[0-9]{1,3}') AND value_norm = lpad(text, 3, '0')))
UNION ALL SELECT DISTINCT 'exact_name', qid FROM place JOIN names ON value_norm = lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AND (entity_id LIKE 'country/%' OR entity_id LIKE 'region/%') AND name_kind <> 'acronym' AND NOT regexp_full_match(text, '[a-z]{1,3}')) GROUP BY source""", PLACES))
def c14_early_stop(spark, d):
    """Evidence by source of texts that codes and single names decide: nothing dearer runs for them."""
    g = graph(spark, d)
    iso2 = g.codes.where("system = 'iso2'").select(F.col("entity_id").alias("e"), F.col("value").alias("iso2"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(iso2, F.concat(F.lit("country/"), "n_nationkey") == F.col("e"))
    q = n.select(F.col("n_nationkey").alias("qid"), F.expr("case n_nationkey % 6 when 0 then n_name when 1 then concat(' ', replace(lower(n_name), '_', '  ')) when 2 then iso2 when 3 then lower(iso2) when 4 then cast(n_nationkey as string) else concat('The ', r_name) end").alias("text"))
    return cascade.generate(cascade.pack_graph(g, cascade.GEO), cascade.prepare(q), cascade.GEO).groupBy("source").agg(F.count("*").alias("n"))


@query(sql(f"""SELECT qid, value_norm AS name, entity_id, round({partial('s', 'l')}, 9) AS ratio FROM (SELECT m.qid, value_norm, entity_id, CASE WHEN length(norm) > length(value_norm) THEN value_norm ELSE norm END AS s, CASE WHEN length(norm) > length(value_norm) THEN norm ELSE value_norm END AS l
FROM misspelt m, (SELECT DISTINCT value_norm, entity_id FROM names JOIN entities USING (entity_id) WHERE entity_type LIKE 'geo.%') WHERE 2 * length(value_norm) >= length(norm)) WHERE {partial('s', 'l')} >= 0.7""", MISSPELT))
def j10_brute_fuzzy(spark, d):
    names = cascade.pack_graph(graph(spark, d), cascade.GEO).names.select("value_norm", "entity_id").distinct()
    q = misspelt(spark, d)
    pairs = suggest.like_pairs(q.select("norm").distinct(), names.select("value_norm").distinct())
    close = pairs.withColumn("ratio", similarity.partial_ratio(F.col("norm"), F.col("value_norm"))).where("ratio >= 0.7")
    return q.join(close, "norm").join(names, "value_norm").select("qid", F.col("value_norm").alias("name"), "entity_id", F.round("ratio", 9).alias("ratio"))


FIXED = "fix AS (SELECT DISTINCT ON (word) word, term AS fixed FROM (SELECT DISTINCT word FROM wat) JOIN dict ON levenshtein(word, term) <= 2 ORDER BY word, levenshtein(word, term), n DESC, term)"
RETRIEVED = (
    FIXED,
    "fixed AS (SELECT DISTINCT norm AS qid, norm, corrected FROM (SELECT qid, norm, string_agg(coalesce(fixed, word), ' ' ORDER BY pos) AS corrected FROM wat LEFT JOIN fix USING (word) GROUP BY qid, norm) WHERE corrected <> norm)",
    "same AS (SELECT DISTINCT qid, norm, corrected, entity_id FROM fixed JOIN own_ids ON value_norm = corrected)",
    *full_text_sql("SELECT DISTINCT entity_id, value_norm FROM names WHERE entity_id LIKE 'custom/%'", "SELECT qid, list_filter(regexp_split_to_array(corrected, '[^a-z0-9]+'), lambda x: x <> '') AS q FROM fixed WHERE qid NOT IN (SELECT qid FROM same)"),
    "got AS (SELECT qid, entity_id, row_number() OVER (PARTITION BY qid ORDER BY entity_id) AS rank FROM same UNION ALL SELECT qid, entity_id, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, entity_id) FROM sel WHERE bm25 IS NOT NULL)",
)


@query(sql(f"SELECT qid, entity_id, corrected, round({indel('norm', 'corrected')}, 9) AS raw_score, CAST(rank AS INT) AS rank FROM got JOIN fixed USING (qid) WHERE rank <= 20", *COUNTED, "own_ids AS (SELECT entity_id, value_norm FROM names WHERE entity_id LIKE 'custom/%')", *RETRIEVED))
def c6_fuzzy_retrieval(spark, d):
    """Entities of misspelt part names, each word corrected: by exact name, else by full text."""
    g = cascade.pack_graph(graph(spark, d), cascade.CUSTOM)
    fixed = spelling.correct_words(custom_terms(spark, d), part_typos(spark, d))
    out = spelling.retrieve(g, fixed.groupBy(F.col("norm").alias("qid"), "norm").agg(F.min("corrected").alias("corrected")))
    return out.withColumn("raw_score", F.round("raw_score", 9))


LIKE = (
    "pre(qid, text, norm) AS (SELECT DISTINCT t, t, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) FROM (SELECT substr(p_name, 1, 2) || substr(p_name, 4, 5) AS t FROM part))",
    SUGGEST,
    "filled AS (SELECT qid FROM hit GROUP BY qid HAVING count(DISTINCT entity_id) >= 5)",
    f"""alike AS (SELECT qid, text, norm, value_norm, row_number() OVER (PARTITION BY qid ORDER BY {partial('s', 'l')} DESC, value_norm) AS r FROM (SELECT *, CASE WHEN length(norm) > length(value_norm) THEN value_norm ELSE norm END AS s, CASE WHEN length(norm) > length(value_norm) THEN norm ELSE value_norm END AS l
    FROM pre, (SELECT DISTINCT value_norm FROM names) WHERE qid NOT IN (SELECT qid FROM filled) AND length(norm) >= 3 AND 2 * length(value_norm) >= length(norm)) WHERE 13 * {lcs('s', 'l')} >= 7 * length(s) AND {partial('s', 'l')} >= 0.7 QUALIFY r <= 50)""",
    """every AS (SELECT *, 0 AS typos FROM hit UNION ALL SELECT qid, text, norm, entity_id, value, value_norm, name_kind, is_preferred, 3, damerau_levenshtein(norm, value_norm)::INT FROM alike JOIN names USING (value_norm))""",
    """keyed AS (SELECT every.*, coalesce(prominence, 0) AS p, CASE WHEN value_norm = norm AND (entity_type <> 'geo.country' OR coalesce(prominence, 0) >= 0.3) THEN 0 ELSE 1 END AS w,
    CASE WHEN name_kind = 'canonical' THEN 0 WHEN is_preferred THEN 1 WHEN name_kind IN ('alias', 'endonym', 'exonym') THEN 2 ELSE 3 END AS k FROM every JOIN entities USING (entity_id))""",
)


@query(sql("""SELECT qid, text, entity_id, cls AS match_class, value AS matched, typos AS typo_count, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY cls, w, typos, -p, k, length(value_norm), entity_id) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY qid, text, entity_id ORDER BY cls, w, typos, -p, k, length(value_norm), value) AS rn FROM keyed) WHERE rn = 1) WHERE rank <= 5""", *LIKE))
def u1_suggest_fuzzy(spark, d):
    p = table(spark, d, "part").selectExpr("concat(substr(p_name, 1, 2), substr(p_name, 4, 5)) as text").distinct().withColumn("qid", F.col("text"))
    return suggest.suggest(graph(spark, d), p, top_k=5, fuzzy=True)


RERANKED = (
    "pair AS (SELECT DISTINCT qid, norm AS a, entity_id, value_norm AS b FROM typo JOIN names ON entity_id IN ('custom/part-' || qid, 'custom/part-' || (qid + 1)))",
    f"each AS ({token_set('(SELECT *, ' + indel('a', 'b') + ' AS e FROM pair)', 'a', 'b', 'qid', 'entity_id', 'e')})",
)


@query(sql("""SELECT qid, entity_id, round(e, 9) AS fuzzy_edit_sim, round(token_set, 9)::DOUBLE AS fuzzy_token_sim, round(greatest(0.6, s), 9)::DOUBLE AS raw FROM (SELECT *, 0.5 * e + 0.5 * token_set AS s, row_number() OVER (PARTITION BY qid, entity_id ORDER BY 0.5 * e + 0.5 * token_set DESC, e DESC, token_set DESC) AS n FROM each) WHERE n = 1""", TYPOS, *RERANKED))
def j11_rerank(spark, d):
    g, q = cascade.pack_graph(graph(spark, d), cascade.CUSTOM), part_typos(spark, d)
    near_ = q.select("qid", F.explode(F.array("qid", F.col("qid") + 1)).alias("k")).select("qid", F.concat(F.lit("custom/part-"), "k").alias("entity_id"))
    found = near_.join(g.entities.select("entity_id"), "entity_id", "left_semi").selectExpr("qid", "entity_id", "false as exact_code_hit", "0.6D as raw", "'fts' as best_source", "1 as best_rank")
    out = cascade.rerank(g, found, q, cascade.CUSTOM)
    return out.select("qid", "entity_id", *[F.round(c, 9).alias(c) for c in ("fuzzy_edit_sim", "fuzzy_token_sim", "raw")])


# --- decisions ---------------------------------------------------------------------------------------------------

RIVALS = """rival AS (SELECT c_custkey AS qid, e, CASE e WHEN 0 THEN 0.9 ELSE round(0.9 - (c_custkey // (1 + 7 * (e - 1))) % 13 * 0.02, 4) END::DOUBLE - CASE WHEN c_custkey % 11 = 0 THEN 0.3 ELSE 0 END AS c, ['geo.country', 'geo.region', 'geo.city', 'geo.admin2'][CAST((c_custkey + e * (1 + c_custkey % 2)) % 4 AS INT) + 1] AS t, c_custkey % 5 = 0 AND e = 0 AS code,
count(*) OVER (PARTITION BY c_custkey) AS nc FROM customer, (SELECT unnest([0, 1, 2]) AS e) WHERE c_custkey % 10 <> 0 OR e = 0)"""
RANKS = "ranked AS (SELECT *, {rank} AS h, row_number() OVER o AS place, lead(c) OVER o AS c2 FROM rival WINDOW o AS (PARTITION BY qid ORDER BY c DESC, e))".format(rank="CASE t WHEN 'geo.country' THEN 0.85 WHEN 'geo.region' THEN 0.75 WHEN 'geo.city' THEN 0.7 ELSE 0.55 END")


def rivals(spark, d):
    e = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("e")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), e).where("qid % 10 <> 0 or e = 0")
    c = "case e when 0 then 0.9D else round(0.9D - (qid div (1 + 7 * (e - 1))) % 13 * 0.02D, 4) end - case when qid % 11 = 0 then 0.3D else 0D end"
    rows = rows.selectExpr(
        "qid", "concat('e', e) as entity_id", f"{c} as confidence", "array('geo.country', 'geo.region', 'geo.city', 'geo.admin2')[cast((qid + e * (1 + qid % 2)) % 4 as int)] as entity_type", "qid % 5 = 0 and e = 0 as exact_code_hit", "false as exact_name_hit", "false as acronym_hit",
        "0.5D as raw", "0 as first_ord", "1 as best_rank", "2 as tier", "'some text' as text",
    )
    return rows.withColumn("hierarchy_rank", scoring.by_type(scoring.HIERARCHY))


DECIDED = """SELECT qid, CASE WHEN code AND c >= {early} AND nc = 1 THEN 'resolved' WHEN c < 0.7 THEN 'no_match' WHEN c - coalesce(c2, 0) >= gap THEN 'resolved' {outranks} ELSE 'ambiguous' END AS status FROM ({of})"""


@query("WITH " + RIVALS + ", " + RANKS + ", " + """w AS (SELECT *, max(h) OVER (PARTITION BY qid) AS most, max(CASE WHEN place = 1 THEN c END) OVER (PARTITION BY qid) AS top FROM ranked),
x AS (SELECT *, max(CASE WHEN place > 1 AND top - c < 0.07 THEN h END) OVER (PARTITION BY qid) AS rival_rank, CASE WHEN most <= 0.7 THEN 0.03 ELSE 0.07 END AS gap FROM w) """ + DECIDED.format(early=0.75, outranks="WHEN h > rival_rank THEN 'resolved'", of="SELECT * FROM x WHERE place = 1"))
def d12_geo_policy(spark, d):
    rows = rivals(spark, d)
    return cascade.decide(rows, rows.select("qid").distinct(), cascade.GEO).select("qid", "status")


@query("WITH " + RIVALS + ", " + RANKS + " " + DECIDED.format(early=0.9, outranks="", of="SELECT *, 0.1 AS gap FROM ranked WHERE place = 1"))
def d10_thresholds(spark, d):
    """The thresholds of scores that aren't calibrated: 0.7 at least, and 0.1 before the next."""
    rows = rivals(spark, d)
    return cascade.decide(rows, rows.select("qid").distinct(), cascade.CUSTOM).select("qid", "status")


SPANS = """span AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY status <> 'resolved', -conf, CASE pack WHEN 'geo' THEN 0 WHEN 'org' THEN 1 ELSE 2 END, -(e - s), s, e, l_linenumber) AS r FROM (SELECT l_orderkey AS doc_id, l_linenumber, CAST(l_partkey % 40 AS INT) AS s, CAST(l_partkey % 40 + 1 + l_suppkey % 9 AS INT) AS e,
['geo', 'org', 'custom'][CAST(l_linenumber % 3 AS INT) + 1] AS pack, CASE WHEN l_returnflag = 'R' THEN 'nil' ELSE 'resolved' END AS status, round(l_discount, 2)::DOUBLE AS conf FROM lineitem))"""
CHOSEN = """chosen AS (SELECT doc_id, r, [{'s': s, 'e': e}] AS kept, true AS keep FROM span WHERE r = 1 UNION ALL SELECT n.doc_id, n.r, CASE WHEN free THEN list_append(kept, {'s': n.s, 'e': n.e}) ELSE kept END, free
FROM chosen c JOIN span n ON n.doc_id = c.doc_id AND n.r = c.r + 1, LATERAL (SELECT len(list_filter(kept, lambda k: k.s < n.e AND n.s < k.e)) = 0 AS free))"""


@query("WITH RECURSIVE " + SPANS + ", " + CHOSEN + " SELECT doc_id, s AS \"start\", e AS \"end\", pack, status, count(*) AS n FROM chosen JOIN span USING (doc_id, r) WHERE keep GROUP BY ALL")
def x3_arbitrated_spans(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as doc_id", "cast(l_partkey % 40 as int) as start", "cast(l_partkey % 40 + 1 + l_suppkey % 9 as int) as end", "array('geo', 'org', 'custom')[cast(l_linenumber % 3 as int)] as pack", "case when l_returnflag = 'R' then 'nil' else 'resolved' end as status", "round(l_discount, 2) as confidence",
    )
    return parse.arbitrate(rows).groupBy("doc_id", "start", "end", "pack", "status").agg(F.count("*").alias("n"))


# --- inputs ------------------------------------------------------------------------------------------------------


@query("SELECT kind, n, custkeys, names FROM (SELECT count(*) AS n, sum(c_custkey)::BIGINT AS custkeys, count(DISTINCT c_name) AS names FROM customer), (SELECT unnest(['csv', 'json', 'jsonl', 'parquet']) AS kind)")
def s7_record_files(spark, d):
    """The same records read back from files of each kind."""
    rows, out = table(spark, d, "customer").select("c_custkey", "c_name"), None
    for kind in ("csv", "json", "jsonl", "parquet"):
        path = f"{scratch(spark, 'records')}.{kind}"
        writer = rows.write.option("header", True)
        {"csv": writer.csv, "json": writer.json, "jsonl": writer.json, "parquet": writer.parquet}[kind](path)
        # a .json file is one document or a list: lines of records are read as .jsonl
        own = records.read_records(spark, path) if kind != "json" else spark.read.json(path)
        own = own.agg(F.count("*").alias("n"), F.sum(F.col("c_custkey").cast("long")).alias("custkeys"), F.count_distinct("c_name").alias("names")).select(F.lit(kind).alias("kind"), "n", "custkeys", "names")
        out = own if out is None else out.union(own)
    return out


@query("SELECT 'country/' || k AS entity_id, 'member_of' AS relation_type, 'groups/g' AS target_id, CASE WHEN k < 2 THEN DATE '1990-01-01' END AS valid_from, CASE WHEN k = 1 THEN DATE '2000-01-01' END AS valid_until FROM (SELECT unnest([0, 1, 2]) AS k)")
def s13_seeds(spark, d):
    return records.seed_relations(spark, [("country/0", "groups/g", "1990-01-01", None), ("country/1", "groups/g", "1990-01-01", "2000-01-01"), ("country/2", "groups/g", None, None)], "member_of")


@query("SELECT kind, row_id, value FROM (VALUES (0, '1'), (1, '2.5'), (2, NULL), (3, 'x')) v(row_id, value), (SELECT unnest(['list', 'tuple', 'dict', 'array', 'series']) AS kind)")
def s14_columns_of_values(spark, d):
    """One column, given as each kind of object that holds one."""
    import numpy as np
    import pandas as pd

    given = [1.0, 2.5, None, "x"]
    kinds = {"list": given, "tuple": tuple(given), "dict": dict(enumerate(given)), "array": np.array(given, object), "series": pd.Series(given, dtype="object")}
    out = None
    for kind, values in kinds.items():
        own = records.values(spark, values).select(F.lit(kind).alias("kind"), "row_id", "value")
        out = own if out is None else out.union(own)
    return out


@query(sql(f"SELECT a, b, round({indel('a', 'b')}, 9) AS ratio, damerau_levenshtein(a, b)::INT AS distance, strip_accents(a) AS folded FROM near", TYPOS, NEAR))
def s15_sql_functions(spark, d):
    """The functions as a SQL user calls them."""
    from oriel.api import register_functions

    register_functions(spark)
    near(spark, d).createOrReplaceTempView("oriel_near")
    return spark.sql("select a, b, round(indel_ratio(a, b), 9) as ratio, damerau(a, b) as distance, fold(a) as folded from oriel_near")


@query(sql("SELECT t, n, copied FROM (SELECT 'entities' AS t, count(*) AS n FROM entities UNION ALL SELECT 'names', count(*) FROM names UNION ALL SELECT 'codes', count(*) FROM codes UNION ALL SELECT 'relations', count(*) FROM relations), (SELECT unnest([true, false]) AS copied)"))
def s11_fetched_pack(spark, d):
    """A pack fetched from a place that Hadoop reads, and found in the cache when it is asked for again."""
    source, cache, out = scratch(spark, "remote"), scratch(spark, "cache"), None
    packs.write_pack(graph(spark, d), source, "all", "geo")
    for _ in range(2):
        path, copied = packs.ensure_pack(spark, source, cache)
        own = table_counts(packs.read_pack(spark, path)).withColumn("copied", F.lit(copied))
        out = own if out is None else out.union(own)
    return out


# --- building ----------------------------------------------------------------------------------------------------


@query("SELECT kind, n, hit FROM (SELECT 'entities' AS kind, count(*) AS n FROM customer), (SELECT unnest([false, true]) AS hit) UNION ALL SELECT 'changed', count(*), false FROM customer WHERE c_custkey > 0")
def b3_build_cache(spark, d):
    """Records built once: again with the same records, in another order, they are found; with others, built anew."""
    from oriel.operators import linking

    rows, cache = table(spark, d, "customer").selectExpr("c_custkey as id", "c_name as name"), scratch(spark, "cache")
    make = lambda r: linking.from_records(r, linking.roles(r.columns, id="id"))
    out = None
    for kind, given in (("entities", rows), ("entities", rows.orderBy(F.desc("id"))), ("changed", rows.where("id > 0"))):
        g, hit = packs.built_pack(given, {"domain": "custom", "id": "id"}, cache, make)
        own = g.entities.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n", F.lit(hit).alias("hit"))
        out = own if out is None else out.union(own)
    return out


@query(sql("SELECT 'done' AS ended, count(*) AS n, 0 AS missing FROM entities WHERE entity_type <> 'custom' UNION ALL SELECT 'no_progress', count_if(entity_id NOT LIKE 'org/%5'), count_if(entity_id LIKE 'org/%5') FROM entities WHERE entity_type <> 'custom'"))
def e2_fetch_with_retries(spark, d):
    """A source that gives a third of what it is asked for each time, and one that never gives some of it."""
    g, out = graph(spark, d), None
    ids = g.entities.where("entity_type <> 'custom'").select("entity_id")
    for lost in ("no such id", "org/%5"):
        turn = iter(range(10))

        def fetch(asked_, lost=lost, turn=turn):
            n = next(turn) % 3
            return g.entities.join(asked_, "entity_id", "left_semi").where((F.pmod(F.xxhash64("entity_id"), F.lit(3)) == n) & ~F.col("entity_id").like(lost))

        rows, left, ended = build.fetch_all(ids, fetch, sleep=lambda s: None)
        own = rows.agg(F.count("*").alias("n")).crossJoin(left.agg(F.count("*").alias("missing"))).select(F.lit(ended).alias("ended"), "n", "missing")
        out = own if out is None else out.union(own)
    return out


@query(sql("SELECT entity_id, system, value FROM (SELECT entity_id, system, CASE WHEN system = 'iso2' THEN value || '-new' ELSE value END AS value FROM codes UNION ALL SELECT 'country/1', 'extra', 'last') WHERE entity_id NOT LIKE 'custom/%'"))
def e3_payload_insert(spark, d):
    """Rows put into a table by its key: the last of a key stays."""
    g = graph(spark, d)
    put = lambda t, o: t.select("entity_id", "system", "value", F.lit(o).alias("o"))
    new = g.codes.where("system = 'iso2'").withColumn("value", F.concat("value", F.lit("-new")))
    extra = spark.createDataFrame([("country/1", "extra", "first", 2), ("country/1", "extra", "last", 3)], "entity_id string, system string, value string, o int")
    rows = put(g.codes, 0).union(put(new, 1)).union(extra).where("entity_id not like 'custom/%'")
    return etl.last_wins(rows, ["entity_id", "system"], F.col("o")).drop("o")


@query(sql("""SELECT entity_type, count(*) AS n, 'no_progress' AS ended FROM entities WHERE entity_type LIKE 'geo.%' OR entity_type = 'org.company' GROUP BY 1"""))
def e5_reconciled(spark, d):
    """Companies alone, with the entities that their relations name fetched round by round until none is left that exists."""
    g = graph(spark, d)
    near_ = g.map(lambda name, t: t.where("relation_type <> 'supplies'") if name == "relations" else t)
    ids = g.entities.where("entity_type = 'org.company'").select("entity_id")
    got, ended = etl.reconcile(etl.subset(near_, ids), lambda missing: etl.subset(near_, missing))
    return got.entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.lit(ended).alias("ended"))


@query(sql("""SELECT t, n FROM (SELECT 'entities' AS t, count(*) AS n FROM entities WHERE entity_id NOT LIKE 'custom/%9'
UNION ALL SELECT 'names', count(*) + 2 * (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM region) FROM names WHERE entity_id NOT LIKE 'custom/%9'
UNION ALL SELECT 'codes', count(*) FROM codes WHERE entity_id NOT LIKE 'custom/%9'
UNION ALL SELECT 'relations', count(*) + (SELECT count(*) FROM nation) FROM relations WHERE target_id NOT LIKE 'custom/%9'
UNION ALL SELECT 'dated', count(*) FROM entities WHERE (valid_from IS NOT NULL AND entity_id NOT LIKE 'custom/%9') OR entity_id LIKE 'region/%'
UNION ALL SELECT 'prominent', count(*) FROM region)"""))
def e6_enriched(spark, d):
    """Formal names, saints, groups, dates, noise and containment, each seeing what those before it left."""
    g = graph(spark, d)
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    formal = n.selectExpr("concat('country/', n_nationkey) as entity_id", "concat(n_name, ', Republic of') as value")
    holy = r.selectExpr("concat('region/', r_regionkey) as entity_id", "concat('Saint ', r_name) as value")
    members = n.selectExpr("concat('country/', n_nationkey) as entity_id", "'groups/BUILDING' as target_id", "'1990-01-01' as valid_from", "cast(null as string) as valid_until")
    dates = r.selectExpr("concat('region/', r_regionkey) as entity_id", "date '1900-01-01' as valid_from", "cast(null as date) as valid_until")
    with_saints = lambda g: g.with_tables(names=enrich.saint_aliases(g.with_tables(names=enrich.with_names(holy)(g).names)).names.where("value not like 'Saint %'"))
    steps = [("formal", enrich.formal_names(formal)), ("saints", with_saints), ("groups", enrich.groups(members)), ("validity", enrich.validity(dates)), ("noise", enrich.without_noise(["custom/%9"], [])), ("containment", enrich.containment(["geo.region"]))]
    out = enrich.enrich(g, steps)
    more = out.entities.agg(F.count("valid_from").alias("dated"), F.count(F.when(F.col("entity_type") == "geo.region", F.col("prominence"))).alias("prominent"))
    flat = more.select(F.explode(F.array(*[F.struct(F.lit(c).alias("t"), F.col(c).alias("n")) for c in ("dated", "prominent")])).alias("x")).select("x.*")
    return table_counts(out).union(flat)


@query("""SELECT 'country/' || n_nationkey AS entity_id, 'n:' || n_name AS fact FROM nation UNION ALL SELECT 'country/' || n_nationkey, 'n:' || replace(n_name, '_', ' ') FROM nation UNION ALL SELECT 'country/' || n_nationkey, 'c:key=' || n_nationkey FROM nation
UNION ALL SELECT 'country/' || n_nationkey, 'r:region/' || n_regionkey FROM nation UNION ALL SELECT 'country/' || n_nationkey, 'e:geo.country' FROM nation""")
def e12_flattened_bundles(spark, d):
    """Nested records, each of them twice, as rows of the four tables."""
    b = table(spark, d, "nation").selectExpr("concat('country/', n_nationkey) as id", "'geo.country' as type", "n_name as name", "array(replace(n_name, '_', ' ')) as aliases", "map('key', cast(n_nationkey as string)) as codes", "array(concat('region/', n_regionkey)) as parents")
    g = etl.flatten_bundles(b.union(b))
    parts = [g.names.select("entity_id", F.concat(F.lit("n:"), "value").alias("fact")), g.codes.select("entity_id", F.concat(F.lit("c:"), "system", F.lit("="), "value")), g.relations.select("entity_id", F.concat(F.lit("r:"), "target_id")), g.entities.select("entity_id", F.concat(F.lit("e:"), "entity_type"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""SELECT 'o/' || s_suppkey AS entity_id, 'canonical:' || s_name AS fact FROM supplier UNION ALL SELECT 'o/' || s_suppkey, 'acronym:S' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'o/' || s_suppkey, 'legal:' || s_name || ' Ltd' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'o/' || s_suppkey, 'c:lei=L' || s_suppkey FROM supplier UNION ALL SELECT 'o/' || s_suppkey, 'r:o/0' FROM supplier WHERE s_suppkey > 0""")
def e13_organisation_rows(spark, d):
    o = table(spark, d, "supplier").selectExpr("concat('o/', s_suppkey) as id", "s_name as name", "case when s_suppkey % 2 = 0 then concat('S', s_suppkey) end as acronym", "cast(null as string) as short", "case when s_suppkey % 3 = 0 then concat(s_name, ' Ltd') end as legal", "case when s_suppkey > 0 then 'o/0' end as parent_id", "'XX' as country", "map('lei', concat('L', s_suppkey)) as codes")
    g = build.org_rows(o)
    return g.names.select("entity_id", F.concat("name_kind", F.lit(":"), "value").alias("fact")).union(g.codes.select("entity_id", F.concat(F.lit("c:"), "system", F.lit("="), "value"))).union(g.relations.select("entity_id", F.concat(F.lit("r:"), "target_id")))
