"""More queries: outputs, spelling, what follows a decision, training, building, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from oriel.functions import scoring, text
from oriel.operators import build, calibration, etl, explain, linking, metrics, output, parse, spelling, suggest
from oriel.operators import resolve as cascade
from oriel.plans.oracle_graph import squeeze, sql
from oriel.plans.queries import HITS, NORM, RESOLVED, SUGGEST, TERMS, TYPOS, WORDS_SQL, asked, graph, hits, query, scored, words_graph
from oriel.session import scratch, table
from oriel.sources import packs
from oriel.streaming import resolve as streams

# --- outputs -----------------------------------------------------------------------------------------------------

KIND_ORDER = "list_position(['canonical', 'alias', 'endonym', 'exonym', 'acronym'], name_kind)"
FIRST = "ORDER BY entity_id, NOT is_preferred, " + KIND_ORDER + ", value_norm, value)"


@query(sql(f"""SELECT token, entity_id, value FROM (SELECT DISTINCT ON (entity_id) 'name:en' AS token, entity_id, value FROM names WHERE lang = 'en' {FIRST}
UNION ALL SELECT token, entity_id, value FROM (SELECT DISTINCT ON (entity_id) 'name:alias' AS token, entity_id, value FROM names WHERE name_kind = 'alias' {FIRST}
UNION ALL SELECT token, entity_id, value FROM (SELECT DISTINCT ON (entity_id) 'name:abbr' AS token, entity_id, value FROM names WHERE name_kind = 'acronym' {FIRST}"""))
def t19_name_selectors(spark, d):
    g, out = graph(spark, d), None
    for token in ("name:en", "name:alias", "name:abbr"):
        own = output.values_of(g, token).select(F.lit(token).alias("token"), "entity_id", "value")
        out = own if out is None else out.union(own)
    return out


@query(sql("""SELECT e.entity_id, coalesce((SELECT min(value) FROM codes c WHERE c.entity_id = e.entity_id AND system = 'iso3'), (SELECT min(value) FROM codes c WHERE c.entity_id = e.entity_id AND system = 'wikidata'),
CASE WHEN entity_type IN ('geo.region', 'geo.country', 'org.company') THEN 'World' END, canonical_name) AS output FROM entities e"""))
def t21_output_chain(spark, d):
    g = graph(spark, d)
    return output.with_output(g, g.entities.select("entity_id"), ["iso3", "wikidata", "continent", "name"], on_miss="raise")


GIVEN = "given AS (SELECT DISTINCT arg FROM (SELECT p_name AS arg FROM part UNION ALL SELECT ' ' || upper(n_name) FROM nation UNION ALL SELECT r_name FROM region UNION ALL VALUES ('region/1'), ('region/x'), ('nobody')))"


@query(sql(f"""SELECT arg, CASE WHEN n = 1 THEN e END AS entity_id, CASE n WHEN 0 THEN 'unknown' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM (
SELECT arg, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM given LEFT JOIN (SELECT value_norm AS k, entity_id FROM names UNION ALL SELECT entity_id, entity_id FROM entities) x ON k = CASE WHEN contains(arg, '/') THEN arg ELSE {squeeze('arg')} END GROUP BY arg)""", GIVEN))
def g6_arguments(spark, d):
    t = lambda name, expr: table(spark, d, name).selectExpr(f"{expr} as arg")
    given = t("part", "p_name").union(t("nation", "concat(' ', upper(n_name))")).union(t("region", "r_name")).union(spark.createDataFrame([("region/1",), ("region/x",), ("nobody",)], "arg string"))
    return output.arguments(graph(spark, d), given)


@query(sql("""SELECT entity_type, count(*) AS n_entities, sum((SELECT count(*) FROM names n WHERE n.entity_id = e.entity_id))::BIGINT AS n_names, sum((SELECT count(*) FROM codes c WHERE c.entity_id = e.entity_id))::BIGINT AS n_codes FROM entities e GROUP BY 1"""))
def g7_info(spark, d):
    return output.info(graph(spark, d))


@query(sql(f"""SELECT qid, how, count(DISTINCT entity_id) AS n_entities, min(entity_id) AS first_id FROM (SELECT qid, 'code' AS how, entity_id FROM asked JOIN codes ON value_norm = lower(trim(text))
UNION ALL SELECT qid, name_kind, entity_id FROM asked JOIN names ON value_norm = {squeeze('text')}) GROUP BY qid, how"""))
def inspect_texts(spark, d):
    return output.inspect(graph(spark, d), asked(spark, d))


# --- text --------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT w AS word, strip_accents(replace(lower(w), 'ß', 'ss')) AS folded FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}]+')) AS w FROM conversations)")
def t5_folded_words(spark, d):
    w = table(spark, d, "conversations").select(F.explode(F.expr(r"regexp_extract_all(text, '[\\p{L}]+', 0)")).alias("word")).distinct()
    return w.select("word", text.fold_for_match(F.col("word")).alias("folded"))


@query("SELECT doc_id, letters > 0 AND coalesce(other / nullif(letters, 0) < 0.2, false) AS latin FROM (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(coalesce(text, ''), '[^\\p{L}]|[\\x{0000}-\\x{024F}]', '', 'g')) AS other FROM documents)")
def t18_latin_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(text.latin_share_ok(F.coalesce("text", F.lit(""))), F.lit(False)).alias("latin"))


# --- spelling ----------------------------------------------------------------------------------------------------

COUNTED = (
    TERMS,
    TYPOS,
    "own AS (SELECT value_norm FROM names WHERE starts_with(entity_id, 'custom/'))",
    "dict AS (SELECT term, max(n) AS n FROM (SELECT value_norm AS term, count(*) AS n FROM own GROUP BY 1 UNION ALL SELECT w, count(*) FROM (SELECT unnest(string_split(value_norm, ' ')) AS w FROM own WHERE contains(value_norm, ' ')) WHERE length(w) >= 2 GROUP BY 1) GROUP BY term)",
    "ws AS (SELECT qid, norm, string_split(norm, ' ') AS w FROM typo)",
    "wat AS (SELECT qid, norm, w, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM ws)",
)


def custom_terms(spark, d):
    return etl.spelling_terms(cascade.pack_graph(graph(spark, d), cascade.CUSTOM))


def part_typos(spark, d):
    k = "case p_partkey % 4 when 0 then concat(substr(p_name, 1, 2), substr(p_name, 4)) when 1 then concat(p_name, 'x') when 2 then concat('q', substr(p_name, 2)) else replace(p_name, ' ', '') end"
    return table(spark, d, "part").selectExpr("p_partkey as qid", f"{k} as norm")


@query(sql("""SELECT qid, norm, corrected FROM (SELECT qid, norm, string_agg(coalesce(fixed, word), ' ' ORDER BY pos) AS corrected FROM wat LEFT JOIN fix USING (word) GROUP BY qid, norm) WHERE corrected <> norm""", *COUNTED,
"fix AS (SELECT DISTINCT ON (word) word, term AS fixed FROM (SELECT DISTINCT word FROM wat) JOIN dict ON levenshtein(word, term) <= 2 ORDER BY word, levenshtein(word, term), n DESC, term)"))
def j8_word_correction(spark, d):
    return spelling.correct_words(custom_terms(spark, d), part_typos(spark, d))


@query(sql("SELECT DISTINCT ON (qid) qid, norm, corrected FROM cand ORDER BY qid, n DESC, corrected", *COUNTED,
"odd AS (SELECT *, unnest(range(2, length(word) - 1)) AS i FROM wat WHERE length(word) >= 4 AND word NOT IN (SELECT term FROM dict))",
"""cand AS (SELECT qid, norm, least(a.n, b.n) AS n, array_to_string(list_concat(w[:pos - 1], [word[:i], word[i + 1:]], w[pos + 1:]), ' ') AS corrected FROM odd JOIN dict a ON a.term = word[:i] JOIN dict b ON b.term = word[i + 1:]
UNION ALL SELECT qid, norm, n, array_to_string(list_concat(w[:pos - 1], [term], w[pos + 2:]), ' ') FROM wat JOIN dict ON pos < len(w) AND term = word || w[pos + 1])"""))
def j9_compound_correction(spark, d):
    return spelling.correct_compounds(custom_terms(spark, d), part_typos(spark, d))


@query(sql("""SELECT DISTINCT t AS text, lower(trim(t)) IN ('na', 'n/a', 'n.a.', 'none', 'unknown', '?', '-', '--', '.') AS degenerate, regexp_full_match(trim(t), '([A-Za-z]\\.){2,}[A-Za-z]?\\.?') AS initialism,
translate(trim(t), '#/-_.,;:!?*|()[]{}''"` ', '') <> trim(t) AND length(translate(trim(t), '#/-_.,;:!?*|()[]{}''"` ', '')) <= 3 AND NOT regexp_matches(translate(trim(t), '#/-_.,;:!?*|()[]{}''"` ', ''), '[0-9]') AND NOT regexp_full_match(trim(t), '([A-Za-z]\\.){2,}[A-Za-z]?\\.?') AS noise
FROM (SELECT value AS t FROM names UNION ALL SELECT value FROM codes UNION ALL SELECT substr(n_name, 1, 1) || '.' || substr(n_name, 2, 1) || '.' FROM nation UNION ALL SELECT '(' || value || ')' FROM codes WHERE system LIKE 'iso%' UNION ALL VALUES ('n/a'), ('--'), ('?'), (' NA '), ('a-b'))"""))
def t10_t12_noise(spark, d):
    g = graph(spark, d)
    more = spark.createDataFrame([("n/a",), ("--",), ("?",), (" NA ",), ("a-b",)], "text string")
    t = g.names.select(F.col("value").alias("text")).union(g.codes.select("value")).union(table(spark, d, "nation").selectExpr("concat(substr(n_name, 1, 1), '.', substr(n_name, 2, 1), '.')"))
    t = t.union(g.codes.where("system like 'iso%'").selectExpr("concat('(', value, ')')")).union(more).distinct()
    c = F.col("text")
    return t.select("text", text.is_degenerate(c).alias("degenerate"), text.is_dotted_initialism(c).alias("initialism"), text.is_punctuation_noise(c).alias("noise"))


@query(sql("""SELECT DISTINCT t AS text, CASE WHEN regexp_full_match(t, '[0-9]{1,3}') THEN (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (VALUES (t), (lpad(regexp_replace(t, '^0+([0-9])', '\\1'), 3, '0')), (regexp_replace(t, '^0+([0-9])', '\\1'))) v(x))
ELSE (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (VALUES (t), (regexp_replace(t, '^wikidata:', ''))) v(x)) END AS keys FROM (SELECT lower(value) AS t FROM codes UNION ALL SELECT 'wikidata:' || lower(value) FROM codes WHERE system = 'wikidata' UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation)"""))
def t24_lookup_values(spark, d):
    g = graph(spark, d)
    t = g.codes.selectExpr("lower(value) as text").union(g.codes.where("system = 'wikidata'").selectExpr("concat('wikidata:', lower(value))")).union(table(spark, d, "nation").selectExpr("cast(n_nationkey as string)")).distinct()
    return t.select("text", F.array_join(F.array_sort(text.lookup_values(F.col("text"))), ",").alias("keys"))


@query("WITH " + WORDS_SQL + """, w AS (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_#''-]+')) AS s FROM conversations),
x AS (SELECT s, norm FROM w JOIN gaz ON lower(s) = norm) SELECT CASE WHEN length(s) <= 20 AND lower(s) IN ('international', 'unknown', 'pending', 'various', 'others', 'example', 'sample', 'testing') THEN 'sentinel' WHEN upper(s) <> s AND norm[1] < 'e' THEN 'code_case_mismatch' WHEN norm[1] > 'r' THEN 'below_threshold' ELSE 'kept' END AS gate, count(*) AS n FROM x GROUP BY 1""")
def x2_link_gates(spark, d):
    """Mentions by the gate that drops them; names before e pass as codes, and those from s on have two entities."""
    g, docs = words_graph(spark, d), table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    initial = F.substring("norm", 1, 1)
    patterns = parse.gazetteer(g).withColumn("code_shaped", initial < "e").withColumn("ids", F.when(initial > "r", F.array(F.lit("a"), F.lit("b"))).otherwise(F.col("ids")))
    spans = parse.leftmost_longest(parse.mentions(g, docs, patterns=patterns))
    return parse.link(spans).groupBy(F.coalesce("dropped", F.lit("kept")).alias("gate")).agg(F.count("*").alias("n"))


# --- resolution --------------------------------------------------------------------------------------------------

PLACES = "place(qid, text) AS (SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN n_name WHEN 1 THEN ' ' || replace(lower(n_name), '_', '  ') WHEN 2 THEN (SELECT value FROM codes WHERE entity_id = 'country/' || n_nationkey AND system = 'iso2') WHEN 3 THEN lower((SELECT value FROM codes WHERE entity_id = 'country/' || n_nationkey AND system = 'iso2')) WHEN 4 THEN CAST(n_nationkey AS VARCHAR) ELSE 'The ' || (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) END FROM nation)"


@query(sql("""SELECT qid, CASE WHEN e IS NULL THEN 'no_match' ELSE 'resolved' END AS status, e AS entity_id, CASE WHEN e IS NOT NULL THEN round(1 / (1 + exp(raw * -8.499867056667657 + 5.556690191789257)), 6) END AS confidence FROM (
SELECT p.qid, coalesce(c.entity_id, n.entity_id) AS e, CASE WHEN c.entity_id IS NOT NULL THEN 0.95 ELSE 0.9 END + 0.009 * CASE WHEN coalesce(c.entity_id, n.entity_id) LIKE 'country/%' THEN 0.85 ELSE 0.75 END + coalesce(0.12 * (x.prominence - 0.5), 0) AS raw
FROM place p LEFT JOIN codes c ON NOT regexp_full_match(p.text, '[a-z]{1,3}') AND ((c.system = 'iso2' AND c.value_norm = lower(trim(p.text))) OR (c.system = 'iso_numeric' AND regexp_full_match(p.text, '[0-9]{1,3}') AND c.value_norm = lpad(p.text, 3, '0')))
LEFT JOIN names n ON c.entity_id IS NULL AND n.value_norm = lower(trim(regexp_replace(p.text, '\\s+', ' ', 'g'))) AND (n.entity_id LIKE 'country/%' OR n.entity_id LIKE 'region/%') AND name_kind <> 'acronym' AND NOT regexp_full_match(p.text, '[a-z]{1,3}') LEFT JOIN entities x ON x.entity_id = coalesce(c.entity_id, n.entity_id))""", PLACES))
def resolve_geo_exact(spark, d):
    g = graph(spark, d)
    iso2 = g.codes.where("system = 'iso2'").select(F.col("entity_id").alias("e"), F.col("value").alias("iso2"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(iso2, F.concat(F.lit("country/"), "n_nationkey") == F.col("e"))
    q = n.select(F.col("n_nationkey").alias("qid"), F.expr("case n_nationkey % 6 when 0 then n_name when 1 then concat(' ', replace(lower(n_name), '_', '  ')) when 2 then iso2 when 3 then lower(iso2) when 4 then cast(n_nationkey as string) else concat('The ', r_name) end").alias("text"))
    out = cascade.resolve(g, q, packs=["geo"], fuzzy=False)
    return out.select("qid", "status", "entity_id", F.round("confidence", 6).alias("confidence"))


SAID = """said AS (SELECT qid, pack, CASE s WHEN 0 THEN 'resolved' WHEN 1 THEN 'ambiguous' ELSE 'no_match' END AS status, pack || '/' || qid AS e, c, CASE WHEN s = 0 THEN 3 + (qid + o) % 3 END AS tier FROM (
SELECT c_custkey AS qid, pack, o, floor(c_custkey / pow(3, o)) % 3 AS s, round(0.7 + ((c_custkey * (o + 3)) % 31) / 110.0::DOUBLE, 6) AS c FROM customer, (VALUES ('custom', 2), ('geo', 0), ('org', 1)) v(pack, o)))"""


@query("WITH " + SAID + """, m AS (SELECT *, CASE pack WHEN 'geo' THEN c WHEN 'org' THEN CASE WHEN c >= 0.85 THEN 0.85 + (c - 0.85) / 0.15 * 0.15 ELSE 0.6 + (c - 0.65) / 0.2 * 0.25 END ELSE CASE WHEN c >= 0.88 THEN 0.85 + (c - 0.88) / 0.12 * 0.15 ELSE 0.6 + (c - 0.65) / 0.23 * 0.25 END END AS u FROM said),
r AS (SELECT *, row_number() OVER o AS place, sum(CAST(status = 'resolved' AS INT)) OVER (PARTITION BY qid) AS k, max(CASE WHEN status = 'ambiguous' THEN u END) OVER (PARTITION BY qid) AS rival, lead(CASE WHEN status = 'resolved' THEN tier END) OVER o AS t2, lead(CASE WHEN status = 'resolved' THEN u END) OVER o AS u2
FROM m WINDOW o AS (PARTITION BY qid ORDER BY CASE status WHEN 'resolved' THEN 0 WHEN 'ambiguous' THEN 1 ELSE 2 END, coalesce(tier, -1) DESC, u DESC, pack)),
f AS (SELECT *, coalesce(CASE WHEN k = 1 THEN rival >= u WHEN k > 1 THEN t2 = tier AND u - u2 < 0.1 END, false) AS x FROM r WHERE place = 1)
SELECT qid, CASE WHEN x THEN 'ambiguous' ELSE status END AS status, CASE WHEN NOT x AND status = 'resolved' THEN e END AS entity_id, CASE WHEN NOT x AND status = 'resolved' THEN pack END AS pack FROM f""")
def d15_merged_packs(spark, d):
    v = spark.createDataFrame([("custom", 2), ("geo", 0), ("org", 1)], "pack string, o int")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("qid")).crossJoin(F.broadcast(v))
    s = rows.selectExpr("qid", "pack", "o", "cast(floor(qid / pow(3, o)) % 3 as int) as s", "round(0.7D + ((qid * (o + 3)) % 31) / 110.0D, 6) as top_confidence")
    said = s.selectExpr(
        "qid", "pack", "case s when 0 then 'resolved' when 1 then 'ambiguous' else 'no_match' end as status", "case when s = 0 then concat(pack, '/', qid) end as entity_id", "top_confidence as confidence",
        "case when s = 0 then cast(3 + (qid + o) % 3 as int) end as tier", "'said' as reason", "top_confidence", "array() as candidates",
    )
    return cascade.merge_packs(said).select("qid", "status", "entity_id", "pack")


@query(sql("""SELECT value, 'ambiguous' AS status, max(CASE WHEN r = 1 THEN entity_id END) AS cand_1_id, max(CASE WHEN r = 2 THEN entity_id END) AS cand_2_id, max(CASE WHEN r = 3 THEN entity_id END) AS cand_3_id, max(CASE WHEN r = 1 THEN canonical_name END) AS cand_1_name FROM (
SELECT q.value, h.entity_id, canonical_name, count(*) OVER (PARTITION BY q.value) AS n, row_number() OVER (PARTITION BY q.value ORDER BY alias, coalesce(prominence, 0.5) DESC, h.entity_id) AS r FROM (SELECT DISTINCT p_name AS value FROM part) q
JOIN (SELECT value_norm, entity_id, bool_and(name_kind = 'alias') AS alias FROM names WHERE entity_id LIKE 'custom/%' GROUP BY 1, 2) h ON h.value_norm = lower(q.value) JOIN entities USING (entity_id)) WHERE n > 1 GROUP BY value"""))
def s9_review(spark, d):
    g = graph(spark, d)
    q = table(spark, d, "part").select(F.col("p_name").alias("text")).distinct().withColumn("qid", F.col("text"))
    rows = linking.review(cascade.resolve(g, q, packs=["custom"], fuzzy=False), g)
    return rows.select("value", "status", "cand_1_id", "cand_2_id", "cand_3_id", "cand_1_name")


# --- what follows a decision -------------------------------------------------------------------------------------

ANSWERS = """answers AS (SELECT c_custkey AS qid, c_custkey % 2 = 0 AS open, 'org/cust-' || c_custkey AS e1, 0.9::DOUBLE AS p1, CASE WHEN c_custkey % 7 = 0 THEN 'geo.organization' ELSE 'org.company' END AS t1,
'groups/' || c_mktsegment AS e2, round(0.9 - (c_custkey % 5) / 1000.0::DOUBLE, 4) AS p2, CASE c_custkey % 3 WHEN 0 THEN 'geo.organization' WHEN 1 THEN 'geo.country' ELSE 'geo.region' END AS t2,
'country/' || c_nationkey AS e3, round(0.9 - (c_custkey % 3) / 1000.0::DOUBLE, 4) AS p3, CASE WHEN c_custkey % 4 = 0 THEN 'geo.country' ELSE 'geo.city' END AS t3 FROM customer)"""


def answers(spark, d):
    c = table(spark, d, "customer").selectExpr(
        "c_custkey as qid", "case when c_custkey % 2 = 0 then 'ambiguous' else 'resolved' end as status", "concat('org/cust-', c_custkey) as e1", "case when c_custkey % 7 = 0 then 'geo.organization' else 'org.company' end as t1",
        "concat('groups/', c_mktsegment) as e2", "round(0.9D - (c_custkey % 5) / 1000.0D, 4) as p2", "case c_custkey % 3 when 0 then 'geo.organization' when 1 then 'geo.country' else 'geo.region' end as t2",
        "concat('country/', c_nationkey) as e3", "round(0.9D - (c_custkey % 3) / 1000.0D, 4) as p3", "case when c_custkey % 4 = 0 then 'geo.country' else 'geo.city' end as t3",
    )
    item = lambda e, p, t: F.struct(F.col(e).alias("entity_id"), p.alias("confidence"), F.col(t).alias("entity_type"))
    listed = F.array(item("e1", F.lit(0.9), "t1"), item("e2", F.col("p2"), "t2"), item("e3", F.col("p3"), "t3"))
    open_ = F.col("status") == "ambiguous"
    return c.select("qid", "status", F.when(~open_, F.col("e1")).alias("entity_id"), F.when(~open_, F.lit(0.9)).alias("confidence"), F.when(open_, "low_gap").otherwise("exact_name_match").alias("reason"), listed.alias("candidates"))


@query("WITH " + ANSWERS + """, w AS (SELECT *, CASE WHEN open AND t1 = 'geo.organization' AND t2 <> 'geo.organization' THEN 1 WHEN open AND t2 = 'geo.organization' AND t1 <> 'geo.organization' THEN 2 ELSE 0 END AS k FROM answers)
SELECT qid, CASE WHEN open AND k = 0 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN k = 2 THEN e2 WHEN k = 1 OR NOT open THEN e1 END AS entity_id, CASE WHEN k = 2 THEN p2 WHEN k = 1 OR NOT open THEN p1 END AS confidence,
CASE WHEN k > 0 THEN 'group_preference_tiebreak' WHEN open THEN 'low_gap' ELSE 'exact_name_match' END AS reason FROM w""")
def d17_group_preference(spark, d):
    return explain.group_preference(answers(spark, d)).drop("candidates")


SPEC = "CASE t WHEN 'geo.country' THEN 0 WHEN 'geo.admin1' THEN 1 WHEN 'geo.region' THEN 2 WHEN 'geo.organization' THEN 4 ELSE 99 END"


@query("WITH " + ANSWERS + f""", x AS (SELECT qid, 0 AS i, e1 AS e, p1 AS p, t1 AS t FROM answers UNION ALL SELECT qid, 1, e2, p2, t2 FROM answers UNION ALL SELECT qid, 2, e3, p3, t3 FROM answers),
y AS (SELECT *, {SPEC} AS r, bool_or({SPEC} <= 1) OVER (PARTITION BY qid) AND bool_or({SPEC} BETWEEN 2 AND 3) OVER (PARTITION BY qid) AS mixed FROM x)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN mixed THEN -round(p, 3) ELSE 0 END, CASE WHEN mixed THEN r ELSE 0 END, i) - 1 AS INT) AS place, e AS entity_id FROM y""")
def w6_specific_first(spark, d):
    return answers(spark, d).select("qid", F.posexplode(explain.specific_first(F.col("candidates"))).alias("place", "c")).select("qid", "place", F.col("c.entity_id").alias("entity_id"))


@query("""WITH s AS (SELECT c_custkey AS qid, pack, common, 'e-' || pack || '-' || i AS entity_id, i FROM customer, (VALUES ('geo', 4), ('org', 2), ('custom', 3)) v(pack, n),
LATERAL (SELECT CASE pack WHEN 'geo' THEN 0.8 WHEN 'org' THEN (c_custkey % 10) / 10.0 ELSE (c_custkey % 4) / 4.0 END::DOUBLE AS common), LATERAL (SELECT unnest(range(0, n)) AS i)),
p AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY common DESC, pack) AS r FROM s WHERE i < 3)
SELECT qid, CAST(place AS INT) AS place, entity_id FROM (SELECT qid, entity_id, row_number() OVER (PARTITION BY qid ORDER BY i, r) - 1 AS place FROM p) WHERE place < 5""")
def w7_interleaved(spark, d):
    v = spark.createDataFrame([("geo", 4), ("org", 2), ("custom", 3)], "pack string, n int")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("qid")).crossJoin(F.broadcast(v))
    common = F.expr("case pack when 'geo' then 0.8D when 'org' then (qid % 10) / 10.0D else (qid % 4) / 4.0D end")
    listed = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.concat(F.lit("e-"), "pack", F.lit("-"), i.cast("string")).alias("entity_id")))
    out = explain.interleave(rows.select("qid", "pack", common.alias("common"), listed.alias("candidates")))
    return out.select("qid", F.posexplode("candidates").alias("place", "c")).select("qid", "place", F.col("c.entity_id").alias("entity_id"))


@query(sql("""SELECT qid, pos, entity_id, canonical_name, entity_type, (SELECT canonical_name FROM entities p WHERE p.entity_id = (SELECT min(target_id) FROM relations r WHERE r.entity_id = y.entity_id AND relation_type IN ('contained_in', 'part_of'))) AS parent_name,
CASE WHEN count(DISTINCT entity_type) OVER (PARTITION BY qid) > 1 THEN 1 ELSE 0 END AS type_hint FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY entity_id) - 1 AS INT) AS pos, entity_id, canonical_name, entity_type FROM hits JOIN entities USING (entity_id)) y""", NORM, HITS))
def d18_enriched(spark, d):
    g = graph(spark, d)
    listed = F.transform(F.sort_array(F.collect_list("entity_id")), lambda e: F.struct(e.alias("entity_id"), F.lit(0.9).alias("confidence")))
    results = hits(spark, d, g).groupBy("qid").agg(listed.alias("candidates")).withColumn("status", F.lit("ambiguous"))
    out = explain.hints(explain.enrich(g, results))
    rows = out.select("qid", F.array_contains("refinement_hints", "entity_types").cast("int").alias("type_hint"), F.posexplode("candidates").alias("pos", "c"))
    return rows.select("qid", "pos", "c.entity_id", "c.canonical_name", "c.entity_type", "c.parent_name", "type_hint")


@query(sql("""SELECT qid, max(CASE WHEN place = 1 THEN entity_id || ' ' || printf('%.3f', s) || ' by ' || CASE s WHEN 0.95 THEN 'exact_code' WHEN 0.92 THEN 'exact_name' ELSE 'acronym' END END)
|| coalesce('; also ' || string_agg(CASE WHEN place > 1 THEN entity_id || ' ' || printf('%.3f', s) END, ', ' ORDER BY place), '') AS line FROM ranked WHERE place <= 6 GROUP BY qid""", *RESOLVED))
def explain_scorecards(spark, d):
    g = cascade.pack_graph(graph(spark, d), cascade.ORG)
    q = cascade.prepare(asked(spark, d))
    rows = cascade.score(g, cascade.candidates(cascade.generate(g, q, cascade.ORG, fuzzy=False)), q, cascade.ORG)
    return explain.render(explain.scorecards(rows))


@query()
def d19_snap(spark, d):
    g = graph(spark, d)
    allowed = g.entities.where("entity_id like 'org/supp-%'").select("entity_id")
    return cascade.snap(g, asked(spark, d), allowed, ["org"]).withColumn("confidence", F.round("confidence", 6))


@query("SELECT x, round(CASE WHEN x <= 0.2 THEN 0.1 WHEN x < 0.5 THEN 0.1 + (x - 0.2) * (0.4 - 0.1) / (0.5 - 0.2) WHEN x < 0.9 THEN 0.4 + (x - 0.5) * (0.95 - 0.4) / (0.9 - 0.5) ELSE 0.95 END, 9)::DOUBLE AS isotonic, round(1 / (1 + exp(-(x * 1.5 + least(n / 20.0, 1) * 0.7 - 0.4))), 9)::DOUBLE AS logistic FROM (SELECT DISTINCT l_discount::DOUBLE * 10 AS x, CAST(l_quantity AS INT) AS n FROM lineitem)")
def d9_calibrators(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("x"), F.col("l_quantity").cast("int").alias("query_len")).distinct()
    model = scoring.logistic({"x": 1.5, "query_len": 0.7}, -0.4)
    return rows.select("x", F.round(scoring.isotonic(F.col("x"), [0.2, 0.5, 0.9], [0.1, 0.4, 0.95]), 9).alias("isotonic"), F.round(model, 9).alias("logistic"))


@query("""WITH f AS (SELECT l_returnflag = 'R' AS code, l_returnflag = 'A' AS name, l_linenumber = 1 AS ax, l_linenumber <= 2 AS ah, CASE WHEN l_discount > 0.03 THEN l_discount * 10 END AS tok, CASE WHEN l_tax > 0.02 THEN l_tax * 12 END AS bm FROM lineitem)
SELECT round(CASE WHEN code THEN 0.95 WHEN name THEN 0.92 WHEN ax THEN 0.88 WHEN ah THEN 0.82 WHEN tok IS NOT NULL THEN 0.5 + 0.35 * tok WHEN bm IS NOT NULL THEN 0.4 + 0.35 * bm ELSE 0.3 END, 6)::DOUBLE AS org,
round(CASE WHEN code THEN 0.95 WHEN name THEN 0.9 WHEN tok IS NOT NULL THEN least(0.89, 0.5 + 0.35 * tok + 0.1 * tok) WHEN bm IS NOT NULL THEN 0.4 + 0.4 * bm ELSE 0.3 END, 6)::DOUBLE AS custom, count(*) AS n FROM f GROUP BY 1, 2""")
def d6_d7_scores(spark, d):
    f = table(spark, d, "lineitem").selectExpr(
        "l_returnflag = 'R' as exact_code_hit", "l_returnflag = 'A' as exact_name_hit", "l_linenumber = 1 as acronym_exact", "l_linenumber <= 2 as acronym_hit",
        "case when l_discount > 0.03 then l_discount * 10 end as fuzzy_token_sim", "case when l_discount > 0.03 then l_discount * 10 end as fuzzy_edit_sim", "case when l_tax > 0.02 then l_tax * 12 end as fts_bm25_norm",
    )
    return f.groupBy(F.round(scoring.org_raw(), 6).alias("org"), F.round(scoring.custom_raw(), 6).alias("custom")).agg(F.count("*").alias("n"))


# --- metrics and training ----------------------------------------------------------------------------------------


@query("WITH x AS (SELECT p_name, list(p_partkey) AS expected, [max(CASE WHEN p_size > 10 THEN p_partkey END), 0] AS found FROM part GROUP BY 1) SELECT count(*) AS n, avg(CAST(list_has_any(expected, list_filter(found, lambda y: y IS NOT NULL)) AS INT)) AS recall FROM x WHERE len(expected) >= 2")
def a10_ambiguity_recall(spark, d):
    rows = table(spark, d, "part").groupBy("p_name").agg(F.collect_list("p_partkey").alias("expected"), F.max(F.when(F.col("p_size") > 10, F.col("p_partkey"))).alias("m"))
    return metrics.ambiguity_recall(rows.select("expected", F.array_compact(F.array("m", F.lit(0).cast("long"))).alias("found")))


@query()
def a16_span_overlaps(spark, d):
    docs = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    found = parse.parse(words_graph(spark, d), docs).select("doc_id", "start", "end", "entity_id")
    gold = found.where("start % 5 <> 0").withColumn("start", F.when(F.col("start") % 3 == 0, F.col("start") + 1).otherwise(F.col("start")))
    return metrics.span_overlaps(gold, found)


@query("""SELECT query_text, expected_entity_id, ('0x' || substr(md5('42|' || lower(query_text)), 1, 6))::BIGINT < 3355443 AS is_eval FROM (SELECT DISTINCT ON (lower(q), e) q AS query_text, e AS expected_entity_id
FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS q, p_type AS e, p_partkey AS k FROM part) ORDER BY lower(q), e, k)""")
def a18_examples_split(spark, d):
    rows = table(spark, d, "part").selectExpr("case when p_partkey % 2 = 0 then upper(p_name) else p_name end as query_text", "p_type as expected_entity_id", "p_partkey as k")
    return calibration.split(calibration.dedup_examples(rows, "k")).drop("k")


@query()
def a19_fitted_calibrators(spark, d):
    rows = scored(spark, d).select("p", "y", (F.col("doc_id") % 12).alias("query_len"))
    fits = [("platt", calibration.fit_platt(rows)), *zip(("short", "long"), calibration.fit_stratified(rows), strict=True)]
    return spark.createDataFrame([(k, round(c.a, 6), round(c.b, 6)) for k, c in fits], "part string, a double, b double")


TYPED = "pre(qid, text, norm) AS (SELECT DISTINCT t, t, lower(t) FROM (SELECT substr(n_name, 1, i) AS t FROM nation, LATERAL (SELECT unnest(range(1, length(n_name) + 1)) AS i)))"


@query(sql("""SELECT count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr, avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS success_at_1, avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END) AS reachable FROM (
SELECT n_name, min(rank) AS rank FROM nation LEFT JOIN (SELECT qid, entity_id, row_number() OVER (PARTITION BY qid, text ORDER BY cls, w, -p, k, length(value_norm), entity_id) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY qid, text, entity_id ORDER BY cls, w, -p, k, length(value_norm), value) AS rn FROM (
SELECT hit.*, coalesce(prominence, 0) AS p, CASE WHEN value_norm = norm AND (entity_type <> 'geo.country' OR coalesce(prominence, 0) >= 0.3) THEN 0 ELSE 1 END AS w,
CASE WHEN name_kind = 'canonical' THEN 0 WHEN is_preferred THEN 1 WHEN name_kind IN ('alias', 'endonym', 'exonym') THEN 2 ELSE 3 END AS k FROM hit JOIN entities USING (entity_id))) WHERE rn = 1) s
ON starts_with(n_name, s.qid) AND s.entity_id = 'country/' || n_nationkey AND rank <= 10 GROUP BY n_name)""", TYPED, SUGGEST))
def a22_typeahead(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("query"), F.concat(F.lit("country/"), "n_nationkey").alias("entity_id"))
    typed = metrics.prefix_sequence(names.select("query"))
    found = suggest.suggest(graph(spark, d), typed.select("text").distinct().withColumn("qid", F.col("text")))
    each = typed.join(names, "query").join(found.select("text", "entity_id", "rank"), ["text", "entity_id"], "left")
    return metrics.typeahead(each.select("query", "rank")).withColumn("mrr", F.round("mrr", 9))


@query("WITH " + WORDS_SQL + ", w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_#''-]+')) AS s FROM documents) SELECT id AS entity_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w JOIN gaz ON lower(s) = norm GROUP BY id")
def x5_plain_tagger(spark, d):
    out = parse.tag_plainly(words_graph(spark, d), table(spark, d, "documents").select("doc_id", "text"))
    return out.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


# --- building and streams ----------------------------------------------------------------------------------------


@query(sql("""SELECT t, count(*) AS n FROM (SELECT 'entities' AS t, entity_id FROM entities UNION ALL SELECT 'names', entity_id FROM names WHERE entity_id IN (SELECT entity_id FROM entities) UNION ALL SELECT 'codes', entity_id FROM codes
UNION ALL SELECT 'relations', entity_id FROM relations WHERE target_id IN (SELECT entity_id FROM entities)) GROUP BY t"""))
def e10_merged_types(spark, d):
    g = graph(spark, d)
    new = g.with_tables(entities=g.entities.where("entity_type like 'geo.%'").withColumn("canonical_name", F.upper("canonical_name")))
    return table_counts(build.merge_types(g, new, ["geo.region", "geo.country"]))


def table_counts(g):
    out = None
    for name, t in g.tables().items():
        own = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = own if out is None else out.union(own)
    return out


@query(sql("""SELECT 'world/0' AS entity_id, 0 AS level, 0 AS place UNION ALL SELECT e, 1, p FROM l1 UNION ALL SELECT e, 2, p FROM l2 UNION ALL SELECT e, 3, p FROM l3""",
"c AS (SELECT target_id AS up, entity_id AS e FROM relations WHERE relation_type = 'contained_in')", "l1 AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS p FROM c WHERE up = 'world/0')",
"l2 AS (SELECT c.e, row_number() OVER (ORDER BY l1.p, c.e) - 1 AS p FROM c JOIN l1 ON c.up = l1.e)", "l3 AS (SELECT c.e, row_number() OVER (ORDER BY l2.p, c.e) - 1 AS p FROM c JOIN l2 ON c.up = l2.e)"))
def e11_discovery(spark, d):
    children = graph(spark, d).relations.where("relation_type = 'contained_in'").select(F.col("target_id").alias("parent_id"), "entity_id")
    return build.discover(children, spark.createDataFrame([("world/0",)], "entity_id string"))


@query(sql("SELECT 'entities' AS t, count(*) AS n FROM entities UNION ALL SELECT 'names', count(*) FROM names UNION ALL SELECT 'codes', count(*) FROM codes UNION ALL SELECT 'relations', count(*) FROM relations"))
def s10_pack_round_trip(spark, d):
    path = scratch(spark, "pack")
    packs.write_pack(graph(spark, d), path, "all", "geo")
    return table_counts(packs.read_pack(spark, path))


@query(sql("SELECT 'entities' AS t, count(*) AS n FROM entities WHERE entity_id NOT LIKE 'region/%' UNION ALL SELECT 'names', count(*) FROM names WHERE entity_id NOT LIKE 'region/%' UNION ALL SELECT 'codes', count(*) FROM codes UNION ALL SELECT 'relations', count(*) FROM relations WHERE entity_id NOT LIKE 'region/%' AND target_id NOT LIKE 'region/%' AND target_id IN (SELECT entity_id FROM entities)"))
def e1_staged_build(spark, d):
    from oriel.operators import constraints

    loaded = lambda g: g.with_tables(relations=g.relations.join(g.entities.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi").select(*g.relations.columns))
    stages = [("filter", lambda g: constraints.drop_noise(g, ["region/%"], [])), ("close", loaded)]
    return table_counts(build.run_stages(graph(spark, d), stages, scratch(spark, "build"))[0])


@query(sql("SELECT entity_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, 'c-' || (user_id % 200) AS k FROM events) LEFT JOIN codes ON system = 'custkey' AND value_norm = k GROUP BY ALL"
    .replace("SELECT event_type, value,", "SELECT event_type, value AS amount,").replace("sum(value)", "sum(amount)")))
def stream_codes(spark, d):
    """Events read as a stream, joined with the static codes, and written once each; then counted."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d.rstrip('/')}/events*.parquet")
    coded = events.select("event_type", "value", F.concat(F.lit("C-"), F.col("user_id") % 200).alias("code"))
    out, at = scratch(spark, "stream"), scratch(spark, "stream-state")
    streams.resolve_codes(graph(spark, d), coded, "code", "custkey").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("entity_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
