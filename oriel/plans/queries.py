"""Queries of the engine over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oriel.functions import scoring, text
from oriel.operators import closure, constraints, etl, linking, lookup, metrics, parse, suggest
from oriel.operators import resolve as cascade
from oriel.plans.oracle_graph import squeeze, sql
from oriel.session import honest_sizes, materialise, table, workers_see_package
from oriel.sources import graph as graphs
from oriel.sources.graph import EntityGraph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return keep


_stored: dict[tuple[str, str], EntityGraph] = {}


def graph(spark: SparkSession, sf_dir: str) -> EntityGraph:
    """The graph of a data folder, derived once per application and stored as tables in the shared folder."""
    honest_sizes(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        _stored.clear()
        tables = graphs.from_warehouse(spark, sf_dir).tables()
        with ThreadPoolExecutor(len(tables)) as pool:  # four independent jobs
            stored = pool.map(lambda x: (x[0], materialise(x[1], f"graph-{x[0]}")), tables.items())
            _stored[key] = EntityGraph(**dict(stored))
    return _stored[key]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, text): one query per customer, as name, spelling variant, code, placeholder or another's code."""
    k, name = "c_custkey", "c_name"
    return table(spark, sf_dir, "customer").select(
        F.col(k).alias("qid"),
        F.expr(
            f"case {k} % 8 when 0 then {name} when 1 then upper({name}) when 2 then concat('  ', replace({name}, '#', '  '), ' ') when 3 then concat('C-', {k}) "
            f"when 4 then concat(substr({name}, 1, 2), substr({name}, 4)) when 5 then 'unknown' when 6 then concat('S-', cast(floor({k} / 8) as bigint)) "
            f"else concat('Supplier 00000', lpad(cast({k} % 1000 as string), 4, '0')) end"
        ).alias("text"),
    )


def normal(q: DataFrame) -> DataFrame:
    return q.withColumn("norm", text.squeeze(F.col("text")))


NORM = f"q(qid, text, norm) AS (SELECT qid, text, {squeeze('text')} FROM asked)"

# --- scans and lookups ---------------------------------------------------------------------------------------


@query(sql("SELECT entity_id FROM entities"))
def s1_all_ids(spark, d):
    return graph(spark, d).entities.select("entity_id")


@query(sql("SELECT value_norm, n.entity_id, name_kind, is_preferred, value, entity_type FROM names n JOIN entities e ON n.entity_id = e.entity_id WHERE starts_with(entity_type, 'geo.') OR starts_with(entity_type, 'org.')"))
def s2_iter_names(spark, d):
    return lookup.iter_names(graph(spark, d), include=["geo.", "org."])


@query(sql("SELECT value_norm, n.entity_id, name_kind, is_preferred, value, entity_type FROM names n JOIN entities e ON n.entity_id = e.entity_id WHERE starts_with(entity_type, 'geo.') AND NOT starts_with(entity_type, 'geo.reg')"))
def s3_suggest_names(spark, d):
    return lookup.iter_names(graph(spark, d), include=["geo."], exclude=["geo.reg"])


@query(sql("""
SELECT e.entity_id, canonical_name, entity_type,
  (SELECT string_agg(name_kind || '=' || value, ';' ORDER BY name_kind, value) FROM names n WHERE n.entity_id = e.entity_id) AS names,
  (SELECT string_agg(system || '=' || value, ';' ORDER BY system, value) FROM codes c WHERE c.entity_id = e.entity_id) AS codes,
  (SELECT count(*) FROM relations r WHERE r.entity_id = e.entity_id) AS n_relations
FROM entities e WHERE entity_type LIKE 'geo.%'"""))
def s4_hydrate(spark, d):
    g = graph(spark, d)
    rows = lookup.hydrate(g, g.entities.where(F.col("entity_type").startswith("geo.")))
    flat = lambda c, k: F.array_join(F.array_sort(F.transform(c, lambda x: F.concat_ws("=", x[k], x["value"]))), ";")
    null = lambda c: F.when(c != "", c)
    return rows.select("entity_id", "canonical_name", "entity_type", null(flat("names", "name_kind")).alias("names"), null(flat("codes", "system")).alias("codes"), F.coalesce(F.size("relations"), F.lit(0)).cast("long").alias("n_relations"))


@query(sql("SELECT entity_id, canonical_name FROM entities WHERE entity_type = 'geo.country'"))
def s5_by_type(spark, d):
    return graph(spark, d).entities.where("entity_type = 'geo.country'").select("entity_id", "canonical_name")


@query(sql("SELECT DISTINCT 'system' AS kind, system AS value FROM codes UNION ALL SELECT DISTINCT 'relation', relation_type FROM relations"))
def s6_systems_and_relations(spark, d):
    g = graph(spark, d)
    return g.codes.select(F.lit("system").alias("kind"), F.col("system").alias("value")).distinct().union(g.relations.select(F.lit("relation"), "relation_type").distinct())


@query(sql("SELECT qid, text, entity_id, system FROM asked JOIN codes ON lower(trim(text)) = value_norm"))
def j1_code_lookup(spark, d):
    return lookup.lookup_code(graph(spark, d), asked(spark, d))


@query(sql("SELECT DISTINCT qid, text, norm, entity_id, name_kind FROM q JOIN names ON norm = value_norm WHERE name_kind IN ('canonical', 'alias')", NORM))
def j3_name_lookup(spark, d):
    return lookup.lookup_name(graph(spark, d), normal(asked(spark, d)), ["canonical", "alias"])


FTS = (
    "docs AS (SELECT DISTINCT entity_id, value_norm FROM names)",
    "toks AS (SELECT entity_id, value_norm, list_filter(regexp_split_to_array(lower(entity_id || ' ' || value_norm), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM docs)",
    "post AS (SELECT entity_id, value_norm, len(w) AS dl, tok, count(*) AS tf FROM (SELECT entity_id, value_norm, w, unnest(w) AS tok FROM toks) GROUP BY ALL)",
    "stat AS (SELECT count(*) AS nd, avg(len(w)) AS al FROM toks)",
    "idf AS (SELECT tok, greatest(1e-6, ln((nd - df + 0.5) / (df + 0.5))) AS idf, al FROM (SELECT tok, count(*) AS df FROM post GROUP BY tok), stat)",
    "terms AS (SELECT p_name AS qid, p_name AS q, unnest(list_distinct(string_split(lower(p_name), ' '))) AS tok FROM (SELECT DISTINCT p_name FROM part))",
    "need AS (SELECT qid, count(*) AS n FROM terms GROUP BY qid)",
    """hit AS (SELECT t.qid, p.entity_id, p.value_norm, t.q, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS bm25, count(*) AS m
      FROM terms t JOIN post p ON t.tok = p.tok JOIN idf ON idf.tok = t.tok GROUP BY ALL)""",
    "ok AS (SELECT hit.*, contains(' ' || value_norm || ' ', ' ' || lower(q) || ' ') AS phrase FROM hit JOIN need ON hit.qid = need.qid AND m = n)",
    "best AS (SELECT qid, entity_id, max(CASE WHEN phrase THEN bm25 END) AS pb, max(bm25) AS ab FROM ok GROUP BY qid, entity_id)",
    "sel AS (SELECT qid, entity_id, CASE WHEN max(pb IS NOT NULL) OVER (PARTITION BY qid) THEN pb ELSE ab END AS bm25 FROM best)",
)


@query(sql("SELECT qid, entity_id, bm25, rank FROM (SELECT qid, entity_id, round(bm25, 6) AS bm25, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, entity_id) AS INT) AS rank FROM sel WHERE bm25 IS NOT NULL) WHERE rank <= 50", *FTS))
def j4_full_text(spark, d):
    """Every part name, each distinct one looked up once."""
    q = table(spark, d, "part").select(F.col("p_name").alias("qid"), F.lower("p_name").alias("norm")).distinct()
    return lookup.full_text(graph(spark, d).names, q, 50).withColumn("bm25", F.round("bm25", 6))


PREFIXES = "pre(qid, text, norm) AS (SELECT DISTINCT substr(c_name, 1, n), substr(c_name, 1, n), lower(substr(c_name, 1, n)) FROM customer, (SELECT unnest([1, 3, 8, 17]) AS n) UNION SELECT DISTINCT p_type, substr(p_name, 1, 4), lower(substr(p_name, 1, 4)) FROM part)"


def prefixes(spark, d):
    n = F.explode(F.array(*[F.lit(i) for i in (1, 3, 8, 17)]))
    a = table(spark, d, "customer").select("c_name", n.alias("n")).select(F.expr("substr(c_name, 1, n)").alias("qid"), F.expr("substr(c_name, 1, n)").alias("text"))
    b = table(spark, d, "part").select(F.col("p_type").alias("qid"), F.substring("p_name", 1, 4).alias("text"))
    return a.union(b).distinct().withColumn("norm", F.lower("text"))


@query(sql("SELECT qid, text, count(*) AS n_names, count(DISTINCT entity_id) AS n_entities, min(entity_id) AS first_id FROM pre JOIN names ON starts_with(value_norm, norm) GROUP BY qid, text", PREFIXES))
def j5_prefix(spark, d):
    asked_ = prefixes(spark, d)
    # many rows ask for one beginning: its names are counted once
    hits = lookup.prefix_join(graph(spark, d).names.select("entity_id", "value_norm"), asked_.select("norm").distinct())
    each = hits.groupBy("norm", "entity_id").agg(F.count("*").alias("n"))
    counted = each.groupBy("norm").agg(F.sum("n").alias("n_names"), F.count("entity_id").alias("n_entities"), F.min("entity_id").alias("first_id"))
    return asked_.join(counted, "norm").select("qid", "text", "n_names", "n_entities", "first_id")


@query(sql("""SELECT DISTINCT w AS qid, entity_id, value_norm FROM (SELECT entity_id, value_norm, string_split(value_norm, ' ') AS ws FROM names) n
JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part) p ON list_contains(list_transform(ws[2:], lambda x: starts_with(x, w)), true)"""))
def j6_infix(spark, d):
    q = table(spark, d, "part").select(F.split("p_name", " ")[1].alias("qid")).distinct().withColumn("norm", F.col("qid"))
    return lookup.infix_join(graph(spark, d).names, q).select("qid", "entity_id", "value_norm").distinct()


TERMS = "term AS (SELECT DISTINCT value_norm AS term FROM names WHERE starts_with(entity_id, 'custom/') OR starts_with(entity_id, 'country/') OR starts_with(entity_id, 'region/'))"
TYPOS = "typo(qid, norm) AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 1, 2) || substr(p_name, 4) WHEN 1 THEN p_name || 'x' WHEN 2 THEN 'q' || substr(p_name, 2) ELSE replace(p_name, ' ', '') END FROM part)"


@query(sql("SELECT qid, term, CAST(dist AS INT) AS distance FROM (SELECT qid, term, levenshtein(norm, term) AS dist, min(levenshtein(norm, term)) OVER (PARTITION BY qid) AS lo FROM typo, term WHERE levenshtein(norm, term) <= 2) WHERE dist = lo", TERMS, TYPOS))
def j7_edit_join(spark, d):
    terms = graph(spark, d).names.where("entity_id like 'custom/%' or entity_id like 'country/%' or entity_id like 'region/%'").select(F.col("value_norm").alias("term")).distinct()
    q = table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.expr("case p_partkey % 4 when 0 then concat(substr(p_name, 1, 2), substr(p_name, 4)) when 1 then concat(p_name, 'x') when 2 then concat('q', substr(p_name, 2)) else replace(p_name, ' ', '') end").alias("norm"))
    # texts repeat: each distinct one is corrected once
    distinct = q.select("norm").distinct().withColumn("qid", F.col("norm"))
    close = lookup.edit_join(terms, distinct).withColumnRenamed("qid", "norm")
    return q.join(close, "norm").select("qid", "term", "distance")


@query(sql("SELECT entity_id, relation_type, target_id FROM relations WHERE relation_type IN ('member_of', 'supplies') AND (valid_from IS NULL OR valid_from <= DATE '1998-06-01') AND (valid_until IS NULL OR DATE '1998-06-01' < valid_until)"))
def j12_relations_as_of(spark, d):
    rows = graph(spark, d).relations.where(F.col("relation_type").isin("member_of", "supplies"))
    return rows.where(lookup.active(F.lit("1998-06-01").cast("date"))).select("entity_id", "relation_type", "target_id")


@query(sql("SELECT target_id, relation_type, count(*) AS n, min(entity_id) AS first_id FROM relations GROUP BY target_id, relation_type"))
def j13_reverse_relations(spark, d):
    return graph(spark, d).relations.groupBy("target_id", "relation_type").agg(F.count("*").alias("n"), F.min("entity_id").alias("first_id"))


RECORDS = "rec AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN 'C-' || c_custkey END AS custkey, CASE WHEN c_custkey % 3 = 1 THEN c_name WHEN c_custkey % 6 = 2 THEN 'small ring' WHEN c_custkey % 6 = 0 THEN 'nobody' END AS name, CASE WHEN c_custkey % 11 = 0 THEN 'x' END AS badkey FROM customer)"


def records(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey as row_id", "case when c_custkey % 3 = 0 then concat('C-', c_custkey) end as custkey",
        "case when c_custkey % 3 = 1 then c_name when c_custkey % 6 = 2 then 'small ring' when c_custkey % 6 = 0 then 'nobody' end as name", "case when c_custkey % 11 = 0 then 'x' end as badkey",
    )


LINKED = (
    RECORDS,
    f"""tries AS (SELECT row_id, 0 AS ord, 'badkey' AS k, -1 AS n, NULL AS e FROM rec WHERE badkey IS NOT NULL
      UNION ALL SELECT row_id, 1, 'custkey', count(DISTINCT entity_id), min(entity_id) FROM rec JOIN codes ON system = 'custkey' AND value_norm = lower(custkey) GROUP BY row_id
      UNION ALL SELECT row_id, 2, 'name', count(DISTINCT entity_id), min(entity_id) FROM rec JOIN names ON value_norm = {squeeze('name')} GROUP BY row_id)""",
    "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ord) AS rn FROM tries) WHERE rn = 1)",
    "linked AS (SELECT rec.row_id, CASE WHEN n = -1 THEN 'invalid_key' WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'no_match' END AS status, CASE WHEN n = 1 THEN e END AS entity_id, CASE WHEN n = 1 THEN k END AS key FROM rec LEFT JOIN firsts USING (row_id))",
)


@query(sql("SELECT row_id, status, entity_id, key FROM linked", *LINKED))
def j14_link_records(spark, d):
    return linking.link(graph(spark, d), records(spark, d), "row_id", ["badkey", "custkey", "name"])


@query(sql("SELECT CASE status WHEN 'no_match' THEN 'skipped' ELSE status END AS status, count(*) AS n FROM linked GROUP BY 1", *LINKED))
def b2_augment_tally(spark, d):
    return linking.augment(graph(spark, d), records(spark, d), "row_id", ["badkey", "custkey", "name"])[1]


@query(sql("SELECT value, c.entity_id, e.entity_id IS NULL AND c.entity_id IS NOT NULL AS offender FROM (SELECT DISTINCT c_mktsegment AS value, CASE WHEN c_mktsegment LIKE 'B%' THEN NULL WHEN c_mktsegment LIKE 'M%' THEN 'groups/none' ELSE 'groups/' || c_mktsegment END AS entity_id FROM customer) c LEFT JOIN entities e USING (entity_id)"))
def j15_crosswalk_offenders(spark, d):
    cross = table(spark, d, "customer").selectExpr("c_mktsegment as value", "case when c_mktsegment like 'B%' then null when c_mktsegment like 'M%' then 'groups/none' else concat('groups/', c_mktsegment) end as entity_id").distinct()
    bad = linking.offenders(graph(spark, d), cross).select("value", F.lit(True).alias("offender"))
    return cross.join(bad, "value", "left").withColumn("offender", F.coalesce("offender", F.lit(False)))


# --- text and scalar functions ---------------------------------------------------------------------------------


@query(sql(f"SELECT qid, {squeeze('text')} AS norm, trim(regexp_replace(regexp_replace({squeeze('text')}, '[^\\w\\s''-]', '', 'g'), '\\s+', ' ', 'g')) AS stripped FROM asked"))
def t1_normalise(spark, d):
    return asked(spark, d).select("qid", text.normalise(F.col("text"), "standard").alias("norm"), text.normalise(F.col("text"), "org").alias("stripped"))


SHAPES = """SELECT DISTINCT t AS text, length(trim(t)) <= 20 AND lower(trim(t)) IN ('unknown', 'none', 'null', 'test', '0', '000', '001', '999', '998') AS sentinel,
CASE WHEN regexp_full_match(t, '[A-Za-z]{2,3}') THEN 'alpha' WHEN regexp_full_match(t, '[0-9]{3}') THEN 'numeric' WHEN regexp_full_match(lower(t), '(wikidata:)?q[0-9]+') THEN 'wikidata' WHEN regexp_full_match(t, '[a-z]+/[A-Za-z0-9_-]+') THEN 'dcid' END AS shape,
NOT regexp_full_match(t, '[A-Za-z]{1,3}') OR regexp_full_match(t, '[A-Z]{2,3}') AS passes
FROM (SELECT value AS t FROM codes UNION ALL SELECT value_norm FROM codes UNION ALL SELECT text FROM asked UNION ALL SELECT entity_id FROM entities WHERE entity_type LIKE 'geo%') WHERE t = trim(t)"""


@query(sql(SHAPES))
def t9_t14_gates_and_shapes(spark, d):
    g = graph(spark, d)
    t = g.codes.select(F.col("value").alias("text")).union(g.codes.select("value_norm")).union(asked(spark, d).select("text")).union(g.entities.where("entity_type like 'geo%'").select("entity_id")).where("text = trim(text)").distinct()
    c = F.col("text")
    return t.select("text", text.is_sentinel(c).alias("sentinel"), text.code_shape(c).alias("shape"), text.short_input_passes(c).alias("passes"))


@query(sql("""SELECT value, length(value) BETWEEN 2 AND 10 AND length(regexp_replace(value, '[^A-Z]', '', 'g')) / length(value) >= 0.5
AND (length(regexp_replace(value, '[^AEIOUaeiou]', '', 'g')) / length(value) < 0.5 OR length(value) <= 5) AS acronym FROM (SELECT DISTINCT value FROM names)"""))
def t13_acronym_like(spark, d):
    return graph(spark, d).names.select("value").distinct().select("value", text.is_acronym_like(F.col("value")).alias("acronym"))


@query(sql("SELECT value AS iso2, translate(value, 'ABCDEFGHIJ', '🇦🇧🇨🇩🇪🇫🇬🇭🇮🇯') AS flag FROM codes WHERE system = 'iso2'"))
def t16_flags(spark, d):
    return graph(spark, d).codes.where("system = 'iso2'").select(F.col("value").alias("iso2"), text.flag(F.col("value")).alias("flag"))


@query("SELECT l_quantity AS quantity, n, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS value FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)")
def t15_numbers_as_text(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("quantity")).agg(F.count("*").alias("n"))
    return n.withColumn("value", text.coerce_number(F.col("quantity")))


@query(sql("""SELECT e.entity_id, canonical_name AS name, max(CASE WHEN system = 'iso2' THEN value END) AS iso2, max(CASE WHEN system = 'iso3' THEN value END) AS iso3,
max(CASE WHEN system = 'iso_numeric' THEN value END) AS iso_numeric, max(CASE WHEN system = 'suppkey' THEN value END) AS suppkey, max(CASE WHEN system = 'custkey' THEN value END) AS custkey,
max(CASE WHEN system = 'partkey' THEN value END) AS partkey, max(CASE WHEN system = 'wikidata' THEN value END) AS wikidata FROM entities e LEFT JOIN codes c ON e.entity_id = c.entity_id GROUP BY 1, 2"""))
def t20_pivot(spark, d):
    return lookup.iso_pivot(graph(spark, d))


@query("SELECT c_custkey AS id, substr(c_name, 1, pos - 1) || substr(c_name, pos + 1) AS dropped, substr(c_name, 1, pos - 1) || substr(c_name, pos + 1, 1) || substr(c_name, pos, 1) || substr(c_name, pos + 2) AS swapped, substr(c_name, 1, pos) || ' ' || substr(c_name, pos + 1) AS spaced FROM (SELECT *, c_custkey % (length(c_name) - 1) + 1 AS pos FROM customer)")
def t23_corruptions(spark, d):
    c, k = F.col("c_name"), F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), text.corrupt(c, "delete", k).alias("dropped"), text.corrupt(c, "transpose", k).alias("swapped"), text.corrupt(c, "space", k).alias("spaced"))


@query(sql("SELECT DISTINCT value_norm, regexp_replace(value_norm || ' co.', '[\\s,]+(inc|incorporated|ltd|limited|llc|plc|ag|gmbh|sa|co|company|corp|corporation)\\.?$', '') AS form FROM names WHERE entity_id LIKE 'org/%'"))
def t4_org_form(spark, d):
    n = graph(spark, d).names.where("entity_id like 'org/%'").select("value_norm").distinct()
    return n.select("value_norm", text.org_form(F.concat("value_norm", F.lit(" co."))).alias("form"))


@query("SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))) AS jaccard FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) > 0")
def f6_word_jaccard(spark, d):
    from oriel.functions.similarity import jaccard

    n = table(spark, d, "part").select("p_name").distinct()
    w = n.select("p_name", F.split("p_name", " ").alias("w"))
    e = w.select("*", F.explode("w").alias("k"))
    pairs = e.alias("x").join(e.alias("y"), "k").select(F.col("x.p_name").alias("a"), F.col("y.p_name").alias("b"), F.col("x.w").alias("u"), F.col("y.w").alias("v")).distinct()
    return pairs.select("a", "b", jaccard(F.col("u"), F.col("v")).alias("jaccard"))


@query(sql("SELECT DISTINCT norm, p_name AS term, damerau_levenshtein(norm, p_name)::INT AS distance FROM typo JOIN part ON p_partkey BETWEEN qid AND qid + 3", TYPOS))
def f4_damerau(spark, d):
    """Each misspelt part name with the names of its part and of the three parts after it."""
    from oriel.functions.similarity import damerau_distance

    q = table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.expr("case p_partkey % 4 when 0 then concat(substr(p_name, 1, 2), substr(p_name, 4)) when 1 then concat(p_name, 'x') when 2 then concat('q', substr(p_name, 2)) else replace(p_name, ' ', '') end").alias("norm"))
    k = F.explode(F.sequence(F.col("qid"), F.col("qid") + 3)).alias("p_partkey")
    pairs = q.select("norm", k).join(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("term")), "p_partkey").select("norm", "term").distinct()
    return pairs.withColumn("distance", damerau_distance(F.col("norm"), F.col("term")))


# --- constraints -----------------------------------------------------------------------------------------------

HITS = "hits AS (SELECT DISTINCT qid, entity_id FROM asked JOIN codes ON lower(trim(text)) = value_norm UNION SELECT DISTINCT qid, entity_id FROM q JOIN names ON norm = value_norm)"


def hits(spark, d, g=None):
    g = g or graph(spark, d)
    q = normal(asked(spark, d))
    both = lookup.lookup_code(g, q).select("qid", "entity_id").union(lookup.lookup_name(g, q).select("qid", "entity_id"))
    return both.repartition("qid").distinct()  # dealt out first: pairs hardly repeat, and a task would hold all that it reads


@query(sql("SELECT qid, entity_id, true AS type_pass FROM hits JOIN entities USING (entity_id) WHERE entity_type IN ('geo.region', 'geo.organization', 'org.company')", NORM, HITS))
def p1_type(spark, d):
    return constraints.type_filter(hits(spark, d), graph(spark, d), ["geo.region", "org.company"])


@query(sql("SELECT qid, entity_id, true AS temporal_pass FROM hits JOIN entities USING (entity_id) WHERE (valid_from IS NULL OR valid_from <= DATE '1999-01-01') AND (valid_until IS NULL OR DATE '1999-01-01' < valid_until)", NORM, HITS))
def p2_temporal(spark, d):
    return constraints.temporal_filter(hits(spark, d), graph(spark, d), F.lit("1999-01-01").cast("date"))


@query(sql("""SELECT qid, h.entity_id, true AS containment_pass FROM hits h WHERE entity_id IN (
  SELECT a.entity_id FROM relations a WHERE a.relation_type = 'contained_in' AND a.target_id = 'region/1'
  UNION SELECT a.entity_id FROM relations a JOIN relations b ON a.target_id = b.entity_id AND b.relation_type = 'contained_in' WHERE a.relation_type = 'contained_in' AND b.target_id = 'region/1')""", NORM, HITS))
def p3_containment(spark, d):
    g = graph(spark, d)
    return constraints.containment_filter(hits(spark, d, g), g, ["region/1"])


@query(sql("""SELECT qid, h.entity_id, EXISTS (SELECT 1 FROM relations r WHERE r.entity_id = h.entity_id AND relation_type = 'member_of' AND target_id = 'groups/BUILDING') AS membership_pass,
EXISTS (SELECT 1 FROM relations r WHERE r.entity_id = h.entity_id AND relation_type IN ('subsidiary_of', 'member_of') AND target_id IN ('org/supp-3', 'groups/FURNITURE')) AS parent_org_match,
country_code = 'AF' AS country_match FROM hits h JOIN entities e ON h.entity_id = e.entity_id""", NORM, HITS))
def p4_p6_soft_flags(spark, d):
    g = graph(spark, d)
    rows = constraints.membership_flag(hits(spark, d, g), g, "groups/BUILDING")
    return constraints.country_flag(constraints.parent_org_flag(rows, g, ["org/supp-3", "groups/FURNITURE"]), g, "NAF")


@query(sql("SELECT entity_id FROM entities WHERE (entity_type = 'geo.country' OR entity_id IN (SELECT target_id FROM relations WHERE relation_type = 'contained_in' AND entity_id LIKE 'country/%')) AND entity_id <> 'country/3'"))
def p8_select_entities(spark, d):
    return constraints.select_entities(graph(spark, d), include_types=["geo.country"], exclude_ids=["country/3"], expand="contained_in")


@query(sql("SELECT t, count(*) AS n FROM (SELECT 'entities' AS t, entity_id FROM entities UNION ALL SELECT 'names', entity_id FROM names UNION ALL SELECT 'codes', entity_id FROM codes UNION ALL SELECT 'relations', entity_id FROM relations WHERE target_id NOT LIKE 'region/%' AND target_id NOT IN (SELECT entity_id FROM entities WHERE canonical_name LIKE '%ring')) WHERE entity_id NOT LIKE 'region/%' AND entity_id NOT IN (SELECT entity_id FROM entities WHERE canonical_name LIKE '%ring') GROUP BY t"))
def p9_noise(spark, d):
    out = constraints.drop_noise(graph(spark, d), ["region/%"], ["%ring"])
    rows = None
    for name, t in out.tables().items():
        own = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        rows = own if rows is None else rows.union(own)
    return rows


# --- graph -----------------------------------------------------------------------------------------------------


@query(sql("SELECT DISTINCT entity_id FROM relations WHERE relation_type = 'member_of' AND target_id = 'groups/BUILDING' AND valid_from <= DATE '1998-06-01' AND DATE '1998-06-01' < valid_until"))
def g1_members_of(spark, d):
    return closure.members_of(graph(spark, d), "groups/BUILDING", F.lit("1998-06-01").cast("date"))


@query(sql("SELECT entity_id, 'groups/BUILDING' AS group_id, EXISTS (SELECT 1 FROM relations r WHERE r.entity_id = e.entity_id AND target_id = 'groups/BUILDING' AND relation_type = 'member_of' AND valid_from <= DATE '1997-01-01' AND DATE '1997-01-01' < valid_until) AS is_member FROM entities e WHERE entity_id LIKE 'org/cust-%'"))
def g2_is_member(spark, d):
    g = graph(spark, d)
    pairs = g.entities.where("entity_id like 'org/cust-%'").select("entity_id", F.lit("groups/BUILDING").alias("group_id"))
    return closure.is_member(g, pairs, F.lit("1997-01-01").cast("date"))


@query(sql("SELECT DISTINCT canonical_name FROM entities WHERE entity_type IN ('geo.organization', 'geo.continental_union')"))
def g3_known_groups(spark, d):
    return closure.known_groups(graph(spark, d))


WITHIN = "walk(entity_id, depth) AS (SELECT 'world/0', 0 UNION ALL SELECT r.entity_id, depth + 1 FROM relations r JOIN walk w ON r.target_id = w.entity_id WHERE r.relation_type = 'contained_in' AND depth < 10)"


@query(sql("SELECT entity_id, CAST(min(depth) AS INT) AS depth FROM walk WHERE depth > 0 GROUP BY entity_id", WITHIN))
def g4_within(spark, d):
    return closure.within(graph(spark, d), "world/0")


@query(sql("SELECT entity_id, CAST(min(depth) AS INT) AS depth FROM walk WHERE depth BETWEEN 1 AND 2 AND entity_id LIKE 'country/%' GROUP BY entity_id", WITHIN))
def g4_within_typed(spark, d):
    return closure.within(graph(spark, d), "world/0", entity_type="geo.country", max_depth=2)


@query(sql("SELECT DISTINCT entity_id, target_id FROM relations WHERE relation_type = 'subsidiary_of' AND target_id IN (SELECT entity_id FROM entities)"))
def g5_related(spark, d):
    return closure.related(graph(spark, d), "subsidiary_of")


@query(sql("SELECT qid, text, entity_id, CASE WHEN n = 1 THEN v END AS value, n AS n_entities FROM (SELECT qid, text, c.entity_id, t.value AS v, count(*) OVER (PARTITION BY qid) AS n FROM asked JOIN codes c ON c.system = 'suppkey' AND c.value_norm = lower(trim(text)) LEFT JOIN codes t ON t.entity_id = c.entity_id AND t.system = 'wikidata')"))
def g8_convert(spark, d):
    return lookup.convert(graph(spark, d), asked(spark, d), "suppkey", "wikidata")


@query(sql("SELECT entity_id, relation_type, target_id FROM relations WHERE target_id NOT IN (SELECT entity_id FROM entities)"))
def g9_unresolved(spark, d):
    return closure.unresolved_relations(graph(spark, d))


UP = "up(entity_id, a, depth) AS (SELECT entity_id, entity_id, 0 FROM entities WHERE entity_type <> 'geo.country' UNION ALL SELECT up.entity_id, r.target_id, depth + 1 FROM up JOIN relations r ON r.entity_id = up.a AND r.relation_type = 'contained_in' WHERE depth < 5)"


@query(sql("SELECT e.entity_id, (SELECT arg_min(value, depth) FROM up JOIN codes ON codes.entity_id = a AND system = 'iso2' WHERE up.entity_id = e.entity_id AND depth > 0) AS iso2 FROM entities e", UP))
def g10_country_of(spark, d):
    return closure.country_of(graph(spark, d))


@query(sql("""SELECT e.entity_id, p.canonical_name AS parent_name, coalesce(c0.value, e.country_code, c1.value, c2.value) AS parent_country FROM entities e
LEFT JOIN (SELECT entity_id, min(target_id) AS t FROM relations WHERE relation_type IN ('contained_in', 'part_of') GROUP BY 1) r ON r.entity_id = e.entity_id
LEFT JOIN (SELECT entity_id, min(target_id) AS t FROM relations WHERE relation_type IN ('contained_in', 'part_of') GROUP BY 1) s ON s.entity_id = r.t
LEFT JOIN entities p ON p.entity_id = r.t LEFT JOIN codes c0 ON c0.entity_id = e.entity_id AND c0.system = 'iso2'
LEFT JOIN codes c1 ON c1.entity_id = r.t AND c1.system = 'iso2' LEFT JOIN codes c2 ON c2.entity_id = s.t AND c2.system = 'iso2'"""))
def g11_parent_context(spark, d):
    return closure.parent_context(graph(spark, d))


# --- resolution ------------------------------------------------------------------------------------------------

RESOLVED = (
    f"q(qid, text, norm) AS (SELECT qid, text, {squeeze('text')} FROM asked WHERE lower(trim(text)) <> 'unknown')",
    "org_e AS (SELECT * FROM entities WHERE entity_type LIKE 'org.%')",
    """code_hits AS (SELECT qid, c.entity_id, CASE WHEN system = 'wikidata' THEN 0 ELSE 1 END AS ord FROM q JOIN codes c ON c.value_norm = lower(trim(text)) JOIN org_e USING (entity_id)
      WHERE system IN ('wikidata', 'suppkey', 'custkey'))""",
    "code_ev AS (SELECT DISTINCT qid, entity_id, 0.95 AS s, 5 AS tier FROM (SELECT *, min(ord) OVER (PARTITION BY qid) AS lo FROM code_hits) WHERE ord = lo)",
    "name_ev AS (SELECT DISTINCT qid, n.entity_id, 0.92 AS s, 4 AS tier FROM q JOIN names n ON n.value_norm = norm AND name_kind = 'canonical' JOIN org_e USING (entity_id))",
    """acr_ev AS (SELECT DISTINCT qid, n.entity_id, CASE WHEN upper(text) = text THEN 0.88 ELSE 0.82 END AS s, 3 AS tier FROM q JOIN names n ON n.value_norm = norm AND name_kind = 'acronym' JOIN org_e USING (entity_id)
      WHERE length(text) BETWEEN 2 AND 10 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(text) >= 0.5)""",
    "ev AS (SELECT qid, entity_id, max(s) AS s, max(tier) AS tier FROM (SELECT * FROM code_ev UNION ALL SELECT * FROM name_ev UNION ALL SELECT * FROM acr_ev) GROUP BY 1, 2)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, entity_id) AS place, lead(s) OVER (PARTITION BY qid ORDER BY s DESC, entity_id) AS s2, count(*) OVER (PARTITION BY qid) AS nc FROM ev)",
)


@query(sql("""SELECT asked.qid, CASE WHEN r.qid IS NULL THEN 'no_match' WHEN s - coalesce(s2, 0) >= 0.1 THEN 'resolved' ELSE 'ambiguous' END AS status,
CASE WHEN s - coalesce(s2, 0) >= 0.1 THEN entity_id END AS entity_id, CASE WHEN s - coalesce(s2, 0) >= 0.1 THEN round(s, 6)::DOUBLE END AS confidence, CASE WHEN s - coalesce(s2, 0) >= 0.1 THEN tier END AS tier
FROM asked LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (qid)""", *RESOLVED))
def resolve_org_exact(spark, d):
    r = cascade.resolve(graph(spark, d), asked(spark, d), packs=["org"], fuzzy=False)
    return r.select("qid", "status", "entity_id", F.round("confidence", 6).alias("confidence"), "tier")


def typos(spark, d) -> DataFrame:
    """(qid, text): misspelt part and nation names."""
    part = table(spark, d, "part").selectExpr("concat('p', p_partkey) as qid", "case p_partkey % 4 when 0 then concat(substr(p_name, 1, 2), substr(p_name, 4)) when 1 then concat(p_name, 'x') when 2 then concat('q', substr(p_name, 2)) else replace(p_name, ' ', '') end as text")
    nation = table(spark, d, "nation").selectExpr("concat('n', n_nationkey) as qid", "case n_nationkey % 2 when 0 then replace(n_name, '_', ' ') else concat(n_name, 'x') end as text")
    return part.union(nation)


@query()
def resolve_fuzzy(spark, d):
    """The cascade with full text, corrections and reranking; each distinct text is resolved once."""
    q = typos(spark, d)
    once = cascade.resolve(graph(spark, d), q.select(F.col("text").alias("qid"), "text").distinct(), packs=["geo", "custom"])
    return q.join(once.drop("qid", "candidates"), "text").withColumn("confidence", F.round("confidence", 6))


@query(sql("""SELECT s_suppkey, n_rows, revenue, 'resolved' AS status, 'org/supp-' || s_suppkey AS entity_id, 0.92 AS confidence, 'Q' || (s_suppkey + 1000) AS output
FROM (SELECT s_suppkey, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"""))
def bulk_supplier_names(spark, d):
    return flagship(spark, d)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve the supplier name of every line item in bulk (each distinct one once), then revenue per entity."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    named = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = cascade.bulk(graph(spark, sf_dir), named, "s_name", packs=["org"], to="wikidata")
    return out.groupBy("s_suppkey", "status", "entity_id", "confidence", "output").agg(F.count("*").alias("n_rows"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query(sql("SELECT status, count(*) AS n FROM (SELECT CASE WHEN c = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM part JOIN (SELECT value_norm, count(DISTINCT entity_id) AS c FROM names WHERE entity_id LIKE 'custom/%' GROUP BY 1) ON value_norm = lower(p_name)) GROUP BY status"))
def bulk_part_names_summary(spark, d):
    out = cascade.bulk(graph(spark, d), table(spark, d, "part").select("p_name"), "p_name", packs=["custom"])
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query(sql("SELECT k AS raw, 1 / (1 + exp(k * -8.499867056667657 + 5.556690191789257)) AS confidence FROM (SELECT unnest(range(0, 101)) / 100.0::DOUBLE AS k)"))
def d8_platt(spark, d):
    return spark.range(101).select((F.col("id") / 100.0).alias("raw")).select("raw", scoring.platt(F.col("raw")).alias("confidence"))


FEATURES = """f AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag = 'R' AS exact_code_hit, l_returnflag = 'A' AND l_linestatus = 'O' AS exact_name_hit, CASE WHEN l_discount > 0.02 THEN 1 - l_discount * 4 END AS edit,
CASE WHEN l_discount > 0.02 THEN 1 - l_tax * 5 END AS tok, CASE WHEN l_tax > 0.01 THEN 0.75::DOUBLE END AS bm, CASE WHEN l_tax > 0.03 THEN l_discount * 10 END AS sym, CAST(l_quantity AS INT) % 12 + 1 AS len, l_linenumber % 2 = 0 AS up,
CASE WHEN l_linenumber % 3 = 0 THEN false WHEN l_linenumber % 3 = 1 THEN true END AS cont, CASE WHEN l_linenumber % 5 < 4 THEN l_linenumber % 5 * 0.25::DOUBLE END AS rank, CASE WHEN l_linenumber % 4 > 0 THEN l_tax * 10 END AS prom FROM lineitem)"""


@query("WITH " + FEATURES + """, b AS (SELECT *, CASE WHEN NOT cont THEN 0.05 ELSE 0 END AS pen, CASE WHEN edit >= 0.85 THEN 1 WHEN len >= 4 THEN least(1, sqrt(len / 6.0::DOUBLE)) ELSE len / 6.0::DOUBLE END AS lf, CASE WHEN sym IS NULL OR sym >= 0.7 THEN 1 ELSE least(1, sym / 0.75) END AS qf FROM f),
r AS (SELECT *, CASE WHEN exact_code_hit THEN 0.95 WHEN exact_name_hit THEN 0.9 WHEN edit IS NOT NULL THEN greatest(least(0.5 + 0.35 * edit * lf * qf + 0.1 * tok * qf, 0.89) - pen, 0.3) WHEN bm IS NOT NULL THEN greatest(0.4 + 0.4 * bm - pen, 0.3) ELSE 0.3 END + 0.009 * coalesce(rank, 0) + coalesce(0.12 * (prom - 0.5), 0) AS s FROM b)
SELECT floor(s_ * 1000 + 0.5000001) / 1000 AS score, count(*) AS n FROM (SELECT CASE WHEN up AND len BETWEEN 4 AND 10 AND NOT exact_code_hit AND coalesce(rank < 0.75 OR (rank < 0.8 AND NOT exact_name_hit), false) THEN 0.3 ELSE s END AS s_ FROM r) GROUP BY 1""")
def d1_geo_scores(spark, d):
    f = table(spark, d, "lineitem").selectExpr(
        "l_returnflag = 'R' as exact_code_hit", "l_returnflag = 'A' and l_linestatus = 'O' as exact_name_hit", "case when l_discount > 0.02 then 1 - l_discount * 4 end as fuzzy_edit_sim", "case when l_discount > 0.02 then 1 - l_tax * 5 end as fuzzy_token_sim",
        "case when l_tax > 0.01 then 0.75D end as fts_bm25_norm", "case when l_tax > 0.03 then l_discount * 10 end as symspell_edit_norm", "cast(l_quantity as int) % 12 + 1 as query_len", "l_linenumber % 2 = 0 as query_is_upper",
        "case when l_linenumber % 3 = 0 then false when l_linenumber % 3 = 1 then true end as containment_pass", "cast(null as boolean) as type_pass", "case when l_linenumber % 5 < 4 then l_linenumber % 5 * 0.25D end as hierarchy_rank", "case when l_linenumber % 4 > 0 then l_tax * 10 end as candidate_prominence",
    )
    # halves go up on both sides, whatever their last bit
    return f.groupBy((F.floor(scoring.geo_raw() * 1000 + 0.5000001) / 1000).alias("score")).agg(F.count("*").alias("n"))


@query("SELECT c, CASE WHEN c >= 0.85 THEN 0.85 + (c - 0.85) / 0.15 * 0.15 WHEN c >= 0.65 THEN 0.6 + (c - 0.65) / 0.2 * 0.25 WHEN c >= 0.4 THEN 0.3 + (c - 0.4) / 0.25 * 0.3 ELSE c * 0.75 END AS common FROM (SELECT DISTINCT round(l_discount * 9.7 + l_tax, 4) AS c FROM lineitem) WHERE c <= 1")
def d16_bands(spark, d):
    c = table(spark, d, "lineitem").select(F.round(F.col("l_discount") * 9.7 + F.col("l_tax"), 4).alias("c")).distinct().where("c <= 1")
    return c.select("c", scoring.band(F.col("c"), "org").alias("common"))


@query(sql("""SELECT qid, packs FROM (SELECT qid, text, least(0.5 + CASE WHEN regexp_full_match(text, '[A-Za-z]{2}') THEN 0.3 WHEN regexp_full_match(text, '[A-Za-z]{3}') THEN 0.2 WHEN regexp_full_match(text, '[A-Z]{1,5}[0-9]{1,2}') THEN 0.15 WHEN regexp_full_match(text, '[A-Za-z]{4,10}') AND length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(text) >= 0.5 THEN 0.15 ELSE 0 END
 + CASE WHEN regexp_matches(lower(text), '(land|stan|ia|ica|ey|ay)$') THEN 0.25 ELSE 0 END + CASE WHEN contains(text, ' ') AND upper(text) <> text THEN 0.1 ELSE 0 END, 1) AS geo,
 0.4 + CASE WHEN length(text) BETWEEN 2 AND 10 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(text) >= 0.5 AND (length(regexp_replace(text, '[^AEIOUaeiou]', '', 'g')) / length(text) < 0.5 OR length(text) <= 5) THEN 0.35 ELSE 0 END AS org FROM asked) x,
LATERAL (SELECT concat_ws(',', CASE WHEN round(geo, 6) >= round(greatest(geo, org) - 0.2, 6) THEN 'geo' END, CASE WHEN round(org, 6) >= round(greatest(geo, org) - 0.2, 6) THEN 'org' END) AS packs)"""))
def d14_router(spark, d):
    return cascade.route(asked(spark, d)).select("qid", F.array_join("packs", ",").alias("packs"))


# --- suggest and parse -------------------------------------------------------------------------------------------

SUGGEST = """hit AS (SELECT qid, text, norm, n.entity_id, n.value, n.value_norm, n.name_kind, n.is_preferred, 0 AS cls FROM pre JOIN names n ON starts_with(value_norm, norm) WHERE norm <> ''
UNION ALL SELECT qid, text, norm, n.entity_id, n.value, n.value_norm, n.name_kind, n.is_preferred, 1 FROM pre, (SELECT *, string_split(value_norm, ' ') AS ws FROM names) n
WHERE norm <> '' AND list_contains(list_transform(range(2, len(ws) + 1), lambda i: starts_with(array_to_string(ws[i:], ' '), norm)), true))"""


@query(sql("""SELECT qid, text, entity_id, cls AS match_class, value AS matched, 0 AS typo_count, CAST(rank AS INT) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY cls, w, -p, k, length(value_norm), entity_id) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY qid, text, entity_id ORDER BY cls, w, -p, k, length(value_norm), value) AS rn FROM (
SELECT hit.*, coalesce(prominence, 0) AS p, CASE WHEN value_norm = norm AND (entity_type <> 'geo.country' OR coalesce(prominence, 0) >= 0.3) THEN 0 ELSE 1 END AS w,
CASE WHEN name_kind = 'canonical' THEN 0 WHEN is_preferred THEN 1 WHEN name_kind IN ('alias', 'endonym', 'exonym') THEN 2 ELSE 3 END AS k FROM hit JOIN entities USING (entity_id))) WHERE rn = 1) WHERE rank <= 10""", PREFIXES.replace("SELECT DISTINCT p_type,", "SELECT DISTINCT substr(p_name, 1, 4),"), SUGGEST))
def u1_suggest(spark, d):
    p = prefixes(spark, d).select("text").distinct().withColumn("qid", F.col("text"))
    return suggest.suggest(graph(spark, d), p)


WORDS_SQL = "gaz AS (SELECT text AS norm, 'bench/' || min(item_id) AS id, count(*) AS n FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS text FROM benchmark) GROUP BY 1)"


def words_graph(spark, d) -> EntityGraph:
    """A gazetteer of the longer words of the test set, each an entity named by it."""
    g = graph(spark, d)
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.expr("regexp_extract_all(lower(text), '[a-z]{6,}', 0)"))).alias("w"))
    w = w.groupBy("w").agg(F.concat(F.lit("bench/"), F.min("item_id")).alias("id"))
    names = w.select(F.col("id").alias("entity_id"), F.lit("canonical").alias("name_kind"), F.col("w").alias("value"), F.col("w").alias("value_norm"), F.lit("en").alias("lang"), F.lit("").alias("script"), F.lit(True).alias("is_preferred"))
    return g.with_tables(names=names)


@query("WITH " + WORDS_SQL + """, w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_#''-]+')) AS s FROM conversations)
SELECT conv_id, turn, surface, entity_id, count(*) AS n FROM (SELECT conv_id, turn, s AS surface, id AS entity_id FROM w JOIN gaz ON lower(s) = norm) GROUP BY ALL""")
def x1_parse_conversations(spark, d):
    docs = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    g = words_graph(spark, d)
    found = parse.link(parse.leftmost_longest(parse.mentions(g, docs)), include_nil=False).where("dropped is null")
    return found.select("doc_id.conv_id", "doc_id.turn", "surface", "entity_id").groupBy("conv_id", "turn", "surface", "entity_id").agg(F.count("*").alias("n"))


@query("WITH " + WORDS_SQL + ", w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_#''-]+')) AS s FROM documents) SELECT doc_id, count(*) AS n_mentions, count(DISTINCT id) AS n_entities FROM w JOIN gaz ON lower(s) = norm GROUP BY doc_id")
def x4_parse_bulk(spark, d):
    out = parse.parse(words_graph(spark, d), table(spark, d, "documents").select("doc_id", "text"))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_mentions"), F.count_distinct("entity_id").alias("n_entities"))


# --- building ----------------------------------------------------------------------------------------------------


@query(sql("SELECT value_norm AS norm, count(DISTINCT entity_id) AS n, min(entity_id) AS first_id FROM names GROUP BY 1 HAVING len(string_split(value_norm, ' ')) <= 6"))
def a4_patterns(spark, d):
    return parse.gazetteer(graph(spark, d)).select("norm", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first_id"))


@query(sql("SELECT term, max(n) AS n FROM (SELECT value_norm AS term, count(*) AS n FROM names GROUP BY 1 UNION ALL SELECT w, count(*) FROM (SELECT unnest(string_split(value_norm, ' ')) AS w FROM names WHERE contains(value_norm, ' ')) WHERE length(w) >= 2 GROUP BY 1) GROUP BY term"))
def a3_spelling_terms(spark, d):
    return etl.spelling_terms(graph(spark, d))


@query(sql("SELECT *, named / entities AS names_coverage, coded / entities AS codes_coverage, relations / entities AS relations_density FROM (SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM names) AS names, (SELECT count(*) FROM codes) AS codes, (SELECT count(*) FROM relations) AS relations, (SELECT count(DISTINCT entity_id) FROM names) AS named, (SELECT count(DISTINCT entity_id) FROM codes) AS coded)").replace("SELECT *, named", "SELECT entities, names, codes, relations, named"))
def a5_quality(spark, d):
    return etl.quality(graph(spark, d))


CHANGED = "SELECT t AS \"table\", count_if(o IS NULL) AS added, count_if(n IS NULL) AS removed, count_if(o IS NOT NULL AND n IS NOT NULL AND o <> n) AS changed"


def changed(spark, d) -> EntityGraph:
    """Yesterday's graph: some parts are missing, some regions are named otherwise, some codes have gone."""
    g = graph(spark, d)
    e = g.entities.where("not (entity_type = 'custom' and entity_id like '%7')").withColumn("canonical_name", F.expr("case when entity_type = 'geo.region' then upper(concat(canonical_name, '!')) else canonical_name end"))
    return g.with_tables(entities=e, codes=g.codes.where("system <> 'wikidata'").withColumn("value", F.expr("case when system = 'iso2' then concat(value, '0') else value end")))


@query(sql("""SELECT 'entities' AS "table", (SELECT count(*) FROM entities WHERE entity_type = 'custom' AND entity_id LIKE '%7') AS added, 0 AS removed, (SELECT count(*) FROM region) AS changed
UNION ALL SELECT 'names', 0, 0, 0 UNION ALL SELECT 'codes', (SELECT count(*) FROM supplier), 0, (SELECT count(*) FROM nation) UNION ALL SELECT 'relations', 0, 0, 0"""))
def a6_diff(spark, d):
    return etl.diff(graph(spark, d), changed(spark, d))


@query(sql("SELECT 'codes' AS \"table\", '' || 'codes: +' || (SELECT count(*) FROM supplier) || ' -0 ~' || (SELECT count(*) FROM nation) AS line UNION ALL SELECT 'entities', 'entities: +' || (SELECT count(*) FROM entities WHERE entity_type = 'custom' AND entity_id LIKE '%7') || ' -0 ~' || (SELECT count(*) FROM region)"))
def e9_changelog(spark, d):
    return etl.changelog(etl.diff(graph(spark, d), changed(spark, d)))


@query(sql("""SELECT 'entities' AS metric, b::DOUBLE AS before, n::DOUBLE AS now, (b - n) / b AS drop, (b - n) / b <= 0.05 AS ok FROM (SELECT count(*) AS b, count_if(NOT (entity_type = 'custom' AND entity_id LIKE '%7')) AS n FROM entities)
UNION ALL SELECT 'codes', b, n, (b - n) / b, (b - n) / b <= 0.5 FROM (SELECT count(*) AS b, count_if(system <> 'wikidata') AS n FROM codes)"""))
def a7_drift(spark, d):
    return etl.drift(etl.quality(changed(spark, d)), etl.quality(graph(spark, d)), {"entities": 0.05, "codes": 0.5})


@query(sql("SELECT entity_id, b AS bucket, CASE WHEN links IS NOT NULL THEN CASE WHEN max(links) OVER w = min(links) OVER w THEN 0.5 ELSE (links - min(links) OVER w) / (max(links) OVER w - min(links) OVER w) END ELSE (lp - min(lp) OVER v) / (max(lp) OVER v - min(lp) OVER v) END AS prominence FROM (SELECT p_partkey AS entity_id, p_brand AS b, CASE WHEN p_partkey % 3 > 0 THEN p_size::DOUBLE END AS links, log10(p_retailprice + 1) AS lp FROM part) WINDOW w AS (PARTITION BY b), v AS (PARTITION BY links IS NULL)"))
def a14_prominence(spark, d):
    return etl.prominence(table(spark, d, "part").selectExpr("p_partkey as entity_id", "p_brand as bucket", "case when p_partkey % 3 > 0 then cast(p_size as bigint) end as sitelinks", "p_retailprice as population"))


@query(sql("""SELECT a AS entity_id, CASE WHEN max(t) OVER w = min(t) OVER w THEN 0.5 ELSE round((t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w), 9) END AS prominence FROM (SELECT a, entity_type, sum(prominence) AS t FROM (SELECT DISTINCT up.entity_id, a FROM up WHERE depth > 0) x JOIN entities m ON m.entity_id = x.entity_id AND m.prominence IS NOT NULL JOIN entities c ON c.entity_id = a GROUP BY a, entity_type) y(a, k, t) WINDOW w AS (PARTITION BY k)""".replace("SELECT a, entity_type, sum(prominence)", "SELECT a, c.entity_type, sum(m.prominence)").replace("GROUP BY a, entity_type)", "GROUP BY a, c.entity_type)"), UP.replace("WHERE entity_type <> 'geo.country' ", "").replace("depth < 5", "depth < 4")))
def a15_containment_prominence(spark, d):
    g = graph(spark, d)
    out = etl.containment_prominence(g, closure.ancestors(g, g.entities.select("entity_id"), 4))
    return out.withColumn("prominence", F.round("prominence", 9))


@query(sql("""SELECT "check", n FROM (SELECT 'blank_id' AS "check", 0 AS n UNION ALL SELECT 'blank_name', 0 UNION ALL SELECT 'empty_validity', 0 UNION ALL SELECT 'duplicate_id', 0 UNION ALL SELECT 'orphan_names', (SELECT count(*) FROM names WHERE entity_id NOT IN (SELECT entity_id FROM entities))
UNION ALL SELECT 'orphan_codes', 0 UNION ALL SELECT 'orphan_relations', (SELECT count(*) FROM relations WHERE entity_id NOT IN (SELECT entity_id FROM entities)) UNION ALL SELECT 'missing_targets', (SELECT count(*) FROM relations WHERE target_id NOT IN (SELECT entity_id FROM entities)))"""))
def e7_integrity(spark, d):
    return etl.integrity(graph(spark, d))


@query(sql("""SELECT DISTINCT r.entity_id, relation_type, coalesce(m.t, r.target_id) AS target_id FROM relations r LEFT JOIN (SELECT 'org/supp-' || s_suppkey AS f, 'org/cust-' || s_suppkey AS t FROM supplier WHERE s_suppkey % 2 = 0) m ON f = r.target_id
WHERE relation_type IN ('subsidiary_of', 'contained_in') AND (m.t IS NOT NULL OR r.target_id IN (SELECT entity_id FROM entities) OR starts_with(r.target_id, 'org/supp-1'))"""))
def e4_canonical_targets(spark, d):
    g = graph(spark, d)
    mapping = table(spark, d, "supplier").where("s_suppkey % 2 = 0").selectExpr("concat('org/supp-', s_suppkey) as alias", "concat('org/cust-', s_suppkey) as entity_id")
    rows = g.relations.where(F.col("relation_type").isin("subsidiary_of", "contained_in"))
    return etl.canonical_targets(rows, mapping, g.entities, ["org/supp-1"]).select("entity_id", "relation_type", "target_id")


@query(sql("""SELECT entity_id, canonical_name, valid_from FROM (SELECT entity_id, CASE WHEN entity_id LIKE 'region/%' THEN 'New ' || canonical_name ELSE canonical_name END AS canonical_name, CASE WHEN entity_id = 'country/4' THEN DATE '1990-01-01' ELSE valid_from END AS valid_from FROM entities WHERE entity_id NOT LIKE 'org/cust-%1') WHERE entity_id NOT LIKE 'custom/%'"""))
def e5_contribution(spark, d):
    g = graph(spark, d)
    regions = g.entities.where("entity_id like 'region/%'").withColumn("canonical_name", F.concat(F.lit("New "), "canonical_name"))
    none = g.with_tables(entities=regions, names=g.names.limit(0), codes=g.codes.limit(0), relations=g.relations.limit(0))
    c = etl.Contribution(rows=none, deletes=g.entities.where("entity_id like 'org/cust-%1'").select("entity_id"), validity=spark.sql("select 'country/4' as entity_id, date '1990-01-01' as valid_from, cast(null as date) as valid_until"))
    return etl.apply_contribution(g, c).entities.where("entity_id not like 'custom/%'").select("entity_id", "canonical_name", "valid_from")


@query(sql("""SELECT entity_id, CASE WHEN entity_id IN ('country/1', 'country/2') THEN 'Top ' || canonical_name ELSE canonical_name END AS canonical_name, (SELECT count(*) FROM names n WHERE n.entity_id = e.entity_id) + CASE WHEN entity_id IN ('country/1', 'country/2') THEN 1 ELSE 0 END AS n_names FROM entities e WHERE entity_type LIKE 'geo.%'"""))
def overlay_merge(spark, d):
    g = cascade.pack_graph(graph(spark, d), cascade.GEO)
    some = g.entities.where("entity_id in ('country/1', 'country/2')").withColumn("canonical_name", F.concat(F.lit("Top "), "canonical_name")).withColumn("country_code", F.lit(""))
    names = some.select("entity_id", F.lit("alias").alias("name_kind"), F.col("canonical_name").alias("value"), F.lower("canonical_name").alias("value_norm"), F.lit("en").alias("lang"), F.lit("").alias("script"), F.lit(False).alias("is_preferred"))
    out = graphs.overlay(g, g.with_tables(entities=some, names=names, codes=g.codes.limit(0), relations=g.relations.limit(0)), allow_new_entities=False)
    n = out.names.groupBy("entity_id").agg(F.count("*").alias("n_names"))
    return out.entities.join(n, "entity_id").select("entity_id", "canonical_name", "n_names")


@query(sql("SELECT entity_type, count(*) AS n FROM entities WHERE entity_type LIKE 'geo.%' OR entity_type LIKE 'org.%' GROUP BY 1"))
def compose_modules(spark, d):
    g = graph(spark, d)
    return graphs.compose([cascade.pack_graph(g, cascade.GEO), cascade.pack_graph(g, cascade.ORG)]).entities.groupBy("entity_type").agg(F.count("*").alias("n"))


@query("SELECT 'local/' || c_custkey AS entity_id, c_name AS canonical_name, lower(c_name) AS canonical_name_norm, 1 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_names FROM customer")
def b1_from_records(spark, d):
    rec = table(spark, d, "customer").selectExpr("c_custkey as id", "c_name as name", "case when c_custkey % 2 = 0 then replace(c_name, '#', ' no ') else ' ' end as alias", "concat('C-', c_custkey) as custkey")
    out = linking.from_records(rec, linking.roles(rec.columns, id="id", aliases=["alias"]))
    n = out.names.groupBy("entity_id").agg(F.count("*").cast("int").alias("n_names"))
    return out.entities.join(n, "entity_id").select("entity_id", "canonical_name", "canonical_name_norm", "n_names")


# --- metrics -----------------------------------------------------------------------------------------------------

SCORED = "s AS (SELECT d.doc_id, least(1.0, n_chars / 5000.0::DOUBLE) AS p, quality AS y, lang, source FROM documents d JOIN labels l USING (doc_id))"


def scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    rows = docs.join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"), F.col("quality").alias("y"), "lang", "source")


MEASURES = "count(*) AS n, sum(c) / count(*) AS accuracy, sum(w) / count(*) AS wrong_rate, sum(a) / count(*) AS abstained, round((p + z / 2 / n_ - h) / (1 + z / n_), 9) AS low"


@query("WITH " + SCORED + ", t AS (SELECT lang, source, CAST(p >= 0.5 AND y = 1 AS INT) AS c, CAST(p >= 0.5 AND y = 0 AS INT) AS w, CAST(p < 0.5 AS INT) AS a FROM s), g AS (SELECT lang, source, count(*) AS n, sum(c) / count(*) AS accuracy, sum(w) / count(*) AS wrong_rate, sum(a) / count(*) AS abstained FROM t GROUP BY GROUPING SETS ((lang), (source), ())) SELECT *, round((accuracy + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt(accuracy * (1 - accuracy) / n + 3.8414588206941236 / (4 * n * n))) / (1 + 3.8414588206941236 / n), 9) AS low FROM g")
def a9_accuracy(spark, d):
    rows = scored(spark, d).select("lang", "source", ((F.col("p") >= 0.5) & (F.col("y") == 1)).alias("correct"), ((F.col("p") >= 0.5) & (F.col("y") == 0)).alias("wrong"), (F.col("p") < 0.5).alias("abstained"))
    return metrics.accuracy(rows, "lang", "source").withColumn("low", F.round("low", 9)).drop("high")


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99 FROM events")
def a11_latency(spark, d):
    out = metrics.latency(table(spark, d, "events"), "value")
    return out.select("n", F.round("mean", 6).alias("mean"), "min", "max", *[F.round(p, 9).alias(p) for p in ("p50", "p95", "p99")])


@query("WITH " + SCORED + " SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 9) AS confidence, avg(y) AS accuracy FROM s GROUP BY 1")
def a12_reliability(spark, d):
    return metrics.reliability(scored(spark, d)).withColumn("confidence", F.round("confidence", 9))


@query("WITH " + SCORED + ", b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS g FROM s GROUP BY 1) SELECT round((SELECT sum(n * g) / sum(n) FROM b), 9) AS ece, round((SELECT avg((p - y) * (p - y)) FROM s), 9) AS brier, round((SELECT avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) FROM s), 6) AS log_loss")
def a12_calibration(spark, d):
    return metrics.calibration(scored(spark, d)).select(F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


@query("WITH " + SCORED + ", c AS (SELECT t / 100.0::DOUBLE AS threshold, count_if(p >= t / 100.0::DOUBLE AND y = 1) AS tp, count_if(p >= t / 100.0::DOUBLE AND y = 0) AS fp, count_if(p < t / 100.0::DOUBLE AND y = 1) AS fn FROM s, (SELECT unnest(range(1, 100)) AS t) GROUP BY t) SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c")
def a13_f1_sweep(spark, d):
    return metrics.f1_sweep(scored(spark, d))


@query("WITH " + SCORED + ", c AS (SELECT *, ntile(10) OVER (ORDER BY p, doc_id) AS b FROM s) SELECT round(sum(n * g) / sum(n), 9) AS adaptive_ece FROM (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS g FROM c GROUP BY b)")
def a13_adaptive_ece(spark, d):
    return metrics.adaptive_ece(scored(spark, d), "doc_id").withColumn("adaptive_ece", F.round("adaptive_ece", 9))


@query("SELECT DISTINCT p_name AS text, p_brand AS entity_type, p_type AS expected_id FROM part WHERE (lower(p_name), p_brand) IN (SELECT (lower(p_name), p_brand) FROM part GROUP BY lower(p_name), p_brand HAVING count(DISTINCT p_type) = 1)")
def a21_unambiguous(spark, d):
    return metrics.unambiguous(table(spark, d, "part").selectExpr("p_name as text", "p_brand as entity_type", "p_type as expected_id").distinct())


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a17_dedup_and_broadcast(spark, d):
    """Distinct values first, then broadcast through the join: the shape of every bulk call."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(sql("SELECT qid, entity_id, CAST(place AS INT) AS place, s - s2 AS gap FROM ranked WHERE place <= 5", *RESOLVED))
def w3_ranked_candidates(spark, d):
    g = cascade.pack_graph(graph(spark, d), cascade.ORG)
    q = cascade.prepare(asked(spark, d))
    rows = cascade.score(g, cascade.candidates(cascade.generate(g, q, cascade.ORG, fuzzy=False)), q, cascade.ORG)
    o = Window.partitionBy("qid").orderBy(F.col("confidence").desc(), "entity_id")
    return rows.withColumn("place", F.row_number().over(o)).withColumn("gap", F.col("confidence") - F.lead("confidence").over(o)).where("place <= 5").select("qid", "entity_id", "place", "gap")


def queries() -> dict[str, Query]:
    def ready(f: Query) -> Query:
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_see_package(spark)
            return f(spark, sf_dir)

        return call

    return {name: ready(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
