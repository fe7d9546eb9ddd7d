"""Rows that joins make on keys which repeat often: they grow with the input, not with its square."""

import time

from pyspark.sql import functions as F

from oriel.operators import linking, lookup, resolve
from oriel.sources.graph import EntityGraph
from tests.test_operators import g  # noqa: F401


def most_rows(df) -> int:
    """The most rows that any join of a frame's plan gives when it is collected."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        metric = p.metrics().get("numOutputRows")
        own = metric.get().value() if "Join" in name and metric.isDefined() else 0
        return max([own, *(walk(p.children().apply(i)) for i in range(p.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def crowd(spark, g, n):  # noqa: F811
    """The graph with ``n`` more entities of one name."""
    more = spark.range(n).select(F.concat(F.lit("custom/"), "id").alias("entity_id"), F.lit("canonical").alias("name_kind"), F.lit("Same Name").alias("value"), F.lit("same name").alias("value_norm"), F.lit("en").alias("lang"), F.lit("").alias("script"), F.lit(True).alias("is_preferred"))
    return g.with_tables(names=g.names.unionByName(more))


def test_linking_on_a_name_of_many_entities(spark, g):  # noqa: F811
    rows = spark.range(300).selectExpr("id as row_id", "case when id % 3 = 0 then 'Xandria' else 'same  name' end as name").union(spark.createDataFrame([(1, "Xandria"), (999, "nobody")], "row_id long, name string"))
    out = linking.link(crowd(spark, g, 200), rows, "row_id", ["name"])
    assert most_rows(out) <= 2 * 302
    got = {r.row_id: (r.status, r.entity_id, r.key) for r in out.collect()}
    assert got[0] == ("linked", "country/x", "name") and got[2] == ("ambiguous", None, None) and got[999] == ("no_match", None, None)
    assert got[1] == ("ambiguous", None, None)
    # a row id with two values is ambiguous if they name two entities
    twice = spark.createDataFrame([(1, "World"), (1, "Xandria"), (2, "World"), (2, "world")], "row_id long, name string")
    assert {(r.row_id, r.status, r.entity_id) for r in linking.link(g, twice, "row_id", ["name"]).collect()} == {(1, "ambiguous", None), (2, "linked", "world/0")}


def test_the_tally_of_a_name_of_many_entities(spark, g):  # noqa: F811
    rows = spark.range(300).selectExpr("id as row_id", "case when id % 3 = 0 then 'Xandria' when id % 3 = 1 then 'nobody' else 'same name' end as name")
    tally = linking.augment(crowd(spark, g, 200), rows, "row_id", ["name"])[1]
    assert most_rows(tally) <= 2 * 300
    assert {r.status: r.n for r in tally.collect()} == {"linked": 100, "skipped": 100, "ambiguous": 100}


def numbered_names(spark, n):
    return spark.range(n).selectExpr("concat('e/', id) as entity_id", "concat('customer#', lpad(id, 6, '0'), ' of customer#', lpad(id, 6, '0')) as value_norm")


def test_prefixes_longer_than_what_names_share(spark):
    names = numbered_names(spark, 1000)
    q = spark.range(100).selectExpr("concat('q', id) as qid", "concat('customer#', lpad(id, 5, '0')) as norm").union(spark.createDataFrame([("", ""), ("no", "customer#x"), ("all", "c"), ("null", None)], "qid string, norm string"))
    starts = [(f"q{i}", f"e/{i * 10 + j}") for i in range(100) for j in range(10)] + [("all", f"e/{i}") for i in range(1000)]
    for join in (lookup.prefix_join, lookup.infix_join):
        hits = join(names, q)
        assert most_rows(hits) <= 2000
        assert sorted((r.qid, r.entity_id) for r in hits.collect()) == sorted(starts)


def test_beginnings_that_many_texts_share(spark, g):  # noqa: F811
    names = crowd(spark, g, 100)
    q = spark.range(100).selectExpr("id as qid", "concat('same', id) as norm")
    out = resolve.prefix_fallback(names, q, resolve.CUSTOM)
    assert most_rows(out) <= 100 * resolve.CUSTOM.budget
    got = {(r.qid, r.rank): r.entity_id for r in out.collect()}
    ids = sorted(f"custom/{i}" for i in range(100))[: resolve.CUSTOM.budget]
    assert got == {(i, k + 1): e for i in range(100) for k, e in enumerate(ids)}


def test_long_prefixes_meet_no_name_that_only_begins_alike(spark):
    """1.6 billion pairs share eight characters; 40,000 share all of a query."""
    began = time.time()
    q = spark.range(40_000).selectExpr("id as qid", "concat('customer#', lpad(id, 6, '0'), ' ') as norm")
    for join in (lookup.prefix_join, lookup.infix_join):
        assert join(numbered_names(spark, 40_000), q).count() == (40_000 if join is lookup.prefix_join else 0)
    assert time.time() - began < 20


def test_corrections_of_texts_and_names_that_repeat(spark, g):  # noqa: F811
    """A name of 200 entities and 300 equal texts; of the entities the first by id count, each by the least of its close names."""
    more = spark.createDataFrame([("custom/199", "Samd Namex"), ("custom/0", "Sam Name"), ("custom/0", "SAM NAME")], "entity_id string, value string").selectExpr("entity_id", "'alias' as name_kind", "value", "lower(value) as value_norm", "'en' as lang", "'' as script", "false as is_preferred")
    one = crowd(spark, g, 200)
    every = one.with_tables(names=one.names.unionByName(more), entities=g.entities.unionByName(spark.range(200).selectExpr("concat('custom/', id) as entity_id", "'custom' as entity_type", "'Same Name' as canonical_name"), allowMissingColumns=True))
    q = spark.range(300).selectExpr("id as qid", "case when id < 299 then 'samd name' else 'samd namee' end as text").withColumn("norm", F.col("text"))
    out = resolve.corrections(every, q, resolve.CUSTOM)
    assert most_rows(out) <= 300 * resolve.CUSTOM.budget
    got = {}
    for r in out.collect():
        got.setdefault(r.qid, []).append((r.rank, r.entity_id, r.edit_distance, r.matched))
    ids = sorted(f"custom/{i}" for i in range(200))[:20]
    want = [(k + 1, e, 1, "SAM NAME" if e == "custom/0" else "Same Name") for k, e in enumerate(ids)]
    assert all(sorted(got[i]) == want for i in range(299)) and got[299] == [(1, "custom/199", 1, "Samd Namex")]


def test_ids_that_a_file_packs_small_are_not_broadcast(spark, g, tmp_path):  # noqa: F811
    """Half a million ids: some MB in a file, far more as a hash table in each task."""
    ids = spark.range(500_000).selectExpr("concat('org/cust-', id) as entity_id", "'org.company' as entity_type")
    g.with_tables(entities=g.entities.unionByName(ids, allowMissingColumns=True)).write(f"file://{tmp_path}/g")
    read = EntityGraph.read(spark, f"file://{tmp_path}/g")
    joined = lookup.iter_names(read.with_tables(names=read.entities.select("entity_id", *[F.col("entity_id").alias(c) for c in ("value_norm", "name_kind", "is_preferred", "value")])))
    assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()
    few = read.entities.join(read.codes.select("entity_id"), "entity_id", "left_semi")
    assert "BroadcastHashJoin" in few._jdf.queryExecution().sparkPlan().toString()


def test_pairs_of_texts_and_names_are_distinct_without_being_gathered(spark, g):  # noqa: F811
    q = spark.createDataFrame([(1, "xandria"), (1, "xandria"), (2, "ypres land"), (3, "none"), (4, None)], "qid long, norm string")
    names = g.names.union(g.names)
    out = lookup.lookup_name(g.with_tables(names=names), q)
    assert sorted((r.qid, r.entity_id) for r in out.collect()) == [(1, "country/x"), (2, "country/y"), (2, "country/z")]
    top = out._jdf.queryExecution().optimizedPlan()
    assert top.nodeName() != "Aggregate"
