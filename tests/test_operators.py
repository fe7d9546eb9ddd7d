import pytest
from pyspark.sql import functions as F

from oriel.functions import similarity
from oriel.operators import closure, etl, linking, lookup, parse, resolve, suggest
from oriel.sources import graph as graphs
from oriel.sources.graph import EntityGraph


@pytest.fixture(scope="module")
def g(spark):
    e = [("world/0", "geo.continent", "World"), ("region/a", "geo.region", "Avalon"), ("country/x", "geo.country", "Xandria"), ("country/y", "geo.country", "Ypres Land"), ("country/z", "geo.country", "Ypres Land"), ("groups/u", "geo.continental_union", "Union U")]
    entities = spark.createDataFrame([(*r, r[2].lower(), None, None, None, None) for r in e], "entity_id string, entity_type string, canonical_name string, canonical_name_norm string, valid_from date, valid_until date, prominence double, country_code string")
    names = spark.createDataFrame([(i, "canonical", n, n.lower(), "en", "", True) for i, _, n in e] + [("country/x", "alias", "Old Xandria", "old xandria", "en", "", False)], "entity_id string, name_kind string, value string, value_norm string, lang string, script string, is_preferred boolean")
    codes = spark.createDataFrame([("country/x", "iso2", "XX", "xx"), ("country/y", "iso2", "YY", "yy"), ("country/x", "iso3", "XXX", "xxx")], "entity_id string, system string, value string, value_norm string")
    edges = [("region/a", "contained_in", "world/0"), ("country/x", "contained_in", "region/a"), ("country/y", "contained_in", "region/a"), ("world/0", "contained_in", "country/x")]
    relations = spark.createDataFrame([(*r, None, None) for r in edges], "entity_id string, relation_type string, target_id string, valid_from date, valid_until date").union(
        spark.sql("select 'country/x', 'member_of', 'groups/u', date '1973-01-01', date '2020-02-01'")
    )
    return EntityGraph(entities, names, codes, relations)


def ids(df, c="entity_id"):
    return sorted(r[c] for r in df.collect())


def test_within_ends_on_cycles(g):
    got = {r.entity_id: r.depth for r in closure.within(g, "world/0").collect()}
    assert got == {"region/a": 1, "country/x": 2, "country/y": 2}
    assert ids(closure.within(g, "world/0", "geo.country", max_depth=1)) == []


def test_membership_is_half_open(g):
    day = lambda d: F.lit(d).cast("date")
    assert ids(closure.members_of(g, "groups/u", day("1973-01-01"))) == ["country/x"]
    assert ids(closure.members_of(g, "groups/u", day("2020-02-01"))) == []
    assert ids(closure.members_of(g, "groups/u", day("2020-02-01"), snapshots=("groups/u",))) == ["country/x"]
    assert ids(closure.members_of(g, "groups/u", day("1999-01-01"), code_system="iso2"), "code") == ["XX"]


def test_resolution_statuses(spark, g):
    q = spark.createDataFrame([(1, "XX"), (2, " old  XANDRIA"), (3, "Ypres Land"), (4, "unknown"), (5, "Xandira"), (6, None), (7, ""), (8, "xx")], "qid long, text string")
    got = {r.qid: (r.status, r.entity_id) for r in resolve.resolve(g, q, packs=["geo"]).collect()}
    assert got[1] == ("resolved", "country/x") and got[2] == ("resolved", "country/x")
    assert got[3][0] == "ambiguous" and got[4] == ("no_match", None) and got[5] == ("resolved", "country/x")
    assert got[6][0] == got[7][0] == got[8][0] == "no_match" and len(got) == 8


def test_bulk_policies(spark, g):
    v = spark.createDataFrame([("Xandria",), ("Ypres Land",), ("nobody",), (None,), ("Xandria",)], "name string")
    cross = spark.createDataFrame([("nobody", "country/y")], "value string, entity_id string")
    rows = resolve.bulk(g, v, "name", packs=["geo"], to="iso2", crosswalk=cross, on_ambiguous="best").collect()
    assert len(rows) == 5
    assert {r.name: r.output for r in rows} == {"Xandria": "XX", "Ypres Land": "YY", "nobody": "YY", None: None}
    with pytest.raises(ValueError, match="ambiguous"):
        resolve.bulk(g, v, "name", packs=["geo"], on_ambiguous="raise")


def test_edit_join_finds_all_within_two_edits(spark):
    import random

    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcd", k=rng.randint(3, 9))) for _ in range(60)})
    asked = ["".join(rng.choices("abcd", k=rng.randint(3, 9))) for _ in range(40)]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, norm string")
    for exact, f in ((None, None), (similarity.osa_distance, similarity.osa)):
        got = sorted((r.qid, r.term, r.distance) for r in lookup.edit_join(terms, q, exact_distance=exact, prefix=24).collect())
        want = []
        for i, a in enumerate(asked):
            d = {w: (f(a, w) if f else lev(a, w)) for w in words}
            low = min((x for x in d.values() if 0 <= x <= 2), default=None)
            want += [(i, w, x) for w, x in d.items() if low is not None and x == low]
        assert got == sorted(want)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_suggest_order(spark, g):
    got = suggest.suggest(g, spark.createDataFrame([(1, "xa"), (2, "land")], "qid long, text string"))
    rows = sorted((r.qid, r["rank"], r.entity_id, r.match_class) for r in got.collect())
    assert rows[0] == (1, 1, "country/x", 0) and {r[3] for r in rows if r[0] == 2} == {1}


def test_parse_offsets_are_code_points(spark, g):
    docs = spark.createDataFrame([(1, "In é old  Xandria, XANDRIA and xandrian; Ypres Land."), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.surface, r.entity_id) for r in parse.parse(g, docs).collect())
    assert got == [(1, 5, 17, "old  Xandria", "country/x"), (1, 19, 26, "XANDRIA", "country/x")]


def test_link_keys_in_order(spark, g):
    rec = spark.createDataFrame([(1, "XX", "nobody"), (2, None, "ypres land"), (3, "QQ", "Avalon"), (4, None, None)], "id long, iso2 string, name string")
    got = {r.row_id: (r.status, r.entity_id, r.key) for r in linking.link(g, rec, "id", ["iso2", "name"]).collect()}
    assert got == {1: ("linked", "country/x", "iso2"), 2: ("ambiguous", None, None), 3: ("linked", "region/a", "name"), 4: ("no_match", None, None)}


def test_crosswalk_round_trip(spark, tmp_path):
    cross = spark.createDataFrame([("a", "x/1"), ("b", None)], "value string, entity_id string")
    linking.write_crosswalk(cross, str(tmp_path / "c"))
    assert {(r.value, r.entity_id) for r in linking.read_crosswalk(spark, str(tmp_path / "c")).collect()} == {("a", "x/1"), ("b", None)}


def test_graph_round_trip_overlay_and_diff(spark, g, tmp_path):
    g.write(str(tmp_path / "g"))
    again = EntityGraph.read(spark, str(tmp_path / "g"))
    assert all(r.added + r.removed + r.changed == 0 for r in etl.diff(again, g).collect())
    top = g.with_tables(entities=g.entities.where("entity_id = 'country/x'").withColumn("canonical_name", F.lit("New")), names=g.names.limit(0), codes=g.codes.limit(0), relations=g.relations.limit(0))
    changed = {r["table"]: r.changed for r in etl.diff(graphs.overlay(g, top), g).collect()}
    assert changed == {"entities": 1, "names": 0, "codes": 0, "relations": 0}
    with pytest.raises(ValueError, match="several modules"):
        graphs.compose([g, g])
    assert graphs.composite([g, g]).entities.count() == g.entities.count()


def test_reconcile_stops(spark, g):
    bad = g.with_tables(relations=g.relations.union(spark.sql("select 'country/x', 'part_of', 'lost/1', cast(null as date), cast(null as date)")))
    assert etl.reconcile(g, lambda m: None)[1] == "closed"
    assert etl.reconcile(bad, lambda m: None)[1] == "no_progress"
