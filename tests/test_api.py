import pytest
from pyspark.sql import functions as F

from oriel.api import Resolver, register_functions
from oriel.operators import build, calibration, constraints, etl, explain, metrics, output, parse, spelling
from oriel.operators import resolve as cascade
from oriel.sources import packs, records
from oriel.sources.graph import EntityGraph
from oriel.streaming import resolve as streams
from tests.test_operators import g  # noqa: F401


@pytest.fixture
def r(g):  # noqa: F811
    return Resolver(g, ["geo"])


def test_resolver_answers(spark, r):
    got = {x.text: (x.status, x.output) for x in r.resolve(["XX", "Ypres Land", "nobody", None], to=["iso3", "name"]).collect()}
    assert got == {"XX": ("resolved", "XXX"), "Ypres Land": ("ambiguous", None), "nobody": ("no_match", None), None: ("no_match", None)}
    typed = r.resolve(["Ypres Land"], context={"parent_ids": ["region/a"]}).first()
    assert (typed.status, typed.entity_id) == ("resolved", "country/y")
    assert r.resolve(["Avalon"], context={"entity_types": ["geo.country"]}).first().status == "no_match"
    assert r.resolve_id(["Ypres Land"], on_ambiguous="best").first().entity_id == "country/y"
    with pytest.raises(ValueError, match="ambiguous"):
        r.resolve_id(["Ypres Land"])
    assert [x.value for x in r.bulk(["XX", "XX", None]).orderBy("row_id").collect()] == ["XX", "XX", None]


def test_resolver_graph_questions(spark, r):
    assert r.one("avalon") == "region/a" and r.is_member("xandria", "Union U", as_of=F.lit("1980-01-01").cast("date"))
    with pytest.raises(ValueError, match="ambiguous"):
        r.one("Ypres Land")
    with pytest.raises(ValueError, match="unknown"):
        r.one("region/none")
    assert {x.entity_id for x in r.within("World", entity_type="geo.country").collect()} == {"country/x", "country/y"}
    assert r.convert(["xx"], "iso2", "iso3").first().value == "XXX"
    assert [x.system for x in r.code_systems().collect()] == ["iso2", "iso3"]
    assert r.explain(["XX"], "geo").first().winner.entity_id == "country/x"
    assert {x.entity_id for x in r.suggest(["xan"]).collect()} == {"country/x"}


def test_outputs_and_selectors(spark, g):  # noqa: F811
    assert output.name_selector("name:abbr:Latn") == output.NameSelector(kind="acronym", script="Latn")
    for bad in ("name:", "name:EN", "name:en:", "name:a:b:c"):
        with pytest.raises(output.UnknownOutput):
            output.name_selector(bad)
    with pytest.raises(output.UnknownOutput, match="iso3"):
        output.values_of(g, "iso33").collect()
    flags = {x.entity_id: x.value for x in output.values_of(g, "flag").collect()}
    assert flags["country/y"] == "\U0001f1fe\U0001f1fe"
    assert {x.value for x in output.values_of(g, "continent").where("entity_id = 'country/y'").collect()} == {"World"}
    with pytest.raises(ValueError, match="none of"):
        output.with_output(g, g.entities.select("entity_id"), "iso3", on_miss="raise")
    with pytest.raises(ValueError, match="did you mean 'country'"):
        output.checked_context({"contry": "DE"})
    assert output.checked_context({"country": "de"}) == {"country": "DE"}


def test_records_and_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,Widget\n2,Gadget\n")
    (tmp_path / "a.jsonl").write_text('{"id": "1", "name": "Widget"}\n')
    assert records.read_records(spark, str(tmp_path / "a.csv")).count() == 2
    assert records.read_records(spark, str(tmp_path / "a.jsonl")).first().name == "Widget"
    assert records.read_records(spark, {"k": {"name": "W"}}).first()["__id__"] == "k"
    assert records.read_records(spark, {"id": [1, 2], "name": ["W", None]}).count() == 2
    r = Resolver.from_records(spark, [{"id": "w1", "name": "Widget"}, {"id": "w2", "name": "Gadget"}], id="id", namespace="x")
    assert r.resolve(["widget"]).first().entity_id == "x/w1"
    assert [x.value for x in records.values(spark, [840.0, 7, "a", None, float("nan")]).orderBy("row_id").collect()] == ["840", "7", "a", None, None]
    for bad, error in (((x for x in [1]), "once"), ("text", "list"), ([True], "boolean")):
        with pytest.raises(TypeError, match=error):
            records.values(spark, bad)
    with pytest.raises(ValueError, match="are read from"):
        records.read_records(spark, "a.xls")


def test_packs_are_checked(spark, g, tmp_path):  # noqa: F811
    path = str(tmp_path / "p")
    packs.write_pack(g, path, "base", "geo")
    assert Resolver.from_packs(spark, [path]).graph.names.count() == g.names.count()
    g.names.limit(1).write.mode("append").parquet(f"{path}/names")
    with pytest.raises(packs.PackError, match="names"):
        packs.read_pack(spark, path)
    packs.write_pack(g, str(tmp_path / "q"), "more", "geo", needs=["base"])
    with pytest.raises(packs.PackError, match="needs base"):
        packs.read_pack(spark, str(tmp_path / "q"))


def test_stages_resume(spark, g, tmp_path):  # noqa: F811
    def broken(_):
        raise RuntimeError("lost")

    ok = ("all", lambda x: x)
    with pytest.raises(RuntimeError):
        build.run_stages(g, [ok, ("next", broken)], f"file://{tmp_path}/b")
    out, ran = build.run_stages(g, [ok, ("next", lambda x: x.with_tables(codes=x.codes.limit(0)))], f"file://{tmp_path}/b")
    assert ran == ["next"] and out.codes.count() == 0 and out.entities.count() == g.entities.count()


def test_discovery_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "e"), ("c", "d"), ("d", "a")], "parent_id string, entity_id string")
    got = {x.entity_id: (x.level, x.place) for x in build.discover(edges, spark.createDataFrame([("a",)], "entity_id string")).collect()}
    assert got == {"a": (0, 0), "b": (1, 0), "c": (1, 1), "d": (2, 0), "e": (2, 1)}


def test_org_rows_resolve(spark):
    orgs = spark.createDataFrame([("org/1", "World Trade Body", "WTB", None, "World Trade Body Inc", None, "XX", {"wikidata": "Q9"}), ("org/2", "Trade Office", None, "Office", None, "org/1", "XX", {})], "id string, name string, acronym string, short string, legal string, parent_id string, country string, codes map<string,string>")
    r = Resolver(build.org_rows(orgs), ["org"])
    got = {x.text: x.entity_id for x in r.resolve(["WTB", "Q9", "office", "world trade body inc"]).collect()}
    assert got == {"WTB": "org/1", "Q9": "org/1", "office": "org/2", "world trade body inc": "org/1"}
    assert [x.target_id for x in r.related("org/2", "subsidiary_of").collect()] == ["org/1"]


def test_parent_context_breaks_ties(spark):
    row = lambda i, parent: (i, "Trade Office", None, None, None, parent, "XX", {})
    orgs = spark.createDataFrame([row("org/a", "org/p"), row("org/b", "org/q"), row("org/c", None)], "id string, name string, acronym string, short string, legal string, parent_id string, country string, codes map<string,string>")
    g = build.org_rows(orgs)  # noqa: F811
    q = cascade.prepare(spark.createDataFrame([(1, "Trade Office")], "qid long, text string"))
    plain = cascade.resolve_pack(g, q, cascade.ORG, fuzzy=False).first()
    kin = cascade.resolve_pack(g, q, cascade.ORG, fuzzy=False, constrain=lambda c: constraints.parent_org_flag(c, g, ["org/q"])).first()
    assert plain.status == "ambiguous" and (kin.status, kin.entity_id, kin.reason) == ("resolved", "org/b", "parent_context")


def test_flat_bundles(spark):
    b = spark.createDataFrame([("a", "geo.country", "Aland", ["Old A"], {"iso2": "AL"}, ["w"]), ("a", "geo.country", "Aland", ["Old A"], {"iso2": "AL"}, ["w"])], "id string, type string, name string, aliases array<string>, codes map<string,string>, parents array<string>")
    assert {k: t.count() for k, t in etl.flatten_bundles(b).tables().items()} == {"entities": 1, "names": 2, "codes": 1, "relations": 1}


def test_word_and_compound_corrections(spark):
    terms = spark.createDataFrame([("new", 5), ("york", 3), ("newark", 9), ("city", 2)], "term string, n long")
    q = spark.createDataFrame([(1, "nwe yorck"), (2, "newyork"), (3, "new york"), (4, "ci ty york")], "qid long, norm string")
    assert {x.qid: x.corrected for x in spelling.correct_words(terms, q).collect()}[1] == "new york"
    assert {x.qid: x.corrected for x in spelling.correct_compounds(terms, q).collect()} == {2: "new york", 4: "city york"}
    assert spelling.did_you_mean(terms, q.where("qid = 2")).first().suggestions == ["newark"]


def test_arbitration(spark):
    rows = [(1, 0, 5, "org", "resolved", 0.9), (1, 3, 9, "geo", "resolved", 0.95), (1, 9, 12, "geo", "nil", None), (1, 8, 14, "org", "nil", None), (1, 20, 22, "org", "resolved", 0.8), (1, 20, 22, "geo", "resolved", 0.8)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, pack string, status string, confidence double")
    assert sorted((x.start, x.pack) for x in parse.arbitrate(df).collect()) == [(3, "geo"), (9, "geo"), (20, "geo")]


def test_span_overlaps(spark):
    s = "doc_id long, start int, end int, entity_id string"
    gold = spark.createDataFrame([(1, 0, 5, "a"), (1, 10, 15, "b"), (1, 20, 25, None), (1, 30, 35, None), (2, 0, 3, "c")], s)
    found = spark.createDataFrame([(1, 1, 5, "a"), (1, 10, 15, "b"), (1, 22, 23, "x"), (3, 0, 1, "y")], s)
    x = metrics.span_overlaps(gold, found).first()
    assert (x.tp, x.fp, x.fn, x.boundary_exact, x.nil_accuracy) == (2, 2, 1, 0.5, 0.5)
    assert metrics.span_overlaps(gold.limit(0), found.limit(0)).first().f1 in (None, 0.0)


def test_fits(spark):
    rows = spark.createDataFrame([(i / 100, int((i * 7919) % 100 < i), i % 12) for i in range(100)], "p double, y int, query_len int")
    c = calibration.fit_platt(rows)
    got = rows.select(F.avg(c.of(F.col("p")) - F.col("y")).alias("d"), F.corr(c.of(F.col("p")), "p").alias("r")).first()
    assert abs(got.d) < 1e-6 and got.r > 0.9 and c.a < 0
    iso = calibration.fit_isotonic(rows)
    assert list(iso.ys) == sorted(iso.ys)
    pair = calibration.fit_stratified(rows)
    assert rows.select(calibration.stratified(F.col("p"), F.col("query_len"), pair).alias("x")).where("x between 0 and 1").count() == 100
    weights, intercept = calibration.fit_model(rows, ["p"])
    assert weights["p"] > 0 > intercept
    with pytest.raises(ValueError, match="both classes"):
        calibration.fit_platt(rows.withColumn("y", F.lit(1)))


def test_split_keeps_queries_together(spark):
    rows = spark.createDataFrame([(f"q{i // 3}", f"e{i}", i % 2) for i in range(300)], "query_text string, expected_entity_id string, label int")
    out = calibration.split_with_both_classes(rows)
    assert out.groupBy("query_text").agg(F.count_distinct("is_eval").alias("n")).where("n > 1").isEmpty()
    assert 20 < out.where("is_eval").count() < 110
    one = calibration.split_with_both_classes(rows.where("label = 1"))
    assert one.where("is_eval").isEmpty()


def test_hints_and_group_preference(spark):
    c = "array<struct<entity_id string, confidence double, entity_type string>>"
    df = spark.createDataFrame([(1, "ambiguous", None, None, "low_gap", [("a", 0.9, "geo.country"), ("b", 0.9, "geo.organization")]), (2, "no_match", None, None, "no_candidates", None)], f"qid long, status string, entity_id string, confidence double, reason string, candidates {c}")
    got = {x.qid: (x.status, x.entity_id) for x in explain.group_preference(df).collect()}
    assert got == {1: ("resolved", "b"), 2: ("no_match", None)}


def test_late_events_are_dropped_after_the_watermark(spark, g, tmp_path):  # noqa: F811
    schema = "ts timestamp, code string"
    batches = [[("2024-01-01 00:10:00", "xx"), ("2024-01-01 00:20:00", "XX")], [("2024-01-01 05:00:00", "yy")], [("2024-01-01 00:30:00", "xx")], [("2024-01-01 09:00:00", "yy")]]
    src = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts string, code string").select(F.to_timestamp("ts").alias("ts"), "code").coalesce(1).write.mode("append").parquet(src)
        events = spark.readStream.schema(schema).parquet(src)
        counts = streams.windowed_counts(streams.resolve_codes(g, events, "code", "iso2"), "ts")
        counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((str(x.start), x.entity_id, x.n) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[0] == ("2024-01-01 00:00:00", "country/x", 2) and len([x for x in got if x[1] == "country/x"]) == 1


def test_sql_functions(spark):
    register_functions(spark)
    x = spark.sql("select normal_form('Straße  X') as n, token_set_ratio('a b', 'b a c') as t, damerau('ca', 'abc') as d").first()
    assert (x.n, x.t, x.d) == ("strasse x", 1.0, 2)


def test_empty_graph(spark, g):  # noqa: F811
    none = EntityGraph(**{k: t.limit(0) for k, t in g.tables().items()})
    assert Resolver(none, ["geo"]).resolve(["XX", ""]).where("status = 'no_match'").count() == 2
