"""Packs from elsewhere and from a cache, fetches with retries, enrichers, and limits that are settings."""

import pytest
from pyspark.sql import functions as F

from oriel.operators import build, enrich, linking, resolve
from oriel.sources import packs
from tests.test_operators import g  # noqa: F401


def test_packs_are_fetched_once_and_held_against_digests(spark, g, tmp_path):  # noqa: F811
    source, cache = f"file://{tmp_path}/there/pack", f"file://{tmp_path}/cache"
    packs.write_pack(g, source, "p", "geo")
    with pytest.raises(packs.PackError, match="digest"):
        packs.ensure_pack(spark, source, cache, sha256="0" * 64)
    assert not (tmp_path / "cache" / "pack").exists() and not list((tmp_path / "cache").glob("*.part-*"))
    path, copied = packs.ensure_pack(spark, source, cache)
    assert copied and packs.read_pack(spark, path).names.count() == g.names.count()
    digest = spark.read.text(f"{path}.sha256").first().value
    assert packs.ensure_pack(spark, source, cache) == (path, False)
    packs.clear_cache(spark, cache)
    assert packs.ensure_pack(spark, source, cache, sha256=digest)[1]
    # contents that aren't what was written, under metadata that says they are
    g.codes.limit(1).write.mode("overwrite").parquet(f"{source}/codes")
    packs.clear_cache(spark, cache)
    with pytest.raises(packs.PackError, match="codes"):
        packs.ensure_pack(spark, source, cache)
    assert not list((tmp_path / "cache").glob("*.part-*"))


def test_builds_are_found_by_what_they_are_made_of(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "id string, name string")
    built = []

    def make(r):
        built.append(1)
        return linking.from_records(r, linking.roles(r.columns, id="id"))

    cache = f"file://{tmp_path}"
    first, hit = packs.built_pack(rows, {"domain": "custom"}, cache, make)
    assert not hit and first.relations.count() == 0 and first.names.count() == 2
    assert packs.built_pack(rows.orderBy(F.desc("id")), {"domain": "custom"}, cache, make)[1] and len(built) == 1
    assert not packs.built_pack(rows, {"domain": "custom", "on": "name"}, cache, make)[1]
    assert not packs.built_pack(rows.limit(1), {"domain": "custom"}, cache, make)[1] and len(built) == 3


def test_fetches_go_on_until_nothing_new_comes(spark):
    ids = spark.createDataFrame([(f"e{i}",) for i in range(9)], "entity_id string")
    waits = []

    def some(n):
        return lambda left: left.orderBy("entity_id").limit(n).withColumn("v", F.lit(1))

    rows, left, why = build.fetch_all(ids, some(4), sleep=waits.append)
    assert (rows.count(), left.count(), why, waits) == (9, 0, "done", [0.5, 1.0])
    rows, left, why = build.fetch_all(ids, some(2), most_retries=1, sleep=waits.append)
    assert (rows.count(), left.count(), why) == (4, 5, "retries")
    rows, left, why = build.fetch_all(ids, lambda left: left.where("entity_id < 'e3'").withColumn("v", F.lit(1)), sleep=waits.append)
    assert (rows.count(), left.count(), why) == (3, 6, "no_progress")


def test_enrichers_see_what_came_before(spark, g):  # noqa: F811
    name = lambda i, v: spark.createDataFrame([(i, v)], "entity_id string, value string")
    steps = [("saint", enrich.with_names(name("country/x", "Saint Xan"))), ("short", enrich.saint_aliases), ("formal", enrich.formal_names(name("country/y", "Ypres, Land of"))), ("none", enrich.with_names(name("nobody", "No one")))]
    out = enrich.enrich(g, steps)
    new = {(r.entity_id, r.value) for r in out.names.collect()} - {(r.entity_id, r.value) for r in g.names.collect()}
    assert new == {("country/x", "Saint Xan"), ("country/x", "St. Xan"), ("country/x", "St Xan"), ("country/y", "Ypres, Land of"), ("country/y", "Land of Ypres")}
    assert enrich.enrich(g, steps, ["short"]).names.count() == g.names.count()
    with pytest.raises(ValueError, match="distinct"):
        enrich.enrich(g, [*steps, steps[0]])
    dated = spark.createDataFrame([("country/x", "groups/u", "1960-01-01", None), ("country/x", "groups/none", None, None), ("country/y", "groups/u", "1990-01-01", None)], "entity_id string, target_id string, valid_from string, valid_until string")
    rows = {r.entity_id: str(r.valid_from) for r in enrich.groups(dated)(g).relations.where("relation_type = 'member_of'").collect()}
    assert rows == {"country/x": "1960-01-01", "country/y": "1990-01-01"}
    assert {r.valid_from for r in enrich.groups(dated, snapshots=("groups/u",))(g).relations.where("relation_type = 'member_of'").collect()} == {None}


def test_long_texts_are_cut_where_the_caller_says(spark):
    q = spark.createDataFrame([(1, "x" * 1500), (2, "Xandria " + "y" * 20)], "qid long, text string")
    assert [len(r.norm) for r in resolve.prepare(q).orderBy("qid").collect()] == [1000, 28]
    assert [r.norm for r in resolve.prepare(q, 7).orderBy("qid").collect()] == ["x" * 7, "xandria"]
