"""Names of many words in texts."""

from oriel.api import Resolver
from oriel.operators import parse


def test_names_of_more_than_six_words(spark, monkeypatch):
    name = "United Kingdom of Great Britain and Northern Ireland"
    g = Resolver.from_records(spark, [{"id": "gb", "name": name}, {"id": "ie", "name": "Ireland"}], id="id").graph
    docs = spark.createDataFrame([(1, f"in the {name} today")], "doc_id long, text string")
    for most in (parse.SENT_PATTERNS, 0):
        monkeypatch.setattr(parse, "SENT_PATTERNS", most)
        assert {r.surface for r in parse.mentions(g, docs).collect()} == {name, "Ireland"}
    assert parse.gazetteer(g).where("n_words = 8").count() == 1
