import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from oriel.functions import scoring, similarity, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "profile", "want"),
    [("  New   York ", "standard", "new york"), ("Straße", "standard", "strasse"), ("**Italy**", "geo", "italy"), ("&amp;Spain", "geo", "&spain"), ("São Tomé", "aggressive", "sao tome"), ("ACME, Inc.", "org", "acme inc"), ("   ", "standard", None), ("a b", "standard", "a b")],
)
def test_normalise_agrees_with_the_string_function(spark, raw, profile, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.normalise(F.col("t"), profile).alias("x")).first().x == want
    assert text.normal_form(raw, text.PROFILES[profile]) == want


def test_aligned_text_is_the_normal_form():
    rng = random.Random(4)
    for _ in range(300):
        raw = "".join(rng.choices("aB é\tßÉ́ .", k=12))
        got, start, end = text.aligned(raw)
        assert got == (text.normal_form(raw) or "")
        assert all(a < b for a, b in zip(start, end, strict=True)) and start == sorted(start)


def test_gates(spark):
    rows = spark.createDataFrame([("US",), ("us",), ("u",), ("U",), ("unknown",), ("na",), ("U.S.A.",), ("--",), ("Chad",)], "t string")
    c = F.col("t")
    got = {r.t: (r.p, r.s, r.d, r.i) for r in rows.select("t", text.short_input_passes(c).alias("p"), text.is_sentinel(c).alias("s"), text.is_degenerate(c).alias("d"), text.is_dotted_initialism(c).alias("i")).collect()}
    assert got["US"][0] and not got["us"][0] and not got["u"][0] and not got["U"][0] and got["Chad"][0]
    assert got["unknown"][1] and not got["na"][1] and got["na"][2] and got["U.S.A."][3]


def test_flag_and_numbers(spark):
    assert one(spark, text.flag(F.lit("de"))) == "🇩🇪"
    assert one(spark, text.coerce_number(F.lit(840.0))) == "840"


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_similarities_against_plain_versions():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 9))) for _ in range(2))
        assert similarity.lcs_length(a, b) == lcs(a, b)
    assert similarity.damerau("ca", "abc") == 2 and similarity.osa("ca", "abc") == -1 and similarity.osa("ab", "ba") == 1
    assert similarity.token_set("new york city", "york new") == 1.0
    assert similarity.partial("york", "new york city") == 1.0


def test_score_anchors(spark):
    assert one(spark, scoring.platt(F.lit(0.9))) == pytest.approx(0.8902, abs=1e-4)
    assert one(spark, scoring.band(F.lit(1.0), "geo")) == pytest.approx(1.0)
    assert one(spark, scoring.isotonic(F.lit(0.5), [0.0, 1.0], [0.2, 0.8])) == pytest.approx(0.5)
    assert one(spark, scoring.bm25_feature(F.lit(-math.e))) == pytest.approx(math.log1p(math.e) / math.log1p(50))
