"""Fuzzy suggestions against a comparison with all names."""

import random

from oriel.functions import similarity
from oriel.operators import suggest


def test_like_names_against_all_names(spark):
    rng = random.Random(1)
    names = ["china", "birds", "bird", "été", "ab", "x" * 80, "\U0001f600 smile", ""]
    names += ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    asked = ["cihna", "brids", "brid", "x" * 70, "smiel", *names[10:60], *("".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(30))]
    asked = sorted({a for a in asked if len(a) >= 3})
    names = sorted(set(names))
    q = spark.createDataFrame([(a, a, a) for a in asked], "qid string, text string, norm string")
    table = spark.createDataFrame([(n,) for n in names], "value_norm string")
    got = {(r.qid, r.value_norm) for r in suggest.like_names(table, q, 100).collect()}
    want = set()
    for a in asked:
        scored = sorted((-s, n) for n in names if 2 * len(n) >= len(a) and (s := similarity.partial(a, n)) >= 0.7)
        want |= {(a, n) for _, n in scored[:500]}
    assert {("cihna", "china"), ("brids", "birds"), ("brid", "bird")} <= want and got == want
