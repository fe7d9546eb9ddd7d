"""The whole fuzzy cascade of one domain against a version in plain Python that tries every name."""

import itertools
import random
import re

import pytest

from oriel.functions import similarity
from oriel.operators import resolve
from oriel.sources.graph import EntityGraph

FIRST, SECOND = ("cold", "small", "bright", "cool"), ("widget", "ring", "bolt")


def names_of():
    """(entity, kind, name): every pair of words once, some names turned round, one name of two entities."""
    out = [(f"custom/{i}", "canonical", f"{a} {b}") for i, (a, b) in enumerate(itertools.product(FIRST, SECOND))]
    out += [(e, "alias", " ".join(reversed(n.split()))) for i, (e, _, n) in enumerate(out) if i % 3 == 0]
    return [*out, ("custom/twin", "canonical", "cold ring"), ("custom/long", "canonical", "internationally known widget"), ("custom/zed", "alias", "zzz")]


def plain(text, names):
    """(status, entity, confidence) of one query."""
    norm = " ".join(text.lower().split())
    words = [w for w in re.split(r"[\W_]+", norm) if w]
    exact = {}
    for e, kind, n in names:
        if n == norm:
            exact[e] = max(exact.get(e, 0), 1.0 if kind == "canonical" else 0.95)
    code_like = bool(re.fullmatch(r"[A-Za-z]{2,3}|[0-9]{3}|(wikidata:)?[qQ][0-9]+", text.strip()))
    found = set(exact)
    if not code_like and len(norm) >= 2 and words:
        index = lambda e, n: [w for w in re.split(r"[\W_]+", f"{e} {n}".lower()) if w]
        hits = [(e, n) for e, _, n in names if set(words) <= set(index(e, n))]
        phrases = [(e, n) for e, n in hits if f" {' '.join(words)} " in f" {n} "]
        found |= {e for e, _ in phrases or hits}
    if not code_like and len(norm) >= 3:
        far = [(similarity.osa(norm, n), e, n) for e, _, n in names if len(n) >= 2]
        near = [x for x in far if x[0] >= 0]
        least = min((d for d, _, _ in near), default=None)
        found |= {e for d, e, n in near if d == least and n != norm and (d <= 1 or len(norm) > 6)}
    scored = []
    for e in found:
        _, edit, token = max((0.5 * similarity.indel(norm, n) + 0.5 * similarity.token_set(norm, n), similarity.indel(norm, n), similarity.token_set(norm, n)) for x, _, n in names if x == e)
        scored.append((0.9 if e in exact else min(0.89, 0.5 + 0.35 * edit + 0.1 * token), e))
    scored.sort(key=lambda x: (-x[0], x[1]))
    if not scored:
        return "no_match", None, None
    top, second = scored[0], scored[1][0] if len(scored) > 1 else 0.0
    if top[0] < 0.7:
        return "no_match", None, pytest.approx(top[0])
    return ("resolved", top[1], pytest.approx(top[0])) if top[0] - second >= 0.1 else ("ambiguous", None, None)


def test_fuzzy_resolution_against_all_names(spark):
    names = names_of()
    ids = sorted({e for e, _, _ in names})
    none = lambda cols: spark.createDataFrame([], cols)
    first = {e: n for e, _, n in reversed(names)}
    g = EntityGraph(
        spark.createDataFrame([(e, "custom", first[e], first[e], None, None, None, None) for e in ids], "entity_id string, entity_type string, canonical_name string, canonical_name_norm string, valid_from date, valid_until date, prominence double, country_code string"),
        spark.createDataFrame([(e, k, n, n, "en", "", k == "canonical") for e, k, n in names], "entity_id string, name_kind string, value string, value_norm string, lang string, script string, is_preferred boolean"),
        none("entity_id string, system string, value string, value_norm string"), none("entity_id string, relation_type string, target_id string, valid_from date, valid_until date"),
    )
    rng = random.Random(5)
    texts = {n for _, _, n in names} | {"cold", "Ring", "zzz", "ZZZ", "zz", "zzzz", "known widget", "widget known", "nothing like it", "x", "ring ring", "  Cold   BOLT "}
    for _, _, n in names:
        for _ in range(4):
            t = list(n)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(t) - 1)
                t[i : i + 2] = rng.choice([[t[i + 1], t[i]], [t[i]], [t[i], "q", t[i + 1]], ["q", t[i + 1]]])
            texts.add("".join(t))
    texts = sorted(texts)
    q = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    got = {r.qid: (r.status, r.entity_id, r.confidence) for r in resolve.resolve(g, q, packs=["custom"]).collect()}
    wrong = [(t, got[i], plain(t, names)) for i, t in enumerate(texts) if got[i] != plain(t, names)]
    assert not wrong
    assert {s for s, _, _ in got.values()} == {"resolved", "ambiguous", "no_match"}
