"""The label model and scores against their formulas written out, the tokenizer's proof, and a key with most of the rows."""

import itertools
import math
import re

import numpy as np
import pytest

from oriel.llm import sharding, tokens, toxicity
from oriel.llm.queries import tokenizer_path


def plain_joint(m, votes, c):
    """P(class and votes) of a tree-shaped model, factor by factor."""
    p = float(m.prior[c])
    for v in range(m.n):
        above = votes[m.parent[v]] if m.parent[v] >= 0 else 0
        p *= float(m.table[v][c][above][votes[v]])
    return p


def fitted(known_share=0.5, seed=1):
    rng = np.random.default_rng(seed)
    y = (rng.random(4000) < 0.3).astype(int)
    accuracy = [0.9, 0.7, 0.8, 0.6]
    votes = np.stack([(rng.random(4000) < np.where(y == 1, a, 0.05)).astype(int) for a in accuracy], 1)
    votes = np.concatenate([votes, votes[:, :1] ^ (rng.random((4000, 1)) < 0.02)], 1)  # follows the first
    known = np.where(rng.random(4000) < known_share, y, -1)
    return toxicity.LabelModel(5).fit(votes, np.ones(4000), known), votes, y, known


def test_posteriors_are_bayes_rule_over_the_tree():
    m, _, _, _ = fitted()
    every = np.array(list(itertools.product((0, 1), repeat=5)))
    got = m.posterior(every)
    for v, p in zip(every.tolist(), got, strict=True):
        a, b = plain_joint(m, v, 0), plain_joint(m, v, 1)
        assert p == pytest.approx(b / (a + b), rel=1e-9)
    for c in (0, 1):  # a distribution: all patterns together have the class's prior
        assert sum(plain_joint(m, v, c) for v in every.tolist()) == pytest.approx(m.prior[c], rel=1e-9)


def test_expectation_maximisation_finds_accuracies_and_correlations():
    m, votes, y, known = fitted()
    for v, a in enumerate([0.9, 0.7, 0.8, 0.6]):
        above = m.parent[v]
        share = votes[:, above][y == 1].mean() if above >= 0 else 0.0
        assert m.table[v][1][0][1] * (1 - share) + m.table[v][1][1][1] * share == pytest.approx(a, abs=0.05)
    assert m.parent[4] == 0 or m.parent[0] == 4  # the pair that votes alike is joined in the tree
    assert m.prior[1] == pytest.approx(0.3, abs=0.03)
    assert np.mean((m.posterior(votes) > 0.5) == y) > 0.93
    # one more round of both steps leaves the tables where they are
    before = m.table.copy()
    q = np.where(known >= 0, known, m.posterior(votes))
    m._tables(votes, np.stack([1 - q, q], 1))
    assert np.abs(m.table - before).max() < 5e-3


def test_with_all_labels_known_tables_are_smoothed_counts():
    m, votes, y, _ = fitted(known_share=1.1)
    for v, c, above, own in itertools.product(range(5), (0, 1), (0, 1), (0, 1)):
        over = votes[:, m.parent[v]] if m.parent[v] >= 0 else np.zeros(len(y), int)
        count = lambda a, o: np.sum((y == c) & (over == a) & (votes[:, v] == o))  # noqa: E731, B023
        marginal = [count(0, o) + count(1, o) + 0.5 for o in (0, 1)]
        want = (count(above, own) + 2 * marginal[own] / sum(marginal)) / (count(above, 0) + count(above, 1) + 2)
        assert m.table[v][c][above][own] == pytest.approx(want, rel=1e-9)


def test_scores_are_the_sum_of_weights_written_out():
    names = ["wvile", "4vile", "5gronk", "wgronkly"]
    model = toxicity.Model({toxicity.hashed(n): i for i, n in enumerate(names)}, np.array([2, 5, 8, 2]), np.array([0.5, 0.25, 1.5, -0.75, 2.0, 1.0, 3.0, -2.0]))
    for text in ("", "a vile thing", "gronkly gronkest VILE", "you are such an idiot", "you are nice, an idiot said", "vilely " * 50):
        words = re.findall(r"\w+", text.lower())
        of = lambda w: {"w" + w, *(f"{n}{w[:n]}" for n in (4, 5, 6, 7) if len(w) >= n)}
        places = {i for w in words for i, n in enumerate(names) if n in of(w)}
        rude = [w for w in words if w in toxicity.LEXICON]
        share = sum(bool(of(w) & set(names)) for w in words) / max(1, len(words))
        z = sum(model.weight[i] for i in places) + 2.0 * bool(rude) + 1.0 * bool(rude and toxicity.ADDRESS.search(text.lower())) + 3.0 * share - 2.0
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9), text


def test_classifier_is_at_the_minimum_of_its_loss():
    rng = np.random.default_rng(3)
    model = toxicity.Model({i: i for i in range(6)}, np.zeros(6), np.zeros(10))
    rows = [(np.flatnonzero(rng.random(6) < 0.4), int(rng.integers(0, 4)), float(rng.random())) for _ in range(300)]
    target = np.clip(rng.random(300) * 0.5 + np.array([0.5 * (0 in p) for p, _, _ in rows]), 0, 1)
    x = np.array([[*(i in p for i in range(6)), v & 1, v >> 1 & 1, s, 1.0] for p, v, s in rows], float)

    def loss(w):
        z = x @ w
        return np.sum(np.log1p(np.exp(z)) - target * z) + 0.01 * np.sum(w[:-1] ** 2)

    w = toxicity.fit_linear(model, rows, target, rounds=4000)
    best = loss(w)
    assert all(loss(w + d * np.eye(10)[i]) > best - 1e-4 for i in range(10) for d in (0.05, -0.05))


def test_the_shortcut_is_proven_by_the_models_settings():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")).serialized_model_proto()
    assert tokens.rewrites_nothing(model)
    assert tokens.whole_tokens(tokenizer_path("piece_bpe_32k.model"))[1]
    field = lambda n, kind, body: bytes([n << 3 | kind]) + body
    message = lambda n, body: field(n, 2, bytes([len(body)]) + body)
    kept = field(4, 0, b"\0")
    assert tokens.rewrites_nothing(message(3, kept))
    assert not tokens.rewrites_nothing(message(3, message(2, b"map") + kept))
    assert not tokens.rewrites_nothing(message(3, field(3, 0, b"\0") + kept))
    assert not tokens.rewrites_nothing(message(3, b"")) and not tokens.rewrites_nothing(b"")


def test_slots_of_a_row_that_repeats(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_GROUP_ROWS", 20)
    rows = [(7, "the same")] * 900 + [(None, "none")] * 300 + [(i, f"t{i}") for i in range(600)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
