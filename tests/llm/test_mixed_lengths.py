"""Vectors of lengths whose XOR is small, mixed in one table, against brute force."""

import numpy as np
import pytest

from oriel.llm import embeddings


@pytest.mark.parametrize("meet", [256, 4])
def test_links_among_mixed_lengths(spark, monkeypatch, meet):
    monkeypatch.setattr(embeddings, "MEET", meet)
    rng = np.random.default_rng(0)
    rows = []
    for width, groups in ((64, 100), (65, 100)):
        for _ in range(groups):
            base = rng.standard_normal(width)
            rows += [base + 0.05 * rng.standard_normal(width) for _ in range(3)]
    rows = [(i, r.tolist()) for i, r in enumerate(rows)]
    want = {}
    for width in (64, 65):
        ids = [i for i, r in rows if len(r) == width]
        x = embeddings.units(np.array([r for _, r in rows if len(r) == width]))
        want |= dict(zip(ids, ((x @ x.T >= 0.9).sum(1) - 1).tolist(), strict=True))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()} == want
