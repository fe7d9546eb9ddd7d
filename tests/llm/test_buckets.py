"""What happens beyond a task's bounds: dense buckets, test sets of several blocks, and items with odd ids."""

import os
import re

import numpy as np
import pytest

from oriel.llm import components, queries, simhash, tiling
from tests.llm.test_cases import plain_tiles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("dense", [4096, 40, 2])
def test_links_of_dense_buckets(spark, monkeypatch, dense):
    """Fingerprints around a few centres, so that buckets are full; their components are those of all pairs."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(4)
    fps = []
    for centre in rng.integers(0, 1 << 63, 4, dtype=np.uint64):
        for _ in range(80):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.append(int(centre) ^ sum(1 << int(f) for f in flips))
    fps = np.unique(np.array([*fps, 0, 1, (1 << 64) - 1], np.uint64))
    left, right = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    want = components.local_roots(len(fps), left, right)
    classes = spark.createDataFrame(list(zip(fps.view(np.int64).tolist(), range(len(fps)), strict=True)), "fp long, id long")
    links = simhash.bucket_links(classes).collect()
    a, b = np.array([(r.a, r.b) for r in links]).T
    assert (want[a] == want[b]).all()
    assert (components.local_roots(len(fps), a, b) == want).all()


ITEM = "the quick brown fox jumps over the lazy dog while seven wise owls watch"
BENCH = [(7, ITEM), (7, "an other text under the same id that has words enough"), (7, ITEM), (8, ITEM), (None, "this one has no id at all but it leaks"), (9, "new york"), (10, "york"), (11, None), (12, ""), (13, "...")]
DOCS = [(1, f"zz {ITEM} zz"), (2, "An other text, under the same id, that has words enough!"), (3, "this one has no id at all but it leaks"), (4, "in new york city"), (5, "york new"), (6, None), (6, "nothing here"), (None, ITEM)]


@pytest.mark.parametrize("words", [2_000_000, 5])
def test_items_are_rows_whatever_ids_and_blocks(spark, monkeypatch, words):
    monkeypatch.setattr(tiling, "BLOCK_WORDS", words)
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    found = lambda **o: sorted([(r.doc_id, r.item_id, r.covered, r.tiles) for r in tiling.contaminated(docs, bench, **o).collect()], key=key)
    long_ones = [(1, 7, 14, 1), (1, 8, 14, 1), (2, 7, 11, 1), (3, None, 10, 1), (None, 7, 14, 1), (None, 8, 14, 1)]
    assert found() == sorted(long_ones, key=key)
    assert found(short_items=True) == sorted([*long_ones, (4, 9, 2, 1), (4, 10, 1, 1), (5, 10, 1, 1)], key=key)
    kept = lambda **o: sorted([tuple(r) for r in tiling.decontaminate(docs, bench, **o).collect()], key=lambda r: str(r))
    assert kept() == sorted([d for d in DOCS if d[0] in (4, 5, 6)], key=lambda r: str(r))
    assert kept(short_items=True) == sorted([d for d in DOCS if d[0] == 6], key=lambda r: str(r))
    assert tiling.decontaminate(docs.withColumnRenamed("doc_id", "_row"), bench).columns == ["_row", "text"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_op4_against_brute_force(spark):
    """All columns of the query, by tiling as published with each pair that shares five words in a row."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet").collect()
    items = [(r.item_id, words(r.text)) for r in read("benchmark")]
    runs = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in items}
    want = []
    for d in read("documents"):
        w = words(d.text)
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i, p in items:
            if runs[i] & own:
                covered, n = plain_tiles(p, w, count=True)
                if covered >= 0.6 * len(p):
                    want.append((d.doc_id, i, covered, len(p), covered / len(p), n))
    got = [(r.doc_id, r.item_id, r.covered, r.words, r.coverage, r.tiles) for r in queries.queries()["op4_benchmark_tiles"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and got
