"""The near-duplicate stage against brute-force Jaccard similarity of 5-word shingles."""

import random
from fractions import Fraction

import numpy as np

import corpus_pipeline
from oriel.llm import components, jaccard
from tests.llm.test_llm import plain_fingerprint


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_roots(texts):
    sets = [plain_set(t) for t in texts]
    alike = lambda a, b: a == b or bool(a | b) and Fraction(len(a & b), len(a | b)) >= Fraction(4, 5)
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if alike(sets[i], sets[j])]
    left, right = np.array(pairs).T
    return components.local_roots(len(sets), left, right), pairs


def corpus(seed=3):
    """Texts of 3 to 400 words and edited copies of them at similarities on both sides of 0.8, exact copies, chains and short ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e"]
    for n in (3, 8, 20, 45, 60, 90, 150, 400):
        for _ in range(5):
            base = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (0, 1, max(1, n // 60), max(1, n // 45), n // 30):
                base = list(base) if rng.random() < 0.5 else texts[-1].split()
                for _ in range(edits):
                    base[rng.randrange(len(base))] = rng.choice(words)
                texts.append(" ".join(base))
    texts += [" ".join(f"c{i}" for i in range(40)), " ".join(f"c{i}" for i in range(36))]  # 32 of 36, above 0.8
    texts += [" ".join(f"d{i}" for i in range(24)), " ".join(f"d{i}" for i in range(20))]  # 16 of 20, exactly 0.8
    rng.shuffle(texts)
    return texts


def test_stage_keeps_what_brute_force_keeps(spark):
    texts = corpus()
    root, pairs = plain_roots(texts)
    fps = [plain_fingerprint(t or "") for t in texts]
    assert sum((fps[i] ^ fps[j]).bit_count() > 3 for i, j in pairs) > 20  # pairs that the fingerprints of query 10 miss
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert got == [i for i, r in enumerate(root) if r == i]


def test_large_clusters_are_compared_whole_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    texts = corpus(5)
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, t string").fillna("").selectExpr("0L as cluster", "row", "t")
    links = jaccard.set_links(rows).collect()
    sets = [plain_set(t) for t in texts]
    assert all(5 * len(sets[r.a] & sets[r.b]) >= 4 * len(sets[r.a] | sets[r.b]) for r in links if sets[r.a] | sets[r.b])
    joined = components.local_roots(len(texts), np.array([r.a for r in links]), np.array([r.b for r in links]))
    assert (joined == plain_roots(texts)[0]).all()


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    root, _ = plain_roots([t for _, t in rows])
    got = sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert got == [d for i, (d, _) in enumerate(rows) if root[i] == i]


def test_stage_keeps_one_row_of_each_group_whatever_the_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, a), (7, a), (7, b), (9, b + " more"), (1, "once"), (1, "once"), (1, "other words"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    want = [(None, a), (1, "once"), (1, "other words"), (3, a), (7, b)]
    assert sorted(got, key=str) == sorted(want, key=str)
