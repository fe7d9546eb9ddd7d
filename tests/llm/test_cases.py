"""Odd rows through every operator and pipeline stage, and the pipeline against a brute-force version."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest

from oriel.llm import embeddings, idfile, mixing, queries, sharding, simhash, suffixes, tiling, tokens, toxicity, warc
from tests.llm.test_jaccard import plain_roots

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [None, "", " \t\n", "one", "a tie", "a tie", "\x00 nul �", "日本語 テキスト", "x" * 20_000, LONG, "you are a pathetic idiot", "The same. " * 200]
NAMES = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, size long, shard int, fp long, component_id long, k string, t string, start long, hash long, _other long, copies int, rate double"


@pytest.fixture(scope="module")
def odd(spark):
    """All kinds of texts, null in every column, repeated rows and keys, and columns named like the operators' own."""
    row = lambda i, t: (i, t, None if i % 2 else "en", None if i % 3 == 0 else f"s{i % 3}", len(t or ""), 0.9, 1, 7, 3, 5, 1, "k", "t", 9, 8, i, 2, 0.5)
    rows = [row(i, t) for i, t in enumerate(TEXTS)]
    rows += [row(4, "a tie"), (None, "no id", *[None] * 16), (None, None, *[None] * 16)]
    return spark.createDataFrame(rows, NAMES)


OPERATORS = {
    "ids": lambda d: idfile.roundtrip(d, queries.tokenizer_path("byte_bpe_50k.json")),
    "shards": sharding.shard_rows,
    "counts": lambda d: tokens.count_tokens(d, queries.tokenizer_path("piece_bpe_32k.model")),
    "mix": mixing.mix,
    "repeats": suffixes.remove_repeats,
    "simhash": simhash.near_groups,
    "toxicity": lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([(10, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_operator_keeps_all_odd_rows(odd, name):
    assert OPERATORS[name](odd).count() == odd.count()
    assert OPERATORS[name](odd.limit(0)).count() == 0
    alone = odd.select("doc_id", "text", "source")
    assert sorted(map(repr, OPERATORS[name](odd).select("doc_id").collect())) == sorted(map(repr, alone.select("doc_id").collect()))


def test_tiles_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, LONG), (2, None), (3, ""), (None, "a tie"), (4, "same the same the same"), (4, "same the same the same")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in tiling.contaminated(odd, bench).collect()}
    assert (9, 1) in got and {d for d, _ in got} <= {9, 11}
    assert tiling.contaminated(odd.limit(0), bench).count() == 0


def test_archives_of_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "", "", "y"), (2, "u", "p" * 2000, "z"), (3, "u", "p" * 2000, "z"), (None, None, "p" * 2000, None), (4, "é\r\n", LONG, "w"), (1, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.roundtrip(df).collect())
    want = collections.Counter([(1, 0, "response", None), (1, 0, "response", None), (2, 0, "response", None), (2, 2000, "revisit", 3), (3, 2000, "response", None), (None, 2000, "revisit", 3), (4, len(LONG), "response", None)])
    assert got == want
    assert warc.roundtrip(df.limit(0)).count() == 0


def test_vectors_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (2, [0.99, 0.05], None), (None, [1.0, 0.0], 1), (3, [0.0, -0.0], 1), (4, [1e-30, 0.0], 1), (5, [3e38, 3e38], 1), (6, [None, 1.0], 1)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n_links int")
        got = embeddings.near_vectors(df).collect()
        assert len(got) == len(rows)
        by = {r.vec_id: r.n_links for r in got}
        assert by[3] == by[6] == by[5] == by[None] == 0 and by[2] == by[1] == by[4] == 3
    assert embeddings.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_each_stage_takes_odd_rows(spark, odd, stage):
    import corpus_pipeline as p

    name, f = p.STAGES[stage]
    out = f(spark, odd, SF)
    rows = out.collect()
    if stage < 4:
        assert out.columns == odd.columns and rows
        assert {r.text for r in rows} <= {r.text for r in odd.collect()}
    else:
        assert len(rows) == odd.count()
    assert f(spark, odd.limit(0), SF).count() == 0, name
    if stage == 1:
        assert sum(r.text == "a tie" for r in rows) <= 2 and sum(r.doc_id is None for r in rows) == 2
    if stage == 2:
        assert len(rows) == odd.count()


def plain_tiles(p, t, least=5, count=False):
    """Greedy string tiling as published: the longest match of unmarked words first, found by trying all."""
    mp, mt, covered, n = [False] * len(p), [False] * len(t), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return (covered, n) if count else covered
        mp[i : i + k], mt[j : j + k] = [True] * k, [True] * k
        covered += k
        n += 1


def plain_mix(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = collections.Counter()
    for d in docs:
        total[d["source"]] += size(d["text"])
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w > 3 * total[s]]
        if not full:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in full:
            target[s] = 3.0 * total[s]
            open_.remove(s)
        left = sum(total.values()) - sum(target.values())
    out = []
    for d in docs:
        rate = min(3.0, target[d["source"]] / total[d["source"]]) if total[d["source"]] else 0.0
        h = hashlib.md5(f"mix-1|{d['doc_id']}|{hashlib.md5((d['text'] or '').encode()).hexdigest()}".encode()).hexdigest()
        out += [d] * (math.floor(rate) + (int(h[:12], 16) / 2**48 < rate - math.floor(rate)))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    table = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    docs = [r.asDict() for r in table("documents").collect()]
    model = toxicity.train(table("documents"), table("labels"))
    docs = [d for d in docs if model.score(d["text"] or "") < 0.5]

    docs.sort(key=lambda d: d["doc_id"])
    root, _ = plain_roots([d["text"] for d in docs])
    docs = [d for i, d in enumerate(docs) if root[i] == i]

    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [w for r in table("benchmark").collect() if len(w := words(r.text)) >= 5]
    seeds = collections.defaultdict(set)
    for n, w in enumerate(items):
        for i in range(len(w) - 4):
            seeds[tuple(w[i : i + 5])].add(n)

    def leaks(t):
        w = words(t)
        near = {n for i in range(len(w) - 4) for n in seeds.get(tuple(w[i : i + 5]), ())}
        return any(plain_tiles(items[n], w) >= 0.6 * len(items[n]) for n in near)

    docs = plain_mix([d for d in docs if not leaks(d["text"])])
    tokenizer = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want, at = [], 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d["doc_id"], at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in p.run(spark, SF).collect())
    assert got == want
