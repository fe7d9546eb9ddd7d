"""The training-data operators against brute force, round trips and held-out labels."""

import collections
import gzip
import hashlib
import io
import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from oriel.llm import components, embeddings, idfile, mixing, sharding, simhash, suffixes, tiling, tokens, toxicity, warc
from oriel.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
CASES = [None, "", " ", "  a", "word", "x y z", "Ünï çödé  words", "<|endoftext|> <s>", "a" * 5000, "tie", "tie", "\t\n", "it's we'll 'tis", "▁ mark", "中文 text", "\x00 nul"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, ties, repeated rows, and columns whose names clash."""
    rows = [(i, t, "s" if i % 3 else None, i, "c") for i, t in enumerate(CASES)] + [(None, "no id", "s", 1, "c"), (9, "tie", "s", 9, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, score string")


def test_token_ids_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for mode in ("byte", "bit"):
        got = idfile.roundtrip(odd, tokenizer_path("byte_bpe_50k.json"), mode=mode).collect()
        key = lambda r: (r.doc_id is not None, r.doc_id or 0)
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r.doc_id for r in sorted(got, key=key)]
        want = collections.Counter()
        for r in odd.collect():
            ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            want[r.doc_id, len(ids), zlib.crc32(ids)] += 1
        assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert idfile.roundtrip(odd.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for n, mode in itertools.product((1, 7, 8, 1000), ("bit", "byte")):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert (idfile.from_planes(idfile.to_planes(ids, mode), n, mode) == ids).all()


def test_token_counts(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = tokens.count_tokens(odd, tokenizer_path("piece_bpe_32k.model"), limit=3).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in odd.collect())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)


def test_ids_of_random_text_are_the_librarys():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    pool = [*"ab sS'tredlmv 12\n\t  .!'", "é", "ß", "\xa0", "　", "中", "😀", "<|endoftext|>", "\x1c", "\x85", "٣", "'ll", "'re", "\r", "\x00"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(3000)]
    ids, n = tokens.ByteBpe(tokenizer_path("byte_bpe_50k.json")).encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shards(spark, odd):
    keys = [0, 1, 2, 10**12, -5, 2**63 - 1, *range(100, 400)]
    df = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_rows(df).collect()}
    assert got == {k: (jump(k % (1 << 64), 24), jump(k % (1 << 64), 25)) for k in keys}
    rows = sharding.shard_rows(odd).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_rows(odd.limit(0)).count() == 0


def test_mix_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["a", "b", None, "big", "big", "big"])) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = out.collect()
    total = sum(r.size for r in got)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(total)
    for s, (t, size) in targets.items():
        assert t <= 3 * size
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(t, rel=0.1)
    assert all(r.taken <= 3 * r.size for r in got)
    assert sorted((r.doc_id, r.taken) for r in out.collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.emit(out).count() == sum(r.copies for r in got)


def test_mix_odd_rows(spark, odd):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    body = "<p>é</p>" * 200
    rows = [(1, "http://a", body), (2, "http://b", body), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "nokey")]
    got = {r.page_id: r for r in warc.roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 7 and got[1].record_type == "revisit" and got[1].refers_to == 2
    assert {k for k, r in got.items() if r.record_type == "response"} == {2, 3, 4, 5, 6, None}
    assert all(got[k].payload_digest == hashlib.sha1((h or "").encode()).hexdigest() and got[k].payload_bytes == len((h or "").encode()) for k, _, h in rows)
    raw = b"".join(warc.record("response", i, "u", hashlib.sha1(b"x" * i).hexdigest(), i, b"x" * i, None) for i in range(40))
    for source in (gzip.compress(raw), b"".join(gzip.compress(raw[i : i + 999]) for i in range(0, len(raw), 999))):
        sink = io.BytesIO()
        index = list(warc.normalise(io.BytesIO(source), sink))
        assert len(index) == 40 and gzip.decompress(sink.getvalue()) == raw
    with pytest.raises(ValueError, match="cut short"):
        list(warc.normalise(io.BytesIO(gzip.compress(raw[:-200])), io.BytesIO()))


def test_tiles_cover_reordered_passages(spark, odd):
    rng = random.Random(5)
    item = [f"w{i}" for i in range(40)]
    clean = " ".join(f"v{rng.randint(0, 99)}" for _ in range(300))
    docs = [(1, clean), (2, clean + " " + " ".join(item)), (3, " ".join(item[20:]) + " zz " + clean + " " + " ".join(item[:20])), (4, " ".join(item[:12])), (5, None), (6, "")]
    bench = spark.createDataFrame([(7, " ".join(item).upper()), (8, "w1 w2"), (9, None)], "item_id long, text string")
    got = tiling.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.covered, r.tiles) for r in got) == [(2, 7, 40, 1), (3, 7, 40, 2)]
    assert tiling.contaminated(odd, bench).count() == 0 and tiling.contaminated(odd, bench.limit(0)).count() == 0
    assert tiling.decontaminate(odd, bench).count() == odd.count()


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 24))
    vectors = [b + rng.standard_normal(24) * s for b in base for s in (0, 0.05, 0.2, 0.35)] + [base[0]] * 5 + [base[1] * 1e-200]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [None] * 24), (1005, [float("inf")] + [1.0] * 23), (1006, [1.0, 2.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")).collect()}
    x = np.array(vectors[:-1])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    root = components.local_roots(len(x), *np.nonzero(np.triu(close)))
    have = sum(got[i][0] for i in range(len(x)))
    assert 0.99 * close.sum() <= have <= close.sum() + 2 * len(x)
    assert np.mean([got[i][1] == root[i] for i in range(len(x))]) > 0.97
    assert all(got[k] == (0, k, True) for k, _ in bad)


def test_connected(spark):
    rng = random.Random(8)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(30)] + [(5, 5)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for a, b in pairs for x in (a, b) if a != b}}


def test_masks_cover_radius_three():
    masks = simhash.covering_masks()
    assert all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a, b, c in itertools.combinations(range(64), 3))


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def test_simhash_groups(spark, odd):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(150)) for _ in range(12)]
    texts = base + [b.replace(b.split()[75], "changed", 1) for b in base] + base[:3] + [None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fp = [plain_fingerprint(t) for t in texts]
    left, right = zip(*[(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3], strict=True)
    root = components.local_roots(len(fp), np.array(left), np.array(right))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(df).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in range(len(fp))}
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == odd.count() and all(r.component_id is None for r in rows if r.doc_id is None)
    assert simhash.near_groups(odd.limit(0)).count() == 0


def brute_repeats(rows, n=400):
    count = collections.Counter()
    bodies = [(t or "").encode() for _, t in rows]
    for b in bodies:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for (k, _), b in zip(rows, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeated_bytes(spark, monkeypatch):
    rng = random.Random(3)
    syllables = ["alpha", "beta", "gam", "de", "eps", "zet", "ét", "th", "iota"]
    prose = lambda n: " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(n))
    passages = [prose(90) for _ in range(4)]
    texts = [prose(rng.randint(1, 300)) for _ in range(20)]
    texts += [prose(rng.randint(0, 60)) + " " + rng.choice(passages)[rng.randint(0, 200) :][: rng.randint(380, 600)] + " " + prose(rng.randint(0, 40)) for _ in range(20)]
    texts += ["In. " * 400, "In. " * 130, "x" * 1500, texts[3], texts[3], "", None, texts[30] + texts[31], "é" * 300]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(brute_repeats(rows), key=key)
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect()), key=key) == want
    monkeypatch.setattr(suffixes, "CONTENTS", 3)  # divide grams by offset
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect()), key=key) == want
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_toxicity_held_out(spark, odd):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        t = rng.choices(words, k=60)
        y = int(rng.random() < 0.25)
        if y:
            t[5] = rng.choice(["idiot", "gronkly", "gronkest", "vexling"])
        rows.append((i, " ".join(t)))
        labels.append((i, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    y = dict(labels)
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    assert toxicity.score(odd, model).where(F.col("score").between(0, 1)).count() == odd.count()
    assert toxicity.toxicity(odd, lab.limit(0)).count() == odd.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in p.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert 0 < docs.count() <= 3 * n
    last = p.STAGES[4][1](spark, docs, SF)
    assert last.count() == docs.count()
