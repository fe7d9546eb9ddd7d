"""Exact removal of byte strings that repeat anywhere in the corpus, by sorting sampled suffixes.

Every window of ``length`` bytes has an anchor: the leftmost of its smallest hashed grams. Equal windows have
equal anchors at equal offsets, so windows need comparing only with those of the same anchor gram. Windows in
a row that share an anchor form a segment, and a corpus has one segment for some 200 bytes of text.

1. Segments of all texts, as hashes: grams seen once can't repeat and go.
2. Of a gram whose segments are all equal, every window repeats (copies end here, unexpanded).
3. Of the other grams, one segment of each content is fetched; their suffixes are range-partitioned by leading
   bytes at sampled splitters, and each bucket sorts its windows by multikey quicksort: by anchor and offset,
   then by one block of bytes after the other, going on only with runs of equal ones. A run that is left after
   the last block is checked byte by byte. Equal windows have equal leading bytes at their anchor, so a
   splitter never falls between them. Windows of a gram with very many contents aren't sorted: they are counted
   by 128-bit hashes, which combine on the map side.

A content hash of 64 bits is compared among segments of one 64-bit gram alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import prepare, string_buffer, text_or_empty
from oriel.session import materialise, release

LENGTH = 400
GRAM = 32
#: Windows of a long text worked on at once; a text is cut there, segments too, which costs no match.
PIECE = 1 << 19
#: Contents of a gram that are sorted in one group; windows of grams with more are counted by hash.
CONTENTS = 2000
#: Windows sorted at once in a task, or one group's.
BATCH_WINDOWS = 1 << 18
SORT_BLOCK = 80
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(raw: bytes) -> np.ndarray:
    """Hashes of all ``GRAM``-byte strings of ``raw``."""
    n = len(raw) - GRAM + 1
    words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = words[:n] * M1
    for j in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += words[j : j + n]
        h *= M2
    h ^= h >> np.uint64(32)
    h *= M1
    return h ^ (h >> np.uint64(29))


def segments(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor's offset from start, gram hash, content hash) of each segment of a text."""
    out = []
    for first in range(0, max(0, len(raw) - length + 1), PIECE):
        piece = raw[first : first + PIECE + length - 1]
        h = gram_hashes(piece)
        low = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
        span, done = length - GRAM + 1, 1
        while done * 2 <= span:
            low, done = np.minimum(low[:-done], low[done:]), done * 2
        if span > done:
            low = np.minimum(low[: len(low) - (span - done)], low[span - done :])
        cut = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        size = np.diff(np.append(cut, len(low)))
        at = (low[cut] & np.uint64(0xFFFFF)).astype(np.int64)
        view, digest = memoryview(piece), xxhash.xxh3_64_intdigest
        content = np.array([digest(view[s : s + n + length - 1], x - s) for s, n, x in zip(cut.tolist(), size.tolist(), at.tolist(), strict=True)], dtype=np.uint64)
        out.append((cut + first, size, at - cut, h[at], content))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def repeated_windows(raw: np.ndarray, start: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows (first bytes ``start`` in ``raw``) have an equal one in their group, by multikey quicksort."""
    powers = np.cumprod(np.full(len(raw) + 1, M1))
    inverse = np.cumprod(np.full(len(raw) + 1, np.uint64(pow(int(M1), -1, 1 << 64))))
    spread = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)[raw] * powers[: len(raw)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread)])
    live, run = np.arange(len(start)), group.astype(np.int64)
    for depth in range(0, length, SORT_BLOCK):
        a = start[live] + depth
        b = np.minimum(a + SORT_BLOCK, start[live] + length)
        symbol = (sums[b] - sums[a]) * inverse[a]
        order = np.lexsort((symbol, run))
        live, run, symbol = live[order], run[order], symbol[order]
        new = np.append(True, (run[1:] != run[:-1]) | (symbol[1:] != symbol[:-1]))
        run = np.cumsum(new)
        size = np.bincount(run)
        keep = size[run] > 1
        live, run = live[keep], run[keep]
        if not len(live):
            break
    found = np.zeros(len(start), bool)
    if not len(live):
        return found
    # the blocks were compared by hash: now each with the one before it, byte by byte
    windows = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.zeros(len(live), bool)
    for i in range(1, len(live), 4096):
        j = min(i + 4096, len(live))
        same[i:j] = (run[i:j] == run[i - 1 : j - 1]) & (windows[start[live[i:j]]] == windows[start[live[i - 1 : j - 1]]]).all(1)
    head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    odd = np.add.reduceat(~same, head) > 1  # a run of equal hashes with unequal bytes
    for r in np.flatnonzero(odd):
        part = slice(head[r], head[r + 1] if r + 1 < len(head) else len(live))
        own = live[part]
        _, which, count = np.unique(windows[start[own]], axis=0, return_inverse=True, return_counts=True)
        found[own[count[which.ravel()] > 1]] = True
    fine = ~odd[np.cumsum(np.append(True, run[1:] != run[:-1])) - 1]
    found[live[fine]] = True
    return found


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    return at[cut], at[np.append(cut[1:], len(at)) - 1]


def _fetched(batches: Iterator[pa.RecordBatch]):
    """Of batches of (text, its segments): the bytes, where each segment starts in them, and (gram, content, c, x, n)."""
    for batch in batches:
        raw, ends = string_buffer(batch.column(0))
        own = batch.column(1)
        count = np.diff(own.offsets.to_numpy())
        gram, content, c, s, x, n = (f.to_numpy() for f in own.flatten().flatten())
        at = np.repeat(ends[:-1], count) + s
        for i in range(0, len(at), 4096):
            part = slice(i, i + 4096)
            yield raw, at[part], tuple(v[part] for v in (gram, content, c, x, n))


def _hot_runs(texts: DataFrame, length: int) -> DataFrame:
    """(gram, content, lo, hi) of windows that repeat among very many contents of one gram.

    Each window is a row of 128 bits of hash, and those met twice are found by an aggregation that combines on the
    map side: no task holds a gram, and a third of the corpus may share one.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for raw, at, (gram, content, c, _, n) in _fetched(batches):
            for i in range(0, len(at), 256):
                part = slice(i, i + 256)
                m, start = n[part], at[part]
                rel = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                view = memoryview(raw)
                h = np.frombuffer(b"".join(digest(view[p : p + length]) for p in (np.repeat(start, m) + rel).tolist()), np.int64).reshape(-1, 2)
                names = ["gram", "content", "c", "lo", "h1", "h2"]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gram[part], m)), pa.array(np.repeat(content[part], m)), pa.array(np.repeat(c[part], m)), pa.array(rel.astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1])], names=names)

    # copies of a row fetch a segment several times
    windows = materialise(texts.mapInArrow(digests, "gram long, content long, c long, lo int, h1 long, h2 long").dropDuplicates(["gram", "content", "lo"]), "windows")
    again = materialise(windows.groupBy("h1", "h2").agg(F.count("*").alias("k")).where("k > 1").select("h1", "h2"), "again")
    found = windows.where("c = 1").join(again, ["h1", "h2"]).groupBy("gram", "content").agg(F.sort_array(F.collect_list("lo")).alias("lo"))
    heads = F.filter("lo", lambda v: ~F.array_contains("lo", v - 1))
    tails = F.filter("lo", lambda v: ~F.array_contains("lo", v + 1))
    return found.select("gram", "content", F.explode(F.arrays_zip(heads.alias("lo"), tails.alias("hi"))).alias("r")).select("gram", "content", "r.lo", "r.hi")


def repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, hash, start, end): byte spans of windows that start anywhere else too; doc and hash name the text."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long")).alias("doc"), F.xxhash64(text_or_empty(text)).alias("hash"), text_or_empty(text).alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = string_buffer(batch.column(2))
            parts, owner = [], []
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if b - a >= length:
                    parts.append(segments(raw[a:b].tobytes(), length))
                    owner.append(np.full(len(parts[-1][0]), i))
            if parts:
                s, n, x, gram, content = (np.concatenate(c) for c in zip(*parts, strict=True))
                at = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(s, pa.int64()), pa.array(n.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["doc", "hash", "s", "n", "x", "gram", "content"],
                )

    found = materialise(rows.mapInArrow(cut, "doc long, hash long, s long, n int, x int, gram long, content long"), "segments")
    grams = found.groupBy("gram").agg(F.count("*").alias("c"), (F.min("content") != F.max("content")).alias("mixed")).where("c > 1").drop("c")
    # a table of its own: with both sides exchanged for the join alone, adaptive execution may split a hot gram
    grams = materialise(grams, "grams")
    seen = materialise(found.join(grams, "gram"), "repeated")
    whole = seen.where("not mixed").select("doc", "hash", F.col("s").alias("start"), (F.col("s") + F.col("n") - 1 + length).alias("end"))

    mixed = seen.where("mixed")
    contents = mixed.groupBy("gram", "content").agg(F.count("*").alias("c"), F.min(F.struct("doc", "hash", "s", "n", "x")).alias("at"))
    contents = materialise(contents.select("gram", "content", "c", "at.*"), "contents")
    # a table of its own, again: there is at most one such gram for CONTENTS rows of contents
    hot = materialise(contents.groupBy("gram").agg(F.count("*").alias("k")).where(F.col("k") > CONTENTS).select("gram"), "hot")

    def of_texts(part: DataFrame) -> DataFrame:
        """(t, own): each text with the segments that are fetched from it, so that it is sent and decoded once."""
        own = part.groupBy("doc", "hash").agg(F.collect_list(F.struct("gram", "content", "c", "s", "x", "n")).alias("own"))
        return rows.join(own, ["doc", "hash"]).select("t", "own")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, at, (gram, content, c, x, n) in _fetched(batches):
            piece = pa.array([raw[i : i + k + length - 1].tobytes() for i, k in zip(at.tolist(), n.tolist(), strict=True)], pa.binary())
            lead = pa.array([raw[i : i + GRAM].tobytes() for i in (at + x).tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(content), pa.array(c), pa.array(x), pa.array(n), piece, lead], names=["gram", "content", "c", "x", "n", "bytes", "lead"])

    fetched = of_texts(contents.join(hot, "gram", "left_anti")).mapInArrow(cut_out, "gram long, content long, c long, x int, n int, bytes binary, lead binary")
    ordered = fetched.repartitionByRange("lead", "gram").sortWithinPartitions("lead", "gram", "content").drop("lead")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            gram, content, c, x, n = (t.column(i).to_numpy() for i in range(5))
            raw, ends = string_buffer(t.column(5).chunk(0))
            # copies of a row (equal keys and texts) fetch a segment several times
            own = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])))
            row = np.repeat(own, n[own])
            rel = np.arange(len(row)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
            group = np.cumsum(np.append(True, gram[1:] != gram[:-1]))[row] * np.int64(1024) + (x[row] - rel)
            again = repeated_windows(raw, ends[row] + rel, group, length)
            again &= c[row] == 1  # of other contents every window repeats anyway
            code = np.flatnonzero(again)
            if len(code):
                lo, hi = _runs(row[code].astype(np.int64) * 4096 + rel[code])
                r = lo // 4096
                yield pa.RecordBatch.from_arrays([pa.array(gram[r]), pa.array(content[r]), pa.array((lo % 4096).astype(np.int32)), pa.array((hi % 4096).astype(np.int32))], names=["gram", "content", "lo", "hi"])

        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            cut_at = np.append(0, np.flatnonzero(gram[1:] != gram[:-1]) + 1)
            size = np.add.reduceat(batch.column(4).to_numpy(), cut_at)
            begin = 0
            for i, (at, n) in enumerate(zip(cut_at.tolist(), size.tolist(), strict=True)):
                joins = i == 0 and held and held[-1].column(0)[-1].as_py() == gram[0]
                if waiting and waiting + n > BATCH_WINDOWS and not joins:
                    if at > begin:
                        held.append(batch.slice(begin, at - begin))
                    yield from flush()
                    held.clear()
                    waiting, begin = 0, at
                waiting += n
            held.append(batch.slice(begin))
        if held:
            yield from flush()

    sorted_runs = ordered.mapInArrow(sort, "gram long, content long, lo int, hi int")
    if not hot.isEmpty():
        sorted_runs = sorted_runs.union(_hot_runs(of_texts(contents.join(hot, "gram")), length))
    twice = contents.where("c > 1").select("gram", "content", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))
    runs = materialise(sorted_runs.union(twice), "runs")
    release(found, contents, hot)
    some = mixed.join(runs, ["gram", "content"]).select("doc", "hash", (F.col("s") + F.col("lo")).alias("start"), (F.col("s") + F.col("hi") + length).alias("end"))
    return whole.union(some)


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row.

    Each byte covered by a ``length``-byte string that also starts anywhere else, in the same text or another,
    is removed; strings are judged on the input, and overlaps count. Nulls are empty texts; texts shorter than
    ``length`` are kept whole; rows with equal or null keys each have a result, and equal rows are copies of
    one another. ``kept`` (binary) holds the remaining bytes. Other columns are dropped.
    """
    spans = materialise(repeats(docs, length, key, text).groupBy("doc", "hash").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long")).alias("doc"), F.xxhash64(text_or_empty(text)).alias("hash"), text_or_empty(text).alias("t"))
    joined = rows.join(spans, ["doc", "hash"], "left").select("k", "t", F.transform("spans", lambda x: x["start"]).alias("a"), F.transform("spans", lambda x: x["end"]).alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = string_buffer(batch.column(1))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                own = raw[ends[i] : ends[i + 1]]
                removed = spans_here = 0
                if batch.column(2)[i].is_valid:
                    a, b = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.append(True, a[1:] > b[:-1])
                    a, b = a[new], b[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
                    removed, spans_here = int((b - a).sum()), len(a)
                    own = np.concatenate([own[p:q] for p, q in zip(np.append(0, b), np.append(a, len(own)), strict=True)])
                kept = own.tobytes()
                out.append((len(raw[ends[i] : ends[i + 1]]), removed, spans_here, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            columns = list(zip(*out, strict=True)) or [()] * (5 if with_text else 4)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns) + 1])

    return joined.mapInArrow(cut, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text).withColumnRenamed("k", key)
