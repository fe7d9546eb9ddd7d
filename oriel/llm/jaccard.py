"""Groups of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of the sets and MinHash bands propose, an exact comparison of the sets decides. The covering masks
of ``simhash`` find every pair within 3 bits; but at a similarity of 0.8 some 10 of 64 bits differ, and to cover those
would take over a million masks, so the bands find the others. Texts that meet, directly or through others, form a cluster; every text goes to its cluster
once (to each pair of blocks, where a cluster is large), and there all pairs that aren't joined yet are compared. Clusters
are dealt by ids and sizes alone; a text moves only if it has a cluster, however many others there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm import simhash
from oriel.llm.common import looked_up, prepare, string_buffer
from oriel.llm.components import connected
from oriel.session import materialise, release

WIDTH = 5
#: Least similarity as a fraction: 4 of 5.
LEAST = (4, 5)
#: Hashes in a band, and bands: a pair exactly at 0.8 shares no band with a chance of (1 - 0.8 ** 5) ** 35, 1 in a million.
ROWS, BANDS = 5, 35
#: Texts, and bytes of text, in a block of a cluster; larger clusters are compared as pairs of blocks.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Shingles hashed at once.
PIECE = 512

_rng = np.random.default_rng(42)
_FLIP, _TIMES = _rng.integers(0, 1 << 64, (2, ROWS * BANDS), np.uint64, endpoint=False)
_TIMES |= np.uint64(1)
_PLACES = _rng.integers(0, 1 << 64, 64, np.uint64, endpoint=False) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's word shingles; a shorter text is one shingle, one without words none."""
    words = text.lower().split()  # as in simhash: of bytes, A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += h[i : i + n] * _PLACES[i]
    return np.unique(mix(total))


def band_keys(members: np.ndarray) -> np.ndarray:
    """One key a band; the band's number is part of it."""
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for i in range(0, len(members), PIECE):
        np.minimum(least, ((members[i : i + PIECE, None] ^ _FLIP) * _TIMES).min(0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys ^ column)
    return keys


def majority(members: np.ndarray) -> int:
    """The set's SimHash fingerprint: bits that more than half of its hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(members), 1 << 16):
        ones += np.unpackbits(members[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(members)).view(">i8")[0])


def sketches(rows: DataFrame, text: str, width: int = WIDTH) -> DataFrame:
    """(row, same, fp, size, keys): ``same`` is equal for equal sets, size in bytes; texts without words have no keys. Nulls count as empty."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = string_buffer(batch.column(1))
            same, fps, keys = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                members = shingles(raw[a:b].tobytes(), width)
                same.append(xxhash.xxh128_digest(members.tobytes()))
                fps.append(majority(members))
                keys.append(band_keys(members).view(np.int64) if len(members) else np.zeros(0, np.int64))
            offsets = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(fps, pa.int64()), pa.array(np.diff(ends), pa.int64()), lists], names=["row", "same", "fp", "size", "keys"])

    return rows.select("_row", F.col(text).cast("string")).mapInArrow(run, "row long, same binary, fp long, size long, keys array<long>")


def close_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places (i, j), i of ``left`` and j of ``right``, that join all sets of similarity 0.8 or more; all pairs count.

    Pairs already joined are left out, and those whose sizes alone are too different.
    """
    part, whole = LEAST
    size = np.array([len(s) for s in sets])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.append(0, np.cumsum(size))
    own = [number[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    mark = np.zeros(int(number.max(initial=-1)) + 1, bool)
    group = np.arange(len(sets))
    for i in left:
        fits = (size[right] * whole >= size[i] * part) & (size[i] * whole >= size[right] * part) & (group[right] != group[i])
        some = right[fits]
        if not len(some):
            continue
        mark[own[i]] = True
        for j in some:
            if group[j] != group[i]:
                both = np.count_nonzero(mark[own[j]])
                if both * whole >= part * (size[i] + size[j] - both):
                    group[group == group[j]] = group[i]
                    yield int(i), int(j)
        mark[own[i]] = False


def set_links(members: DataFrame, width: int = WIDTH) -> DataFrame:
    """Links (a, b) between the rows of (cluster, row, t): enough to join all pairs of similarity 0.8 or more in a cluster."""
    return compared(members.join(blocks(members.select("cluster", F.octet_length("t").alias("size"))), "cluster"), width)


def blocks(members: DataFrame) -> DataFrame:
    """(cluster, parts): the blocks that the members (cluster, size) of each cluster are dealt to."""
    return members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("parts"))


def compared(members: DataFrame, width: int = WIDTH) -> DataFrame:
    """``set_links`` of (cluster, row, parts, t)."""
    placed = members.withColumn("own", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "row", "t")
    placed = placed.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")

    def links_of(held: list[tuple[int, int, np.ndarray]], lo: int, hi: int):
        own = np.array([h[0] for h in held])
        left, right = (np.flatnonzero(own == lo), np.flatnonzero(own == hi))
        found = list(close_sets([h[2] for h in held], left, right)) if len(held) > 1 and len(left) and len(right) else []
        if found:
            ids = np.array([h[1] for h in held])
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            cluster, lo, hi, own, row = (batch.column(i).to_pylist() for i in range(5))
            raw, ends = string_buffer(batch.column(5))
            for i in range(batch.num_rows):
                if at != (cluster[i], lo[i], hi[i]):
                    if at:
                        yield from links_of(held, at[1], at[2])
                    at, held = (cluster[i], lo[i], hi[i]), []
                held.append((own[i], row[i], shingles(raw[ends[i] : ends[i + 1]].tobytes(), width)))
        if at:
            yield from links_of(held, at[1], at[2])

    return placed.mapInArrow(run, "a long, b long")


def groups(rows: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """(row, component): for each ``_row`` of ``rows`` the smallest ``_row`` that its text is linked to, itself included.

    ``rows`` is a written table of ``numbered``. Equal sets are one class, those of texts without words too; a class
    costs one row in the search.
    """
    sketched = materialise(sketches(rows, text, width), "sketches")
    classes = materialise(sketched.groupBy("same").agg(F.min("row").alias("id"), F.first("fp").alias("fp"), F.max("size").alias("size"), F.first("keys").alias("keys")), "classes")
    keyed = classes.select("id", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    prints = materialise(classes.where(F.size("keys") > 0).groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "prints")
    equal = classes.where(F.size("keys") > 0).select("fp", F.col("id").alias("b")).join(prints.where("n > 1").select("fp", F.col("id").alias("a")), "fp").select("a", "b")
    met = keyed.join(heads, "key").select("a", F.col("id").alias("b")).union(equal).union(simhash.bucket_links(prints.select("fp", "id")))
    clusters = connected(met).select(F.col("component").alias("cluster"), F.col("node").alias("id"))
    sized = materialise(clusters.join(classes.select("id", "size"), "id"), "clusters")
    dealt = sized.join(blocks(sized), "cluster").select(F.col("id").alias("_row"), "cluster", "parts")
    members = looked_up(rows.select("_row", text), dealt, "at").where("at is not null")
    members = members.select("at.cluster", F.col("_row").alias("row"), F.col("at.parts").cast("int").alias("parts"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    joined = connected(compared(members, width))
    of = classes.join(joined.select(F.col("node").alias("id"), "component"), "id", "left").select("same", F.coalesce("component", "id").alias("component"))
    found = materialise(sketched.join(of, "same").select("row", "component"), "groups")
    release(sketched, classes, prints, sized)
    return found
