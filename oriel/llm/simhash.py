"""SimHash fingerprints and covering locality-sensitive hashing of them.

Covering masks for radius r: give each of the 64 bits a nonzero vector of r + 1 bits. For each nonzero vector v
of that length there is a table whose key keeps the bits whose vector has an odd product with v. Any r bits
have vectors that span at most r dimensions, so some v is orthogonal to all of them: two fingerprints that
differ in those bits only have the same key in v's table. No pair within the radius is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import prepare, string_buffer
from oriel.llm.components import connected, local_roots
from oriel.session import materialise

RADIUS = 3
#: Fingerprints of a bucket that are compared in one task; larger buckets are divided, see ``bucket_links``.
DENSE = 4096
#: Shingles hashed at once; counts are added up over a text's pieces.
PIECE = 1 << 16


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2 ** (radius + 1) - 1 masks; every pair of words within ``radius`` bits agrees under one of them."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text's word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(size + 1) - size - 1
    n = max(1, len(words) - width + 1)
    last = np.minimum(np.arange(n) + width, len(words)) - 1
    begin, end = starts[:n].tolist(), (starts[last] + size[last]).tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, PIECE):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(begin[i : i + PIECE], end[i : i + PIECE], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long. Nulls count as empty texts."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = string_buffer(batch.column(1))
            fps = np.array([fingerprint(raw[a:b].tobytes(), width) for a, b in zip(ends[:-1], ends[1:], strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", key)


def close_pairs(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all pairs of ``left`` x ``right`` (places in ``fps``) within ``radius`` bits: a forest, not the pairs."""
    root = np.arange(len(fps))
    for i in range(0, len(left), 512):
        at = left[i : i + 512]
        r, c = np.nonzero(np.bitwise_count(fps[at, None] ^ fps[None, right]) <= radius)
        new = root[at[r]] != root[right[c]]
        if new.any():
            root = local_roots(len(fps), np.append(np.arange(len(fps)), at[r[new]]), np.append(root, right[c[new]]))
    node = np.flatnonzero(root != np.arange(len(root)))
    return root[node], node


def bucket_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the ids of (fp, id) rows with distinct fp: enough to join all pairs within ``radius``.

    Each bucket gives a forest, fewer links than members, not its pairs. A bucket of more than ``DENSE`` is
    divided before it reaches a task: by each of radius + 1 groups of the bits that its key leaves out, one of
    which is equal in any close pair; what is still larger is dealt to pairs of blocks.
    """
    masks = covering_masks(radius)
    free = [[i for i in range(64) if not m >> i & 1] for m in masks]
    shares = F.array(*[F.array(*[F.lit(signed(sum(1 << i for i in f[part :: radius + 1]))) for part in range(radius + 1)]) for f in free])
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)]))
    rows = classes.select("fp", "id", keys.alias("x")).select("x.t", "x.key", "fp", "id")
    # tables of their own: their size is known, and one row stands for more than DENSE fingerprints
    large = materialise(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).select("t", "key"), "large")
    none = F.lit(0)
    small = rows.join(large, ["t", "key"], "left_anti").select("t", "key", F.lit(-1).alias("part"), none.cast("long").alias("bits"), none.alias("lo"), none.alias("hi"), none.alias("own"), "fp", "id")
    if large.isEmpty():
        parts = small
    else:
        divided = rows.join(large, ["t", "key"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(radius))))
        divided = divided.withColumn("bits", F.col("fp").bitwiseAND(shares[F.col("t")][F.col("part")]))
        place = ["t", "key", "part", "bits"]
        crowds = materialise(divided.groupBy(*place).agg(F.ceil(F.count("*") / DENSE).cast("int").alias("blocks")).where("blocks > 1"), "crowds")
        dealt = divided.join(crowds, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        parts = small.union(dealt.select(*place, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp", "id"))
    place = ["t", "key", "part", "bits", "lo", "hi"]
    placed = parts.repartition(*place).sortWithinPartitions(*place)

    def links_of(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        change = np.zeros(len(columns[0]) - 1, bool)
        for c in columns[:6]:
            change |= c[1:] != c[:-1]
        new = np.append(0, np.flatnonzero(change) + 1)
        ends = np.append(new[1:], len(columns[0]))
        lo, own, fp, ids = columns[4], columns[6], columns[7].view(np.uint64), columns[8]
        for a, b in zip(new[ends - new > 1], ends[ends - new > 1], strict=True):
            first = own[a:b] == lo[a]
            every = np.arange(b - a)
            left, right = (every, every) if first.all() else (every[first], every[~first])
            left, right = close_pairs(fp[a:b], left, right, radius)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][left], pa.int64()), pa.array(ids[a:b][right], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last group so far, of two blocks at most
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in range(9)]
            other = np.zeros(batch.num_rows, bool)
            for c in now[:6]:
                other |= c != c[-1]
            last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if last:
                yield from links_of([np.concatenate(x) for x in zip(*held, [c[:last] for c in now], strict=True)])
                held = []
            held.append([c[last:] for c in now])
        if held:
            yield from links_of([np.concatenate(x) for x in zip(*held, strict=True)])

    return placed.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = 3, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate groups: key, fingerprint (16 hex digits), component_id (smallest key reachable, itself included).

    Fingerprints within ``radius`` bits are linked. Texts without words (null, empty, blank) have the
    fingerprint 0 and are linked like others. Rows with equal keys count as one document that may have several
    fingerprints; a null key is linked to nothing and has a null component. Copies are one class, so a group
    of equal texts costs one row in the search. Other columns are dropped.
    """
    fps = materialise(fingerprints(docs, width, key, text).select(F.col(key).cast("long").alias("doc"), "fp"), "fps")
    known = fps.where("doc is not null")
    classes = materialise(known.groupBy("fp").agg(F.min("doc").alias("id")), "classes")
    # one id in several classes (repeated keys) links them too
    several = known.join(classes, "fp").where("doc <> id").select(F.col("id").alias("a"), F.col("doc").alias("b")) if _keys_repeat(known) else None
    links = bucket_links(classes, radius)
    joined = connected(links.union(several) if several is not None else links)
    member = joined.select(F.col("node").alias("id"), "component")
    of = classes.join(member, "id", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "id").alias("component_id"))
    out = fps.join(of, fps["fp"] == of["_fp"], "left")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("doc").alias(key), digits.alias("fingerprint"), F.when(F.col("doc").isNotNull(), F.col("component_id")).alias("component_id"))


def _keys_repeat(rows: DataFrame) -> bool:
    return not rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
