"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import prepare
from oriel.llm.components import connected, local_roots
from oriel.session import materialise, release

#: Bucket width of a projection, in units of the distance between normalised vectors.
WIDTH = 2.5
#: Chance that a pair exactly at the threshold is in no common bucket of any table.
MISS = 1e-3
#: Rows that a vector may expect to meet by chance in one bucket. Each table ships the vectors, so larger buckets
#: (shorter keys, fewer tables) trade cheap products of matrices for dear shuffles: 12 tables at 50,000 rows, not 29.
MEET = 4096
#: Members of a bucket compared in one task group; larger buckets are divided into blocks, and all pairs of blocks.
BLOCK = 8192


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection puts two points at ``distance`` into one cell."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(projections per key, tables) for n vectors: keys selective for unrelated ones, tables enough for the recall."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(2 - 2 * threshold))
    k = max(1, math.ceil(math.log(max(n, MEET) / MEET) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


def units(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length 1; squares of tiny or huge components stay in range."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Rows are linked when they share a bucket of some table and their cosine in double precision is at least
    ``threshold``; a link is never made below it, and a pair exactly at it is missed with chance ``MISS`` or
    less. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
    null keys, and vectors of different lengths. Equal vectors are one class: they are counted, not paired.
    n_links counts other rows linked directly; a pair that meets in several tables counts in the first.
    Links are added up per block of a bucket and leave it as counts and a spanning forest. Other columns are
    dropped.
    """
    spark = vectors.sparkSession
    prepare(spark)
    element = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"  # as given: half the bytes on the wire
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{element}>").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.coalesce(finite & (square > 0), F.lit(False))
    rows = materialise(rows.withColumn("usable", usable), "vectors")
    classes = materialise(rows.where("usable").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
    k, tables = plan(classes.count(), threshold)
    rng_seed = seed
    # with a row in table t go the first halves of its keys in the tables before: a pair that met there was counted there
    earlier = np.concatenate([np.arange(t) for t in range(tables)]).astype(np.int64)
    flat_type = pa.float32() if element == "float" else pa.float64()

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            column = batch.column(0)
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            ends = np.append(0, np.cumsum(size))
            ids, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for width in np.unique(size):
                if width not in planes:
                    rng = np.random.default_rng([rng_seed, int(width)])
                    planes[width] = rng.standard_normal((width, k * tables)), rng.uniform(0, WIDTH, k * tables)
                at = np.flatnonzero(size == width)
                raw = flat[ends[at][:, None] + np.arange(width)]
                a, b = planes[width]
                cells = np.floor((units(raw) @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(at), tables, k)
                # the length as an odd multiple, shifted, so that lengths never differ by what cells differ by
                start = int(width) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
                mixed = np.full((len(at), tables), start ^ start >> 32, np.uint64)
                for j in range(k):
                    mixed = (mixed ^ cells[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                short = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for i in range(0, len(at), 128):
                    part = at[i : i + 128]
                    m = len(part)
                    values = [pa.array(np.repeat(ids[part], tables)), pa.array(np.repeat(n[part], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), m)), pa.array(mixed[i : i + 128].view(np.int64).ravel())]
                    offsets = np.append(0, np.cumsum(np.tile(np.arange(tables), m))).astype(np.int32)
                    keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(short[i : i + 128][:, earlier].ravel()))
                    x = pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(raw[i : i + 128], tables, axis=0).ravel()), int(width)).cast(pa.list_(flat_type))
                    yield pa.RecordBatch.from_arrays([*values, keys, x], names=["id", "n", "t", "bucket", "keys", "x"])

    hashed = classes.select("v", "id", "n").mapInArrow(hash_rows, f"id long, n long, t int, bucket long, keys array<int>, x array<{element}>")
    hashed = materialise(hashed, "buckets")
    large = hashed.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    spread = hashed.join(large, ["t", "bucket"], "left").withColumn("parts", parts).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = spread.select("*", other.alias("other")).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    placed = spread.select("t", "bucket", "lo", "hi", "own", "id", "n", "keys", "x").repartition("t", "bucket", "lo", "hi").sortWithinPartitions("t", "bucket", "lo", "hi")

    def compare(t: int, same: bool, own: np.ndarray, lo: int, ids: np.ndarray, n: np.ndarray, keys: np.ndarray, x: np.ndarray):
        left = np.arange(len(ids)) if same else np.flatnonzero(own == lo)
        right = left if same else np.flatnonzero(own != lo)
        single = x.astype(np.float32)
        unsure = (x.shape[1] + 4) * 1.2e-7  # more than single precision can be off; what lies within is done in double
        links, a, b = np.zeros(len(ids), np.int64), [], []
        for i in range(0, len(left), 512):
            at = left[i : i + 512]
            cosine = single[at] @ single[right].T
            close = cosine >= threshold
            r, c = np.nonzero(np.abs(cosine - threshold) <= unsure)
            for j in range(0, len(r), 8192):
                p, q = r[j : j + 8192], c[j : j + 8192]
                close[p, q] = np.einsum("ij,ij->i", x[at[p]], x[right[q]]) >= threshold
            if same:
                close[np.arange(len(at)), np.arange(i, i + len(at))] = False
            for earlier in range(t):  # a pair that met before was counted there
                if not close.any():
                    break
                close &= keys[at, earlier][:, None] != keys[right, earlier][None, :]
            links[at] += close @ n[right]
            if not same:
                links[right] += n[at] @ close
            r, c = np.nonzero(close)
            if len(r):
                # enough of these links to join what they join
                root = local_roots(len(ids), at[r], right[c])
                node = np.flatnonzero(root != np.arange(len(root)))
                a.append(ids[root[node]])
                b.append(ids[node])
        some = np.flatnonzero(links)
        out = [(ids[some], np.full(len(some), -1), links[some])] if len(some) else []
        if a:
            a_all, b_all = np.concatenate(a), np.concatenate(b)
            out.append((a_all, b_all, np.zeros(len(a_all), np.int64)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # one group of at most two blocks

        def flush():
            group = pa.Table.from_batches(held).combine_chunks()
            if group.num_rows < 2:
                return
            columns = {name: group.column(name).chunk(0) for name in group.column_names}
            t, lo, hi = columns["t"][0].as_py(), columns["lo"][0].as_py(), columns["hi"][0].as_py()
            keys = columns["keys"].flatten().to_numpy().reshape(group.num_rows, t)
            size = np.diff(columns["x"].offsets.to_numpy())
            flat, ends = columns["x"].flatten().to_numpy(), np.append(0, np.cumsum(size))
            own, ids, n = (columns[name].to_numpy() for name in ("own", "id", "n"))
            for width in np.unique(size):  # lengths are part of the hash, but two may meet by chance
                at = np.flatnonzero(size == width)
                if len(at) < 2:
                    continue
                x = units(flat.reshape(len(at), -1) if len(at) == len(size) else flat[ends[at][:, None] + np.arange(width)])
                for a, b, c in compare(t, lo == hi, own[at], lo, ids[at], n[at], keys[at], x):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["a", "b", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(i).to_numpy() for i in range(4)]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in ids:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                piece = batch.slice(i, j - i)
                if held and any(held[-1].column(c)[0] != piece.column(c)[0] for c in range(4)):
                    yield from flush()
                    held.clear()
                held.append(piece)
        if held:
            yield from flush()

    found = materialise(placed.mapInArrow(run, "a long, b long, links long"), "found")
    release(hashed)
    counts = found.where("b = -1 and links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    joined = connected(found.where("links = 0").select("a", "b"))
    known = (
        classes.join(counts, classes["id"] == counts["a"], "left")
        .join(joined, classes["id"] == joined["node"], "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    )
    good = rows.where("usable").join(known, "v").select("id", "links", "component")
    rest = rows.where("not usable").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = good.union(rest)
    return out.select(F.col("id").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
