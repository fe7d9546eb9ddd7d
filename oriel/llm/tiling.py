"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyarrow import parquet
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import file_system, prepare, text_or_empty
from oriel.session import materialise

WORD = re.compile(r"\w+")
#: Words of a shared seed, and of the shortest tile.
MIN_MATCH = 5
#: Share of a test item's words that tiles must cover.
COVERAGE = 0.6
#: Words of the test items that a task holds; more items are taken in blocks of about this size.
BLOCK_WORDS = 2_000_000
BASE = 1_000_003
MASK = (1 << 61) - 1


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def tiles(pattern: list[int], text: list[int], least: int = MIN_MATCH, first: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in pattern, start in text, length) of tiles, none overlapping another.

    The longest matches of unmarked tokens are marked first. Matches of at least s tokens are looked for by
    running hashes of s tokens, and verified; s halves until ``least``. Ties go by place in pattern, then text.
    """
    taken_p, taken_t = [False] * len(pattern), [False] * len(text)
    out: list[tuple[int, int, int]] = []

    def free_runs(taken: list[bool], s: int):
        start = 0
        for i in range(len(taken) + 1):
            if i == len(taken) or taken[i]:
                if i - start >= s:
                    yield start, i
                start = i + 1

    def windows(of: list[int], taken: list[bool], s: int):
        top = pow(BASE, s - 1, MASK)
        for a, b in free_runs(taken, s):
            h = 0
            for i in range(a, b):
                if i >= a + s:
                    h = (h - (of[i - s] + 1) * top) % MASK
                h = (h * BASE + of[i] + 1) % MASK
                if i >= a + s - 1:
                    yield h, i - s + 1

    s = max(least, min(first, len(pattern), len(text)))
    while True:
        at: dict[int, list[int]] = defaultdict(list)
        for h, i in windows(text, taken_t, s):
            at[h].append(i)
        found: list[tuple[int, int, int]] = []
        longest = 0
        for h, p in windows(pattern, taken_p, s):
            for t in at.get(h, ()):
                if p and t and not taken_p[p - 1] and not taken_t[t - 1] and pattern[p - 1] == text[t - 1]:
                    continue  # not the left end of its match
                k = 0
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and not taken_p[p + k] and not taken_t[t + k]:
                    k += 1
                if k >= s:
                    found.append((-k, p, t))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        marked = short = False
        for k, p, t in sorted(found):
            k = -k
            if not any(taken_p[p : p + k]) and not any(taken_t[t : t + k]):
                taken_p[p : p + k] = [True] * k
                taken_t[t : t + k] = [True] * k
                out.append((p, t, k))
                marked = True
            else:
                short = True  # what is left of it may still be a match of this length
        if marked and short:
            continue
        if s == least:
            return sorted(out)
        s = max(least, s // 2)


class Items:
    """A block of test items with its seeds, in arrays. Items are told apart by their place, whatever their ids.

    Seeds are the distinct runs of ``least`` words of an item. With ``short_items`` an item of fewer words is its own
    only seed, so that it is found where all its words stand together.
    """

    def __init__(self, rows: list[tuple[int | None, str]], least: int, short_items: bool = False) -> None:
        self.least, self.vocabulary = least, {}
        self.names: list[int | None] = []
        self.items: list[list[int]] = []
        seeds: dict[int, tuple[list[np.ndarray], list[int]]] = {}
        for item, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens(text)]
            width = min(least, len(ids))
            if width < (1 if short_items else least):
                continue
            hashes, owners = seeds.setdefault(width, ([], []))
            hashes.append(np.unique(self.hashes(np.array(ids), width)))
            owners.append(len(self.items))
            self.names.append(item)
            self.items.append(ids)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width, (hashes, owners) in seeds.items():
            flat, owner = np.concatenate(hashes), np.repeat(np.array(owners, np.int32), [len(h) for h in hashes])
            order = np.argsort(flat, kind="stable")
            self.seeds[width] = flat[order], owner[order]

    @staticmethod
    def hashes(ids: np.ndarray, width: int) -> np.ndarray:
        """Running hashes of ``width`` ids."""
        n = len(ids) - width + 1
        h = np.zeros(max(0, n), np.uint64)
        for j in range(width):
            h = (h ^ ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h

    def shared(self, ids: np.ndarray, width: int) -> dict[int, list[int]]:
        """Places in a text of the seeds of ``width`` words that it shares, by item."""
        flat, owner = self.seeds[width]
        known = (ids >= 0).astype(np.int64)
        at = np.flatnonzero(np.convolve(known, np.ones(width, np.int64), "valid") == width) if known.any() else np.zeros(0, np.int64)
        places: dict[int, list[int]] = defaultdict(list)
        if len(at):
            h = self.hashes(ids, width)[at]
            first, last = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
            for k in np.flatnonzero(last > first).tolist():
                for item in owner[first[k] : last[k]].tolist():
                    places[item].append(int(at[k]))
        return places

    def leaks(self, text: str, coverage: float) -> list[tuple[int | None, int, int, int]]:
        """(item, words covered, words, tiles) of the items that ``text`` covers enough of."""
        get = self.vocabulary.get
        words = tokens(text)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = []
        for width in self.seeds:
            if len(words) < width:
                continue
            for item, starts in self.shared(ids, width).items():
                pattern = self.items[item]
                # only the words of shared seeds can be in a tile; a gap keeps stretches apart
                text_ids: list[int] = []
                end = -1
                for i in starts:
                    if end >= 0 and i > end:
                        text_ids.append(-1)
                    text_ids += ids[max(i, end) : i + width].tolist()
                    end = i + width
                found = tiles(pattern, text_ids, width)
                covered = sum(k for _, _, k in found)
                if found and covered >= coverage * len(pattern):
                    out.append((self.names[item], covered, len(pattern), len(found)))
        return out


def stored(benchmark: DataFrame, item: str, text: str) -> list[str]:
    """Folders of distinct (item, text) rows, each of about ``BLOCK_WORDS`` words, whatever the size of the test set."""
    rows = benchmark.select(F.col(item).cast("long").alias("i"), text_or_empty(text).alias("t")).where("t <> ''").distinct()
    total = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    n = int(total // (6 * BLOCK_WORDS)) + 1
    blocks = materialise(rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int")), "items", partition_by=["block"])
    return [f"{blocks._scratch}/block={b}" for b in range(n)]


@lru_cache(maxsize=1)
def loaded(folder: str, least: int, short_items: bool) -> Items:
    """One block a process: a task works on one, and the next task of the block finds it there."""
    system, base = file_system(folder)
    files = [f.path for f in system.get_file_info(FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet")]
    rows = [r for f in sorted(files) for r in parquet.read_table(f, filesystem=system, columns=["i", "t"]).to_pylist()]
    return Items([(r["i"], r["t"]) for r in rows], least, short_items)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", short_items: bool = False) -> DataFrame:
    """(key, item, covered, words, coverage, tiles): the test items that each text covers at least ``coverage`` of.

    Words are lower-case runs of word characters. A pair of text and item is looked at when they share
    ``least`` words in a row; then greedy tiling covers the item with the longest unmarked matches, in any
    order, so a passage with its sentences moved about is caught. Items with fewer words than ``least`` match
    nothing, or, with ``short_items``, the texts that hold all their words in a row; items without words and null
    or wordless texts match nothing. Each distinct (item, text) row of the test set counts, and is reported, by
    itself: texts under one id, one text under several ids, and rows without an id (null). Other columns are
    dropped. The test set lies in the shared folder in blocks of bounded size; each block meets all texts in
    tasks of its own, which load that block alone, and nothing is shuffled or sent through the driver.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, item long, covered int, words int, coverage double, tiles int"
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    parts = []
    for folder in stored(benchmark, item, item_text):

        def run(batches: Iterator[pa.RecordBatch], folder: str = folder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                items = loaded(folder, least, short_items)
                out = [(i, *leak) for i, t in enumerate(batch.column(1)) if t.is_valid for leak in items.leaks(t.as_py(), coverage)]
                if out:
                    i, names, covered, words, n = (list(c) for c in zip(*out, strict=True))
                    share = (np.array(covered) / np.array(words)).tolist()
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(names, pa.int64()), pa.array(covered, pa.int32()), pa.array(words, pa.int32()), pa.array(share), pa.array(n, pa.int32())], names=["k", "item", "covered", "words", "coverage", "tiles"])

        parts.append(rows.mapInArrow(run, schema))
    out = reduce(DataFrame.union, parts)
    return out.withColumnRenamed("k", key).withColumnRenamed("item", item)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", short_items: bool = False) -> DataFrame:
    """``docs`` without the rows whose text covers a test item: same columns.

    Without ``short_items`` an item of fewer than ``MIN_MATCH`` words takes nothing out: a text isn't a leak
    because it holds "yes" or "New York". A test set of one block filters the rows in one pass; with more, rows
    are numbered once, each block gives the numbers of those to leave out, and an anti join takes them.
    """
    prepare(docs.sparkSession)
    folders = stored(benchmark, "item_id", "text")

    def marks(rows: DataFrame, folder: str, dirty: bool) -> DataFrame:
        place = rows.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                items = loaded(folder, MIN_MATCH, short_items)
                yield batch.filter(pa.array([dirty == bool(t.is_valid and items.leaks(t.as_py(), coverage)) for t in batch.column(place)], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    if len(folders) == 1:
        return marks(docs, folders[0], False)
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    leaks = reduce(DataFrame.union, [marks(rows.select(number, text), f, True).select(number) for f in folders])
    return rows.join(materialise(leaks.distinct(), "leaks"), number, "left_anti").drop(number)
