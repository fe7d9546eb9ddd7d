"""Typeahead suggestions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.functions import similarity
from oriel.operators.lookup import infix_join, iter_names, prefix_join
from oriel.session import workers_see_package
from oriel.sources.graph import EntityGraph

#: Tiers whose entities carry prominence.
LIVE_TIERS = ("geo.country", "geo.subregion", "geo.region", "geo.continental_union", "geo.city", "geo.admin1", "geo.admin2", "geo.admin3", "geo.admin4", "geo.admin5")
EXACT_PREFIX, TOKEN_PREFIX, INFIX, FUZZY = 0, 1, 2, 3
RANKED_TIERS = ("geo.country", "geo.admin1", "geo.city")
LEAST_PROMINENCE = 0.3
#: Queries and names in a pair of blocks, and names compared with a query at once.
QUERIES, NAMES, SCORED = 64, 8192, 1024


def suggest(g: EntityGraph, prefixes: DataFrame, top_k: int = 10, include: list[str] | None = None, exclude: list[str] | None = None, fuzzy: bool = False) -> DataFrame:
    """(qid, text, entity_id, match_class, matched, typo_count, rank): the best ``top_k`` (1 to 100) per prefix.

    Names that start with the prefix, names with a later word that does, and, where those don't fill the list,
    names like it. Order: class, whole match (lost by obscure entities of ranked types), typos, prominence,
    name kind, length, id.
    """
    k = min(max(top_k, 1), 100)
    names = iter_names(g, include, exclude)
    q = prefixes.select("qid", "text", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("norm")).where("norm <> ''")
    columns = ["qid", "text", "norm", "entity_id", "entity_type", "name_kind", "is_preferred", "value", "value_norm"]
    first = prefix_join(names, q).select(*columns, F.lit(EXACT_PREFIX).alias("match_class"), F.lit(0).alias("typo_count"))
    inner = infix_join(names, q).select(*columns, F.lit(TOKEN_PREFIX).alias("match_class"), F.lit(0).alias("typo_count"))
    hits = first.union(inner)
    if fuzzy:
        full = hits.groupBy("qid").agg(F.count_distinct("entity_id").alias("n")).where(F.col("n") >= k).select("qid")
        hits = hits.union(like_names(names, q.where(F.length("norm") >= 3).join(full, "qid", "left_anti"), k).select(*columns, F.lit(FUZZY).alias("match_class"), "typo_count"))
    rows = hits.join(g.entities.select("entity_id", "prominence"), "entity_id").withColumn("p", F.coalesce("prominence", F.lit(0.0)))
    ranked_type = F.lit(False)
    for t in RANKED_TIERS:
        ranked_type = ranked_type | F.col("entity_type").startswith(t)
    lift = (F.col("value_norm") == F.col("norm")) & (~ranked_type | (F.col("p") >= LEAST_PROMINENCE))
    kind = F.when(F.col("name_kind") == "canonical", 0).when(F.col("is_preferred"), 1).when(F.col("name_kind").isin("alias", "endonym", "exonym"), 2).otherwise(3)
    key = F.struct("match_class", F.when(lift, 0).otherwise(1).alias("whole"), "typo_count", (-F.col("p")).alias("p"), kind.alias("kind"), F.length("value_norm").alias("len"), F.col("value").alias("matched"))
    best = rows.groupBy("qid", "text", "entity_id").agg(F.min(key).alias("k"))
    order = Window.partitionBy("qid").orderBy("k.match_class", "k.whole", "k.typo_count", "k.p", "k.kind", "k.len", "entity_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "text", "entity_id", F.col("k.match_class").alias("match_class"), F.col("k.matched").alias("matched"), F.col("k.typo_count").alias("typo_count"), "rank")


def ranking_quality(entity_type: Column) -> Column:
    """"ranked" for types of a tier that carries prominence, whether or not an entity has any; else "unranked"."""
    live = F.lit(False)
    for t in LIVE_TIERS:
        live = live | (entity_type == t) | entity_type.startswith(t + ".")
    return F.when(F.coalesce(live, F.lit(False)), "ranked").otherwise("unranked")


def like_names(names: DataFrame, q: DataFrame, top_k: int) -> DataFrame:
    """Names whose partial ratio with the query is 0.7 or more, of all names at least half as long.

    Blocks of queries meet blocks of names; ``may_be_like`` leaves out only pairs that can't reach 0.7.
    """
    pool = min(max(5 * top_k, 50), 500)
    like = like_pairs(q.select("norm").distinct(), names.select("value_norm").where("value_norm is not null").distinct())
    scored = q.select("qid", "norm").join(like.withColumn("s", similarity.partial_ratio(F.col("norm"), F.col("value_norm"))).where("s >= 0.7"), "norm")
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("s").desc(), "value_norm"))).where(F.col("r") <= pool)
    typed = best.withColumn("typo_count", similarity.damerau_distance(F.col("norm"), F.col("value_norm")))
    return q.select("qid", "text").join(typed.select("qid", "norm", "value_norm", "typo_count"), "qid").join(names, "value_norm")


def like_pairs(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """(norm, value_norm): the pairs of ``may_be_like``, found in blocks."""
    workers_see_package(asked.sparkSession)
    block = lambda df, c, most, i: df.groupBy(F.pmod(F.xxhash64(c), F.lit(max(1, math.ceil(df.count() / most)))).alias(i)).agg(F.collect_list(c).alias(c))
    pairs = block(asked, "norm", QUERIES, "i").crossJoin(block(terms, "value_norm", NAMES, "j")).repartition("i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                norms, values = batch.column(0)[row].as_py(), sorted(batch.column(1)[row].as_py(), key=len)
                for i in range(0, len(values), SCORED):
                    part = values[i : i + SCORED]
                    for norm, at in may_be_like(norms, part):
                        yield pa.RecordBatch.from_arrays([pa.array([norm] * len(at), pa.string()), pa.array([part[k] for k in at], pa.string())], names=["norm", "value_norm"])

    return pairs.select("norm", "value_norm").mapInArrow(run, "norm string, value_norm string")


def may_be_like(norms: list[str], values: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """For each query the places of ``values`` that can have a partial ratio of 0.7; none that has it is left out.

    With n characters in the shorter text and L of them in common with a window w, L <= w and 20 L >= 7 (n + w), so
    13 L >= 7 n, and L is at most the characters in common in any order. What passes is compared with every window.
    """
    size = np.array([len(v) for v in values])
    points = [np.frombuffer(v.encode("utf-32-le", "surrogatepass"), "<u4") for v in values]
    letters, code = np.unique(np.concatenate(points), return_inverse=True)
    codes = np.full((len(values), max(1, size.max())), len(letters))  # the last code stands for no character
    codes[np.arange(codes.shape[1]) < size[:, None]] = code
    counts = np.zeros((len(values), len(letters) + 1), np.int32)
    np.add.at(counts, (np.repeat(np.arange(len(values)), size), code), 1)
    place = {chr(c): i for i, c in enumerate(letters.tolist())}
    for norm in norms:
        n = len(norm)
        own: dict[int, int] = {}
        masks = np.zeros(len(letters) + 1, np.uint64)
        for i, c in enumerate(norm):
            if c in place:
                own[place[c]] = own.get(place[c], 0) + 1
                if n < 64:
                    masks[place[c]] |= np.uint64(1 << i)
        common = np.minimum(counts[:, list(own)], np.array(list(own.values()), np.int32)).sum(1) if own else np.zeros(len(values), np.int64)
        passed = (13 * common >= 7 * np.minimum(n, size)) & (2 * size >= n)
        at = np.flatnonzero(passed & (size >= n))
        if len(at) and n < 64:
            wide = np.pad(masks[codes[at]], ((0, 0), (n - 1, n - 1)))
            windows = wide.shape[1] - n + 1
            row = np.full((len(at), windows), (1 << n) - 1, np.uint64)
            for k in range(n):
                hit = row & wide[:, k : k + windows]
                row = (row + hit) | (row - hit)
            first = np.arange(windows) - n + 1
            length = np.minimum(first + n, size[at][:, None]) - np.maximum(first, 0)
            alike = n - np.bitwise_count(row & np.uint64((1 << n) - 1)).astype(np.int64)
            at = at[((20 * alike >= 7 * (n + length)) & (length > 0)).any(1)]
        at = np.concatenate([at, np.flatnonzero(passed & (size < n))])
        if len(at):
            yield norm, at
