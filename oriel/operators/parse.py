"""Entity mentions in free text: token n-grams joined with a gazetteer, leftmost longest spans, gates."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.functions import text
from oriel.sources.graph import EntityGraph

DENY = ("a", "an", "and", "de", "der", "die", "et", "in", "is", "island", "islands", "la", "le", "of", "on", "or", "the", "to", "und", "with")
#: Names of a gazetteer that is sent to workers whole; a larger one is met by the join alone.
SENT_PATTERNS = 300_000
WORD = re.compile(r"[\w#'-]+")


def gazetteer(g: EntityGraph, codes: bool = False) -> DataFrame:
    """(norm, ids, n_words, code_shaped): patterns by normal name, with the sorted ids that have it."""
    rows = g.names.select("entity_id", F.col("value_norm").alias("norm"), F.lit(False).alias("code"))
    if codes:
        rows = rows.union(g.codes.select("entity_id", F.col("value_norm").alias("norm"), F.lit(True).alias("code")))
    out = rows.groupBy("norm").agg(F.sort_array(F.collect_set("entity_id")).alias("ids"), F.every("code").alias("code_shaped"))
    return out.withColumn("n_words", F.size(F.split("norm", " "))).where(F.col("norm") != "")


def mentions(g: EntityGraph, docs: DataFrame, key: str = "doc_id", column: str = "text", patterns: DataFrame | None = None) -> DataFrame:
    """(key, start, end, surface, norm, ids, n_words, code_shaped): all runs of words that equal a gazetteer name.

    Offsets are half-open code points. Words are runs of word characters, marks that join them and number
    signs; those of a run are apart by white space alone. Runs are as long as the longest name at most, and each
    is a join key, so the gazetteer may be of any size. One of up to ``SENT_PATTERNS`` names is sent to the
    workers, which then drop all other runs before anything is shuffled.
    """
    patterns = gazetteer(g) if patterns is None else patterns
    spark = docs.sparkSession
    bounds = patterns.agg(F.max("n_words").alias("most"), F.count("*").alias("n")).first()
    most, sent = bounds.most or 1, None
    if bounds.n <= SENT_PATTERNS:
        known = {r.norm for r in patterns.select("norm").collect()}
        begun = {" ".join(w[:n]) for w in (k.split(" ") for k in known) for n in range(1, len(w))}
        sent = spark.sparkContext.broadcast((known, begun))
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, begun = sent.value if sent is not None else (None, None)
        for batch in batches:
            row, start, end, surface, norm = [], [], [], [], []

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(surface, pa.string()), pa.array(norm, pa.string())], names=["k", "start", "end", "surface", "norm"])

            for r, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                spans = [m.span() for m in WORD.finditer(t)]
                for i, (a, b) in enumerate(spans):
                    for n in range(1, most + 1):
                        if n > 1:
                            if i + n > len(spans) or not t[spans[i + n - 2][1] : spans[i + n - 1][0]].isspace():
                                break
                            b = spans[i + n - 1][1]
                        now = t[a:b].lower() if n == 1 else " ".join(t[a:b].lower().split())
                        if known is None or now in known:
                            row.append(r), start.append(a), end.append(b), surface.append(t[a:b]), norm.append(now)
                        if known is not None and now not in begun:
                            break
                if len(row) > 100_000:
                    yield out()
                    row, start, end, surface, norm = [], [], [], [], []
            if row:
                yield out()

    schema = T.StructType([T.StructField("k", kind), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("surface", T.StringType()), T.StructField("norm", T.StringType())])
    runs = docs.select(F.col(key).alias("k"), F.col(column).alias("t")).mapInArrow(run, schema)
    return runs.join(patterns, "norm").select(F.col("k").alias(key), "start", "end", "surface", "norm", "ids", "n_words", "code_shaped")


def leftmost_longest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans without overlaps: from the left, the longest at each place. One pass over sorted partitions."""
    ordered = spans.repartition(key).sortWithinPartitions(F.col(key), F.col("start"), F.col("end").desc())
    place = [ordered.columns.index(c) for c in (key, "start", "end")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free = object(), 0
        for batch in batches:
            keep = []
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in place), strict=True):
                if k != now:
                    now, free = k, 0
                keep.append(a >= free)
                if a >= free:
                    free = b
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema)


def link(spans: DataFrame, include_nil: bool = False) -> DataFrame:
    """Spans with entity_id, status and the first gate that drops them (null: kept).

    Gates in order: placeholder, deny list (all capitals pass), a code in lower case, short input, and several
    entities of one name (no match, or a mention without entity with ``include_nil``).
    """
    s = F.col("surface")
    drop = (
        F.when(text.is_sentinel(s), "sentinel").when(F.lower(s).isin(*DENY) & (F.upper(s) != s), "deny_list")
        .when(F.col("code_shaped") & (F.upper(s) != s), "code_case_mismatch").when(~text.short_input_passes(s), "short_input")
        .when((F.size("ids") > 1) & F.lit(not include_nil), "below_threshold")
    )
    return spans.withColumn("entity_id", F.when(F.size("ids") == 1, F.col("ids")[0])).withColumn("status", F.when(F.size("ids") == 1, "resolved").otherwise("nil")).withColumn("dropped", drop)


def parse(g: EntityGraph, docs: DataFrame, key: str = "doc_id", column: str = "text", include_nil: bool = False) -> DataFrame:
    """(key, start, end, surface, entity_id, status): linked mentions."""
    out = link(leftmost_longest(mentions(g, docs, key, column), key), include_nil)
    return out.where("dropped is null").select(key, "start", "end", "surface", "entity_id", "status")


def arbitrate(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of several domains without overlaps: (key, start, end, pack, status, confidence, ...).

    Resolved ones go before those without entity, then the surer, the geographic, the longer and the first;
    a span stays if it meets none that stays already. One pass over a document's spans in that order.
    """
    order = [F.when(F.col("status") == "resolved", 0).otherwise(1), F.coalesce("confidence", F.lit(0.0)).desc(), F.when(F.col("pack") == "geo", 0).when(F.col("pack") == "org", 1).otherwise(2), (F.col("end") - F.col("start")).desc(), F.col("start"), F.col("end")]
    ordered = spans.repartition(key).sortWithinPartitions(F.col(key), *order)
    place = [ordered.columns.index(c) for c in (key, "start", "end")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, starts, ends = object(), [], []
        for batch in batches:
            keep = []
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in place), strict=True):
                if k != now:
                    now, starts, ends = k, [], []
                i = bisect.bisect_left(starts, a)
                free = (i == 0 or ends[i - 1] <= a) and (i == len(starts) or starts[i] >= b)
                keep.append(free)
                if free:
                    starts.insert(i, a)
                    ends.insert(i, b)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema)


def tag_plainly(g: EntityGraph, docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, start, end, surface, entity_id): a baseline tagger that links every name to its most prominent entity."""
    found = leftmost_longest(mentions(g, docs, key, column), key)
    each = found.select(key, "start", "end", "surface", F.explode("ids").alias("entity_id")).join(g.entities.select("entity_id", "prominence"), "entity_id", "left")
    best = F.min(F.struct((-F.coalesce("prominence", F.lit(0.0))).alias("p"), "entity_id"))["entity_id"]
    return each.groupBy(key, "start", "end", "surface").agg(best.alias("entity_id"))
