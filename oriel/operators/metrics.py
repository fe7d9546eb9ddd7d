"""Accuracy, latency, calibration and typeahead metrics as aggregations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.operators.numbering import numbered

Z = 1.959963984540054


def wilson(hits: Column, n: Column, upper: bool) -> Column:
    p, z2 = hits / n, Z * Z
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (p + z2 / (2 * n) + (half if upper else -half)) / (1 + z2 / n)


def accuracy(rows: DataFrame, *strata: str) -> DataFrame:
    """Per stratum, and over all: n, accuracy, wrong_rate, abstained, low, high. rows: correct, wrong, abstained booleans."""
    hits, n = F.sum(F.col("correct").cast("int")), F.count("*")
    measures = [n.alias("n"), (hits / n).alias("accuracy"), (F.sum(F.col("wrong").cast("int")) / n).alias("wrong_rate"), (F.sum(F.col("abstained").cast("int")) / n).alias("abstained"), wilson(hits, n, False).alias("low"), wilson(hits, n, True).alias("high")]
    if not strata:
        return rows.agg(*measures)
    return rows.groupingSets([[F.col(s)] for s in strata] + [[]], *strata).agg(*measures)


def latency(rows: DataFrame, column: str) -> DataFrame:
    """n, mean, min, max, p50, and with 20 rows or more p95 and p99, interpolated."""
    p = lambda q: F.percentile(column, F.lit(q))
    enough = F.count(column) >= 20
    return rows.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"), p(0.5).alias("p50"), F.when(enough, p(0.95)).alias("p95"), F.when(enough, p(0.99)).alias("p99"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of equal-width bins over (p, y); the last is closed."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """ece, brier and log_loss of (p, y)."""
    per = reliability(rows, bins)
    total = per.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))).alias("g"))
    clip = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    loss = -(F.col("y") * F.log(clip) + (1 - F.col("y")) * F.log(1 - clip))
    other = rows.agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.avg(loss).alias("log_loss"))
    return total.crossJoin(other).select((F.col("g") / F.col("t")).alias("ece"), "brier", "log_loss")


def adaptive_ece(rows: DataFrame, key: str, bins: int = 10) -> DataFrame:
    """ECE over chunks of equal counts in order of p, ties by key; the first chunks have one row more if it doesn't divide."""
    total = rows.count()
    each, more = divmod(total, bins)
    i, head = F.col("place"), more * (each + 1)
    chunk = F.when(i < head, F.floor(i / (each + 1))).otherwise(more + F.floor((i - head) / max(each, 1)))
    per = numbered(rows, [F.col("p"), F.col(key)]).groupBy(chunk.alias("c")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("g"))
    return per.agg((F.sum(F.col("n") * F.col("g")) / F.sum("n")).alias("adaptive_ece"))


def f1_sweep(rows: DataFrame) -> DataFrame:
    """(threshold, precision, recall, f1) for 0.01 to 0.99.

    Rows are counted by how many thresholds they reach, which leaves a hundred rows; those are summed up from above.
    """
    reached = F.array_size(F.filter(F.array(*[F.lit(i / 100) for i in range(1, 100)]), lambda t: t <= F.col("p")))
    counts = rows.groupBy(reached.alias("t")).agg(F.count_if(F.col("y") == 1).alias("yes"), F.count_if(F.col("y") == 0).alias("no"))
    every = rows.sparkSession.range(0, 100).select(F.col("id").cast("int").alias("t")).join(counts, "t", "left").na.fill(0, ["yes", "no"])
    above = Window.orderBy(F.col("t").desc())
    said = every.select("t", F.sum("yes").over(above).alias("tp"), F.sum("no").over(above).alias("fp"), (F.sum("yes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.sum("yes").over(above)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return said.where("t > 0").select((F.col("t") / 100).alias("threshold"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"))


def spans(gold: DataFrame, found: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of exact spans (doc_id, start, end, entity_id), each matched once."""
    keys = ["doc_id", "start", "end", "entity_id"]
    numbered = lambda t: t.select(*keys).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    both = numbered(gold).withColumn("g", F.lit(1)).join(numbered(found).withColumn("f", F.lit(1)), [*keys, "k"], "full")
    c = both.agg(F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return c.select("*", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"), (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def typeahead(ranks: DataFrame) -> DataFrame:
    """n, mrr, success_at_1, reachable of (query, rank or null) rows, best rank of each query."""
    best = ranks.groupBy("query").agg(F.min("rank").alias("rank"))
    return best.agg(F.count("*").alias("n"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((F.col("rank") == 1).cast("int"), F.lit(0))).alias("success_at_1"), F.avg(F.col("rank").isNotNull().cast("int")).alias("reachable"))


def unambiguous(rows: DataFrame) -> DataFrame:
    """Benchmark rows (text, entity_type, expected_id) whose text and type mean one id alone."""
    one = rows.groupBy(F.lower("text").alias("_t"), F.col("entity_type").alias("_k")).agg(F.count_distinct("expected_id").alias("n")).where("n = 1")
    return rows.join(one, (F.lower("text") == F.col("_t")) & (F.col("entity_type") == F.col("_k")), "left_semi")


def ambiguity_recall(rows: DataFrame) -> DataFrame:
    """(n, recall): of rows that expect two ids or more, the share whose found ids hold any of them."""
    several = rows.where(F.size("expected") >= 2)
    return several.agg(F.count("*").alias("n"), F.avg(F.arrays_overlap("expected", "found").cast("int")).alias("recall"))


def _match_spans(gold: list[tuple], found: list[tuple]) -> tuple[int, ...]:
    """Greedy matches of one document: each gold span takes the first unused overlapping span of its entity."""
    used: set[int] = set()
    meets = lambda p, g: p[0] < g[1] and g[0] < p[1]
    tp = fn = exact = nil_total = nil_correct = 0
    for g in (g for g in gold if g[2] is not None):
        at = next((i for i, p in enumerate(found) if i not in used and p[2] == g[2] and meets(p, g)), None)
        if at is None:
            fn += 1
        else:
            used.add(at)
            tp, exact = tp + 1, exact + (found[at][:2] == g[:2])
    matched = len(used)
    for g in (g for g in gold if g[2] is None):
        over = {i for i, p in enumerate(found) if i not in used and meets(p, g)}
        used |= over
        nil_total, nil_correct = nil_total + 1, nil_correct + (not over)
    return tp, len(found) - matched, fn, exact, nil_total, nil_correct


def span_overlaps(gold: DataFrame, found: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, boundary_exact, nil_accuracy over documents.

    (doc_id, start, end, entity_id) each; gold spans without an entity mean that nothing should be linked there.
    Spans are matched in order of start and end within a document, whose spans are one task's work.
    """
    
    side = lambda t, n: t.select("doc_id", "start", "end", "entity_id", F.lit(n).alias("side"))
    names = ["tp", "fp", "fn", "exact", "nil_total", "nil_correct"]

    def match(of_document: pa.Table) -> pa.Table:
        rows = sorted(zip(*(of_document.column(c).to_pylist() for c in ("start", "end", "entity_id", "side")), strict=True), key=lambda r: (r[0], r[1], r[2] or ""))
        return pa.table([pa.array([n], pa.int64()) for n in _match_spans(*([r[:3] for r in rows if r[3] == s] for s in (0, 1)))], names=names)

    each = side(gold, 0).union(side(found, 1)).groupBy("doc_id").applyInArrow(match, ", ".join(f"{n} long" for n in names))
    c = each.agg(*[F.sum(n).alias(n) for n in names])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(F.col("exact"), tp).alias("boundary_exact"), F.when(F.col("nil_total") > 0, F.col("nil_correct") / F.col("nil_total")).otherwise(1.0).alias("nil_accuracy"),
    )


def prefix_sequence(queries: DataFrame) -> DataFrame:
    """(query, text) of all prefixes of each query: what a user types on the way."""
    n = F.explode(F.sequence(F.lit(1), F.length("query")))
    return queries.select("query", n.alias("n")).select("query", F.expr("substring(query, 1, n)").alias("text"))
