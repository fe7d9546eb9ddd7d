"""Training: examples without leaks, splits by query, and calibrators fitted by distributed aggregation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.functions import scoring
from oriel.session import materialise

#: Queries of at most so many characters have a calibrator of their own, if there are so many examples.
SHORT_QUERY, LEAST_EXAMPLES = 6, 10


def dedup_examples(examples: DataFrame, order: str) -> DataFrame:
    """One example per lower-case query and expected entity: the first by ``order``."""
    n = F.row_number().over(Window.partitionBy(F.lower("query_text"), "expected_entity_id").orderBy(order))
    return examples.withColumn("_n", n).where("_n = 1").drop("_n")


def split(examples: DataFrame, share: float = 0.2, seed: str = "42") -> DataFrame:
    """``examples`` with is_eval: all rows of a query text fall on one side, by a hash of its lower-case form."""
    digest = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.lower("query_text"))), 1, 6)
    return examples.withColumn("is_eval", F.conv(digest, 16, 10).cast("long") < int(share * (1 << 24)))


def split_with_both_classes(examples: DataFrame, share: float = 0.2, seed: str = "42") -> DataFrame:
    """The split by query; where a side lacks a class, a split of each class by hash; where that can't be, no evaluation rows."""
    out = split(examples, share, seed)
    sides = out.groupBy("is_eval").agg(F.count_distinct("label").alias("n")).collect()  # two rows at most
    if all(r.n == 2 for r in sides) and len(sides) == 2:
        return out
    place = F.percent_rank().over(Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit(seed + "|"), "query_text")), "query_text"))
    by_class = examples.withColumn("is_eval", place >= 1 - share)
    counts = by_class.groupBy("is_eval").agg(F.count_distinct("label").alias("n")).collect()
    return by_class if len(counts) == 2 and all(r.n == 2 for r in counts) else examples.withColumn("is_eval", F.lit(False))


@dataclass(frozen=True)
class Calibrator:
    """Platt's two numbers, or the points of an isotonic fit."""

    a: float = 0.0
    b: float = 0.0
    xs: tuple[float, ...] = ()
    ys: tuple[float, ...] = ()

    def of(self, raw: Column) -> Column:
        return scoring.isotonic(raw, list(self.xs), list(self.ys)) if self.xs else scoring.platt(raw, self.a, self.b)


def fit_platt(rows: DataFrame, rounds: int = 50) -> Calibrator:
    """Maximum likelihood of 1 / (1 + exp(a p + b)) for (p, y), by Newton's method: one aggregation a round.

    Equal scores are added up first, so rounds don't read the examples again.
    """
    table = materialise(rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("k")), "scores")
    total = table.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    if not total.n or total.k in (0, total.n):
        raise ValueError("both classes are needed")
    a, b = 0.0, math.log((total.n - total.k) / total.k)
    for _ in range(rounds):
        q = scoring.platt(F.col("p"), a, b)
        x, w, e = F.col("p"), F.col("n") * q * (1 - q), F.col("n") * q - F.col("k")
        s = table.agg(F.sum(e * x).alias("ga"), F.sum(e).alias("gb"), F.sum(w * x * x).alias("aa"), F.sum(w * x).alias("ab"), F.sum(w).alias("bb")).first()
        det = s.aa * s.bb - s.ab * s.ab
        if det <= 1e-12:
            break
        da, db = (s.bb * s.ga - s.ab * s.gb) / det, (s.aa * s.gb - s.ab * s.ga) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return Calibrator(a=a, b=b)


def fit_isotonic(rows: DataFrame) -> Calibrator:
    """Isotonic regression of (p, y), pooled in parallel; points where the fit bends."""
    from pyspark.ml.regression import IsotonicRegression

    table = rows.groupBy("p").agg((F.sum("y") / F.count("*")).alias("label"), F.count("*").cast("double").alias("weight"))
    fitted = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(table)
    return Calibrator(xs=tuple(fitted.boundaries.toArray().tolist()), ys=tuple(fitted.predictions.toArray().tolist()))


def fit_stratified(rows: DataFrame, fit=fit_platt) -> tuple[Calibrator, Calibrator]:
    """Calibrators of short and longer queries from (p, y, query_len); a part that is too small takes the fit of all."""
    counts = {r.s: r for r in rows.groupBy((F.col("query_len") <= SHORT_QUERY).alias("s")).agg(F.count("*").alias("n"), F.count_distinct("y").alias("c")).collect()}
    part = lambda s: rows.where((F.col("query_len") <= SHORT_QUERY) == s) if s in counts and counts[s].n >= LEAST_EXAMPLES and counts[s].c == 2 else rows
    return fit(part(True)), fit(part(False))


def stratified(raw: Column, query_len: Column, calibrators: tuple[Calibrator, Calibrator]) -> Column:
    return F.when(query_len <= SHORT_QUERY, calibrators[0].of(raw)).otherwise(calibrators[1].of(raw))


def fit_model(rows: DataFrame, features: list[str], label: str = "y", strength: float = 1.0) -> tuple[dict[str, float], float]:
    """(weights, intercept) of a logistic model with balanced classes; as ``scoring.logistic`` reads them."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = {r[label]: r.n for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if set(n) != {0, 1}:
        raise ValueError("both classes are needed")
    total = n[0] + n[1]
    number = lambda f: F.coalesce(F.least(F.col(f) / 20.0, F.lit(1.0)) if f == "query_len" else F.col(f).cast("double"), F.lit(0.0)).alias(f)
    table = rows.select(*[number(f) for f in features], F.col(label).cast("double").alias("_y"), F.when(F.col(label) == 1, total / (2 * n[1])).otherwise(total / (2 * n[0])).alias("_w"))
    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(table)
    fitted = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=strength / total, standardization=False).fit(vectors)
    return dict(zip(features, fitted.coefficients.toArray().tolist(), strict=True)), float(fitted.intercept)
