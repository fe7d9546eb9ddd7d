"""Scores, calibration and rank tables as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIERARCHY = {
    "geo.continent": 1.0, "geo.continental_union": 0.9, "geo.country": 0.85, "geo.organization": 0.8, "geo.subregion": 0.78, "geo.region": 0.75,
    "geo.city": 0.7, "geo.admin1": 0.65, "geo.admin2": 0.55, "geo.admin3": 0.4, "geo.admin4": 0.35, "geo.admin5": 0.25,
}
SPECIFICITY = {"geo.country": 0, "geo.admin1": 1, "geo.region": 2, "geo.subregion": 2, "geo.continental_union": 3, "geo.organization": 4}
TIERS = {"exact_code": 5, "exact_name": 4, "acronym": 3, "fts": 2, "fuzzy": 1, "fallback": 0}
PLATT = (-8.499867056667657, 5.556690191789257)


def by_type(table: dict[str, float], other: float | None = None, column: str = "entity_type") -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def platt(raw: Column, a: float = PLATT[0], b: float = PLATT[1]) -> Column:
    return 1 / (1 + F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), raw * a + b))))


def isotonic(raw: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear between fitted points, flat beyond them."""
    out = F.lit(ys[-1])
    for i in range(len(xs) - 1, 0, -1):
        line = (raw - xs[i - 1]) * (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1]) if xs[i] > xs[i - 1] else F.lit(0.0)
        out = F.when(raw < xs[i], ys[i - 1] + line).otherwise(out)
    return F.when(raw <= xs[0], F.lit(ys[0])).otherwise(out)


def logistic(features: dict[str, float], intercept: float) -> Column:
    """A linear model over columns; booleans count 1, nulls 0, query_len a twentieth of itself up to 1."""
    z = F.lit(intercept)
    for name, w in features.items():
        x = F.least(F.col(name) / 20.0, F.lit(1.0)) if name == "query_len" else F.col(name).cast("double")
        z = z + F.coalesce(x, F.lit(0.0)) * w
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def failed(*flags: str) -> Column:
    """0.05 for each constraint that failed; null isn't a failure."""
    out = F.lit(0.0)
    for f in flags:
        out = out + F.when(~F.col(f), 0.05).otherwise(0.0)
    return out


def geo_raw(c=F.col) -> Column:
    """Raw score of a geographic candidate from its features."""
    edit, token = c("fuzzy_edit_sim"), c("fuzzy_token_sim")
    length = F.when(edit >= 0.85, 1.0).when(c("query_len") >= 4, F.least(F.lit(1.0), F.sqrt(c("query_len") / 6.0))).otherwise(c("query_len") / 6.0)
    quality = F.when(c("symspell_edit_norm").isNull() | (c("symspell_edit_norm") >= 0.7), 1.0).otherwise(F.least(F.lit(1.0), c("symspell_edit_norm") / 0.75))
    penalty = failed("containment_pass", "type_pass")
    fuzzy = F.greatest(F.least(0.5 + 0.35 * edit * length * quality + 0.1 * F.coalesce(token, F.lit(0.0)) * quality, F.lit(0.89)) - penalty, F.lit(0.3))
    fts = F.greatest(0.4 + 0.4 * c("fts_bm25_norm") - penalty, F.lit(0.3))
    base = F.when(c("exact_code_hit"), 0.95).when(c("exact_name_hit"), 0.9).when(edit.isNotNull(), fuzzy).when(c("fts_bm25_norm").isNotNull(), fts).otherwise(0.3)
    rank = c("hierarchy_rank")
    lifted = base + 0.009 * F.coalesce(rank, F.lit(0.0)) + F.coalesce(0.12 * (c("candidate_prominence") - 0.5), F.lit(0.0))
    acronym = c("query_is_upper") & c("query_len").between(4, 10) & ~c("exact_code_hit")
    clamp = acronym & ((rank < 0.75) | ((rank < 0.8) & ~c("exact_name_hit")))
    return F.when(F.coalesce(clamp, F.lit(False)), 0.3).otherwise(lifted)


def org_raw(c=F.col) -> Column:
    return (
        F.when(c("exact_code_hit"), 0.95).when(c("exact_name_hit"), 0.92).when(c("acronym_exact"), 0.88).when(c("acronym_hit"), 0.82)
        .when(c("fuzzy_token_sim").isNotNull(), 0.5 + 0.35 * c("fuzzy_token_sim")).when(c("fts_bm25_norm").isNotNull(), 0.4 + 0.35 * c("fts_bm25_norm")).otherwise(0.3)
    )


def custom_raw(c=F.col) -> Column:
    fuzzy = F.least(F.lit(0.89), 0.5 + 0.35 * c("fuzzy_edit_sim") + 0.1 * F.coalesce(c("fuzzy_token_sim"), F.lit(0.0)))
    return F.when(c("exact_code_hit"), 0.95).when(c("exact_name_hit"), 0.9).when(c("fuzzy_edit_sim").isNotNull(), fuzzy).when(c("fts_bm25_norm").isNotNull(), 0.4 + 0.4 * c("fts_bm25_norm")).otherwise(0.3)


BANDS = {"geo": (0.88, 0.65, 0.4), "org": (0.85, 0.65, 0.4), "custom": (0.88, 0.65, 0.4)}


def band(confidence: Column, pack: str) -> Column:
    """A pack's raw confidence on the common scale."""
    high, medium, low = BANDS[pack]
    return (
        F.when(confidence >= high, 0.85 + (confidence - high) / (1 - high) * 0.15)
        .when(confidence >= medium, 0.6 + (confidence - medium) / (high - medium) * 0.25)
        .when(confidence >= low, 0.3 + (confidence - low) / (medium - low) * 0.3)
        .otherwise(confidence * (0.3 / low))
    )


def bm25_feature(bm25: Column) -> Column:
    return F.least(F.log1p(F.abs(bm25)) / F.log1p(F.lit(50.0)), F.lit(1.0))
