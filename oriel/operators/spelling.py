"""Correction word by word: each to its closest dictionary term, with splits and merges of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oriel.functions import similarity
from oriel.operators import lookup
from oriel.sources.graph import EntityGraph


def closest_terms(terms: DataFrame, words: DataFrame, exact_distance=None) -> DataFrame:
    """(word, fixed): the closest of (term, n) within two edits, ties by count, then by term."""
    close = lookup.edit_join(terms, words.select(F.col("word").alias("qid"), F.col("word").alias("norm")), exact_distance=exact_distance)
    counted = close.join(terms, "term")
    return counted.groupBy(F.col("qid").alias("word")).agg(F.min(F.struct("distance", (-F.col("n")).alias("m"), "term"))["term"].alias("fixed"))


def correct_words(terms: DataFrame, queries: DataFrame, exact_distance=None) -> DataFrame:
    """(qid, norm, corrected) of queries whose words, each corrected, give another phrase. Distinct words are corrected once."""
    each = queries.select("qid", "norm", F.posexplode(F.split("norm", " ")).alias("at", "word"))
    fixed = closest_terms(terms, each.select("word").where("word <> ''").distinct(), exact_distance)
    out = each.join(fixed, "word", "left").withColumn("word", F.coalesce("fixed", "word"))
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return out.groupBy("qid", "norm").agg(phrase.alias("corrected")).where("corrected <> norm")


def correct_compounds(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, norm, corrected): a word that is no term split into two that are, or two words merged into one that is.

    The split or merge with the most frequent terms wins, ties by phrase; one change per query.
    """
    known = terms.select("term", "n")
    each = queries.select("qid", "norm", F.split("norm", " ").alias("w")).select("qid", "norm", "w", F.posexplode("w").alias("at", "word"))
    odd = each.join(known.select(F.col("term").alias("word")), "word", "left_anti")
    cut = odd.where(F.length("word") >= 4).select("*", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("i"))
    cut = cut.select("qid", "norm", "w", "at", F.expr("substring(word, 1, i)").alias("a"), F.expr("substring(word, i + 1)").alias("b"))
    cut = cut.join(known.select(F.col("term").alias("a"), F.col("n").alias("na")), "a").join(known.select(F.col("term").alias("b"), F.col("n").alias("nb")), "b")
    head, tail = F.expr("slice(w, 1, at)"), F.expr("slice(w, at + 2, 1000)")
    split = cut.select("qid", "norm", F.least("na", "nb").alias("n"), F.array_join(F.concat(head, F.array("a", "b"), tail), " ").alias("corrected"))
    pair = each.where("at + 1 < size(w)").withColumn("term", F.concat("word", F.expr("w[at + 1]"))).join(known, "term")
    merged = pair.select("qid", "norm", "n", F.array_join(F.concat(head, F.array("term"), F.expr("slice(w, at + 3, 1000)")), " ").alias("corrected"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "corrected"))["corrected"]
    return split.union(merged).groupBy("qid", "norm").agg(best.alias("corrected"))


def retrieve(g: EntityGraph, corrected: DataFrame, budget: int = 20) -> DataFrame:
    """(qid, entity_id, corrected, raw_score, rank): entities of a corrected phrase, by exact name, else by full text."""
    exact = lookup.lookup_name(g, corrected, text="corrected").select("qid", "corrected", "norm", "entity_id").distinct()
    exact = exact.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("entity_id"))).where(F.col("rank") <= budget)
    rest = corrected.join(exact.select("qid").distinct(), "qid", "left_anti")
    found = lookup.full_text(g.names, rest, budget, text="corrected").join(rest, "qid").select("qid", "corrected", "norm", "entity_id", "rank")
    every = exact.select("qid", "corrected", "norm", "entity_id", "rank").union(found)
    scored = every.select("norm", "corrected").distinct().withColumn("raw_score", similarity.ratio(F.col("norm"), F.col("corrected")))
    return every.join(scored, ["norm", "corrected"]).select("qid", "entity_id", "corrected", "raw_score", "rank")


def did_you_mean(terms: DataFrame, queries: DataFrame, most: int = 3) -> DataFrame:
    """(qid, suggestions): up to ``most`` terms closest to a text that matched nothing, by count, then by term."""
    close = lookup.edit_join(terms, queries).join(terms, "term")
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("n").desc(), "term"))
    top = close.withColumn("r", order).where(F.col("r") <= most)
    return top.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("suggestions"))
