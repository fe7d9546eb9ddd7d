"""Scans and lookups over an entity graph; each replaces an index by a join that Catalyst plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.sources.graph import EntityGraph


def any_prefix(column: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [column.startswith(p) for p in prefixes], F.lit(False))


def iter_names(g: EntityGraph, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Names with their entity's type, by type prefixes to take and to leave out."""
    kept = g.entities.select("entity_id", "entity_type")
    if include:
        kept = kept.where(any_prefix(F.col("entity_type"), include))
    if exclude:
        kept = kept.where(~any_prefix(F.col("entity_type"), exclude))
    return g.names.join(kept, "entity_id").select("value_norm", "entity_id", "name_kind", "is_preferred", "value", "entity_type")


def hydrate(g: EntityGraph, ids: DataFrame) -> DataFrame:
    """Whole entities for a column of ids: the three lists are aggregated for those entities alone."""
    want = ids.select("entity_id").distinct()
    listed = lambda t, cols: F.sort_array(F.collect_list(F.struct(*cols)))
    names = g.names.join(want, "entity_id", "left_semi").groupBy("entity_id").agg(listed(g.names, ["name_kind", "value_norm", "value"]).alias("names"))
    codes = g.codes.join(want, "entity_id", "left_semi").groupBy("entity_id").agg(listed(g.codes, ["system", "value"]).alias("codes"))
    edges = g.relations.join(want, "entity_id", "left_semi").groupBy("entity_id").agg(listed(g.relations, ["relation_type", "target_id"]).alias("relations"))
    return g.entities.join(want, "entity_id", "left_semi").join(names, "entity_id", "left").join(codes, "entity_id", "left").join(edges, "entity_id", "left")


def lookup_code(g: EntityGraph, queries: DataFrame, systems: list[str] | None = None) -> DataFrame:
    """(qid, text, entity_id, system) of equal codes, of any system or given ones."""
    codes = g.codes.where(F.col("system").isin(systems)) if systems else g.codes
    return queries.join(codes.select("entity_id", "system", F.col("value_norm").alias("key")), F.lower(F.trim("text")) == F.col("key")).drop("key")


def lookup_name(g: EntityGraph, queries: DataFrame, kinds: list[str] | None = None, text: str = "norm") -> DataFrame:
    """(…, entity_id, name_kind) of equal normal names, distinct."""
    names = g.names.where(F.col("name_kind").isin(kinds)) if kinds else g.names
    # both sides are distinct before they meet, and so is what they make: pairs, which may be many, aren't gathered again
    return queries.distinct().join(names.select("entity_id", "name_kind", F.col("value_norm").alias("key")).distinct(), F.col(text) == F.col("key")).drop("key")


def active(as_of: Column | None, since: str = "valid_from", until: str = "valid_until") -> Column:
    """Half-open validity; without a date every row is active."""
    if as_of is None:
        return F.lit(True)
    return (F.col(since).isNull() | (F.col(since) <= as_of)) & (F.col(until).isNull() | (as_of < F.col(until)))


def words(text: Column) -> Column:
    """Words of the full-text index: letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


K1, B = 1.2, 0.75


def full_text(names: DataFrame, queries: DataFrame, budget: int = 50, text: str = "norm") -> DataFrame:
    """(qid, entity_id, bm25, rank) of names with all words of a query; phrases first where any match.

    BM25 with k1 1.2 and b 0.75 and a floor on the inverse document frequency; an entity counts by its best
    name. A query meets the postings of its rarest word alone, whose names carry their words, so the long
    postings of common words are never joined; the other words are looked for in those names.
    """
    docs = names.select("entity_id", "value_norm").distinct().withColumn("w", words(F.concat_ws(" ", "entity_id", "value_norm")))
    index = docs.select("entity_id", "value_norm", "w", F.explode(F.array_distinct("w")).alias("token"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("avg_dl"))
    idf = index.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    idf = idf.select("token", "df", "avg_dl", F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    asked = queries.select("qid", F.array_distinct(words(F.col(text))).alias("qw"), F.array_join(words(F.col(text)), " ").alias("q")).where(F.size("qw") > 0)
    known = asked.select("qid", "q", F.size("qw").alias("n"), F.explode("qw").alias("token")).join(idf, "token")
    each = known.groupBy("qid", "q", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token", "idf"))).alias("terms"), F.first("avg_dl").alias("avg_dl")).where(F.size("terms") == F.col("n"))
    hits = each.withColumn("token", F.col("terms")[0]["token"]).join(index, "token").where(F.forall("terms", lambda t: F.array_contains("w", t["token"])))
    norm = K1 * (1 - B + B * F.size("w") / F.col("avg_dl"))

    def part(t: Column) -> Column:
        tf = F.size(F.filter("w", lambda x: x == t["token"]))
        return t["idf"] * tf * (K1 + 1) / (tf + norm)

    scored = hits.withColumn("bm25", F.aggregate("terms", F.lit(0.0), lambda s, t: s + part(t)))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    phrase = F.instr(spaced(F.array_join(words(F.col("value_norm")), " ")), spaced(F.col("q"))) > 0
    flagged = scored.withColumn("phrase", phrase)
    best = flagged.groupBy("qid", "entity_id").agg(F.max(F.when(F.col("phrase"), F.col("bm25"))).alias("phrase_bm25"), F.max("bm25").alias("any_bm25"))
    with_phrase = best.groupBy("qid").agg(F.max(F.col("phrase_bm25").isNotNull()).alias("has_phrase"))
    best = best.join(with_phrase, "qid").withColumn("bm25", F.when(F.col("has_phrase"), F.col("phrase_bm25")).otherwise(F.col("any_bm25"))).where("bm25 is not null")
    order = Window.partitionBy("qid").orderBy(F.round("bm25", 9).desc(), "entity_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget).select("qid", "entity_id", "bm25", "rank")


def bm25_score(rank: Column, steps: tuple[float, ...] = (0.85, 0.75, 0.65, 0.55, 0.45)) -> Column:
    return F.when(rank == 1, steps[0]).when(rank <= 3, steps[1]).when(rank <= 10, steps[2]).when(rank <= 20, steps[3]).otherwise(steps[4])


def beginning(text: Column, n: Column | int) -> Column:
    """A narrow key of a text's first ``n`` characters; what meets on it is compared in full."""
    return F.xxhash64(F.substring(text, F.lit(1), n if isinstance(n, Column) else F.lit(n)))


def by_beginning(names: DataFrame, column: str, queries: DataFrame, text: str) -> DataFrame:
    """Queries with the ``names`` whose ``column`` starts with their text: an equality of whole beginnings.

    A name is a row for each of its beginnings that is as long as some query, so that a query meets no name that
    doesn't start with it. Lengths are one row, with a number for each length that occurs.
    """
    q = queries.where(F.length(text) > 0)
    lengths = q.agg(F.sort_array(F.collect_set(F.length(text))).alias("_lengths"))
    n = names.crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode(F.filter("_lengths", lambda x: x <= F.length(column)))).withColumn("_b", beginning(F.col(column), F.col("_n"))).drop("_n", "_lengths")
    return q.withColumn("_b", beginning(F.col(text), F.length(text))).join(n, "_b").where(F.col(column).startswith(F.col(text))).drop("_b")


def prefix_join(names: DataFrame, queries: DataFrame, text: str = "norm") -> DataFrame:
    """Names that start with a query's text; short queries alone meet many names."""
    return by_beginning(names, "value_norm", queries, text)


def infix_join(names: DataFrame, queries: DataFrame, text: str = "norm") -> DataFrame:
    """Names with a later word that starts with a query's first word, and the query's text from there."""
    rows = names.select("*", F.posexplode(F.split("value_norm", " ")).alias("_at", "_w")).where("_at > 0").withColumn("_rest", F.expr("array_join(slice(split(value_norm, ' '), _at + 1, size(split(value_norm, ' '))), ' ')"))
    return by_beginning(rows, "_rest", queries, text).drop("_at", "_w", "_rest")


PREFIX, MOST_EDITS = 7, 2


def deletes(text: Column, edits: int = MOST_EDITS, prefix: int = PREFIX) -> Column:
    """All strings that up to ``edits`` deletions leave of a text's first characters."""
    head = F.substring(text, 1, prefix)
    n = F.length(head)

    def less(of: Column) -> Column:
        return F.flatten(F.transform(of, lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array(s))))

    one = F.when(n > 0, less(F.array(head))).otherwise(F.array(head))
    every = F.array_union(F.array(head), one)
    return every if edits < 2 else F.array_distinct(F.concat(every, less(F.array_distinct(one))))


def edit_join(terms: DataFrame, queries: DataFrame, text: str = "norm", edits: int = MOST_EDITS, exact_distance=None, prefix: int = PREFIX, within: str | None = None) -> DataFrame:
    """(qid, term, distance) of the closest terms within ``edits`` edits, by symmetric deletes.

    Both sides are reduced to deletion strings of their first characters and joined on those; pairs are then
    checked. Terms: distinct ``term``. By default the distance is Levenshtein's, which Spark computes. A longer
    ``prefix`` makes more keys of a string and fewer false pairs: right where many names begin alike. With
    ``within``, a column of the terms, the closest are those of each of its values.
    """
    part = [within] if within else []
    t = terms.select("term", *part, F.explode(deletes(F.col("term"), edits, prefix)).alias("key"))
    q = queries.select("qid", F.col(text).alias("q"), F.explode(deletes(F.col(text), edits, prefix)).alias("key"))
    pairs = q.join(t, "key").select("qid", "q", "term", *part).distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("q", "term", edits if exact_distance is None else 2 * edits)).where("distance >= 0")
    if exact_distance is None:
        close = pairs
    else:
        # a transposition is two of Levenshtein's edits: it matters from distance 2 on, and at 2 for anagrams alone
        letters = lambda c: F.array_sort(F.split(c, ""))
        unsure = (F.col("distance") > 2) | ((F.col("distance") == 2) & (letters("q") == letters("term")))
        checked = exact_distance(F.when(unsure, F.col("q")), F.when(unsure, F.col("term")))
        close = pairs.withColumn("distance", F.when(unsure, checked).otherwise(F.col("distance"))).where(f"distance between 0 and {edits}")
    best = F.min("distance").over(Window.partitionBy("qid", *part))
    return close.withColumn("best", best).where("distance = best").select("qid", "term", *part, "distance")


def iso3_to_iso2(g: EntityGraph) -> DataFrame:
    """(iso3, iso2), upper case: the table that turns three-letter hints into two letters, from the graph's own codes."""
    of = lambda s: g.codes.where(F.col("system") == s).select("entity_id", F.upper("value").alias(s))
    return of("iso3").join(of("iso2"), "entity_id").select("iso3", "iso2").distinct()


def union_first_seen(*lists: DataFrame) -> DataFrame:
    """(qid, entity_id, place): ids of several lists (qid, entity_id, place), each id where it is seen first."""
    every = reduce(DataFrame.union, [t.select("qid", "entity_id", F.struct(F.lit(i).alias("list"), F.col("place").alias("at")).alias("seen")) for i, t in enumerate(lists)])
    first = every.groupBy("qid", "entity_id").agg(F.min("seen").alias("seen"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("seen", "entity_id"))).select("qid", "entity_id", "place")


def valid_at(facts: DataFrame, key: str, day: str, relations: DataFrame) -> DataFrame:
    """``facts`` with the relations (entity_id, ..., valid_from, valid_until) of their ``key`` that hold on their ``day``.

    An interval join by equality of the key first, so that only a key's own intervals are compared with a day.
    """
    return facts.join(relations, facts[key] == relations["entity_id"]).where(active(F.col(day))).drop("valid_from", "valid_until")


def iso_pivot(g: EntityGraph) -> DataFrame:
    """Codes as columns, the name and flag: what entities convert to."""
    wide = g.codes.groupBy("entity_id").pivot("system", ["iso2", "iso3", "iso_numeric", "suppkey", "custkey", "partkey", "wikidata"]).agg(F.min("value"))
    return g.entities.select("entity_id", F.col("canonical_name").alias("name")).join(wide, "entity_id", "left")


def convert(g: EntityGraph, queries: DataFrame, from_system: str, to_system: str) -> DataFrame:
    """(qid, text, entity_id, value, n_entities): code to code; more than one entity is ambiguous and gives null."""
    source = lookup_code(g, queries, [from_system]).drop("system")
    count = source.withColumn("n_entities", F.count("*").over(Window.partitionBy("qid")))
    target = g.codes.where(F.col("system") == to_system).select("entity_id", F.col("value").alias("_v"))
    return count.join(target, "entity_id", "left").select("qid", "text", "entity_id", F.when(F.col("n_entities") == 1, F.col("_v")).alias("value"), "n_entities")
