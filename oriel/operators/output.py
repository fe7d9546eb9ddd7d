"""What a resolved entity is turned into: pivots, names by selector, output chains; arguments and contexts."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.functions.text import flag, squeeze
from oriel.operators.closure import ancestors
from oriel.sources.graph import EntityGraph

#: Kinds of names that a selector may ask for, and outputs that every entity can be asked for.
KINDS = ("canonical", "alias", "endonym", "exonym", "acronym")
COMPUTED = ("name", "flag", "continent", "iso2", "iso3", "numeric", "aliases")
CONTEXT_KEYS = ("country", "parent_ids", "entity_types", "as_of", "languages", "attributes")


def did_you_mean(word: str, known: list[str], n: int = 3) -> list[str]:
    """The known words that are most like ``word``, at most ``n``."""
    return difflib.get_close_matches(word, known, n=n, cutoff=0.6)


class UnknownOutput(ValueError):
    """An output that no entity can have; the message names similar ones."""

    def __init__(self, token: str, known: list[str]) -> None:
        like = did_you_mean(token, known)
        super().__init__(f"no output {token!r}" + (f"; did you mean {', '.join(like)}?" if like else ""))


@dataclass(frozen=True)
class NameSelector:
    """``name:<language or kind>[:<script>]``."""

    lang: str | None = None
    kind: str | None = None
    script: str | None = None


def name_selector(token: str) -> NameSelector:
    """A selector's parts; malformed ones are errors."""
    head, *rest = token.split(":")
    if head != "name" or not 1 <= len(rest) <= 2 or "" in rest:
        raise UnknownOutput(token, [f"name:{k}" for k in KINDS])
    what, script = rest[0], rest[1] if len(rest) == 2 else None
    kind = "acronym" if what == "abbr" else what
    if kind in KINDS:
        return NameSelector(kind=kind, script=script)
    if not re.fullmatch("[a-z]{2,3}", what):
        raise UnknownOutput(token, [f"name:{k}" for k in KINDS])
    return NameSelector(lang=what, script=script)


def selected_names(g: EntityGraph, s: NameSelector) -> DataFrame:
    """(entity_id, value): preferred names first, then by kind and normal form, since tables have no order of their own."""
    rows = g.names.where(F.coalesce("value", F.lit("")) != "")
    if s.lang is not None:
        rows = rows.where(F.col("lang") == s.lang)
    if s.kind is not None:
        rows = rows.where(F.when(F.col("name_kind") == "abbr", "acronym").otherwise(F.col("name_kind")) == s.kind)
    if s.script is not None:
        rows = rows.where(F.col("script") == s.script)
    order = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("name_kind")), F.lit(99))
    first = F.min(F.struct((~F.col("is_preferred")).alias("p"), order.alias("o"), "value_norm", "value"))
    return rows.groupBy("entity_id").agg(first["value"].alias("value"))


def values_of(g: EntityGraph, token: str) -> DataFrame:
    """(entity_id, value) of one output: computed ones, name selectors, code systems, then attributes."""
    code = lambda s: g.codes.where(F.col("system") == s).groupBy("entity_id").agg(F.min("value").alias("value"))
    if token == "name":
        return g.entities.select("entity_id", F.col("canonical_name").alias("value"))
    if token == "flag":
        return code("iso2").withColumn("value", flag(F.col("value")))
    if token == "numeric":
        return code("iso_numeric")
    if token == "aliases":
        rows = g.names.where("name_kind <> 'canonical'")
        return rows.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("value")), "; ").alias("value"))
    if token == "continent":
        above = ancestors(g, g.entities.select("entity_id"), 5)
        named = g.entities.where("entity_type = 'geo.continent'").select(F.col("entity_id").alias("ancestor_id"), F.col("canonical_name").alias("v"))
        return above.join(named, "ancestor_id").groupBy("entity_id").agg(F.min(F.struct("depth", "v"))["v"].alias("value"))
    if token.startswith("name:"):
        return selected_names(g, name_selector(token))
    if token in COMPUTED or not g.codes.where(F.col("system") == token).limit(1).isEmpty():
        return code(token)
    attributes = [c for c in g.entities.columns if c not in ("entity_id", "canonical_name", "canonical_name_norm")]
    if token in attributes:
        return g.entities.select("entity_id", F.col(token).cast("string").alias("value"))
    systems = [r.system for r in g.codes.select("system").distinct().collect()]  # a handful
    raise UnknownOutput(token, sorted({*systems, *COMPUTED, *attributes}))


def with_output(g: EntityGraph, results: DataFrame, chain: str | list[str], on_miss: str = "null", name: str = "output") -> DataFrame:
    """``results`` (entity_id, ...) with the first non-empty output of a chain; misses are null or an error."""
    out, found = results, F.lit(None).cast("string")
    for i, token in enumerate([chain] if isinstance(chain, str) else chain):
        own = values_of(g, token).select("entity_id", F.col("value").alias(f"_o{i}"))
        out = out.join(own, "entity_id", "left")
        found = F.coalesce(found, F.nullif(F.col(f"_o{i}"), F.lit("")))
    out = out.withColumn(name, found).select(*results.columns, name)
    if on_miss == "raise" and not out.where(F.col("entity_id").isNotNull() & F.col(name).isNull()).limit(1).isEmpty():
        raise ValueError(f"some entities have none of {chain}")
    return out


def arguments(g: EntityGraph, given: DataFrame, prefer: tuple[str, ...] = ()) -> DataFrame:
    """(arg, entity_id, status) of arguments: an id if it holds a slash, else the entity of that exact name.

    Several entities are ambiguous, unless just one of them has a preferred type.
    """
    rows = given.select("arg").distinct()
    by_id = rows.where(F.contains("arg", F.lit("/"))).join(g.entities.select("entity_id"), F.col("arg") == F.col("entity_id")).select("arg", "entity_id")
    named = rows.where(~F.contains("arg", F.lit("/"))).withColumn("n", squeeze(F.col("arg")))
    hits = named.join(g.names.select("entity_id", F.col("value_norm").alias("n")).distinct(), "n").select("arg", "entity_id").distinct()
    hits = hits.union(by_id).join(g.entities.select("entity_id", "entity_type"), "entity_id")
    liked = F.col("entity_type").isin(*prefer) if prefer else F.lit(False)
    each = hits.groupBy("arg").agg(F.count("*").alias("n"), F.min("entity_id").alias("one"), F.count_if(liked).alias("n_liked"), F.min(F.when(liked, F.col("entity_id"))).alias("liked"))
    chosen = F.when(F.col("n") == 1, F.col("one")).when(F.col("n_liked") == 1, F.col("liked"))
    out = rows.join(each, "arg", "left")
    return out.select("arg", chosen.alias("entity_id"), F.when(F.col("n").isNull(), "unknown").when(chosen.isNull(), "ambiguous").otherwise("found").alias("status"))


def checked_context(context: dict) -> dict:
    """A context with known keys and a country of two or three letters, upper case; else an error with a hint."""
    for key in context:
        if key not in CONTEXT_KEYS:
            like = did_you_mean(key, list(CONTEXT_KEYS), 1)
            raise ValueError(f"no context {key!r}" + (f"; did you mean {like[0]!r}?" if like else ""))
    country = context.get("country")
    if country is not None and not re.fullmatch("[A-Za-z]{2,3}", country):
        raise ValueError(f"a country is a code of two or three letters, not {country!r}")
    return context | ({"country": country.upper()} if country else {})


def info(g: EntityGraph) -> DataFrame:
    """(entity_type, n_entities, n_names, n_codes): what is loaded."""
    n = lambda t, c: t.groupBy("entity_id").agg(F.count("*").alias(c))
    rows = g.entities.select("entity_id", "entity_type").join(n(g.names, "names"), "entity_id", "left").join(n(g.codes, "codes"), "entity_id", "left")
    return rows.groupBy("entity_type").agg(F.count("*").alias("n_entities"), F.sum(F.coalesce("names", F.lit(0))).alias("n_names"), F.sum(F.coalesce("codes", F.lit(0))).alias("n_codes"))


def inspect(g: EntityGraph, queries: DataFrame) -> DataFrame:
    """(qid, how, n_entities, first_id): how many entities a text is a code or a name of, for diagnosis."""
    n = queries.select("qid", F.lower(F.trim("text")).alias("c"), squeeze(F.col("text")).alias("n"))
    code = n.join(g.codes.select("entity_id", F.col("value_norm").alias("c")), "c").select("qid", F.lit("code").alias("how"), "entity_id")
    name = n.join(g.names.select("entity_id", "name_kind", F.col("value_norm").alias("n")), "n").select("qid", F.col("name_kind").alias("how"), "entity_id")
    return code.union(name).groupBy("qid", "how").agg(F.count_distinct("entity_id").alias("n_entities"), F.min("entity_id").alias("first_id"))
