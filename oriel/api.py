"""One object over a graph: what a session asks of it, each call a batch of texts and a DataFrame back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.functions import text as texts
from oriel.operators import closure, constraints, etl, explain, linking, lookup, output, parse, spelling, suggest
from oriel.operators import resolve as cascade
from oriel.sources import graph as graphs
from oriel.sources import packs, records
from oriel.sources.graph import EntityGraph

AMBIGUOUS = ("null", "best", "raise")


class Resolver:
    """Resolution, lookups and graph questions over one entity graph.

    Texts are a list, a pandas column, or a DataFrame with ``text`` (and ``qid``, if results are to be joined
    back). Calls plan joins and return DataFrames; nothing is collected but flags and lists of code systems.
    """

    def __init__(self, graph: EntityGraph, domains: list[str] | None = None, fuzzy: bool = True) -> None:
        self.graph, self.domains, self.fuzzy = graph, domains, fuzzy
        self.spark: SparkSession = graph.entities.sparkSession

    # --- where a graph comes from ---

    @classmethod
    def from_records(cls, spark: SparkSession, data, namespace: str = "local", **roles) -> Resolver:
        rows = records.read_records(spark, data)
        if "__id__" in rows.columns:
            roles.setdefault("id", "__id__")
        return cls(linking.from_records(rows, linking.roles(rows.columns, **roles), namespace), ["custom"])

    @classmethod
    def from_packs(cls, spark: SparkSession, paths: list[str], verify: bool = True) -> Resolver:
        """Packs in the order of what they need; an entity in two of them is an error."""
        loaded, found = [], []
        for p in paths:
            found.append(packs.read_pack(spark, p, verify, tuple(loaded)))
            loaded.append(packs.read_metadata(spark, p)["pack_id"])
        return cls(found[0] if len(found) == 1 else graphs.compose(found))

    def augment(self, data, row_id: str, link_on: list[str], **options) -> tuple[Resolver, DataFrame]:
        """A resolver over the graph with the records' codes and aliases, and the tally of how rows were linked."""
        g, tally = linking.augment(self.graph, records.read_records(self.spark, data), row_id, link_on, **options)
        return Resolver(g, self.domains, self.fuzzy), tally

    # --- texts to entities ---

    def queries(self, data) -> DataFrame:
        """(qid, text); texts without a number get one."""
        if isinstance(data, str):
            data = [data]
        if not isinstance(data, DataFrame):
            return records.values(self.spark, data, "text").withColumnRenamed("row_id", "qid")
        return data.select("qid", F.col("text").cast("string")) if "qid" in data.columns else data.select("text").distinct().select(F.col("text").alias("qid"), "text")

    def resolve(self, data, to: str | list[str] | None = None, domain: str | list[str] | None = None, context: dict | None = None, on_missing: str = "null") -> DataFrame:
        """Results with status, entity, confidence, reason and candidates; with ``to``, an output."""
        domains = self.domains if domain is None else [domain] if isinstance(domain, str) else domain
        q = self.queries(data)
        if context:
            found = self._in_context(q, domains or list(cascade.PACKS), output.checked_context(context))
        else:
            found = cascade.resolve(self.graph, q, domains, self.fuzzy)
        found = explain.group_preference(found).withColumn("candidates", explain.specific_first(F.col("candidates")))
        return found if to is None else output.with_output(self.graph, found, to, on_missing)

    def _in_context(self, q: DataFrame, domains: list[str], context: dict) -> DataFrame:
        """Results of candidates that a context leaves: types, dates and containers filter."""
        g = self.graph
        parents = list(context.get("parent_ids", []))
        if country := context.get("country"):
            system = "iso2" if len(country) == 2 else "iso3"
            parents += [r.entity_id for r in g.codes.where((F.col("system") == system) & (F.col("value_norm") == country.lower())).select("entity_id").distinct().collect()]  # all entities of one country code

        def constrain(c: DataFrame) -> DataFrame:
            if kinds := context.get("entity_types"):
                c = constraints.type_filter(c, g, kinds)
            if day := context.get("as_of"):
                c = constraints.temporal_filter(c, g, F.lit(str(day)).cast("date"))
            return constraints.containment_filter(c, g, parents) if parents else c

        ready = cascade.prepare(q)
        parts = None
        for name in domains:
            own = cascade.resolve_pack(g, ready, cascade.PACKS[name], self.fuzzy, constrain)
            parts = own if parts is None else parts.union(own)
        merged = q.join(cascade.merge_packs(parts), "qid", "left")
        return merged.withColumn("status", F.coalesce("status", F.lit("no_match"))).withColumn("reason", F.coalesce("reason", F.lit("no_candidates")))

    def resolve_id(self, data, on_ambiguous: str = "raise") -> DataFrame:
        """(qid, text, entity_id); ambiguous texts raise, give null, or their best candidate."""
        if on_ambiguous not in AMBIGUOUS:
            raise ValueError(f"on_ambiguous is one of {', '.join(AMBIGUOUS)}")
        found = self.resolve(data)
        if on_ambiguous == "raise" and not found.where("status = 'ambiguous'").limit(1).isEmpty():
            raise ValueError("some texts are ambiguous")
        best = F.when((F.col("status") == "ambiguous") & F.lit(on_ambiguous == "best"), F.col("candidates")[0]["entity_id"])
        return found.select("qid", "text", F.coalesce("entity_id", best).alias("entity_id"))

    def bulk(self, values, column: str = "value", **options) -> DataFrame:
        """``values`` with entity_id, status, confidence and, with ``to``, output; distinct texts are resolved once."""
        rows = values if isinstance(values, DataFrame) else records.values(self.spark, values, column)
        return cascade.bulk(self.graph, rows, column, **({"packs": self.domains, "fuzzy": self.fuzzy} | options))

    def explain(self, data, domain: str) -> DataFrame:
        """(qid, winner, alternatives, features) in one domain."""
        pack, q = cascade.PACKS[domain], cascade.prepare(self.queries(data))
        g = cascade.pack_graph(self.graph, pack)
        cands = cascade.rerank(g, cascade.candidates(cascade.generate(g, q, pack, self.fuzzy)), q, pack)
        return explain.scorecards(cascade.score(g, cands, q, pack))

    def snap(self, data, allowed: list[str] | DataFrame, most_distance: float = 0.5) -> DataFrame:
        ids = allowed if isinstance(allowed, DataFrame) else self.spark.createDataFrame([(i,) for i in allowed], "entity_id string")
        return cascade.snap(self.graph, self.queries(data), ids, self.domains or list(cascade.PACKS), most_distance)

    def suggest(self, prefixes, top_k: int = 10, **options) -> DataFrame:
        return suggest.suggest(self.graph, self.queries(prefixes), top_k, **options)

    def did_you_mean(self, data) -> DataFrame:
        q = self.queries(data).withColumn("norm", texts.normalise(F.col("text")))
        return spelling.did_you_mean(etl.spelling_terms(self.graph), q)

    def parse(self, docs: DataFrame, key: str = "doc_id", column: str = "text", to: str | None = None, include_nil: bool = False) -> DataFrame:
        """Mentions with offsets in code points; with ``to``, an output of those that are linked."""
        found = parse.parse(self.graph, docs, key, column, include_nil)
        return found if to is None else output.with_output(self.graph, found, to)

    # --- the graph ---

    def entity(self, ids: list[str]) -> DataFrame:
        return lookup.hydrate(self.graph, self.spark.createDataFrame([(i,) for i in ids], "entity_id string"))

    def arguments(self, args: list[str], prefer: tuple[str, ...] = ()) -> DataFrame:
        return output.arguments(self.graph, self.spark.createDataFrame([(a,) for a in args], "arg string"), prefer)

    def one(self, arg: str, prefer: tuple[str, ...] = ()) -> str:
        """The id that one argument means; unknown and ambiguous ones are errors."""
        row = self.arguments([arg], prefer).first()
        if row.status != "found":
            raise ValueError(f"{arg!r} is {row.status}")
        return row.entity_id

    def convert(self, data, from_system: str, to: str) -> DataFrame:
        return lookup.convert(self.graph, self.queries(data), from_system, to)

    def members_of(self, group: str, **options) -> DataFrame:
        return closure.members_of(self.graph, self.one(group), **options)

    def is_member(self, entity: str, group: str, **options) -> bool:
        pair = self.spark.createDataFrame([(self.one(entity), self.one(group))], "entity_id string, group_id string")
        return closure.is_member(self.graph, pair, **options).first().is_member

    def known_groups(self) -> DataFrame:
        return closure.known_groups(self.graph)

    def within(self, container: str, **options) -> DataFrame:
        return closure.within(self.graph, self.one(container, ("geo.subregion", "geo.continent")), **options)

    def related(self, entity: str, relation: str, as_of=None) -> DataFrame:
        e = self.one(entity)
        return closure.related(self.graph, relation, as_of).where(F.col("entity_id") == e)

    def code_systems(self) -> DataFrame:
        return self.graph.codes.select("system").distinct().orderBy("system")

    def entity_types(self) -> DataFrame:
        return self.graph.entities.select("entity_type").distinct().orderBy("entity_type")

    def info(self) -> DataFrame:
        return output.info(self.graph)

    def inspect(self, data) -> DataFrame:
        return output.inspect(self.graph, self.queries(data))

    def unresolved_relations(self) -> DataFrame:
        return closure.unresolved_relations(self.graph)


def register_functions(spark: SparkSession) -> None:
    """Text and similarity functions for SQL: normal_form, fold, indel_ratio, token_set_ratio, partial_ratio, damerau."""
    import pandas as pd
    from pyspark.sql import types as T

    from oriel.functions import similarity

    def one(f):
        def call(a: pd.Series) -> pd.Series:
            return pd.Series([f(x) if isinstance(x, str) else None for x in a], dtype="object")

        call.__annotations__ = {"a": pd.Series, "return": pd.Series}
        return F.pandas_udf(call, T.StringType())

    spark.udf.register("normal_form", one(texts.normal_form))
    spark.udf.register("fold", one(texts.fold))
    for name, f, kind in (("indel_ratio", similarity.indel, T.DoubleType()), ("token_set_ratio", similarity.token_set, T.DoubleType()), ("partial_ratio", similarity.partial, T.DoubleType()), ("damerau", similarity.damerau, T.IntegerType())):
        spark.udf.register(name, similarity.pairwise(f, kind))
