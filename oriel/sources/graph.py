"""The entity graph: four tables, how the driver's tables give one, and how graphs are composed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oriel.functions.text import squeeze
from oriel.session import honest_sizes, table

ENTITY = ["entity_id", "entity_type", "canonical_name", "canonical_name_norm", "valid_from", "valid_until", "prominence", "country_code"]
NAME = ["entity_id", "name_kind", "value", "value_norm", "lang", "script", "is_preferred"]
CODE = ["entity_id", "system", "value", "value_norm"]
RELATION = ["entity_id", "relation_type", "target_id", "valid_from", "valid_until"]
KEYS = {
    "entities": ["entity_id"],
    "names": ["entity_id", "name_kind", "value_norm", "lang", "script"],
    "codes": ["entity_id", "system"],
    "relations": ["entity_id", "relation_type", "target_id"],
}


@dataclass(frozen=True)
class EntityGraph:
    """entities, names, codes and relations as DataFrames; validity is half-open, null is unbounded."""

    entities: DataFrame
    names: DataFrame
    codes: DataFrame
    relations: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"entities": self.entities, "names": self.names, "codes": self.codes, "relations": self.relations}

    def with_tables(self, **tables: DataFrame) -> EntityGraph:
        return replace(self, **tables)

    def map(self, change) -> EntityGraph:
        """``change(name, table)`` applied to each table."""
        return EntityGraph(**{k: change(k, t) for k, t in self.tables().items()})

    def write(self, path: str) -> None:
        """Parquet, with relations partitioned by type so that lookups of one type read only it."""
        self.entities.write.parquet(f"{path}/entities")
        self.names.write.parquet(f"{path}/names")
        self.codes.write.parquet(f"{path}/codes")
        self.relations.write.partitionBy("relation_type").parquet(f"{path}/relations")

    @staticmethod
    def read(spark: SparkSession, path: str) -> EntityGraph:
        """Tables without newer columns (script, validity, prominence) get them as defaults."""
        honest_sizes(spark)
        need = {"entities": ENTITY, "names": NAME, "codes": CODE, "relations": RELATION}
        default = {"lang": F.lit(""), "script": F.lit(""), "is_preferred": F.lit(False)}
        kinds = {"valid_from": "date", "valid_until": "date", "prominence": "double"}
        out = {}
        for name, columns in need.items():
            # a table partitioned by type has no file to take its columns from while it is empty
            reader = spark.read.schema("entity_id string, relation_type string, target_id string, valid_from date, valid_until date") if name == "relations" else spark.read
            t = reader.parquet(f"{path}/{name}")
            out[name] = t.select(*[F.col(c) if c in t.columns else default.get(c, F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in columns])
        return EntityGraph(**out)


def _letters(k: str) -> Column:
    pick = lambda x: F.expr(f"substring('ABCDEFGHIJ', cast({x} as int) + 1, 1)")
    return F.concat(pick(f"floor({k} / 10)"), pick(f"{k} % 10"))


def _entity(df: DataFrame, key: Column, kind: str, name: str, **more: Column) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return df.select(
        key.alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(name).alias("canonical_name"), squeeze(F.col(name)).alias("canonical_name_norm"),
        more.get("valid_from", none("date")).alias("valid_from"), more.get("valid_until", none("date")).alias("valid_until"),
        more.get("prominence", none("double")).alias("prominence"), more.get("country_code", none("string")).alias("country_code"),
    )


def from_warehouse(spark: SparkSession, sf_dir: str) -> EntityGraph:
    """The graph that the driver's tables describe: regions, nations, companies, parts and market segments."""
    region, nation, customer, supplier, part, orders, lineitem = (table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    rid, nid = F.concat(F.lit("region/"), F.col("r_regionkey")), F.concat(F.lit("country/"), F.col("n_nationkey"))
    sid, cid, pid = F.concat(F.lit("org/supp-"), F.col("s_suppkey")), F.concat(F.lit("org/cust-"), F.col("c_custkey")), F.concat(F.lit("custom/part-"), F.col("p_partkey"))
    low_high = supplier.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    segment = customer.select("c_mktsegment").distinct()
    world = spark.range(1).select(F.lit("World").alias("name"))
    entities = (
        _entity(world, F.lit("world/0"), "geo.continent", "name")
        .union(_entity(region, rid, "geo.region", "r_name"))
        .union(_entity(nation, nid, "geo.country", "n_name", prominence=F.col("n_nationkey") / F.lit(25.0)))
        .union(_entity(supplier.crossJoin(F.broadcast(low_high)), sid, "org.company", "s_name", prominence=(F.col("s_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo")), country_code=_letters("s_nationkey")))
        .union(_entity(customer, cid, "org.company", "c_name", country_code=_letters("c_nationkey"), valid_from=F.expr("case when c_custkey % 7 = 0 then date '1992-01-01' end"), valid_until=F.expr("case when c_custkey % 5 = 0 then date '1998-01-01' end")))
        .union(_entity(part, pid, "custom", "p_name", prominence=F.col("p_size") / F.lit(50.0)))
        .union(_entity(segment, F.concat(F.lit("groups/"), F.col("c_mktsegment")), "geo.organization", "c_mktsegment"))
    )

    def name(df: DataFrame, key: Column, kind: str, value: Column) -> DataFrame:
        return df.select(key.alias("entity_id"), F.lit(kind).alias("name_kind"), value.alias("value"), squeeze(value).alias("value_norm"), F.lit("en").alias("lang"), F.lit("").alias("script"), F.lit(kind == "canonical").alias("is_preferred"))

    names = (
        entities.select("entity_id", F.lit("canonical").alias("name_kind"), F.col("canonical_name").alias("value"), F.col("canonical_name_norm").alias("value_norm"), F.lit("en").alias("lang"), F.lit("").alias("script"), F.lit(True).alias("is_preferred"))
        .union(name(supplier, sid, "alias", F.expr("replace(s_name, '#', ' ')")))
        .union(name(customer, cid, "alias", F.expr("replace(c_name, '#', ' ')")))
        .union(name(nation, nid, "alias", F.expr("replace(n_name, '_', ' ')")))
        .union(name(region, rid, "exonym", F.expr("concat('The ', lower(r_name))")))
        .union(name(nation, nid, "acronym", F.expr("concat('N', n_nationkey)")))
        .union(name(supplier, sid, "acronym", F.expr("concat('SUPP', s_suppkey)")))
        .union(name(part.where("p_partkey % 3 = 0"), pid, "alias", F.expr("concat(split(p_name, ' ')[1], ' ', split(p_name, ' ')[0])")))
    )

    def code(df: DataFrame, key: Column, system: str, value: Column) -> DataFrame:
        return df.select(key.alias("entity_id"), F.lit(system).alias("system"), value.alias("value"), F.lower(value).alias("value_norm"))

    codes = (
        code(nation, nid, "iso2", _letters("n_nationkey"))
        .union(code(nation, nid, "iso3", F.concat(F.lit("N"), _letters("n_nationkey"))))
        .union(code(nation, nid, "iso_numeric", F.lpad(F.col("n_nationkey").cast("string"), 3, "0")))
        .union(code(supplier, sid, "suppkey", F.concat(F.lit("S-"), F.col("s_suppkey"))))
        .union(code(supplier, sid, "wikidata", F.concat(F.lit("Q"), F.col("s_suppkey") + 1000)))
        .union(code(customer, cid, "custkey", F.concat(F.lit("C-"), F.col("c_custkey"))))
        .union(code(part, pid, "partkey", F.concat(F.lit("P-"), F.col("p_partkey"))))
    )

    def edge(df: DataFrame, source: Column, kind: str, target: Column, since: Column | None = None, until: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("date")
        return df.select(source.alias("entity_id"), F.lit(kind).alias("relation_type"), target.alias("target_id"), (none if since is None else since).alias("valid_from"), (none if until is None else until).alias("valid_until"))

    dated = orders.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("since"), F.date_add(F.max(F.to_date("o_orderdate")), 1).alias("until"))
    supplied = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.min(F.to_date("l_shipdate")).alias("since"), F.date_add(F.max(F.to_date("l_shipdate")), 1).alias("until"))
    relations = (
        edge(region, rid, "contained_in", F.lit("world/0"))
        .union(edge(nation, nid, "contained_in", F.concat(F.lit("region/"), F.col("n_regionkey"))))
        .union(edge(supplier, sid, "contained_in", F.concat(F.lit("country/"), F.col("s_nationkey"))))
        .union(edge(customer, cid, "contained_in", F.concat(F.lit("country/"), F.col("c_nationkey"))))
        .union(edge(customer.join(dated, customer["c_custkey"] == dated["o_custkey"]), cid, "member_of", F.concat(F.lit("groups/"), F.col("c_mktsegment")), F.col("since"), F.col("until")))
        .union(edge(customer.where("c_custkey % 10 = 0"), cid, "subsidiary_of", F.expr("concat('org/supp-', cast(floor(c_custkey / 10) as bigint))")))
        .union(edge(supplied, F.concat(F.lit("org/supp-"), F.col("l_suppkey")), "supplies", F.concat(F.lit("custom/part-"), F.col("l_partkey")), F.col("since"), F.col("until")))
    )
    return EntityGraph(entities, names, codes, relations)


def compose(graphs: list[EntityGraph]) -> EntityGraph:
    """Union of modules: an entity in two of them is an error; of equal names and relations the first stays, of codes the last."""
    ids = None
    for i, g in enumerate(graphs):
        own = g.entities.select("entity_id").withColumn("module", F.lit(i))
        ids = own if ids is None else ids.union(own)
    twice = ids.groupBy("entity_id").agg(F.count_distinct("module").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"entity {twice[0].entity_id} is in several modules")
    return pile(graphs, {"names": "first", "relations": "first", "codes": "last", "entities": "first"})


def pile(graphs: list[EntityGraph], keep: dict[str, str]) -> EntityGraph:
    """Union of graphs with one row per key, of the first or last graph that has it."""
    out = {}
    for name, key in KEYS.items():
        every = None
        for i, g in enumerate(graphs):
            own = g.tables()[name].withColumn("_module", F.lit(i))
            every = own if every is None else every.unionByName(own, allowMissingColumns=True)
        order = F.col("_module").asc() if keep[name] == "first" else F.col("_module").desc()
        best = F.row_number().over(Window.partitionBy(*key).orderBy(order))
        out[name] = every.withColumn("_n", best).where("_n = 1").drop("_n", "_module")
    return EntityGraph(**out)


def composite(graphs: list[EntityGraph]) -> EntityGraph:
    """Precedence: the first graph that has an entity gives all of its rows; others' rows of it are unseen."""
    owner = None
    for i, g in enumerate(graphs):
        own = g.entities.select("entity_id", F.lit(i).alias("_module"))
        owner = own if owner is None else owner.union(own)
    owner = owner.groupBy("entity_id").agg(F.min("_module").alias("_module"))
    out = {}
    for name in KEYS:
        every = None
        for i, g in enumerate(graphs):
            own = g.tables()[name].withColumn("_module", F.lit(i))
            every = own if every is None else every.unionByName(own, allowMissingColumns=True)
        out[name] = every.join(owner, ["entity_id", "_module"], "left_semi").drop("_module")
    return EntityGraph(**out)


def overlay(base: EntityGraph, top: EntityGraph, allow_new_entities: bool = True) -> EntityGraph:
    """``top`` merged onto ``base``: its non-empty scalars win, its list items come first, keys stay unique."""
    blocked = None if allow_new_entities else base.entities.select("entity_id")
    top = top if blocked is None else top.map(lambda _, t: t.join(blocked, "entity_id", "left_semi"))
    b, t = base.entities.alias("b"), top.entities.alias("t")
    scalars = []
    for c in base.entities.columns[1:]:
        over = F.col(f"t.{c}") if c in top.entities.columns else F.lit(None)
        kind = base.entities.schema[c].dataType.simpleString()
        scalars.append(F.coalesce(F.when(over != "", over) if kind == "string" else over, F.col(f"b.{c}")).alias(c))
    entities = b.join(t, "entity_id", "full").select("entity_id", *scalars)
    lists = pile([top, base], {k: "first" for k in KEYS})
    return lists.with_tables(entities=entities)
