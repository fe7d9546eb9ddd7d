"""Users' own records: schema roles, minting, linking onto a graph; crosswalks and review files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.functions.text import squeeze
from oriel.operators.numbering import numbered
from oriel.sources.graph import EntityGraph

KNOWN_SYSTEMS = ("iso2", "iso3", "iso_numeric", "wikidata", "dcid", "duns", "lei", "suppkey", "custkey", "partkey")


@dataclass(frozen=True)
class Roles:
    """What the columns of a record table are."""

    id: str | None = None
    names: tuple[str, ...] = ("name",)
    aliases: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    attrs: tuple[str, ...] = ()
    entity_type: str = "custom"
    type_column: str | None = field(default=None)


def roles(columns: list[str], id: str | None = None, name: str | list[str] = "name", aliases=(), codes=None, attrs=(), entity_type: str = "custom") -> Roles:
    """Columns to roles; codes default to columns named as known systems; attrs "rest" takes what is left."""
    names = (name,) if isinstance(name, str) else tuple(name)
    for c in (*names, *aliases, *(codes or ()), *(() if attrs == "rest" else attrs), *((id,) if id else ())):
        if c not in columns:
            raise ValueError(f"no column {c!r} among {columns}")
    found = tuple(c for c in columns if c.lower() in KNOWN_SYSTEMS) if codes is None else tuple(codes)
    taken = {id, *names, *aliases, *found}
    rest = tuple(c for c in columns if c not in taken and c != entity_type) if attrs == "rest" else tuple(attrs)
    by_column = entity_type in columns
    return Roles(id, names, tuple(aliases), found, rest, "custom" if by_column else entity_type, entity_type if by_column else None)


def filled(column: str) -> Column:
    return F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))


def from_records(records: DataFrame, r: Roles, namespace: str = "local") -> EntityGraph:
    """Mint a graph: ids ``namespace``/id; of rows with one id the first name and type stay, names and codes add up."""
    if r.id is None:
        records = numbered(records, [F.col(c).cast("string") for c in records.columns], "_row")
    seed = filled(r.id) if r.id else F.concat(F.lit("row-"), (F.col("_row") + 1).cast("string"))
    name = F.coalesce(*[filled(c) for c in r.names])
    rows = records.withColumn("_name", name).withColumn("_id", F.concat(F.lit(namespace + "/"), seed)).where("_name is not null and _id is not null")
    rows = rows.withColumn("_type", filled(r.type_column) if r.type_column else F.lit(r.entity_type)).withColumn("_ord", F.monotonically_increasing_id())
    first = rows.groupBy("_id").agg(F.min(F.struct("_ord", "_name", "_type")).alias("f"))
    none = lambda t: F.lit(None).cast(t)
    entities = first.select(F.col("_id").alias("entity_id"), F.col("f._type").alias("entity_type"), F.col("f._name").alias("canonical_name"), squeeze(F.col("f._name")).alias("canonical_name_norm"), none("date").alias("valid_from"), none("date").alias("valid_until"), none("double").alias("prominence"), none("string").alias("country_code"))

    def names_of(column: Column, kind: str) -> DataFrame:
        return rows.select(F.col("_id").alias("entity_id"), F.lit(kind).alias("name_kind"), column.alias("value"), squeeze(column).alias("value_norm"), F.lit("").alias("lang"), F.lit("").alias("script"), F.lit(kind == "canonical").alias("is_preferred")).where("value is not null")

    names = names_of(F.col("_name"), "canonical")
    for a in r.aliases:
        names = names.union(names_of(filled(a), "alias"))
    names = names.dropDuplicates(["entity_id", "name_kind", "value_norm"])
    codes = rows.sparkSession.createDataFrame([], "entity_id string, system string, value string, value_norm string")
    for c in r.codes:
        codes = codes.union(rows.select(F.col("_id"), F.lit(c.lower()), filled(c), F.lower(filled(c))).where(filled(c).isNotNull()))
    codes = codes.dropDuplicates(["entity_id", "system"])
    relations = rows.sparkSession.createDataFrame([], "entity_id string, relation_type string, target_id string, valid_from date, valid_until date")
    return EntityGraph(entities, names, codes, relations)


def link(g: EntityGraph, records: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """(row_id, status, entity_id, key): the first key with a match decides.

    One entity links, several make the row ambiguous and stop it; keys without a value are passed over; a
    key that is no code system of the graph makes rows with a value for it invalid. "name" is the exact name.
    """
    systems = {r.system for r in g.codes.select("system").distinct().collect()}  # a handful
    parts = None
    for i, k in enumerate(keys):
        value = filled(k)
        base = records.select(F.col(row_id).alias("row_id"), F.lit(i).alias("ord"), F.lit(k).alias("key"), value.alias("v")).where("v is not null")
        if k != "name" and k not in systems:
            own = base.select("row_id", "ord", "key", F.lit(-1).cast("long").alias("n"), F.lit(None).cast("string").alias("entity_id"))
        else:
            pool = g.names.select("entity_id", F.col("value_norm").alias("v")) if k == "name" else g.codes.where(F.col("system") == k).select("entity_id", F.col("value_norm").alias("v"))
            # a value is one row with its first and last entity: that says none, one or several, and no row meets every entity of its value
            ends = pool.groupBy("v").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
            found = base.withColumn("v", squeeze(F.col("v"))).join(ends, "v")
            lo, hi = F.min("lo"), F.max("hi")
            own = found.groupBy("row_id", "ord", "key").agg(F.when(lo.isNull(), 0).when(lo == hi, 1).otherwise(2).cast("long").alias("n"), lo.alias("entity_id"))
        parts = own if parts is None else parts.union(own)
    first = parts.groupBy("row_id").agg(F.min(F.struct("ord", "key", "n", "entity_id")).alias("f")).select("row_id", "f.*")
    status = F.when(F.col("n") == -1, "invalid_key").when(F.col("n") == 1, "linked").when(F.col("n") > 1, "ambiguous").otherwise("no_match")
    out = records.select(F.col(row_id).alias("row_id")).join(first, "row_id", "left")
    return out.select("row_id", status.alias("status"), F.when(F.col("n") == 1, F.col("entity_id")).alias("entity_id"), F.when(F.col("n") == 1, F.col("key")).alias("key"))


def augment(g: EntityGraph, records: DataFrame, row_id: str, keys: list[str], add_codes: list[str] = (), add_aliases: list[str] = (), on_miss: str = "skip", namespace: str = "local", name: str = "name") -> tuple[EntityGraph, DataFrame]:
    """The graph with the records' codes and aliases on the entities they link to; and the tally by status."""
    linked = link(g, records, row_id, keys)
    if on_miss == "error" and not linked.where("status <> 'linked'").limit(1).isEmpty():
        raise ValueError("some records link to nothing")
    rows = records.join(linked.withColumnRenamed("row_id", row_id), row_id)
    hits = rows.where("status = 'linked'")
    none = lambda t: F.lit(None).cast(t)
    codes, names, out = g.codes, g.names, g
    for c in add_codes:
        new = hits.select("entity_id", F.lit(c.lower()).alias("system"), filled(c).alias("value"), F.lower(filled(c)).alias("value_norm")).where("value is not null").dropDuplicates(["entity_id", "system"])
        codes = codes.join(new.select("entity_id", "system"), ["entity_id", "system"], "left_anti").unionByName(new)
    for a in add_aliases:
        new = hits.select("entity_id", F.lit("alias").alias("name_kind"), filled(a).alias("value"), squeeze(filled(a)).alias("value_norm"), F.lit("").alias("lang"), F.lit("").alias("script"), F.lit(False).alias("is_preferred")).where("value is not null")
        names = names.unionByName(new).dropDuplicates(["entity_id", "name_kind", "value_norm", "lang", "script"])
    out = g.with_tables(codes=codes, names=names)
    status = F.col("status")
    if on_miss == "mint":
        missed = rows.where("status = 'no_match'").drop("status", "entity_id", "key")
        minted = from_records(missed, Roles(id=row_id, names=(name,), codes=tuple(add_codes)), namespace)
        out = EntityGraph(**{k: t.unionByName(minted.tables()[k]) for k, t in out.tables().items()})
        status = F.when(status == "no_match", "minted").otherwise(status)
    else:
        status = F.when(status == "no_match", "skipped").otherwise(status)
    return out, linked.withColumn("status", status).groupBy("status").agg(F.count("*").alias("n"))


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """(value, entity_id) of a CSV file: an empty id or IGNORE is null; a value twice is an error."""
    rows = spark.read.csv(path, header=True).select("value", F.when(F.upper(F.trim("entity_id")) == "IGNORE", None).otherwise(F.nullif(F.trim("entity_id"), F.lit(""))).alias("entity_id"))
    twice = rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the crosswalk has {twice[0].value!r} twice")
    return rows


def write_crosswalk(crosswalk: DataFrame, path: str) -> None:
    crosswalk.select("value", F.coalesce("entity_id", F.lit("IGNORE")).alias("entity_id")).write.csv(path, header=True)


def offenders(g: EntityGraph, crosswalk: DataFrame) -> DataFrame:
    """Crosswalk rows whose entity isn't loaded."""
    return crosswalk.where("entity_id is not null").join(g.entities.select("entity_id"), "entity_id", "left_anti")


def review(results: DataFrame, g: EntityGraph, top: int = 3) -> DataFrame:
    """Rows to look at by hand: value, status and the first candidates with names and confidences, an empty choice."""
    rows = results.where("status <> 'resolved'").select(F.col("text").alias("value"), "status", F.posexplode_outer(F.slice("candidates", 1, top)).alias("i", "c"))
    named = rows.select("value", "status", "i", F.col("c.entity_id").alias("entity_id"), F.col("c.confidence").alias("conf")).join(g.entities.select("entity_id", "canonical_name"), "entity_id", "left")
    wide = named.groupBy("value", "status").agg(*[x for i in range(top) for x in (F.max(F.when(F.col("i") == i, F.col("entity_id"))).alias(f"cand_{i + 1}_id"), F.max(F.when(F.col("i") == i, F.col("canonical_name"))).alias(f"cand_{i + 1}_name"), F.max(F.when(F.col("i") == i, F.col("conf"))).alias(f"cand_{i + 1}_conf"))])
    return wide.withColumn("chosen", F.lit("")).withColumn("note", F.lit(""))


def review_to_crosswalk(reviewed: DataFrame) -> DataFrame:
    """(value, entity_id) of the rows with a choice: a candidate's number, an id, or IGNORE."""
    c = F.trim("chosen")
    picked = F.when(c == "1", F.col("cand_1_id")).when(c == "2", F.col("cand_2_id")).when(c == "3", F.col("cand_3_id")).when(F.upper(c) == "IGNORE", None).otherwise(c)
    return reviewed.where(c != "").select("value", picked.alias("entity_id"))
