"""Data packs: a graph's four tables with a metadata file of versions, counts and checksums."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.sources.graph import EntityGraph

#: Versions that this package writes and reads.
SCHEMA_VERSION, FEATURE_VERSION = "1", "1"


class PackError(ValueError):
    """A pack that can't be used: another version, or contents that aren't what was written."""


def checksum(table: DataFrame) -> dict:
    """Rows and a sum of row hashes: the same for any order and partitioning of the rows."""
    every = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(table.columns)])
    row = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(every.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash")).first()
    return {"rows": row.rows, "hash": row.hash}


def write_pack(g: EntityGraph, path: str, pack_id: str, domain: str, needs: list[str] | None = None) -> dict:
    """Write a graph and its metadata below ``path``; the metadata goes last, so a pack without it was cut short."""
    spark = g.entities.sparkSession
    g.write(path)
    stored = EntityGraph.read(spark, path)
    meta = {"pack_id": pack_id, "domain": domain, "schema_version": SCHEMA_VERSION, "feature_version": FEATURE_VERSION, "needs": needs or [], "tables": {k: checksum(t) for k, t in stored.tables().items()}}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return meta


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/metadata").collect()))


def read_pack(spark: SparkSession, path: str, verify: bool = True, loaded: tuple[str, ...] = ()) -> EntityGraph:
    """A pack's graph, after its versions, the packs it needs (among ``loaded``) and its checksums are found right."""
    meta = read_metadata(spark, path)
    for name, have in (("schema_version", SCHEMA_VERSION), ("feature_version", FEATURE_VERSION)):
        if meta.get(name) != have:
            raise PackError(f"{meta.get('pack_id')} has {name} {meta.get(name)}; this package reads {have}")
    if missing := sorted(set(meta["needs"]) - set(loaded)):
        raise PackError(f"{meta['pack_id']} needs {', '.join(missing)}")
    g = EntityGraph.read(spark, path)
    if verify:
        for name, t in g.tables().items():
            if checksum(t) != meta["tables"][name]:
                raise PackError(f"{meta['pack_id']}: {name} isn't what was written")
    return g


def _at(spark: SparkSession, path: str):
    """A Hadoop path and its file system: any place that the cluster reads, be it a disk, HDFS or an object store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a pack lies at ``path``: its metadata is written last."""
    at, files = _at(spark, f"{path}/metadata/_SUCCESS")
    return files.exists(at)


def place(spark: SparkSession, built: str, path: str) -> bool:
    """Move a finished pack to its place; one that is there already stays (the first writer wins), a half-written one goes."""
    source, files = _at(spark, built)
    target, _ = _at(spark, path)
    if not is_whole(spark, path):
        files.delete(target, True)
        files.mkdirs(target.getParent())
        if files.rename(source, target):
            return True
    files.delete(source, True)
    return False


def ensure_pack(spark: SparkSession, source: str, cache: str, sha256: str | None = None) -> tuple[str, bool]:
    """(path, whether it was copied now) of a remote pack's copy below ``cache``.

    ``source`` is any URI that Hadoop reads. The copy is made beside its place, its metadata held against
    ``sha256`` where given, its tables against their checksums, and then moved; a copy that is whole is used as is.
    The digest of the metadata lies beside the copy, in the folder ``<name>.sha256``.
    """
    name = source.rstrip("/").rpartition("/")[2]
    path = f"{cache}/{name}"
    if is_whole(spark, path):
        return path, False
    (a, from_files), (b, to_files) = _at(spark, source), _at(spark, f"{path}.part-{uuid.uuid4().hex[:8]}")
    to_files.mkdirs(b.getParent())
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_files, a, to_files, b, False, spark._jsc.hadoopConfiguration()):
        raise PackError(f"{source} could not be copied")
    part = b.toString()
    try:
        digest = hashlib.sha256(json.dumps(read_metadata(spark, part), sort_keys=True).encode()).hexdigest()
        if sha256 is not None and digest != sha256:
            raise PackError(f"{source} has the digest {digest}, not {sha256}")
        read_pack(spark, part, loaded=tuple(read_metadata(spark, part)["needs"]))
    except Exception:
        to_files.delete(b, True)
        raise
    copied = place(spark, part, path)
    if copied:
        spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.sha256")
    return path, copied


def clear_cache(spark: SparkSession, cache: str) -> None:
    at, files = _at(spark, cache)
    files.delete(at, True)


def built_pack(rows: DataFrame, options: dict, cache: str, build) -> tuple[EntityGraph, bool]:
    """(graph, whether it was there) of ``build(rows)``, kept as a pack below ``cache`` by what it is made of.

    The key is a digest of the rows' checksum, which no order of theirs changes, their columns, and the options.
    """
    spark = rows.sparkSession
    made_of = {"rows": checksum(rows), "columns": sorted(rows.columns), "options": options, "schema_version": SCHEMA_VERSION}
    key = hashlib.sha256(json.dumps(made_of, sort_keys=True, default=str).encode()).hexdigest()[:40]
    path = f"{cache}/{key}"
    hit = is_whole(spark, path)
    if not hit:
        part = f"{path}.part-{uuid.uuid4().hex[:8]}"
        write_pack(build(rows), part, key, options.get("domain", "custom"))
        place(spark, part, path)
    return read_pack(spark, path), hit
