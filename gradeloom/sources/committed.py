"""Tables that change by commits, several at a time.

A commit writes its files to a new folder and then one manifest, which names the
folders of every partition of every table. The manifest is put in place by a
rename that fails if its number is taken, so of two writers that start from the
same state one is told so, and readers, who follow the newest manifest, see all
of a commit or nothing. A write that fails leaves the manifests as they are.

A manifest has an entry for each partition, as a catalog has; the rows are read
and written by Spark only. The partition column is kept in the files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import materialise

PART = "_committed_part"
MANIFESTS = "_manifests"
#: Partitions of a key index.
BUCKETS = 256


class Conflict(RuntimeError):
    """Another commit came first; read the table again."""


class Change(NamedTuple):
    """Rows that replace the partitions they fall into, or with ``append`` are added to them.

    The partitions ``emptied`` lose their rows unless ``rows`` has some of them.
    With ``few`` partitions every task writes the rows that it reads, a file for
    each partition, and nothing is shuffled.
    """

    rows: DataFrame
    column: str
    emptied: Sequence = ()
    append: bool = False
    few: bool = False


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path) -> list[str]:
    """Names in a folder; none if it does not exist."""
    files = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    names = _names(spark, _path(spark, path, MANIFESTS))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    file = f"{path.rstrip('/')}/{MANIFESTS}/{version:012d}.json"
    return json.loads(spark.read.text(file, wholetext=True).first()[0])


def _latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and tables of the newest manifest; 0 and none for a store that does not exist yet."""
    versions = _versions(spark, path)
    return (versions[-1], _manifest(spark, path, versions[-1])) if versions else (0, {})


def _folder_name(spark: SparkSession, value) -> str:
    if value is None or value == "":
        return f"{PART}=__HIVE_DEFAULT_PARTITION__"
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{PART}={escape(str(value))}"


def read_committed(spark: SparkSession, path: str, table: str, values: Sequence | None = None) -> DataFrame:
    """The rows of ``table`` as of its newest commit, or only those in the partitions of ``values``.

    Only the folders of those partitions are listed and read. Equal texts of
    NULL and of an empty partition value share a folder.
    """
    tables = _latest(spark, path)[1]
    if table not in tables:
        raise LookupError(f"no table {table} at {path}")
    return _read(spark, path, tables[table], values)


def _read(spark: SparkSession, path: str, entry: dict, values: Sequence | None) -> DataFrame:
    schema, parts = StructType.fromJson(entry["schema"]), entry["parts"]
    names = parts if values is None else {_folder_name(spark, v) for v in values} & parts.keys()
    folders = [f"{path.rstrip('/')}/{folder}" for n in sorted(names) for folder in parts[n]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def commit(spark: SparkSession, path: str, changes: Mapping[str, Change], base: int | None = None) -> int:
    """Make all ``changes`` at once, on top of manifest ``base`` (the newest one); returns the new number.

    A table that does not exist is created. Courses of a few rows are written
    by one task each, one with most of the rows is split by size.
    """
    newest, tables = _latest(spark, path)
    if base is not None and newest != base:
        raise Conflict(f"{path} is at commit {newest}, not {base}")
    for table in changes:
        if f"{table}.keys" in tables and f"{table}.keys" not in changes:
            raise ValueError(f"{table} has a key index; change it by upsert")
    tables = dict(tables)
    stage = f"data/{uuid.uuid4().hex}"
    try:
        for table, change in changes.items():
            tables[table] = _stage(spark, path, f"{stage}/{table}", change, tables.get(table))
        version = newest + 1
        _publish(spark, path, version, tables)
    except BaseException:
        folder = _path(spark, path, stage)
        _files(spark, folder).delete(folder, True)
        raise
    return version


def _stage(spark: SparkSession, path: str, folder: str, change: Change, entry: dict | None) -> dict:
    """Write the rows of a change; the table's manifest entry with them in place."""
    rows = change.rows
    if entry is not None:
        known = StructType.fromJson(entry["schema"])
        if {f.name: f.dataType for f in rows.schema} != {f.name: f.dataType for f in known}:
            raise ValueError(f"the columns are {known.simpleString()}, not {rows.schema.simpleString()}")
        if entry["column"] != change.column:
            raise ValueError(f"the table is partitioned by {entry['column']}")
        rows = rows.select(*known.names)
    placed = rows.withColumn(PART, F.col(change.column).cast("string"))
    if not change.few:
        placed = placed.hint("rebalance", F.col(PART))
    placed.write.partitionBy(PART).parquet(f"{path.rstrip('/')}/{folder}")
    written = [n for n in _names(spark, _path(spark, path, folder)) if n.startswith(f"{PART}=")]
    emptied = {_folder_name(spark, v) for v in change.emptied}
    kept = {} if entry is None else {n: f for n, f in entry["parts"].items() if n not in emptied}
    schema = rows.schema.jsonValue() if entry is None else entry["schema"]
    before = kept if change.append else {}
    parts = kept | {n: [*before.get(n, ()), f"{folder}/{n}"] for n in written}
    return {"schema": schema, "column": change.column, "parts": parts}


def _publish(spark: SparkSession, path: str, version: int, tables: dict) -> None:
    """Write a manifest beside its place and rename it; the rename fails if the place is taken."""
    jvm = spark._jvm
    draft = _path(spark, path, MANIFESTS, f".{uuid.uuid4().hex}")
    place = _path(spark, path, MANIFESTS, f"{version:012d}.json")
    files = _files(spark, draft)
    out = files.create(draft, False)
    try:
        out.write(bytearray(json.dumps(tables).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(place), options)
    except Exception as error:
        files.delete(draft, False)
        if files.exists(place):
            raise Conflict(f"commit {version} of {path} was made by another writer") from error
        raise


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def upsert(
    spark: SparkSession, path: str, table: str, rows: DataFrame, keys: Sequence[str], column: str,
    also: Mapping[str, Change] | None = None,
) -> int:
    """Rows of new keys are added, those of known keys replaced, wherever they were stored.

    The table has an index from key to partition, itself a committed table in
    buckets of the keys' hash. It names the partitions that hold a key now, so
    only these and the ones that ``rows`` fall into are read and written again,
    and a key that changes its partition leaves the old one. Table and index
    change in one commit, with the changes ``also`` asked for; without a table
    both are created. A key that ``rows`` has twice is an error. Keys may be NULL.
    """
    new = materialise(rows)
    if not new.groupBy(*keys).count().where(F.col("count") > 1).isEmpty():
        raise ValueError(f"a key of {', '.join(keys)} occurs twice")
    base, tables = _latest(spark, path)
    index = f"{table}.keys"
    places = new.select(*keys, F.col(column).cast("string").alias("place"), _bucket(keys))
    touched = places.select("place").distinct()
    merged, indexed, buckets = new, places, []
    if table in tables:
        buckets = [r[0] for r in places.select("bucket").distinct().collect()]  # at most BUCKETS
        known = _read(spark, path, tables[index], buckets).alias("k")
        held = known.join(new.alias("n"), _same("k", "n", keys), "left_semi")
        touched = touched.union(held.select("place")).distinct()
        indexed = known.join(new.alias("n"), _same("k", "n", keys), "left_anti").unionByName(places)
    values = [r[0] for r in touched.collect()]  # partitions of this change, an entry each in the manifest
    if table in tables:
        stored = _read(spark, path, tables[table], values).alias("s")
        merged = stored.join(new.alias("n"), _same("s", "n", keys), "left_anti").unionByName(new)
    changes = {table: Change(merged, column, values), index: Change(indexed, "bucket", buckets)}
    return commit(spark, path, changes | dict(also or {}), base)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove what none of the last ``keep`` commits refers to; no commit may be under way."""
    versions = _versions(spark, path)
    recent = versions[-keep:]
    entries = [entry for v in recent for entry in _manifest(spark, path, v).values()]
    folders = [f for entry in entries for part in entry["parts"].values() for f in part]
    used, stages = set(folders), {f.split("/")[1] for f in folders}
    for stage in _names(spark, _path(spark, path, "data")):
        if stage not in stages:
            _remove(spark, path, f"data/{stage}")
            continue
        for table in _names(spark, _path(spark, path, "data", stage)):
            for part in _names(spark, _path(spark, path, "data", stage, table)):
                if part.startswith(f"{PART}=") and f"data/{stage}/{table}/{part}" not in used:
                    _remove(spark, path, f"data/{stage}/{table}/{part}")
    for version in versions[: -keep]:
        _remove(spark, path, f"{MANIFESTS}/{version:012d}.json")


def _remove(spark: SparkSession, path: str, name: str) -> None:
    folder = _path(spark, path, name)
    _files(spark, folder).delete(folder, True)
