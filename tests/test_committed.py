"""Committed tables: upserts, changes of several tables, failures and conflicts."""

import uuid

import pytest
from pyspark.sql import functions as F

from gradeloom.sources import committed, sinks
from gradeloom.sources.committed import Change

SCHEMA = "k long, v double, course string"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def rows(spark, *values, schema=SCHEMA):
    return spark.createDataFrame(list(values), schema)


def stored(spark, path, table="points", values=None):
    return sorted(tuple(r) for r in committed.read_committed(spark, path, table, values).collect())


def test_upsert_creates_adds_replaces_and_moves(spark, path):
    assert committed.upsert(spark, path, "points", rows(spark, (1, 1.0, "A"), (2, 2.0, "A"), (3, 3.0, "B")), ["k"], "course") == 1
    committed.upsert(spark, path, "points", rows(spark, (1, 9.0, "B"), (4, 4.0, "C/1"), (2, 5.0, "A")), ["k"], "course")
    assert stored(spark, path) == [(1, 9.0, "B"), (2, 5.0, "A"), (3, 3.0, "B"), (4, 4.0, "C/1")]
    # Key 1 came back, and the partition of key 4 is left empty.
    committed.upsert(spark, path, "points", rows(spark, (1, 7.0, "A"), (4, 8.0, "A")), ["k"], "course")
    assert stored(spark, path) == [(1, 7.0, "A"), (2, 5.0, "A"), (3, 3.0, "B"), (4, 8.0, "A")]
    assert stored(spark, path, values=["C/1"]) == []
    assert stored(spark, path, values=["B", "none"]) == [(3, 3.0, "B")]


def test_upsert_of_null_keys_and_odd_partitions(spark, path):
    schema = "a string, b long, course string"
    first = rows(spark, (None, 1, "x=y"), ("p", None, None), ("q", 2, "{*}"), ("r", 3, "é %"), schema=schema)
    committed.upsert(spark, path, "t", first, ["a", "b"], "course")
    committed.upsert(spark, path, "t", rows(spark, (None, 1, None), ("p", None, "x=y"), ("r", 4, "é %"), schema=schema), ["a", "b"], "course")
    got = {tuple(r) for r in committed.read_committed(spark, path, "t").collect()}
    assert got == {(None, 1, None), ("p", None, "x=y"), ("q", 2, "{*}"), ("r", 3, "é %"), ("r", 4, "é %")}
    got = {tuple(r) for r in committed.read_committed(spark, path, "t", [None, "é %"]).collect()}
    assert got == {(None, 1, None), ("r", 3, "é %"), ("r", 4, "é %")}


def test_upsert_rejects_a_key_given_twice(spark, path):
    with pytest.raises(ValueError, match="twice"):
        committed.upsert(spark, path, "points", rows(spark, (1, 1.0, "A"), (1, 2.0, "B")), ["k"], "course")
    with pytest.raises(LookupError):
        committed.read_committed(spark, path, "points")


def test_upsert_reads_only_the_partitions_it_changes(spark, path):
    many = spark.range(400).select("id", F.concat(F.lit("c"), F.col("id") % 40).alias("course"))
    committed.upsert(spark, path, "t", many, ["id"], "course")
    before = committed._latest(spark, path)[1]["t"]["parts"]
    committed.upsert(spark, path, "t", rows(spark, (3, "c9"), (999, "new"), schema="id long, course string"), ["id"], "course")
    after = committed._latest(spark, path)[1]["t"]["parts"]
    changed = {n.split("=")[1] for n in after if before.get(n) != after[n]}
    assert changed == {"c3", "c9", "new"}
    assert committed.read_committed(spark, path, "t").count() == 401


def test_nodes_and_edges_change_together(spark, path):
    node, edge = "id long, course string", "source long, target long, course string"
    nodes = rows(spark, (1, "A"), (2, "A"), (3, "B"), (4, "C"), schema=node)
    edges = rows(spark, (1, 2, "A"), (3, 3, "B"), (4, 4, "C"), schema=edge)
    committed.commit(spark, path, {"nodes": Change(nodes, "course"), "edges": Change(edges, "course")})
    broken = edges.withColumn("target", F.when(F.col("course") == "B", F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("target")))
    with pytest.raises(Exception, match="broken"):
        committed.commit(spark, path, {"nodes": Change(nodes.where("id = 1"), "course", ["A", "B"]), "edges": Change(broken, "course")})
    assert stored(spark, path, "nodes") == [(1, "A"), (2, "A"), (3, "B"), (4, "C")]
    assert len(committed._names(spark, committed._path(spark, path, "data"))) == 1  # the failed write left no files
    changes = {
        "nodes": Change(rows(spark, (9, "A"), schema=node), "course", ["A", "B"]),
        "edges": Change(edges.limit(0), "course", ["A", "B"]),
    }
    assert committed.commit(spark, path, changes) == 2
    assert stored(spark, path, "nodes") == [(4, "C"), (9, "A")]
    assert stored(spark, path, "edges") == [(4, 4, "C")]


def test_of_two_writers_one_is_told(spark, path):
    committed.commit(spark, path, {"t": Change(rows(spark, (1, 1.0, "A")), "course")})
    with pytest.raises(committed.Conflict):
        committed.commit(spark, path, {"t": Change(rows(spark, (2, 1.0, "A")), "course")}, base=0)
    with pytest.raises(committed.Conflict):
        committed._publish(spark, path, 1, {})
    assert stored(spark, path, "t") == [(1, 1.0, "A")]


def test_other_columns_or_partitioning_are_refused(spark, path):
    committed.commit(spark, path, {"t": Change(rows(spark, (1, 1.0, "A")), "course")})
    with pytest.raises(ValueError, match="columns"):
        committed.commit(spark, path, {"t": Change(rows(spark, (1, "A"), schema="k long, course string"), "course")})
    with pytest.raises(ValueError, match="partitioned"):
        committed.commit(spark, path, {"t": Change(rows(spark, (1, 1.0, "A")), "k")})


def test_vacuum_keeps_what_is_read(spark, path):
    for i in range(3):
        committed.upsert(spark, path, "points", rows(spark, (i, 1.0, "A"), (10, float(i), f"c{i}")), ["k"], "course")
    want = stored(spark, path)
    before = len(list((__import__("pathlib").Path(path)).rglob("*.parquet")))
    committed.vacuum(spark, path)
    assert stored(spark, path) == want == [(0, 1.0, "A"), (1, 1.0, "A"), (2, 1.0, "A"), (10, 2.0, "c2")]
    assert len(list((__import__("pathlib").Path(path)).rglob("*.parquet"))) < before
    committed.upsert(spark, path, "points", rows(spark, (0, 2.0, "c2")), ["k"], "course")
    assert stored(spark, path) == [(0, 2.0, "c2"), (1, 1.0, "A"), (2, 1.0, "A"), (10, 2.0, "c2")]


def test_plain_upsert_finds_moved_keys_and_absent_tables(spark, tmp_path):
    plain = str(tmp_path / f"plain-{uuid.uuid4().hex}")
    sinks.upsert_courses(rows(spark, (1, 1.0, "A"), (2, 2.0, "B")), plain, ["k"])
    sinks.upsert_courses(rows(spark, (1, 9.0, "B"), (3, 3.0, "C")), plain, ["k"])
    got = sorted(tuple(r) for r in spark.read.schema(SCHEMA).parquet(plain).collect())
    assert got == [(1, 9.0, "B"), (2, 2.0, "B"), (3, 3.0, "C")]
