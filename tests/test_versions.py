"""A versioned table against a dictionary: merging, conflicts, replays, compaction."""

import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pageloom.sources.versions import Conflict, VersionedTable

SCHEMA = StructType([StructField("id", StringType()), StructField("_number", LongType()), StructField("value", StringType())])


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "table"), SCHEMA)


def frame(spark, rows):
    return spark.createDataFrame([(k, 1, v) for k, v in rows], "id string, _number long, value string")


def rows(table, version=None):
    return {r["id"]: r["value"] for r in table.read(version).collect()}


def test_against_a_dictionary(spark, table):
    rng, wanted = random.Random(4), {str(k): "0" for k in range(50)}
    version = table.create(frame(spark, wanted.items()).select("value", "id", "_number"))
    history = [(version, dict(wanted))]
    for n in range(4):
        changed = {str(rng.randrange(80)): f"v{n}" for _ in range(12)}
        version = table.commit(frame(spark, changed.items()), version)
        wanted |= changed
        history.append((version, dict(wanted)))
        if n == 1:
            version = table.compact(version)
            assert version.changes == [] and table.compact(version) == version
    assert rows(table) == wanted and table.version() == version and table.read().count() == len(wanted)
    for old, expected in history:
        assert rows(table, table.version(old.number)) == expected


def test_conflicts_and_replays(spark, table):
    with pytest.raises(FileNotFoundError):
        table.version()
    first = table.create(frame(spark, [("a", "1"), ("b", None)]))
    with pytest.raises(Conflict):
        table.create(frame(spark, []))
    second = table.commit(frame(spark, [("a", "2")]), first, "rounds", 0)
    with pytest.raises(Conflict):  # has read what is no longer the newest
        table.commit(frame(spark, [("a", "x")]), first)
    assert table.commit(frame(spark, [("a", "x")]), first, "rounds", 0) == second  # a replay
    third = table.commit(frame(spark, [("c", "3")]), second, "rounds", 1)
    with pytest.raises(Conflict):  # a compaction of what has been changed since
        table.compact(second)
    assert rows(table) == {"a": "2", "b": None, "c": "3"} and table.version() == third
    last = table.compact()
    assert last.applied == {"rounds": 1} and table.commit(frame(spark, []), last, "rounds", 1) == last
    assert rows(table) == {"a": "2", "b": None, "c": "3"}


def test_a_race_has_one_winner(spark, table, monkeypatch):
    first = table.create(frame(spark, [("a", "1")]))
    other = VersionedTable(spark, table.path, SCHEMA)
    stored = table._stored

    def late(changed, label):  # another writer publishes while this one writes its rows
        other.commit(frame(spark, [("a", "theirs")]), first)
        return stored(changed, label)

    monkeypatch.setattr(table, "_stored", late)
    with pytest.raises(Conflict):
        table.commit(frame(spark, [("a", "mine")]), first)
    assert rows(table) == {"a": "theirs"}
