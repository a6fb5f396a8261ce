"""Partitioned reads of a database, on the driver that Python brings along."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera.roles import TargetRole
from tessera.sources import database


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "some.db")
    with sqlite3.connect(path) as connection:
        connection.execute('CREATE TABLE "rows" (id INTEGER, x REAL, "a name" TEXT)')
        connection.executemany("INSERT INTO rows VALUES (?, ?, ?)", [(i if i % 50 else None, i / 2, None if i % 7 == 0 else f"n{i % 3}") for i in range(1, 1001)])
    return path


SCHEMA = "id long, x double, `a name` string"


def test_partitions_columns_and_filters(spark, path):
    frame = database.read_database(spark, "sqlite3:connect", "rows", SCHEMA, key="id", partitions=6, arguments=[path], roles={TargetRole(): ["x"]})
    assert frame.df.rdd.getNumPartitions() == 6 and frame.search_columns(TargetRole) == ["x"]
    assert frame.df.count() == 1000 and frame.df.agg(F.sum("x")).first()[0] == sum(range(1, 1001)) / 2
    sizes = [r["count"] for r in frame.df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 250
    some = frame.df.filter((F.col("x") > 100) & (F.col("a name") == "n1") & F.col("id").isin([301, 304, 305]))
    assert {(r.id, r["a name"]) for r in some.collect()} == {(i, f"n{i % 3}") for i in (304, 301) if i % 3 == 1 and i % 7}
    assert "a name" not in database.read_database(spark, "sqlite3:connect", "rows", SCHEMA, ["id", "x"], arguments=[path]).df.columns
    with pytest.raises(errors.InvalidArgumentError):
        database.read_database(spark, "sqlite3:connect", "rows", SCHEMA, ["y"], arguments=[path])


def test_conditions_reach_the_database(path):
    reader = database._Reader({"connect": "sqlite3:connect", "table": "rows", "arguments": f'["{path}"]', "key": "id", "partitions": "3"}, database.T._parse_datatype_string("id long, x double"))
    left = list(reader.pushFilters([database.D.GreaterThan(("x",), 400.0), database.D.IsNotNull(("id",)), database.D.StringContains(("x",), "1")]))
    assert [type(f) for f in left] == [database.D.StringContains]
    assert reader.conditions == ['"x" > ?', '"id" IS NOT NULL']
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(reader.partitions()) == 3 and sorted(rows) == [(i, i / 2) for i in range(801, 1001) if i % 50]
