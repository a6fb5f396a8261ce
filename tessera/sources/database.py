"""Tables of databases with a Python driver, read in as many tasks as partitions.

Each task opens its own connection and reads one range of the key: the key's least and greatest
value are asked for once, and the range between them is cut evenly. Only the wanted columns
are selected, and simple filters become conditions of the database's own.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from .. import errors
from ..frame import RoleFrame

FORMAT = "tessera_database"
BATCH = 10_000  # rows fetched at a time
COMPARISONS = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def _connect(options: dict) -> Any:
    module, _, name = options["connect"].partition(":")
    return getattr(importlib.import_module(module), name)(*json.loads(options.get("arguments", "[]")))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class _Range(D.InputPartition):
    condition: str
    values: tuple


class _Reader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.columns = options, [f.name for f in schema.fields]
        self.conditions: list[str] = []
        self.values: list[Any] = []

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802, the interface's name
        for f in filters:
            kind = type(f)
            if kind in COMPARISONS and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.conditions.append(f"{_quoted(f.attribute[0])} {COMPARISONS[kind]} ?")
                self.values.append(f.value)
            elif kind is D.In and len(f.attribute) == 1 and all(isinstance(v, (int, float, str)) for v in f.value):
                self.conditions.append(f"{_quoted(f.attribute[0])} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif kind is D.IsNotNull and len(f.attribute) == 1:
                self.conditions.append(f"{_quoted(f.attribute[0])} IS NOT NULL")
            else:
                yield f

    def partitions(self) -> Sequence[_Range]:
        key, n = self.options.get("key"), int(self.options.get("partitions", 1))
        if not key or n < 2:
            return [_Range("", ())]
        connection = _connect(self.options)
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT min({_quoted(key)}), max({_quoted(key)}) FROM {_quoted(self.options['table'])}")
            lo, hi = cursor.fetchone()
        finally:
            connection.close()
        if lo is None or lo == hi:
            return [_Range("", ())]
        step = (hi - lo) / n
        cuts = [lo + (hi - lo) * i // n if isinstance(lo, int) and isinstance(hi, int) else lo + step * i for i in range(1, n)]
        k = _quoted(key)
        first = _Range(f"({k} < ? OR {k} IS NULL)", (cuts[0],))  # rows without a key are read once
        inner = [_Range(f"({k} >= ? AND {k} < ?)", (a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
        return [first, *inner, _Range(f"{k} >= ?", (cuts[-1],))]

    def read(self, partition: _Range) -> Iterator[tuple]:
        parts = [c for c in (partition.condition, *self.conditions) if c]
        where = f" WHERE {' AND '.join(parts)}" if parts else ""
        connection = _connect(self.options)
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.options['table'])}{where}", (*partition.values, *self.values))
            while rows := cursor.fetchmany(BATCH):
                yield from map(tuple, rows)
        finally:
            connection.close()


class DatabaseSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise errors.NoRequiredArgumentError("schema")

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options), schema)


def read_database(spark: SparkSession, connect: str, table: str, schema: str, columns: Sequence[str] | None = None, key: str | None = None, partitions: int = 1, arguments: Sequence[Any] = (), roles=None) -> RoleFrame:
    """A frame of ``table``; ``connect`` names a function as "module:function" that takes ``arguments`` and gives a DB-API connection.

    ``schema`` declares the table; of it only ``columns`` are read. With ``key``, a number, the rows
    are read in ``partitions`` ranges of it.
    """
    whole = T._parse_datatype_string(schema)
    if unknown := set(columns or ()) - set(whole.names):
        raise errors.InvalidArgumentError(f"no columns {sorted(unknown)}")
    spark.dataSource.register(DatabaseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wanted = T.StructType([f for f in whole.fields if columns is None or f.name in columns])
    options = {"connect": connect, "table": table, "partitions": str(partitions), "arguments": json.dumps(list(arguments))} | ({"key": key} if key else {})
    return RoleFrame(spark.read.format(FORMAT).schema(wanted).options(**options).load(), roles, key if key in wanted.names else None)
