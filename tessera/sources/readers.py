"""Sources and sinks by file extension; executors read and write, the driver only plans."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import errors
from ..frame import RoleFrame

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def _extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return f".{name.rsplit('.', 1)[1].lower()}" if "." in name else ""


def read_file(spark: SparkSession, path: str, roles: Mapping | None = None, key: str | None = None, **options: Any) -> RoleFrame:
    """csv (header and types inferred unless told otherwise), parquet, json, orc; xlsx through the driver."""
    kind = _extension(path)
    if kind == ".xlsx":
        try:
            frame = pd.read_excel(path, **options)
        except ImportError as e:
            raise errors.InvalidArgumentError("reading .xlsx needs the openpyxl package") from e
        return RoleFrame(spark.createDataFrame(frame), roles, key)
    if kind not in FORMATS:
        raise errors.InvalidArgumentError(f"cannot read {path!r}: one of {[*FORMATS, '.xlsx']} is expected")
    if kind == ".csv":
        options = {"header": True, "inferSchema": "schema" not in options} | options
    reader = spark.read
    if "schema" in options:
        reader = reader.schema(options.pop("schema"))
    return RoleFrame(reader.format(FORMATS[kind]).options(**options).load(path), roles, key)


def read_table(spark: SparkSession, name: str, roles: Mapping | None = None, key: str | None = None) -> RoleFrame:
    return RoleFrame(spark.table(name), roles, key)


def write_file(frame: RoleFrame | DataFrame, path: str, mode: str = "errorifexists", partition_by: str | None = None, **options: Any) -> None:
    kind = _extension(path)
    if kind not in FORMATS:
        raise errors.InvalidArgumentError(f"cannot write {path!r}: one of {list(FORMATS)} is expected")
    df = frame.df if isinstance(frame, RoleFrame) else frame
    if kind == ".csv":
        options = {"header": True} | options
    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).format(FORMATS[kind]).save(path)
