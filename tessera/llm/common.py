"""Session helpers of the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Workspace, shared_folder
from .textbytes import release

__all__ = ["Workspace", "batches", "components", "crc32_text", "read", "shared_folder", "unused"]


def unused(name: str, taken: set[str]) -> str:
    """``name`` with as many underscores before it as no column in ``taken`` has."""
    while name in taken:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches that have rows; memory freed after each goes back to the system."""
    for batch in stream:
        if batch.num_rows:
            yield batch
            del batch
            release()


def crc32_text(value: int | None) -> int:
    return zlib.crc32(str(value).encode())


def components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long): the smallest node reachable.

    Every round points each node at its smallest neighbour, compresses those pointers and
    contracts the graph, so rounds are logarithmic in the length of paths. Nothing is collected.
    """
    rounds: list[DataFrame] = []
    rest = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    while True:
        rest = workspace.save(rest, "edges")
        if rest.isEmpty():
            break
        both = rest.union(rest.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        up = workspace.save(up.select("node", F.least("node", "up").alias("up")), "up")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            jumped = up.join(over, "up", "left").select("node", "up", F.coalesce("over", "up").alias("over"))
            jumped = workspace.save(jumped, "jump")
            moved = not jumped.filter("over <> up").isEmpty()
            up = jumped.select("node", F.col("over").alias("up"))
            if not moved:
                break
        rounds.append(up)
        left = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        rest = rest.join(left, "a").join(right, "b").filter("ua <> ub")
        rest = rest.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    found = rounds[0].withColumnRenamed("up", "component")
    for up in rounds[1:]:
        step = up.select(F.col("node").alias("component"), F.col("up").alias("over"))
        found = found.join(step, "component", "left").select("node", F.coalesce("over", "component").alias("component"))
    return workspace.save(found, "components")
