"""Splits for A/A tests: exact sizes, by the order of a hash of key and seed.

A split is a function of key and seed alone, so it is the same in every run and engine.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions.ranking import hash_labelled, hash_order
from .stats import column


@dataclass(frozen=True)
class Splitter:
    """control_size: share of the control; groups_sizes: shares of control, test_1, ... (sum 1).

    ``strata``: the split is made inside each combination of these columns. ``const``: column of
    groups fixed beforehand; "control" stays control, other values are test_1, and the control's
    share is balanced over the free rows. ``sample_size``: share of the rows that is split at all;
    the rest get no group (test_1 with ``compat``).
    """

    key: str
    seed: int = 0
    control_size: float = 0.5
    groups_sizes: tuple[float, ...] | None = None
    strata: tuple[str, ...] = ()
    const: str | None = None
    sample_size: float | None = None
    compat: bool = False

    def __post_init__(self):
        if self.groups_sizes is not None and abs(sum(self.groups_sizes) - 1) > 1e-9:
            raise errors.InvalidArgumentError("groups_sizes must sum to 1")
        if not 0 < self.control_size < 1:
            raise errors.InvalidArgumentError("control_size lies between 0 and 1")

    @property
    def id(self) -> str:
        """The splitter as text: what differs from the defaults; ``from_id`` makes it again."""
        changed = {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) != f.default}
        return "splitter:" + json.dumps(changed, sort_keys=True)

    @classmethod
    def from_id(cls, text: str) -> Splitter:
        if not text.startswith("splitter:"):
            raise errors.InvalidArgumentError(f"{text!r} is no splitter's id")
        made = json.loads(text.removeprefix("splitter:"))
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in made.items()})

    def _edges(self) -> list[float]:
        sizes = self.groups_sizes or (self.control_size, 1 - self.control_size)
        return [sum(sizes[: i + 1]) for i in range(len(sizes) - 1)]

    def _label(self, rank: Column, n: Column) -> Column:
        drawn = None
        if self.sample_size is not None:
            n = F.floor(n * F.lit(self.sample_size))
            drawn = rank <= n
        out: Column = F.lit(f"test_{len(self._edges())}")
        for i, edge in reversed(list(enumerate(self._edges()))):
            out = F.when(rank <= F.floor(n * F.lit(edge)), "control" if i == 0 else f"test_{i}").otherwise(out)
        return out if drawn is None else F.when(drawn, out).otherwise(F.lit("test_1" if self.compat else None))

    def split(self, df: DataFrame, name: str = "split") -> DataFrame:
        """Adds ``name``: control, test_1, test_2, ..."""
        return self._labelled(df, hash_order(self.key, self.seed), [], name)

    def split_many(self, df: DataFrame, seeds: Sequence[int], name: str = "split") -> DataFrame:
        """The splits of all seeds in one plan: rows times seeds, with ``seed`` and ``name``; batch the seeds for large tables."""
        spread = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
        hashed = F.md5(F.concat(column(self.key).cast("string"), F.lit(":"), F.col("seed").cast("string")))
        return self._labelled(spread, hashed, ["seed"], name)

    def _labelled(self, df: DataFrame, hashed: Column, by: list[str], name: str) -> DataFrame:
        if self.const is None:
            return hash_labelled(df, self.key, hashed, [*by, *self.strata], self._label, name)
        fixed = column(self.const)
        totals = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(fixed == "control").alias("fixed")).first()  # the same for every seed
        wanted = max(0, math.floor(totals["n"] * self.control_size) - totals["fixed"]) if totals else 0
        free = hash_labelled(df.filter(fixed.isNull()), self.key, hashed, by, lambda rank, n: F.when(rank <= wanted, "control").otherwise("test_1"), name)
        held = df.filter(fixed.isNotNull()).withColumn(name, F.when(fixed == "control", "control").otherwise("test_1"))
        return held.unionByName(free)


def split_many(df: DataFrame, key: str, seeds: Sequence[int], control_size: float = 0.5, strata: Sequence[str] = ()) -> DataFrame:
    """Two arms for all seeds at once."""
    return Splitter(key, control_size=control_size, strata=tuple(strata)).split_many(df, seeds)
