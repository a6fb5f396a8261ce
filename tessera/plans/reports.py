"""Results of experiments as flat dictionaries, nested ones and tables of verdicts.

Only result tables are read, which have a row for each feature, group and test; matched pairs and
other tables that grow with the data stay DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import fields, is_dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors

MEASURES = ("control_mean", "test_mean", "difference", "difference_pct")


def _flat(table: DataFrame, name: str | None, keys: tuple[str, ...], sep: str) -> dict[str, Any]:
    """One entry for each row and value: <feature> <name> <measure> <group>."""
    out = {}
    for row in table.collect():
        r = row.asDict()
        lead = [str(r[k]) for k in keys if k != "group" and r.get(k) is not None]
        tail = [str(r["group"])] if "group" in keys else []
        for k, v in r.items():
            if k not in keys:
                out[sep.join([*lead, *([name] if name else []), k.replace("_", " "), *tail])] = v
    return out


def as_dict(output: Any, sep: str = " ") -> dict[str, Any]:
    """An A/B, homogeneity, A/A or matching output, flat. ``sep`` other than a space keeps the parts apart for ``nested``."""
    found: dict[str, Any] = {}
    if hasattr(output, "indexes"):
        keys = tuple(k for k in ("target", "match_group", "metric") if k in output.resume.columns)
        found |= _flat(output.resume, None, keys, sep)
        tests = output.quality
    elif hasattr(output, "best_split"):
        found["best seed"] = output.best_seed
        found |= _flat(output.best_split_statistic.select("feature", "group", *[c for c in MEASURES if c in output.best_split_statistic.columns]), "group-difference", ("feature", "group"), sep)
        tests = output.experiments.filter(F.col("seed") == output.best_seed).drop("seed")
        found |= _flat(output.aa_score.withColumnRenamed("score", "aa score").withColumnRenamed("ok", "aa test"), None, ("feature", "test", "group"), sep)
    else:
        measures = [c for c in MEASURES if c in output.resume.columns]
        if measures:
            found |= _flat(output.resume.select("feature", "group", *measures).dropna(subset=measures), "group-difference", ("feature", "group"), sep)
        if hasattr(output, "sizes"):
            found |= _flat(output.sizes, "group-sizes", ("group",), sep)
        tests = output.tests
    if tests is not None:
        keys = tuple(k for k in ("match_group", "feature", "test", "group") if k in tests.columns)
        found |= _flat(tests.withColumnRenamed("p_value", "p-value"), None, keys, sep)
    return found


def nested(output: Any) -> dict[str, dict[str, dict[str, dict[str, Any]]]]:
    """feature -> group -> test -> measure, for tests and differences."""
    out: dict[str, Any] = {}
    for key, value in as_dict(output, "␟").items():
        parts = key.split("␟")
        if len(parts) == 4:
            feature, test, measure, group = parts
            out.setdefault(feature, {}).setdefault(group, {}).setdefault(test, {})[measure] = value
    return out


def verdicts(tests: DataFrame, significant_is_ok: bool = False) -> DataFrame:
    """One row for each feature and group: ``<test> pass`` (OK or NOT OK) and ``<test> p-value``."""
    names = [r["test"] for r in tests.select("test").distinct().orderBy("test").collect()]  # the tests of one experiment
    good = F.col("pass") if significant_is_ok else ~F.coalesce("pass", F.lit(False))
    verdict = F.when(F.coalesce(good, F.lit(False)), "OK").otherwise("NOT OK")
    made = [c for t in names for c in (F.max(F.when(F.col("test") == t, verdict)).alias(f"{t} pass"), F.max(F.when(F.col("test") == t, F.col("p_value"))).alias(f"{t} p-value"))]
    return tests.groupBy("feature", "group").agg(*made)


def aa_summary(experiments: DataFrame, reliability: float = 0.05) -> DataFrame:
    """feature, group, test, n_splits, passed_share (splits without a significant difference), score, verdict."""
    passed = ~F.coalesce("pass", F.lit(False))
    out = experiments.groupBy("feature", "group", "test").agg(F.count_distinct("seed").alias("n_splits"), F.avg(passed.cast("double")).alias("passed_share"))
    score = 1 - F.abs(F.lit(reliability) - (1 - F.col("passed_share")))
    return out.withColumns({"score": score, "verdict": F.when(score >= 1 - 1.2 * reliability, "OK").otherwise("NOT OK")})


def configured(experiment: Any, params: Mapping[Any, Any]) -> Any:
    """A copy of an experiment or operator with other parameters: {name: value}, or {class: {name: value}} for those of its own class."""
    own: dict[str, Any] = {}
    for key, value in params.items():
        if isinstance(key, type):
            own |= dict(value) if isinstance(experiment, key) else {}
        else:
            own[key] = value
    if not is_dataclass(experiment) or (unknown := set(own) - {f.name for f in fields(experiment)}):
        raise errors.InvalidArgumentError(f"{type(experiment).__name__} has no parameters {sorted(unknown) if is_dataclass(experiment) else ''}")
    return replace(experiment, **own)
