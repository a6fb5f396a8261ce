"""Ranks, positions and running sums over a whole table without sorting it in one task.

Rows are dealt to ordered buckets (hash prefixes, leading characters, or steps of the value range
that are equal in width and on logarithmic scales). Sums over the buckets, which are few, are
accumulated by a window; inside a bucket a window partitioned by it does the rest. The bucket of a
row depends on exact aggregates alone, so it is the same whenever a lost task is computed again.

Sums of buckets are stored before they are joined: Spark then knows how small they are and sends
them to the rows; only where groups are so many that they are not small, it moves the rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import Workspace

def _before(totals: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums of the buckets before each; one small partition for each key."""
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({f"{s}__before": F.coalesce(F.sum(s).over(earlier), F.lit(0)) for s in sums})


def hash_order(key: str, seed: int) -> Column:
    """The random order of rows: md5 of key and seed, equal in every engine."""
    return F.md5(F.concat(F.col(f"`{key}`").cast("string"), F.lit(":"), F.lit(str(seed))))


def hash_rank(df: DataFrame, key: str, seed: int, strata: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """Adds __rank (from 1, by hash_order, ties by key) and __n (rows), both within the strata (nulls are one stratum)."""
    strata = list(strata)
    df = df.withColumn("__hash", hash_order(key, seed)).withColumn("__bucket", F.substring("__hash", 1, digits))
    totals = df.groupBy(*strata, "__bucket").agg(F.count("*").alias("__c"))
    everywhere = Window.partitionBy(*(strata or [F.lit(0)]))
    totals = _before(totals, strata, ["__c"]).withColumn("__n", F.sum("__c").over(everywhere))
    names = [f"__s{i}" for i in range(len(strata))]
    totals = Workspace(df.sparkSession, "ranks").save(totals, "buckets")
    small = totals.select(*[F.col(f"`{s}`").alias(n) for s, n in zip(strata, names, strict=True)], F.col("__bucket").alias("__b"), F.col("__c__before").alias("__off"), "__n")
    cond = F.col("__bucket") == F.col("__b")
    for s, n in zip(strata, names, strict=True):
        cond &= F.col(f"`{s}`").eqNullSafe(F.col(n))
    inside = Window.partitionBy(*strata, "__bucket").orderBy("__hash", F.col(f"`{key}`"))
    ranked = df.join(small, cond).withColumn("__rank", F.row_number().over(inside) + F.col("__off"))
    return ranked.drop("__hash", "__bucket", "__b", "__off", *names)


def hash_labelled(df: DataFrame, key: str, hashed: Column, keys: Sequence[str], label: Callable[[Column, Column], Column], name: str, digits: int = 3) -> DataFrame:
    """Adds ``name`` = label(rank, n): a row's rank (from 1, by ``hashed``, ties by key) and the number of rows, both within ``keys``.

    label must not return to an earlier value as the rank grows. Then it is known from counts of
    hash prefixes wherever a prefix's first and last rank have one label; ranges of such prefixes
    are sent to the rows, a few for each of the keys, and only rows of the few prefixes that hold
    an edge are shuffled and ranked.
    """
    keys = list(keys)
    df = df.withColumn("__hash", hashed).withColumn("__bucket", F.substring("__hash", 1, digits))
    totals = _before(df.groupBy(*[F.col(f"`{k}`") for k in keys], "__bucket").agg(F.count("*").alias("__c")), [f"`{k}`" for k in keys], ["__c"])
    totals = totals.withColumn("__n", F.sum("__c").over(Window.partitionBy(*([F.col(f"`{k}`") for k in keys] or [F.lit(0)]))))
    names = [f"__s{i}" for i in range(len(keys))]
    off, n = F.col("__c__before"), F.col("__n")
    told = totals.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, names, strict=True)], F.col("__bucket").alias("__b"), off.alias("__off"), n, label(off + 1, n).alias("__first"), label(off + F.col("__c"), n).alias("__last"))
    alone = F.when(~F.col("__first").eqNullSafe(F.col("__last")), F.col("__b"))  # prefixes of one label are one range
    ranges = told.groupBy(*names, "__n", "__first", "__last", alone.alias("__alone")).agg(F.min("__b").alias("__from"), F.max("__b").alias("__to"), F.min("__off").alias("__off")).drop("__alone")
    ranges = Workspace(df.sparkSession, "ranks").save(ranges, "ranges")
    cond = F.col("__bucket").between(F.col("__from"), F.col("__to"))
    for k, a in zip(keys, names, strict=True):
        cond &= F.col(f"`{k}`").eqNullSafe(F.col(a))
    joined = df.join(ranges if keys else F.broadcast(ranges), cond)  # without keys a range for each label and edge
    decided = F.col("__first").eqNullSafe(F.col("__last"))
    inside = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "__bucket").orderBy("__hash", F.col(f"`{key}`"))
    edge = joined.filter(~decided).withColumn("__rank", F.row_number().over(inside) + F.col("__off")).withColumn(name, label(F.col("__rank"), F.col("__n"))).drop("__rank")
    out = joined.filter(decided).withColumn(name, F.col("__first")).unionByName(edge)
    return out.drop("__hash", "__bucket", "__from", "__to", "__off", "__n", "__first", "__last", *names)


def hash_prefix_sums(df: DataFrame, key: str, hashed: Column, keys: Sequence[str], sums: Sequence[str], digits: int = 3) -> DataFrame:
    """Adds <s>__earlier for each s: its sum over the rows of the same keys that come before a row by ``hashed`` (ties by key)."""
    keys = list(keys)
    df = df.withColumn("__hash", hashed).withColumn("__bucket", F.substring("__hash", 1, digits))
    totals = _before(df.groupBy(*[F.col(f"`{k}`") for k in keys], "__bucket").agg(*[F.sum(s).alias(s) for s in sums]), keys, sums)
    names = [f"__s{i}" for i in range(len(keys))]
    totals = Workspace(df.sparkSession, "ranks").save(totals, "buckets")
    small = totals.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], F.col("__bucket").alias("__b"), *[f"{s}__before" for s in sums])
    cond = F.col("__bucket") == F.col("__b")
    for k, n in zip(keys, names, strict=True):
        cond &= F.col(f"`{k}`").eqNullSafe(F.col(n))
    inside = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "__bucket").orderBy("__hash", F.col(f"`{key}`")).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(small, cond).withColumns({f"{s}__earlier": F.coalesce(F.sum(s).over(inside), F.lit(0.0)) + F.col(f"{s}__before") for s in sums})
    return out.drop("__hash", "__bucket", "__b", *names, *[f"{s}__before" for s in sums])


def ordered_bucket(value: Column, lo: Column, hi: Column, buckets: int = 1024) -> Column:
    """A struct that never falls as ``value`` grows from lo to hi.

    Equal widths tell apart what is spread evenly; logarithmic steps from zero and from both
    ends what is crowded there. The number of buckets is bounded by the resolution of a double.
    """
    steps = lambda x: F.coalesce(F.floor(F.ln(F.when(x > 0, x)) * 24), F.lit(-20_000))
    share = F.coalesce(F.floor(F.try_divide(value - lo, hi - lo) * buckets), F.lit(0))
    zero = F.when(value < 0, -40_000 - steps(-value)).otherwise(steps(value))
    return F.struct(share.cast("long").alias("a"), zero.cast("long").alias("b"), steps(value - lo).cast("long").alias("c"), (-steps(hi - value)).cast("long").alias("d"))


def cumulative(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], buckets: int = 1024) -> DataFrame:
    """Adds <s>__upto for each s: its sum over rows of the same keys whose ``order`` is not larger.

    ``order`` is numeric or temporal, without nulls and distinct within the keys (aggregate first).
    """
    keys = list(keys)
    ws = Workspace(df.sparkSession, "sums")
    df = ws.save(df, "rows")  # it is read three times
    value = F.col(f"`{order}`").cast("double")
    names = [f"__k{i}" for i in range(len(keys))]

    def same(prefix: Sequence[str]) -> Column:
        cond = F.lit(True)
        for k, n in zip(keys, prefix, strict=True):
            cond &= F.col(f"`{k}`").eqNullSafe(F.col(n))
        return cond

    span = df.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = ws.save(span, "spans") if keys else F.broadcast(span)  # one row, or one of each group
    placed = df.join(span, same(names)) if keys else df.crossJoin(span)
    placed = placed.withColumn("__bucket", ordered_bucket(value, F.col("__lo"), F.col("__hi"), buckets)).drop("__lo", "__hi", *names)
    totals = ws.save(_before(placed.groupBy(*keys, "__bucket").agg(*[F.sum(s).alias(s) for s in sums]), keys, sums), "buckets")
    theirs = [f"__t{i}" for i in range(len(keys))]
    small = totals.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, theirs, strict=True)], F.col("__bucket").alias("__b"), *[f"{s}__before" for s in sums])
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(small, same(theirs) & (F.col("__bucket") == F.col("__b")))
    out = out.withColumns({f"{s}__upto": F.sum(s).over(inside) + F.col(f"{s}__before") for s in sums})
    return out.drop("__bucket", "__b", *theirs, *[f"{s}__before" for s in sums])


def position(df: DataFrame, key: str, name: str, buckets: int = 1024) -> DataFrame:
    """Adds the row's position from 1 in the order of ``key``; equal keys share the last position of theirs."""
    kind = df.schema[key].dataType
    if isinstance(kind, (T.NumericType, T.TimestampType, T.DateType)):
        counts = df.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__key")).agg(F.count("*").alias("__c"))
        placed = cumulative(counts, [], "__key", ["__c"], buckets).select("__key", F.col("__c__upto").alias(name))
        return df.join(placed, F.col(f"`{key}`") == F.col("__key"), "left").drop("__key")
    # strings: buckets by leading characters keep the order; what least and greatest have in common, all have
    ends = df.agg(F.min(F.col(f"`{key}`")), F.max(F.col(f"`{key}`"))).first()
    common = len(os.path.commonprefix([str(e or "") for e in ends]))
    df = df.withColumn("__bucket", F.substring(F.col(f"`{key}`"), 1, common + 3))
    totals = _before(df.groupBy("__bucket").agg(F.count("*").alias("__c")), [], ["__c"]).select(F.col("__bucket").alias("__b"), F.col("__c__before").alias("__off"))
    inside = Window.partitionBy("__bucket").orderBy(F.col(f"`{key}`"))
    out = df.join(totals, F.col("__bucket").eqNullSafe(F.col("__b"))).withColumn(name, F.row_number().over(inside) + F.col("__off"))
    return out.drop("__bucket", "__b", "__off")
