"""Nearest-neighbour matching and treatment effects.

Units are treated (group 1) or control (group 0). ``whiten`` maps features to a space where
squared Euclidean distance is Mahalanobis distance; ``nearest`` finds the k nearest units of the
other group; ``effects`` turns matches into ATT, ATC and ATE with standard errors. With ``by``
everything happens within each value of those columns, in one plan whatever their number.

A search is a set of strata, one for each value of ``by`` and direction. A stratum with up to WHOLE
candidates meets as a whole, its queries part by part, through a tree in memory. Larger ones are cut into the cells of a k-d
tree of their own, whose splits come from a bounded sample of all of them. A query meets its
own cell first; the distance found there bounds the search, so it meets only those other cells whose
bounding box is no farther, found by descending the tree. Cells above WHOLE rows meet part by part.
Approximate search trains k-means cells on a sample of bounded size and meets queries only
with their nearest cells. Keys are numbers or texts; ties go to the smaller one, all candidates of
equal distance being compared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors
from ..functions import special
from ..storage import Workspace
from .stats import column

WHOLE = 131_072  # candidates that meet queries at once
PART = 8192  # queries in a meeting
LEAF = 512  # candidates in a cell of a meeting's own tree
DISTANCES = 1 << 22  # that are held at a time
CELL_SAMPLE = 200_000  # rows that k-means cells are trained on
CELL, MOST_CELLS, TREE_SAMPLE = 4096, 65_536, 500_000  # candidates to a cell of a tree, cells of all trees at most, rows that place their splits
STRATUM = ["s", "g"]  # direction (1: treated units ask) and value of ``by``


def whitening(df: DataFrame, group: str, features: Sequence[str], weights: Sequence[float] | None = None) -> np.ndarray:
    """The k x k map T (y = x T') from the mean of both groups' covariances; only moments are collected."""
    k = len(features)
    cells = [(i, j) for i in range(k) for j in range(i + 1)]
    rows = df.filter(column(group).isNotNull()).groupBy(column(group)).agg(*[F.covar_samp(column(features[i]).cast("double"), column(features[j]).cast("double")).alias(f"c{i}_{j}") for i, j in cells]).collect()
    if len(rows) != 2:
        raise errors.NotSuitableFieldError(f"{group} must have two groups, has {len(rows)}")
    total = np.zeros((k, k))
    for row in rows:
        for i, j in cells:
            total[i, j] += (row[f"c{i}_{j}"] or 0.0) / len(rows)
    total = total + np.tril(total, -1).T
    inverse = np.linalg.inv(np.linalg.cholesky(total + 1e-3 * np.eye(k)))
    if weights is not None:
        w = np.asarray(weights, float)
        inverse = inverse * np.sqrt(w / w.sum())[None, :]
    return inverse


def whitened(df: DataFrame, group: str, features: Sequence[str], names: Sequence[str], by: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """Adds ``names``: the features whitened within each value of ``by``; moments of all values come from one aggregate."""
    k = len(features)
    cells = [(i, j) for i in range(k) for j in range(i + 1)]
    covariances = F.array(*[F.coalesce(F.covar_samp(column(features[i]).cast("double"), column(features[j]).cast("double")), F.lit(0.0)) for i, j in cells])
    sides = df.filter(column(group).isNotNull()).groupBy(_stratum(by).alias("g"), column(group).alias("side")).agg(covariances.alias("c"))
    sides = Workspace(df.sparkSession, "whitening").save(sides, "moments")
    lone = sides.groupBy("g").agg(F.count("*").alias("n")).filter("n <> 2").first()
    if lone:
        raise errors.NotSuitableFieldError(f"{group} must have two groups in every part, has {lone['n']} in {lone['g']}")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((k, k))
        for c in rows["c"]:
            for (i, j), v in zip(cells, c, strict=True):
                total[i, j] += v / len(rows)
        total = total + np.tril(total, -1).T
        inverse = np.linalg.inv(np.linalg.cholesky(total + 1e-3 * np.eye(k)))
        if weights is not None:
            w = np.asarray(weights, float)
            inverse = inverse * np.sqrt(w / w.sum())[None, :]
        return pd.DataFrame({"__g": [rows["g"].iloc[0]], "__t": [inverse.ravel()]})

    maps = sides.groupBy("g").applyInPandas(solve, "__g string, __t array<double>")
    made = {n: sum((column(f).cast("double") * F.get("__t", F.lit(i * k + j)) for j, f in enumerate(features)), F.lit(0.0)) for i, n in enumerate(names)}
    return df.withColumn("__own", _stratum(by)).join(maps, F.col("__own") == F.col("__g")).withColumns(made).drop("__own", "__g", "__t")


def linear(df: DataFrame, features: Sequence[str], matrix: np.ndarray, names: Sequence[str]) -> DataFrame:
    """Adds names[i] = sum_j matrix[i, j] * features[j] as plain expressions."""
    made = {n: sum((column(f).cast("double") * F.lit(float(matrix[i, j])) for j, f in enumerate(features)), F.lit(0.0)) for i, n in enumerate(names)}
    return df.withColumns(made)


def key_of(df: DataFrame, key: str) -> Column:
    """Keys as searches carry them: whole numbers as long, all others as text."""
    return column(key).cast("long" if isinstance(df.schema[key].dataType, T.IntegralType) else "string")


def _stratum(by: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[column(c).cast("string").alias(f"c{i}") for i, c in enumerate(by)]), {"ignoreNullFields": "false"}) if by else F.lit("")


def _first(rough: np.ndarray, part: np.ndarray, base: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, d2) of the ``keep`` nearest; rough distances decide who is looked at, exact ones and the order of candidates who is nearer."""
    least = rough.min(axis=1, keepdims=True) if keep == 1 else np.partition(rough, keep - 1, axis=1)[:, keep - 1 : keep]
    slack = 1e-9 * (np.abs(least) + (part * part).sum(axis=1, keepdims=True) + 1e-300)
    near = rough <= least + slack
    upto = np.cumsum(near.sum(axis=1))
    out = []
    at = 0
    while at < len(part):  # crowds of equal distance are compared a few queries at a time
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + DISTANCES // 4, side="right")))
        row, who = np.nonzero(near[at:end])
        d2 = ((base[who] - part[row + at]) ** 2).sum(axis=1)
        order = np.lexsort((who, d2, row))
        row, who, d2 = row[order], who[order], d2[order]
        first = np.flatnonzero(np.r_[True, np.diff(row) > 0])
        kept = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < keep
        out.append((row[kept] + at, who[kept], d2[kept]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _meet(k: int, kind: str):
    """Rows of one meeting (side 0 queries, 1 candidates) -> s, query, match, d2 of the k nearest."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        side, ids = rows["side"].to_numpy(), rows["id"].to_numpy()
        asked = np.flatnonzero(side == 0)
        offered = np.flatnonzero(side == 1)
        if not len(asked) or not len(offered):
            return pd.DataFrame({"s": [], "query": [], "match": [], "d2": []}).astype({"s": "int32", "query": kind, "match": kind, "d2": float})
        x = np.vstack(rows["x"].to_numpy())
        offered = offered[np.argsort(ids[offered], kind="stable")]
        row, who, d2 = _nearest_of(x[asked], x[offered], min(k, len(offered)))
        return pd.DataFrame({"s": rows["s"].iloc[0], "query": ids[asked[row]], "match": ids[offered[who]], "d2": d2})

    return work


def _all_of(queries: np.ndarray, base: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, d2) of the ``keep`` nearest, every pair being looked at."""
    norms, step, out = (base * base).sum(axis=1), max(1, DISTANCES // len(base)), []
    for a in range(0, len(queries), step):
        own = queries[a : a + step]
        row, who, d2 = _first(norms[None, :] - 2 * own @ base.T, own, base, min(keep, len(base)))
        out.append((row + a, who, d2))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _nearest_of(queries: np.ndarray, base: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same through a k-d tree of the candidates: a query's own cell, then the cells in reach."""
    if len(base) <= 2 * LEAF:
        return _all_of(queries, base, keep)
    tree = Tree(base, len(base) // LEAF)
    home = tree.cell_of(base)
    order = np.argsort(home, kind="stable")  # candidates of a cell stay in their order, which decides ties
    edge = np.searchsorted(home[order], np.arange(tree.cells + 1))
    members = [order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    tree.bound({c: (base[m].min(axis=0), base[m].max(axis=0)) for c, m in enumerate(members) if len(m)})

    def visit(row: np.ndarray, cell: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        by = np.argsort(cell, kind="stable")
        out = []
        for part in np.split(by, np.flatnonzero(np.diff(cell[by])) + 1):
            if len(part):
                at, who, d2 = _all_of(queries[row[part]], base[members[cell[part[0]]]], keep)
                out.append((row[part][at], members[cell[part[0]]][who], d2))
        return out

    own = tree.cell_of(queries)
    found = visit(np.arange(len(queries)), own)
    row, _, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
    reach = np.full(len(queries), -np.inf)
    np.maximum.at(reach, row, d2)
    reach[np.bincount(row, minlength=len(queries)) < keep] = np.inf
    near, cell = tree.within(queries, reach)
    other = cell != own[near]
    found += visit(near[other], cell[other])
    row, who, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((who, d2, row))
    row, who, d2 = row[order], who[order], d2[order]
    first = np.flatnonzero(np.r_[True, np.diff(row) > 0])
    kept = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < keep
    return row[kept], who[kept], d2[kept]


def nearest(queries: DataFrame, base: DataFrame, key: str, features: Sequence[str], k: int = 1, mode: str = "auto", cells: int = 1000, probes: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """query, match, d2, rank: the k nearest rows of ``base`` for each row of ``queries``; null features never match.

    ``auto`` is exact at any size; ``cells`` is approximate.
    """
    q, b = (_points(df, key, features, by).select(F.lit(1).alias("s"), "g", "id", "x") for df in (queries, base))
    return _search(q, b, k, mode, cells, probes).drop("s")


def _points(df: DataFrame, key: str, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    x = F.array(*[column(f).cast("double") for f in features])
    return df.select(_stratum(by).alias("g"), key_of(df, key).alias("id"), x.alias("x"), *[column(c) for c in df.columns if c == "__side"]).filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def _search(q: DataFrame, b: DataFrame, k: int, mode: str, cells: int, probes: int) -> DataFrame:
    """s, query, match, d2, rank; q and b are (s, g, id, x)."""
    if mode not in ("auto", "exact", "cells"):
        raise errors.InvalidArgumentError(f"mode {mode!r}")
    sizes = b.groupBy(*STRATUM).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n"), F.max("n")).first()
    if not total[0]:
        raise errors.PairsNotFoundError("there is nothing to match with")
    if mode == "cells":
        met = _by_cells(q, b, k, int(total[0]), max(2, min(cells, int(total[0]) // 100)), probes)
    elif total[1] <= WHOLE:
        whole = F.lit(0).cast("long").alias("cell")
        met = _met(q.select("*", whole), b.select("*", whole), k)
    else:
        met = _by_tree(q, b, k, sizes.filter(F.col("n") > WHOLE))
    best = F.slice(F.array_sort(F.collect_list(F.struct("d2", "match"))), 1, k)  # at most k from each meeting
    return met.groupBy("s", "query").agg(best.alias("m")).select("s", "query", F.posexplode("m")).select("s", "query", F.col("col.match").alias("match"), F.col("col.d2").alias("d2"), (F.col("pos") + 1).alias("rank"))


def _met(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """s, query, match, d2 of the k nearest in each meeting; left: queries, right: candidates, both (s, g, cell, id, x)."""
    cell = [*STRATUM, "cell"]
    many = lambda df, n, size: df.groupBy(*cell).agg(F.ceil(F.count("*") / size).alias(n))
    counts = many(right, "nb", WHOLE).join(many(left, "nq", PART), cell)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    right = right.join(counts, cell).withColumn("b", part("nb")).withColumn("q", spread("nq"))
    left = left.join(counts, cell).withColumn("q", part("nq")).withColumn("b", spread("nb"))
    keys = [*cell, "q", "b"]
    rows = left.withColumn("side", F.lit(0)).select(*keys, "side", "id", "x").unionByName(right.withColumn("side", F.lit(1)).select(*keys, "side", "id", "x"))
    kind = left.schema["id"].dataType.simpleString()
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows are much work, so they are not put together
    return rows.repartition(tasks, *keys).groupBy(*keys).applyInPandas(_meet(k, "int64" if kind == "bigint" else "object"), f"s int, query {kind}, match {kind}, d2 double")


class Tree:
    """A k-d tree: nodes (dimension, value, left, right), the root first; a negative child -c - 1 is cell c."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[list] = []
        self.cells = 0
        self.root = self._grow(points, np.arange(len(points)), cells)

    def _grow(self, points: np.ndarray, rows: np.ndarray, share: int) -> int:
        span = points[rows].max(axis=0) - points[rows].min(axis=0) if len(rows) else np.zeros(1)
        wide = int(span.argmax())
        value = float(np.median(points[rows, wide])) if len(rows) else 0.0
        if share < 2 or len(rows) < 4 or not span[wide]:
            self.cells += 1
            return -self.cells
        own = points[rows, wide]
        if value == own.max():  # most values are the greatest, as of a category's indicator
            value = float(own[own < value].max())
        left = own <= value
        at = len(self.nodes)
        self.nodes.append([wide, value, 0, 0])
        self.nodes[at][2] = self._grow(points, rows[left], share // 2)
        self.nodes[at][3] = self._grow(points, rows[~left], share - share // 2)
        return at

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                wide, value, left, right = self.nodes[node]
                low = points[rows, wide] <= value
                stack += [(left, rows[low]), (right, rows[~low])]
        return out

    def bound(self, boxes: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Boxes of the cells that hold candidates -> boxes of all nodes, cells negative."""
        self.boxes = {-c - 1: box for c, box in boxes.items()}
        for at in range(len(self.nodes) - 1, -1, -1):  # children come behind their node
            found = [self.boxes[c] for c in self.nodes[at][2:] if c in self.boxes]
            if found:
                self.boxes[at] = (np.min([lo for lo, _ in found], axis=0), np.max([hi for _, hi in found], axis=0))

    def within(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells with a box no farther than the row's reach."""
        rows_out, cells_out = [], []
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node not in self.boxes:
                continue
            lo, hi = self.boxes[node]
            far = (np.maximum(np.maximum(lo - points[rows], points[rows] - hi), 0) ** 2).sum(axis=1)
            rows = rows[far <= reach[rows] * (1 + 1e-9)]
            if node < 0:
                rows_out.append(rows)
                cells_out.append(np.full(len(rows), -node - 1))
            elif len(rows):
                stack += [(child, rows) for child in self.nodes[node][2:]]
        none = np.zeros(0, np.int64)
        return np.concatenate([*rows_out, none]), np.concatenate([*cells_out, none])


def _by_tree(q: DataFrame, b: DataFrame, k: int, large: DataFrame) -> DataFrame:
    """s, query, match, d2: k or more candidates for each query, the k nearest ones among them."""
    ws = Workspace(q.sparkSession, "nearest")
    q, b = ws.save(q, "asking"), ws.save(b, "offered")
    held = {(r["s"], r["g"]): r["n"] for r in large.collect()}  # fewer than one for each WHOLE candidates
    total = sum(held.values())
    share = min(1.0, TREE_SAMPLE / total)
    few = F.broadcast(q.sparkSession.createDataFrame(list(held), "s int, g string"))
    drawn = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    sample = b.join(few, STRATUM, "left_semi").filter(drawn).select("s", "g", "x").toPandas()  # about TREE_SAMPLE rows
    size = max(CELL, -(-total // MOST_CELLS))
    forest = {key: Tree(np.vstack(rows["x"].to_numpy()), max(1, held[key] // size)) for key, rows in sample.groupby(STRATUM)}

    def spots(s: pd.Series, g: pd.Series):
        """(tree, rows of a batch) of each stratum that has one."""
        for key, at in pd.DataFrame({"s": s.to_numpy(), "g": g.to_numpy()}).groupby(STRATUM).indices.items():
            if key in forest:
                yield forest[key], at

    @F.pandas_udf("long")
    def cell_of(s: pd.Series, g: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int64)
        for tree, at in spots(s, g):
            out[at] = tree.cell_of(np.vstack(x.iloc[at].to_numpy()))
        return pd.Series(out)

    right = ws.save(b.withColumn("cell", cell_of("s", "g", "x")), "candidates")
    width = range(len(sample["x"].iloc[0]))
    boxes = right.join(few, STRATUM, "left_semi").groupBy(*STRATUM, "cell").agg(F.array(*[F.min(F.col("x")[i]) for i in width]).alias("lo"), F.array(*[F.max(F.col("x")[i]) for i in width]).alias("hi")).toPandas()  # at most MOST_CELLS rows
    for key, rows in boxes.groupby(STRATUM):
        if key in forest:
            forest[key].bound({int(c): (np.array(lo), np.array(hi)) for c, lo, hi in zip(rows["cell"], rows["lo"], rows["hi"], strict=True)})

    @F.pandas_udf("long")
    def own_cell(s: pd.Series, g: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int64)
        for tree, at in spots(s, g):
            points = np.vstack(x.iloc[at].to_numpy())
            found = tree.cell_of(points)
            full = np.array([c for c in range(tree.cells) if -c - 1 in tree.boxes])
            lost = np.flatnonzero(~np.isin(found, full))  # a cell that has no candidate
            for i in lost:
                far = [(np.maximum(np.maximum(lo - points[i], points[i] - hi), 0) ** 2).sum() for lo, hi in (tree.boxes[-c - 1] for c in full)]
                found[i] = full[int(np.argmin(far))]
            out[at] = found
        return pd.Series(out)

    @F.pandas_udf("array<long>")
    def other_cells(s: pd.Series, g: pd.Series, x: pd.Series, cell: pd.Series, reach: pd.Series) -> pd.Series:
        out = [np.zeros(0, np.int64)] * len(x)
        for tree, at in spots(s, g):
            row, found = tree.within(np.vstack(x.iloc[at].to_numpy()), reach.to_numpy()[at])
            other = found != cell.to_numpy()[at][row]
            order = np.argsort(row[other], kind="stable")
            row, found = row[other][order], found[other][order]
            for i, c in zip(at, np.split(found, np.searchsorted(row, np.arange(1, len(at)))), strict=True):
                out[i] = c
        return pd.Series(out)

    left = ws.save(q.withColumn("cell", own_cell("s", "g", "x")), "queries")
    met = ws.save(_met(left, right, k), "met")
    reach = met.groupBy("s", "query").agg(F.array_sort(F.collect_list("d2")).alias("d")).select(F.col("s").alias("t"), "query", F.coalesce(F.get("d", F.lit(k - 1)), F.lit(float("inf"))).alias("reach"))
    more = left.join(reach, (F.col("id") == F.col("query")) & (F.col("s") == F.col("t")), "left")
    more = more.withColumn("cell", F.explode(other_cells("s", "g", "x", "cell", F.coalesce("reach", F.lit(float("inf"))))))
    return met.unionByName(_met(ws.save(more.select(*STRATUM, "cell", "id", "x"), "more"), right, k))


def _by_cells(q: DataFrame, b: DataFrame, k: int, size: int, cells: int, probes: int) -> DataFrame:
    """One set of k-means cells for all strata; a query meets the candidates of its stratum in its nearest cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, CELL_SAMPLE / size)
    sample = b.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    model = KMeans(k=cells, seed=17, maxIter=10, featuresCol="v").fit(sample.select(array_to_vector("x").alias("v")))
    centres = np.array([c for c in model.clusterCenters()])
    probes = min(probes, len(centres))

    @F.pandas_udf("array<int>")
    def nearest_cells(x: pd.Series) -> pd.Series:
        points = np.vstack(x.to_numpy())
        d2 = (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
        return pd.Series(list(np.argsort(d2, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return _met(q.withColumn("cell", F.explode(nearest_cells("x"))), b.withColumn("cell", nearest_cells("x")[0]), k)


SIDES = {"ate": (1, 0), "att": (1,), "atc": (0,)}


def match_both(df: DataFrame, key: str, group: str, features: Sequence[str], k: int = 1, two_sides: bool = True, mode: str = "auto", metric: str | None = None, test_pairs: bool = False, by: Sequence[str] = (), cells: int = 1000, probes: int = 8) -> DataFrame:
    """query, match, d2, rank and treated (1 if the query is).

    Treated units are matched to controls, and back if two_sides; with ``test_pairs`` controls ask
    and treated units are what they are matched with. ``metric`` names the sides instead: att treated
    units alone, atc controls alone, ate both. Both directions, and all values of ``by``, are one search.
    """
    sides = SIDES["ate" if two_sides else "atc" if test_pairs else "att"] if metric is None else SIDES[metric]
    ws = Workspace(df.sparkSession, "units")
    side = column(group).cast("int")
    units = ws.save(_points(df.filter(side.isin(0, 1)).withColumn("__side", side), key, features, by), "units")
    asked = units.filter(F.col("__side").isin(*sides)).select(F.col("__side").alias("s"), "g", "id", "x")
    offered = units.filter((1 - F.col("__side")).isin(*sides)).select((1 - F.col("__side")).alias("s"), "g", "id", "x")
    return _search(asked, offered, k, mode, cells, probes).withColumnRenamed("s", "treated").select("query", "match", "d2", "rank", "treated")


def matched_means(df: DataFrame, key: str, matches: DataFrame, columns: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """df with <column>_matched: the mean over a row's matches, for ``text`` the nearest one's value; rows without a match are left out."""
    base = df.select(key_of(df, key).alias("match"), *[column(c).cast("double").alias(f"__{c}") for c in columns], *[column(c).alias(f"__{c}") for c in text])
    made = [F.avg(f"__{c}").alias(f"{c}_matched") for c in columns] + [F.min_by(f"__{c}", "rank").alias(f"{c}_matched") for c in text]
    means = matches.join(base, "match").groupBy("query").agg(*made)
    return df.join(means, key_of(df, key) == F.col("query")).drop("query")


def bias_coefficients(matched: DataFrame, group: str, target: str, features: Sequence[str]) -> dict[int, np.ndarray]:
    """For each side the least-squares slopes of the matched outcome on the matched features."""
    names = [f"{f}_matched" for f in features]
    y = column(f"{target}_matched")
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = matched.groupBy(column(group).cast("int").alias("g")).agg(*[F.covar_pop(column(names[i]), column(names[j])).alias(f"a{i}_{j}") for i, j in pairs], *[F.covar_pop(column(n), y).alias(f"b{i}") for i, n in enumerate(names)]).collect()
    out = {}
    for row in rows:
        a = np.zeros((k, k))
        for i, j in pairs:
            a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
        out[row["g"]] = np.linalg.lstsq(a, np.array([row[f"b{i}"] or 0.0 for i in range(k)]), rcond=None)[0]
    return out


def bias_slopes(matched: DataFrame, group: str, target: str, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The same slopes for each value of ``by`` and side, as a table (__g, __side, __slopes) of one aggregate."""
    names = [f"{f}_matched" for f in features]
    y = column(f"{target}_matched")
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    at = lambda a, b: F.coalesce(F.covar_pop(a, b), F.lit(0.0))
    found = matched.groupBy(_stratum(by).alias("g"), column(group).cast("int").alias("side")).agg(F.array(*[at(column(names[i]), column(names[j])) for i, j in pairs]).alias("a"), F.array(*[at(column(n), y) for n in names]).alias("b"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b in zip(rows["a"], rows["b"], strict=True):
            whole = np.zeros((k, k))
            for (i, j), v in zip(pairs, a, strict=True):
                whole[i, j] = whole[j, i] = v
            out.append(np.linalg.lstsq(whole, np.asarray(b), rcond=None)[0])
        return pd.DataFrame({"__g": rows["g"], "__side": rows["side"], "__slopes": out})

    return found.groupBy("g").applyInPandas(solve, "__g string, __side int, __slopes array<double>")


def unit_effects(matched: DataFrame, key: str, group: str, target: str, features: Sequence[str] = (), slopes: dict[int, np.ndarray] | DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """id, by, treated, effect: own minus matched outcome of treated units, the reverse for controls, bias-corrected with slopes (of ``bias_coefficients``, or of ``bias_slopes`` for ``by``)."""
    effect = column(target) - column(f"{target}_matched")
    gaps = [column(f"{f}_matched") - column(f) for f in features]
    if isinstance(slopes, DataFrame):
        matched = matched.withColumn("__own", _stratum(by)).join(slopes, (F.col("__own") == F.col("__g")) & (column(group) == F.col("__side")), "left")
        effect = effect + F.coalesce(sum((F.get("__slopes", F.lit(i)) * gap for i, gap in enumerate(gaps)), F.lit(0.0)), F.lit(0.0))
    elif slopes is not None:
        def bias(side: int) -> Column:
            return sum((F.lit(float(b)) * gap for gap, b in zip(gaps, slopes.get(side, []), strict=False)), F.lit(0.0))

        effect = effect + F.when(column(group) == 1, bias(1)).otherwise(bias(0))
    return matched.select(key_of(matched, key).alias("id"), *[column(c) for c in by], column(group).cast("int").alias("treated"), F.when(column(group) == 1, effect).otherwise(-effect).alias("effect"))


def effects(units: DataFrame, matches: DataFrame, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """by, metric (ATT, ATC, ATE), effect_size, standard_error, p_value, ci_lower, ci_upper; one aggregate over the units."""
    used = matches.groupBy(F.col("match").alias("id")).agg((F.count("*") / k).alias("k"))
    u = units.join(used, "id", "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    t, c = F.col("treated") == 1, F.col("treated") == 0
    e, kk = F.col("effect"), F.col("k")
    s = u.groupBy(*[column(c) for c in by]).agg(
        F.count_if(t).alias("nt"), F.count_if(c).alias("nc"), F.avg(F.when(t, e)).alias("att"), F.avg(F.when(c, e)).alias("atc"),
        F.coalesce(F.var_samp(F.when(t, e)), F.lit(0.0)).alias("vc"), F.coalesce(F.var_samp(F.when(c, e)), F.lit(0.0)).alias("vt"),
        F.coalesce(F.sum(F.when(c, kk * kk)), F.lit(0.0)).alias("kc"), F.coalesce(F.sum(F.when(t, kk * kk)), F.lit(0.0)).alias("kt"),
        F.coalesce(F.sum(F.when(c, (1 + kk) * (1 + kk))), F.lit(0.0)).alias("k1c"), F.coalesce(F.sum(F.when(t, (1 + kk) * (1 + kk))), F.lit(0.0)).alias("k1t"),
    )
    nt, nc, vt, vc = (F.col(x) for x in ("nt", "nc", "vt", "vc"))
    rows = [
        ("ATT", F.col("att"), F.sqrt(F.try_divide(F.col("kc") * vt, nt * nt) + F.try_divide(vc, nt))),
        ("ATC", F.col("atc"), F.sqrt(F.try_divide(F.col("kt") * vc, nc * nc) + F.try_divide(vt, nc))),
        ("ATE", F.try_divide(nt * F.col("att") + nc * F.coalesce("atc", F.lit(0.0)), nt + F.when(F.col("atc").isNull(), F.lit(0)).otherwise(nc)), F.try_divide(F.sqrt(F.col("k1c") * vt + F.col("k1t") * vc), nt + nc)),
    ]
    cells = [F.struct(F.lit(m).alias("metric"), size.alias("effect_size"), se.alias("standard_error")) for m, size, se in rows]
    out = s.select(*[column(c) for c in by], F.explode(F.array(*cells)).alias("r")).select(*[column(c) for c in by], "r.*")
    z = F.try_divide(F.col("effect_size"), F.col("standard_error"))
    return out.withColumns({"p_value": special.normal_two_sided_column(z), "ci_lower": F.col("effect_size") - 1.96 * F.col("standard_error"), "ci_upper": F.col("effect_size") + 1.96 * F.col("standard_error")})
