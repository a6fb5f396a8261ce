"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors of a label form one class. Classes of a label go through ``trees`` trees: each node
projects its vectors on its own random direction and splits in the middle part; the vectors around
the split (``spill`` of the node on each side) go to both children. Vectors are compared only
within leaves, with cosines in double precision; pairs at or above the threshold are united over
all trees, and links are joined to components.

Splitting cannot separate a group of more than a leaf whose vectors link with each other, so such
groups are finished exactly. In memory, a node whose sampled rows have more links than an eighth
of a leaf on average is compared block by block. Labels above ``node_rows`` first give off their
dense cores: rows that link with a sampled row of more than two leaves of links are compared with
every row in reach, in blocks spread over tasks, and leave the trees with all their links known.

Nodes above ``node_rows`` are split level by level with distributed quantiles, all trees at once;
only the places of vectors in the trees are written at each level, not the vectors;
below it one task grows the rest of a tree in memory, where the links of a node are one bit
matrix, so memory depends on ``node_rows`` alone. A label that fits into one node grows all its
trees in that task.

The search for cores is linear in a label: its n / 1024 pivots meet a sample of SEEN rows at most,
and rows are then compared with CORES cores at most, in as many rounds as find any. In labels above
SEEN rows a group that is a small share of them can escape the sample and is split like others.

Defined results: vectors that are null, zero or hold null or non-finite components, and those
with a null label, link with nothing; repeated rows are vectors of their own that link with each
other; a null vec_id keeps its row; vectors of different length never link; only the id, label
and vector columns are read, so others cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, components

LEAF, NODE_ROWS = 256, 8192
SAMPLE = 64  # rows of a node that tell whether it is dense; a label's sample adds 8 for each node_rows
BLOCK = 2048  # rows on each side of one comparison
SEEN = 65_536  # rows of a label that pivots are compared with
CORES, CANDIDATES = 1024, 4096  # cores of a label in a round, and the pivots that they are chosen from


def _direction(seed: int, tree: int, node: int, size: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, node]).normal(size=size)


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    out = np.vstack(vectors.to_numpy())
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def leaves(vectors: np.ndarray, rows: np.ndarray, tree: int, node: int, leaf: int, spill: float, seed: int, threshold: float):
    """Row sets of the leaves below one node.

    Splits stand where the projections are sparsest between the deciles 0.3 and 0.7, which
    keeps dense groups together; a node whose rows have more links than an eighth of a leaf on
    average is a leaf of any size.
    """
    stack = [(node, rows)]
    while stack:
        node, rows = stack.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        own = vectors[rows]
        sample = np.random.default_rng([seed, tree, node % (1 << 62), 1]).choice(len(rows), min(SAMPLE, len(rows)), replace=False)
        if ((own[sample] @ own.T >= threshold).sum() - len(sample)) * 8 > leaf * len(sample):
            yield rows
            continue
        at = own @ _direction(seed, tree, node % (1 << 62), vectors.shape[1])
        by = np.argsort(at, kind="stable")
        order, at = rows[by], at[by]
        over = max(1, int(len(rows) * spill))
        cuts = np.linspace(0.3, 0.7, 17) * len(rows)
        cuts = cuts[np.argsort(np.abs(cuts - len(rows) / 2), kind="stable")].astype(int)
        cut = cuts[np.argmax(at[cuts + over] - at[cuts - over])]
        stack.append((2 * node, order[: cut + over]))
        stack.append((2 * node + 1, order[cut - over :]))


def linked(vectors: np.ndarray, trees: list[tuple[int, int]], threshold: float, leaf: int, spill: float, seed: int) -> np.ndarray:
    """Symmetric matrix of the links found in leaves of the given (tree, node) pairs; vectors have length 1."""
    n = len(vectors)
    found = np.zeros((n, n), bool)
    whole = False
    for tree, node in trees:
        for rows in leaves(vectors, np.arange(n), tree, node, leaf, spill, seed, threshold):
            own = vectors[rows]
            for at in range(0, len(rows), BLOCK):
                a, b = np.nonzero(own[at : at + BLOCK] @ own.T >= threshold)
                found[rows[a + at], rows[b]] = True
            whole |= len(rows) == n
        if whole:
            break
    found |= found.T  # rounding can differ between the two orders of a product
    np.fill_diagonal(found, False)
    return found


def roots(found: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    n = len(found)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            frontier = np.array([i])
            while len(frontier):
                frontier = np.flatnonzero(found[frontier].any(axis=0) & (root < 0))
                root[frontier] = i
    return root


def _cores(rest: DataFrame, ws: Workspace, threshold: float, leaf: int, node_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """What is exact of the dense cores of ``rest`` (label, dim, cid, m, v): (cid, others, root), and the rows that are in no core.

    A core row links with a dense pivot; all that links with it is within twice the threshold's
    angle of that pivot. Each pair of core row and other row is met in the core row's cell alone.
    """
    label = ["label", "dim"]
    sizes = rest.groupBy(*label).agg(F.count("*").alias("n"))
    chance = F.lit(8.0) / node_rows + F.lit(float(SAMPLE)) / F.col("n")
    draw = lambda what: F.pmod(F.xxhash64("cid", F.lit(what)), F.lit(1 << 30)) / float(1 << 30)
    sized = rest.join(sizes.withColumnRenamed("label", "l").withColumnRenamed("dim", "d"), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))).drop("l", "d")
    chunks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("long")
    at = lambda n: F.pmod(F.xxhash64("cid", F.lit("chunk")), chunks(n)).alias("chunk")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), chunks(n) - 1)).alias("chunk")
    chunked = sized.select(*label, "cid", "m", "v", at(F.col("n")))
    pivots = ws.save(sized.filter(draw("pivot") < chance).select(*label, "cid", "v", "n"), "pivots")
    seen = F.least(F.col("n"), F.lit(SEEN))
    sampled = ws.save(sized.filter(draw("seen") < seen / F.col("n")).select(*label, "cid", "v", at(seen)), "sampled")

    def count(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or own.empty:
            return pd.DataFrame({"pivot": [], "links": []})
        own = own.sort_values("cid", kind="stable")
        near, among = np.zeros(len(own), np.int64), _unit(rows["v"])
        by = _unit(own["v"])
        for at in range(0, len(by), BLOCK):
            near[at : at + BLOCK] = (by[at : at + BLOCK] @ among.T >= threshold).sum(axis=1)
        return pd.DataFrame({"pivot": own["cid"], "links": near})

    key = [*label, "chunk"]
    met = sampled.groupBy(*key).cogroup(pivots.select(*label, "cid", "v", every(seen)).groupBy(*key)).applyInPandas(count, "pivot long, links long")
    told = met.groupBy("pivot").agg(F.sum("links").alias("links")).filter("links > 3")  # few links in a sample can be chance
    dense = pivots.join(told, F.col("cid") == F.col("pivot")).withColumn("links", (F.col("links") * F.col("n") / seen).cast("long")).filter(F.col("links") > 2 * leaf)
    most = Window.partitionBy(*label).orderBy(F.col("links").desc(), "cid")
    dense = ws.save(dense.withColumn("k", F.row_number().over(most)).filter(F.col("k") <= CANDIDATES).select(*label, "cid", "v", "n", "links"), "dense")
    if dense.isEmpty():
        return None

    def apart(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["links", "cid"], ascending=[False, True], kind="stable")
        by, taken = _unit(own["v"]), []
        for i in range(len(by)):
            if len(taken) < CORES and (not taken or (by[taken] @ by[i]).max() < threshold):
                taken.append(i)
        return own.iloc[taken][[*label, "cid", "v", "n"]]

    chosen = ws.save(dense.groupBy(*label).applyInPandas(apart, dense.drop("links").schema), "chosen")
    angle = np.arccos(threshold)

    def place(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """(cid, m, v, cell, home): each row in the cells of the pivots in its reach; home is its core's cell."""
        out = []
        if len(rows) and len(own):
            own = own.sort_values("cid", kind="stable")
            by, ids = _unit(own["v"]), own["cid"].to_numpy()
            for at in range(0, len(rows), 256):
                part = rows.iloc[at : at + 256]
                cosine = _unit(part["v"]) @ by.T
                best = cosine.argmax(axis=1)
                home = np.where(cosine[np.arange(len(part)), best] >= threshold, best, -1)
                i, j = np.nonzero((cosine >= np.cos(min(2 * angle, np.pi)) - 1e-9) | (np.arange(len(by)) == home[:, None]))
                out.append(part.iloc[i][["cid", "m", "v"]].assign(cell=ids[j], home=home[i] == j, core=home[i] >= 0))
        # of labels without a pivot; an empty column must be one of objects to become one of arrays
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype=object) for c in ("cid", "m", "v", "cell", "home", "core")})

    placed = chunked.groupBy(*key).cogroup(chosen.select(*label, "cid", "v", every(F.col("n"))).groupBy(*key))
    placed = ws.save(placed.applyInPandas(place, "cid long, m long, v array<double>, cell long, home boolean, core boolean"), "placed")
    counts = placed.groupBy("cell").agg(F.ceil(F.count_if("home") / BLOCK).alias("nx"), F.ceil(F.count("*") / BLOCK).alias("ny"))
    there = placed.join(counts.withColumnRenamed("cell", "c"), F.col("cell") == F.col("c")).drop("c")
    side = lambda k: F.pmod(F.xxhash64("cid", F.lit("side")), F.col(k))
    spread = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    queries = there.filter("home").select("cell", side("nx").alias("x"), F.explode(spread("ny")).alias("y"), "cid", "m", "v")
    others = there.select("cell", F.explode(spread("nx")).alias("x"), side("ny").alias("y"), "cid", "m", "v", "core")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"cid": [], "others": [], "root": []})
        near = _unit(a["v"]) @ _unit(b["v"]).T >= threshold
        near &= a["cid"].to_numpy()[:, None] != b["cid"].to_numpy()
        own = pd.DataFrame({"cid": a["cid"], "others": near @ b["m"].to_numpy(np.int64)})
        hit = near.any(axis=0)
        # links of a core row are counted in its own cell; another's are told there as 0
        back = np.where(b["core"], 0, a["m"].to_numpy(np.int64) @ near)
        met = pd.DataFrame({"cid": b["cid"][hit], "others": back[hit]})
        return pd.concat([own, met]).assign(root=int(a["cell"].iloc[0]))

    pair = ["cell", "x", "y"]
    others = others.toDF(*others.columns)  # names of its own in the plan
    told = queries.groupBy(*pair).cogroup(others.groupBy(*pair)).applyInPandas(compare, "cid long, others long, root long")
    told = ws.save(told.groupBy("cid", "root").agg(F.sum("others").alias("others")).select("cid", "others", "root"), "exact")
    left = ws.save(rest.join(placed.filter("home").select("cid"), "cid", "left_anti").select(rest.columns), "rest")
    return told, left


def near_duplicates(df: DataFrame, threshold: float = 0.93, trees: int = 12, leaf: int = LEAF, spill: float = 0.06, node_rows: int = NODE_ROWS, seed: int = 17, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    ws = Workspace(df.sparkSession, "forest")
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    own = F.xxhash64("label", "v")
    classes = rows.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("cid", own)
    classes = ws.save(classes, "classes")

    group = ["label", "dim", "tree", "node"]
    nodes = classes.select("cid", "m", "v", "label", F.size("v").alias("dim"))
    above = nodes.groupBy("label", "dim").count().filter(F.col("count") > node_rows).drop("count")
    rest = ws.save(nodes.join(above, ["label", "dim"], "left_semi").select("label", "dim", "cid", "m", "v"), "large")
    small = nodes.join(above, ["label", "dim"], "left_anti").select("label", "dim", "cid", "m", "v")
    exact: list[DataFrame] = []
    while not rest.isEmpty():
        found = _cores(rest, ws, threshold, leaf, node_rows)
        if found is None:
            break
        exact.append(found[0])
        rest = found[1]
    nodes = small.unionByName(rest)
    large = rest.groupBy("label", "dim").count().filter(F.col("count") > node_rows).drop("count")
    all_trees = F.lit(-1).cast("long")
    ready = [nodes.join(large, ["label", "dim"], "left_anti").select("cid", "m", "v", "label", "dim", all_trees.alias("tree"), F.lit(1).cast("long").alias("node"))]
    vectors = ws.save(nodes.join(large, ["label", "dim"], "left_semi").select("cid", "m", "v", "label", "dim"), "vectors")
    open_ = vectors.select("cid", "label", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))).alias("tree"), F.lit(1).cast("long").alias("node"))

    @F.pandas_udf("array<double>")
    def project(v: pd.Series, tree: pd.Series, node: pd.Series) -> pd.Series:
        out: list = [None] * len(v)
        for rows in v.reset_index(drop=True).groupby(v.map(len).to_numpy()).indices.values():
            own, many = _unit(v.iloc[rows]), tree.iloc[rows].map(len).to_numpy()
            owner = np.repeat(np.arange(len(rows)), many)
            places = pd.DataFrame({"t": np.concatenate(tree.iloc[rows].to_list()), "k": np.concatenate(node.iloc[rows].to_list())})
            p = np.zeros(len(owner))
            for (t, k), at in places.groupby(["t", "k"]).indices.items():
                p[at] = own[owner[at]] @ _direction(seed, int(t), int(k) % (1 << 62), own.shape[1])
            for row, part in zip(rows, np.split(p, np.cumsum(many)[:-1]), strict=True):
                out[row] = part
        return pd.Series(out)

    # places (cid and group) in the trees, to which vectors are joined once, at the end; as files they
    # are far smaller than in memory, so their size must not decide that a join sends them to all tasks
    settled: list[DataFrame] = []
    while not open_.isEmpty():
        at = open_.groupBy("cid").agg(F.collect_list(F.struct("tree", "node")).alias("at"))
        projected = vectors.join(at.hint("merge"), "cid").select("cid", "label", "dim", "at", project("v", "at.tree", "at.node").alias("p"))
        projected = projected.select("cid", "label", "dim", F.explode(F.arrays_zip("at", "p")).alias("x"))
        projected = ws.save(projected.select("cid", "label", "dim", "x.at.tree", "x.at.node", "x.p"), "projected")
        cuts = projected.groupBy(*group).agg(F.percentile_approx("p", F.array(F.lit(0.5 - spill), F.lit(0.5 + spill)), 10_000).alias("q"), F.count("*").alias("n"))
        cuts = cuts.withColumn("split", (F.col("n") > node_rows) & (F.col("q")[0] < F.col("q")[1]))
        cuts = ws.save(cuts, "cuts")
        there = projected.join(cuts, group)
        settled.append(ws.save(there.filter("not split").select("cid", *group), "settled"))
        left, right = F.when(F.col("p") <= F.col("q")[1], 2 * F.col("node")), F.when(F.col("p") >= F.col("q")[0], 2 * F.col("node") + 1)
        child = there.filter("split").withColumn("node", F.explode(F.array_compact(F.array(left, right))))
        before, open_ = open_, ws.save(child.select("cid", *group), "open")
        ws.drop(before, projected, cuts)
    if settled:
        placed = settled[0]
        for more in settled[1:]:
            placed = placed.unionByName(more)
        ready.append(placed.hint("merge").join(vectors.select("cid", "m", "v"), "cid").select("cid", "m", "v", *group))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cid", kind="stable")
        vectors = _unit(frame["v"])
        tree, node = int(frame["tree"].iloc[0]), int(frame["node"].iloc[0])
        pairs = [(t, 1) for t in range(trees)] if tree < 0 else [(tree, node)]
        found = linked(vectors, pairs, threshold, leaf, spill, seed)
        cid, m = frame["cid"].to_numpy(), frame["m"].to_numpy(np.int64)
        out = pd.DataFrame({"cid": cid, "root": cid[roots(found)]})
        if tree < 0:  # all of the label's links are here, so their number does
            return out.assign(near=[[]] * len(out), times=[[]] * len(out), others=[int(m[x].sum()) for x in found])
        near = [np.flatnonzero(x) for x in found]
        return out.assign(near=[cid[x] for x in near], times=[m[x] for x in near], others=0)

    pool = ready[0]
    for more in ready[1:]:
        pool = pool.unionByName(more)
    grown = ws.save(pool.groupBy(*group).applyInPandas(grow, "cid long, near array<long>, times array<long>, others long, root long"), "grown")
    for told in exact:
        none = F.array().cast("array<long>")
        grown = grown.unionByName(told.withColumns({"near": none, "times": none}))
    joined = components(grown.select(F.col("cid").alias("a"), F.col("root").alias("b")), ws)
    near = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("near", "times"))))
    links = grown.groupBy("cid").agg(F.aggregate(near, F.lit(0).cast("long"), lambda s, x: s + x["times"]).alias("listed"), F.sum("others").alias("counted"))
    links = links.select("cid", (F.col("listed") + F.col("counted")).alias("others"))
    graph = classes.select("cid", "rep", "m").join(joined.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    first = graph.groupBy("component").agg(F.min("rep").alias("component_id"))
    told = graph.join(first, "component").join(links, "cid").select("cid", "component_id", (F.col("others") + F.col("m") - 1).alias("n_links"))
    out = rows.withColumn("cid", F.when(F.col("v").isNotNull(), own)).select("vec_id", "cid").join(told, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
