"""Hard-negative mining by exact inner-product search over rotated vectors.

Vectors become integers, floor(scale * x). For each anchor the best rows of its own label are the
positives; for each positive, the best rows of other labels whose score lies between ``low``
hundredths of the positive's score and that score are the negatives.

Rows are dealt to blocks, anchors to smaller ones, and every block of anchors meets every block of
rows (of its own label for positives) in a task of its own. There the vectors are turned into the
principal axes of a sample, so that leading components hold most of a product: partial products
of those, with the product of the residual norms and the slack of rounding on either side, bound a
score. Pairs whose bounds miss what is still wanted are discarded; the next components are added
for the rest; survivors are verified with integer products. Each meeting gives off its best rows,
and Spark ranks those of all meetings.

The axes come from at most SAMPLE rows of a length of vectors; they are only a rotation, so the
sample decides what is discarded early and never what is found.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part; a null vec_id is no anchor and comes last among ties; equal rows are rows of their own, and
may be each other's positives; vectors of different lengths, and empty ones, never meet; scores
beyond a long are its limits; only the id, label and vector columns are read, so others cannot
clash; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

SAMPLE = 20_000  # rows of a length that place the axes, fewer for long vectors
ROWS = 1 << 22  # components in a block of rows
ANCHORS = 2048  # anchors in a block
CHUNK = 1024  # rows that meet a block of anchors at a time
STAGES = (0.25, 0.5)  # shares of the components after which pairs are discarded
LAST = (1 << 63) - 1


def axes(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose rows are the principal axes, the longest first."""
    return np.linalg.svd(sample.T @ sample)[2]


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows a[i] and b[j] of whole numbers, clipped to longs."""
    if not len(i):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        small = np.sqrt((a * a).sum(axis=1).max()) * np.sqrt((b * b).sum(axis=1).max()) < 2.0**52
    if small and len(i) * 8 > len(a) * len(b):  # every partial sum is a whole number below 2 ** 53, in any order
        return (a @ b.T)[i, j].astype(np.int64)
    if small:
        return np.einsum("ij,ij->i", a[i], b[j]).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a[i], b[j], strict=True)]
    return np.array([max(-LAST - 1, min(LAST, x)) for x in exact], np.int64)


def _best(found: list[tuple[np.ndarray, ...]], keep: int) -> tuple[np.ndarray, ...]:
    """Of (slot, score, id, row) the first ``keep`` of each slot: higher scores, then smaller ids."""
    slot, score, ids, row = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((row, ids, ~score, slot))
    first = np.flatnonzero(np.r_[True, np.diff(slot[order]) != 0]) if len(order) else order
    size = np.diff(np.append(first, len(order)))
    order = order[np.arange(len(order)) - np.repeat(first, size) < keep]
    return slot[order], score[order], ids[order], row[order]


def search(anchors: np.ndarray, rows: np.ndarray, ids: np.ndarray, least: np.ndarray, most: np.ndarray, allowed, keep: int, rotation: np.ndarray) -> tuple[tuple[np.ndarray, ...], int]:
    """The first ``keep`` rows for each anchor and range of scores, and how many pairs were verified.

    least, most: whole numbers, (anchors, ranges); allowed(i, j): which of these pairs count. Slots
    are anchor * ranges + range.
    """
    n, d = anchors.shape
    ranges = least.shape[1]
    cuts = [0, *sorted({max(1, int(d * s)) for s in STAGES} - {d}), d]
    turned = anchors @ rotation.T
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((anchors * anchors).sum(axis=1))
        rest = [np.sqrt((turned[:, c:] ** 2).sum(axis=1)) for c in cuts]
    floor = least.astype(float)  # rises to the keep-th best score of a range
    top = np.where(most.max(axis=1) < LAST, most.max(axis=1).astype(float), np.inf)  # scores are clipped there
    best: list[tuple[np.ndarray, ...]] = []
    verified = 0
    for at in range(0, len(rows), CHUNK):
        own = rows[at : at + CHUNK]
        with np.errstate(over="ignore", invalid="ignore"):  # what overflows is not discarded
            over = own @ rotation.T
            slack = (d + 8) * 1e-15 * norm[:, None] * np.sqrt((own * own).sum(axis=1))[None, :]
            bottom = floor.min(axis=1)
            i = j = partial = None
            for k in range(1, len(cuts) - 1):
                leading = slice(cuts[k - 1], cuts[k])
                left = np.sqrt((over[:, cuts[k] :] ** 2).sum(axis=1))
                if i is None or len(i) * 8 > n * len(own):  # most pairs are left: all at once
                    partial = turned[:, : cuts[k]] @ over[:, : cuts[k]].T
                    bound = rest[k][:, None] * left[None, :] + slack
                    i, j = np.nonzero(~((partial + bound < bottom[:, None]) | (partial - bound > top[:, None])))
                    partial = partial[i, j]
                else:
                    partial = partial + np.einsum("ij,ij->i", turned[i, leading], over[j, leading])
                    bound = rest[k][i] * left[j] + slack[i, j]
                    alive = ~((partial + bound < bottom[i]) | (partial - bound > top[i]))
                    i, j, partial = i[alive], j[alive], partial[alive]
            if i is None:
                i, j = (x.ravel() for x in np.indices((n, len(own))))
        good = allowed(i, j + at)
        i, j = i[good], j[good]
        verified += len(i)
        score = products(anchors, own, i, j)
        for p in range(ranges):
            fits = (score >= least[i, p]) & (score <= most[i, p]) & ~(score < floor[i, p])
            best.append((i[fits] * ranges + p, score[fits], ids[j[fits] + at], j[fits] + at))
        kept = _best(best, keep)
        best = [kept]
        size = np.bincount(kept[0], minlength=n * ranges)
        last = np.cumsum(size) - 1
        full = size >= keep
        floor.ravel()[full] = np.maximum(floor.ravel()[full], kept[1][last[full]])
    none = np.zeros(0, np.int64)
    return (best[0] if best else (none, none, none, none)), verified


def _whole(column: pd.Series, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        made = np.floor(np.vstack(column.to_numpy()) * scale)
    return np.clip(made, -np.finfo(float).max, np.finfo(float).max)


def _blocks(rows: DataFrame, keys: list[str], ws: Workspace, block: int) -> DataFrame:
    """Of each key, how many blocks of rows and of anchors it is dealt to."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") * F.first("dim") / block).alias("nr"), F.ceil(F.count_if("anchor") / ANCHORS).alias("na"))
    return ws.save(counts.filter("na > 0"), "blocks")


def _met(anchors: DataFrame, rows: DataFrame, blocks: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """work(anchors, rows) for each block of anchors and block of rows of equal keys."""
    deal = lambda n: F.pmod(F.xxhash64("rid", F.lit(n)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = anchors.join(blocks, keys).withColumn("a", deal("na")).withColumn("r", every("nr")).drop("na", "nr")
    right = rows.join(blocks, keys).withColumn("r", deal("nr")).withColumn("a", every("na")).drop("na", "nr")
    both = [*keys, "a", "r"]
    right = right.toDF(*right.columns)  # names of its own in the plan
    return left.groupBy(*both).cogroup(right.groupBy(*both)).applyInPandas(work, schema)


def hard_negatives(df: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, every: int = 100, scale: float = 256.0, shift_every: int | None = 7, labels: int = 10, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id ``every`` divides. Where ``shift_every`` divides the id, the label
    moves on by one of ``labels`` first (None: it stays).
    """
    ws = Workspace(df.sparkSession, "negatives")
    own = F.col(label)
    if shift_every:
        own = F.when(F.col(vec_id) % shift_every == 0, (own + 1) % labels).otherwise(own)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), own.alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & (F.size("v") > 0))
    ids = F.coalesce("vec_id", F.lit(LAST))  # null ids come last
    anchor = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    rows = ws.save(rows.select(F.monotonically_increasing_id().alias("rid"), ids.alias("id"), "label", F.size("v").alias("dim"), "v", anchor.alias("anchor")), "rows")
    code = ws.save(rows.select("dim").distinct(), "dims")

    turns: dict[int, np.ndarray] = {}
    few = F.least(F.lit(SAMPLE), F.lit(ROWS) / F.col("dim"))
    share = rows.groupBy("dim").count().select("dim", (few / F.col("count")).alias("share"))
    draw = F.pmod(F.xxhash64("rid", F.lit("axes")), F.lit(1 << 30)) / float(1 << 30)
    wide = code.agg(F.count("*"), F.max("dim")).first()
    if wide[0] and wide[0] <= 8 and wide[1] <= 2048:  # else vectors stay as they are: a rotation is no condition
        for dim in [r["dim"] for r in code.collect()]:
            sample = rows.filter(F.col("dim") == dim).join(share, "dim").filter(draw < F.col("share")).select("v").limit(SAMPLE).toPandas()
            if len(sample):
                with np.errstate(over="ignore", invalid="ignore"):
                    made = _whole(sample["v"], scale)
                    made = made / max(np.abs(made).max(), 1.0)
                turns[int(dim)] = axes(made)

    def rotation(d: int) -> np.ndarray:
        return turns[d] if d in turns else np.eye(d)

    def positive(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if a.empty or r.empty:
            return pd.DataFrame({"anchor": [], "id": [], "rid": [], "score": []})
        x, y = _whole(a["v"], scale), _whole(r["v"], scale)
        mine, theirs = a["rid"].to_numpy(), r["rid"].to_numpy()
        least, most = np.full((len(a), 1), -LAST - 1), np.full((len(a), 1), LAST)
        (slot, score, ids, row), _ = search(x, y, r["id"].to_numpy(), least, most, lambda i, j: mine[i] != theirs[j], positives, rotation(x.shape[1]))
        return pd.DataFrame({"anchor": mine[slot], "id": ids, "rid": theirs[row], "score": score})

    keys = ["dim", "label"]
    anchors = rows.filter("anchor").drop("anchor")
    found = _met(anchors.select("dim", "label", "rid", "v"), rows.select("dim", "label", "rid", "id", "v"), _blocks(rows, keys, ws, block), keys, positive, "anchor long, id long, rid long, score long")
    by = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "rid")
    found = ws.save(found.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= positives), "positives")
    useful = found.filter("score >= 0")  # a negative score is below low hundredths of itself
    useful = useful.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("k", "score"))).alias("p"))  # at most ``positives``
    wanted = anchors.join(useful.withColumnRenamed("anchor", "rid"), "rid")

    def negative(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if a.empty or r.empty:
            return pd.DataFrame({"anchor": [], "k": [], "id": [], "rid": [], "score": []})
        x, y = _whole(a["v"], scale), _whole(r["v"], scale)
        most = np.full((len(a), positives), -1)
        least = np.zeros((len(a), positives), np.int64)
        for i, p in enumerate(a["p"]):
            for s in p:
                most[i, s["k"] - 1] = s["score"]
                least[i, s["k"] - 1] = -(-low * int(s["score"]) // 100)
        mine, theirs = pd.factorize(pd.concat([a["label"], r["label"]]))[0].reshape(-1), r["rid"].to_numpy()
        mine, other = mine[: len(a)], mine[len(a) :]
        (slot, score, ids, row), _ = search(x, y, r["id"].to_numpy(), least, most, lambda i, j: mine[i] != other[j], negatives, rotation(x.shape[1]))
        return pd.DataFrame({"anchor": a["rid"].to_numpy()[slot // positives], "k": slot % positives + 1, "id": ids, "rid": theirs[row], "score": score})

    met = _met(wanted.select("dim", "rid", "label", "v", "p"), rows.select("dim", "rid", "id", "label", "v"), _blocks(rows, ["dim"], ws, block), ["dim"], negative, "anchor long, k int, id long, rid long, score long")
    by = Window.partitionBy("anchor", "k").orderBy(F.col("score").desc(), "id", "rid")
    met = met.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
    met = met.select("anchor", "k", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    known = lambda c: F.nullif(F.col(c), F.lit(LAST))
    told = found.select("anchor", "k", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    out = met.join(told, ["anchor", "k"]).join(anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", known("positive").alias("positive_id"), "rank", known("negative").alias("negative_id"), "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.rid, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) AS k FROM pairs WHERE same) WHERE k <= 5),
negative AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.vec_id, n.rid) AS rank
  FROM positive p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""
