"""A quality classifier over document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of the whole
text. Each partition sums its share of the normal equations, the sums are added up in a tree of
bounded fan-in, and ridge weights are solved on the driver (features x features). The sums are kept
by FOLDS folds of the rows, so that each fold can be scored by the weights of the others; isotonic
regression on those binned scores turns them into probabilities.

Defined results: null text counts as empty; null or repeated ids keep their own rows; label rows
without a text or without a label teach nothing; with no label at all every score is 0.5; other
columns never enter a score. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, batches
from .textbytes import Texts, chunks, from_arrow
from .textstats import CONTINUES, DIGIT, PUNCTUATION, STOP, UPPER, WIDE, Words, base_counts, distinct, per_text

FEATURES = 18
FOLDS = 5


def statistics(texts: Texts) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    words = Words(texts)
    base = base_counts(texts, words)
    n, data = len(texts), texts.data
    chars = np.maximum(per_text(~CONTINUES[data], texts), 1)
    count, size = np.maximum(base["n_words"], 1), words.ends - words.starts
    first = data[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    last = data[words.ends - 1] if len(words.starts) else np.zeros(0, np.uint8)
    share = lambda flags: per_text(flags, texts) / chars
    of_words = lambda flags: np.bincount(words.doc, flags, minlength=n) / count
    gram_first, gram = words.grams(4)
    gram_doc = words.doc[gram_first]
    grams = np.maximum(np.bincount(gram_doc, minlength=n), 1)
    mean = np.bincount(words.doc, size, minlength=n) / count
    return np.column_stack([
        np.log1p(base["n_words"]),
        mean,
        np.sqrt(np.maximum(np.bincount(words.doc, size.astype(float) ** 2, minlength=n) / count - mean**2, 0)),
        np.sqrt(base["n_symbols"] / chars),
        share(UPPER[data]),
        np.sqrt(share(DIGIT[data])),
        share(PUNCTUATION[data]),
        share(STOP[data]),
        np.sqrt(per_text(data == 0x21, texts) / chars),
        np.sqrt(per_text(data == 0x7C, texts) / chars),
        share(WIDE[data]),
        base["n_dup_lines"] / np.maximum(base["n_lines"], 1),
        np.log1p(base["n_lines"]),
        1 - distinct(gram_doc, gram, n) / grams,
        distinct(words.doc, words.hashes, n) / count,
        of_words(UPPER[first]),
        of_words(PUNCTUATION[last]),
        of_words(size == 1),
    ])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def expand(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([z, np.ones(len(x))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.ridge(x), *self.knots), 0, 1)


def isotonic(x: np.ndarray, positive: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending x: knots and their non-decreasing rates."""
    blocks: list[list[float]] = []
    for value, p, m in zip(x, positive, n, strict=True):
        blocks.append([value, value, p, m])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, p1, m1 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + p1, blocks[-1][3] + m1]
    knots = np.array([k for lo, hi, p, m in blocks for k in ((lo, p / m), (hi, p / m))])
    keep = np.r_[True, np.diff(knots[:, 0]) > 0]
    return knots[keep, 0], knots[keep, 1]


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by ``stats`` (array<double>)."""
    kept = [f for f in df.schema.fields if f.name.lower() not in (text.lower(), "stats")]

    def work(stream):
        for batch in batches(stream):
            found = np.concatenate([statistics(t) for _, _, t in chunks(from_arrow(batch.column(text)))])
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * FEATURES), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [stats], names=[f.name for f in kept] + ["stats"])

    return df.mapInArrow(work, T.StructType([*kept, T.StructField("stats", T.ArrayType(T.DoubleType()))]))


def _rows(frame: pd.DataFrame) -> np.ndarray:
    return np.vstack(frame["stats"].to_numpy()) if len(frame) else np.zeros((0, FEATURES))


def _added(frames: Iterator[pd.DataFrame] | pd.DataFrame, size: int) -> pd.DataFrame:
    total = np.zeros(size)
    for frame in [frames] if isinstance(frames, pd.DataFrame) else frames:
        for raw in frame["sums"]:
            total += np.frombuffer(raw)
    return pd.DataFrame({"slot": [0], "sums": [total.tobytes()]})


def fit(train: DataFrame, features: int = 256, width: float = 3.0, ridge: float = 1e-4, seed: int = 11) -> QualityModel:
    """train: stats and label (0 or 1). Memory on the driver depends on ``features`` alone."""
    columns = [F.col("stats")[i] for i in range(FEATURES)]
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)], F.count("*").alias("n")).first()
    random = np.random.default_rng(seed)
    if not row["n"]:
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1))
    scale = np.array([row[f"s{i}"] for i in range(FEATURES)])
    model = QualityModel(np.array([row[f"m{i}"] for i in range(FEATURES)]), np.where(scale > 1e-9, scale, 1.0), random.normal(0, 1 / width, (FEATURES, features)), random.uniform(0, 2 * np.pi, features))
    d = features + 1

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, first = np.zeros((FOLDS, d * d + d)), None
        for frame in frames:
            z, y, fold = model.expand(_rows(frame)), frame["label"].to_numpy(float), frame["fold"].to_numpy()
            for k in np.unique(fold):
                own = fold == k
                sums[k, : d * d] += (z[own].T @ z[own]).ravel()
                sums[k, d * d :] += z[own].T @ y[own]
            first = frame["slot"].iloc[0] if first is None and len(frame) else first
        if first is not None:
            yield pd.DataFrame({"slot": [int(first)], "sums": [sums.tobytes()]})

    folded = train.select("stats", "label", F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int").alias("fold"))
    sums = folded.withColumn("slot", F.spark_partition_id()).mapInPandas(partial, "slot long, sums binary")
    for fan in (64, 4):
        sums = sums.withColumn("slot", F.pmod("slot", F.lit(fan))).groupBy("slot").applyInPandas(lambda key, f: _added(f, FOLDS * (d * d + d)).assign(slot=int(key[0])), "slot long, sums binary")
    parts = sum(np.frombuffer(r["sums"]) for r in sums.collect()).reshape(FOLDS, -1)  # at most 4 rows

    def solved(total: np.ndarray) -> np.ndarray:
        penalty = np.eye(d) * ridge * row["n"]
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(total[: d * d].reshape(d, d) + penalty, total[d * d :])

    whole = parts.sum(axis=0)
    fitted = QualityModel(**{**model.__dict__, "weights": solved(whole)})
    others = np.array([solved(whole - part) for part in parts])

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = (model.expand(_rows(frame)) * others[frame["fold"].to_numpy()]).sum(axis=1)
            bins = np.rint(np.clip(scores, -1, 2) * 500).astype(int)
            yield pd.DataFrame({"bin": bins, "label": frame["label"].to_numpy(float)}).groupby("bin", as_index=False).agg(positive=("label", "sum"), n=("label", "size"))

    bins = folded.mapInPandas(binned, "bin long, positive double, n long").groupBy("bin").agg(F.sum("positive").alias("positive"), F.sum("n").alias("n")).toPandas()
    bins = bins.sort_values("bin")  # at most 1,501 rows
    return QualityModel(**{**fitted.__dict__, "knots": isotonic(bins["bin"].to_numpy() / 500, bins["positive"].to_numpy(), bins["n"].to_numpy())})


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """Replaces ``stats`` by ``score``."""
    kept = [f for f in stats.schema.fields if f.name.lower() not in ("stats", "score")]

    def work(stream):
        for batch in batches(stream):
            flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(model.score(flat))], names=[f.name for f in kept] + ["score"])

    return stats.mapInArrow(work, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Rows that never teach: crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", label: str = "quality", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns of ``carry`` for every row of ``docs``; ``labels`` has doc_id and label."""
    ws = Workspace(docs.sparkSession, "quality")
    stats = ws.save(text_statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carry)), "stats")
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label")).filter("label is not null")
    train = ws.save(stats.join(known, "doc_id").filter(~held_out()).select("stats", "label"), "train")
    scored = score(stats, fit(train))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)
