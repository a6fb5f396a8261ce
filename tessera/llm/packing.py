"""Best-fit packing of documents into token sequences, certified by lower bounds.

Bound-certified repacking. Pieces are dealt to groups of bounded size. Each group is packed by
best-fit decreasing and its bin count compared with lower bounds from dual feasible functions.
A group that meets its bound is certified: only its emptiest sequence stays open. Of the others
all sequences that are not full stay open. Open sequences give up their documents, which are
dealt to new groups of mixed origin and packed again, until one group is left or nothing is won.

Defined results: null text is an empty document (the end token alone); a null id is kept; equal
rows are separate documents; only the id and text columns are read, so others cannot clash; an
empty table gives no rows. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, batches
from .textbytes import chunks, from_arrow, mix
from .units import words
from .wordbpe import cached_units

GROUP = 16_384  # pieces packed in one task
ROUNDS = 8


def token_pieces(df: DataFrame, path: str, capacity: int = 2048, end: int | None = 0, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, lot (a fixed random number), and ids if asked for."""
    df = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [df.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "lot"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * keep_ids

    def work(stream):
        units = cached_units(path)
        seen = 0
        part_no = TaskContext.get().partitionId() if TaskContext.get() else 0
        tail = np.array([] if end is None else [end], np.uint32)
        for batch in batches(stream):
            rows: list[tuple] = []
            for first, _, part in chunks(from_arrow(batch.column("text"))):
                starts, stops = words(part)
                ids, sizes = units.gather(units.slots(part, starts, stops))
                at = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, part.at)]
                for i in range(len(part)):
                    own = np.concatenate([ids[at[i] : at[i + 1]], tail]).astype("<u4")
                    for k, a in enumerate(range(0, max(len(own), 1), capacity)):
                        piece = own[a : a + capacity]
                        rows.append((first + i, k, a, len(piece), zlib.crc32(piece.tobytes()), piece))
            lots = mix(np.arange(seen, seen + len(rows), dtype=np.uint64) + (np.uint64(part_no) << np.uint64(40))).astype(np.int64)
            seen += len(rows)
            which, piece, start, length, crc, ids_ = zip(*rows, strict=True)
            out = [batch.column("doc_id").take(pa.array(which)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(lots)]
            if keep_ids:
                out.append(pa.array([x.astype(np.int32) for x in ids_], pa.list_(pa.field("element", pa.int32(), False))))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return df.mapInArrow(work, T.StructType(fields))


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs; counts[x] items of length x, capacity len(counts) - 1.

    The best of the fractional bound and three families of dual feasible functions (rounding to
    k parts, cutting off at a threshold, and the step function around one half).
    """
    capacity = len(counts) - 1
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    n, x = counts[sizes].astype(float), sizes.astype(float)
    best = (n * x).sum() / capacity
    for k in range(1, 64):
        scaled = sizes * (k + 1)
        even = scaled % capacity == 0
        best = max(best, (n * np.where(even, x / capacity, (scaled // capacity) / k)).sum())
    eps = np.unique(np.r_[np.arange(1, capacity // 2 + 1, max(1, capacity // 256)), sizes[sizes <= capacity // 2], capacity - sizes[sizes >= capacity - capacity // 2]])
    eps = eps[(eps >= 1) & (eps <= capacity // 2)]
    for block in np.array_split(eps, max(1, math.ceil(len(eps) / 256))):
        if not len(block):
            continue
        e = block[:, None]
        cut = np.where(x > capacity - e, 1.0, np.where(x < e, 0.0, x / capacity))
        parts = capacity // e
        step = np.where(2 * x > capacity, 1 - np.floor((capacity - x) / e) / parts, np.where(2 * x == capacity, 0.5, np.floor(x / e) / parts))
        best = max(best, (cut @ n).max(), (step @ n).max())
    return math.ceil(best - 1e-9)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and each bin's fill. Ties keep the given order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    fills: list[int] = []
    for i in order.tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, own = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = own, fills[own]
        fills[own] += size
        if room > size:
            free[room - size].append(own)
            mask |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def _packed_group(capacity: int, number: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "lot"], ascending=False, kind="stable")
        lengths = rows["length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        certified = len(fills) == lower_bound(np.bincount(lengths, minlength=capacity + 1))
        opened = fills < capacity
        if certified and opened.any():
            opened = np.arange(len(fills)) == np.argmin(fills)
        group = rows["group"].to_numpy()
        return rows.assign(sequence_id=(np.int64(number) << 54) | (group << 28) | bins, offset=offsets, opened=opened[bins])

    return work


def pack(pieces: DataFrame, capacity: int = 2048, group: int = GROUP, workspace: Workspace | None = None) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``, a stored table with length and lot."""
    ws = workspace or Workspace(pieces.sparkSession, "packing")
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, *(T.StructField(n, T.LongType()) for n in ("group", "sequence_id", "offset")), T.StructField("opened", T.BooleanType())])
    result = [*names, "sequence_id", "offset"]
    done: list[DataFrame] = []
    rest, before = pieces, None
    for number in range(ROUNDS):
        n = rest.count()
        groups = max(1, math.ceil(n / group))
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("lot", F.lit(number)), F.lit(groups)))
        packed = ws.save(dealt.select(*names, "group").groupBy("group").applyInPandas(_packed_group(capacity, number), schema), f"round{number}")
        bins = packed.select("sequence_id").distinct().count()
        if before is not None and bins >= before:  # nothing won: the earlier packing stands
            done.append(rest.select(result))
            break
        done.append(packed.filter("not opened").select(result))
        rest = packed.filter("opened").select(result)
        before = rest.select("sequence_id").distinct().count()
        if groups == 1 or number == ROUNDS - 1 or not before:
            done.append(rest)
            break
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, end: int | None = 0, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset (see the module)."""
    ws = Workspace(df.sparkSession, "packing")
    pieces = ws.save(token_pieces(df, path, capacity, end, doc_id, text, keep_ids), "pieces")
    return pack(pieces, capacity, workspace=ws).drop("lot")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from a packing made with keep_ids; a group is one sequence, so it is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def certificate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """(sequences used, lower bound over all pieces); collects one count per length, at most ``capacity``."""
    lengths = packed.groupBy("length").count().toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    counts[lengths["length"].to_numpy(int)] = lengths["count"].to_numpy(int)
    return packed.select("sequence_id").distinct().count(), lower_bound(counts)
