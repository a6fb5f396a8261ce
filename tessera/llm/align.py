"""Alignment of two tokenizers over whole texts: overlaps, groups and how common each pairing is.

Both tokenizers read the stream space + text. Byte offsets where tokens of both end cut it into
groups; two tokens whose byte ranges overlap are linked; the count of a pair of ids is the number
of its links in all texts.

1. A task cuts its texts before a space that follows no white space, where no token of
   either tokenizer crosses (checked in the vocabularies), and encodes each distinct unit once. Its
   new units go into DuckDB as two tables of token intervals on one axis: ASOF joins find the first
   and the last overlapping token, a range join lists what lies between, and window sums over the
   common ends number the groups.
2. Texts are dealt to blocks of BLOCK bytes, one text at least. A block gives off its texts with
   their units, and its dictionary: the links of its units, and partial counts of its pairs.
3. Spark adds up the partial counts, takes each B id's highest, and sends every block the counts of
   its own pairs alone, so nothing that grows with the corpus is held in one task or broadcast; a
   common pair is one row of each block.
4. Each block sums the counts over its texts.

Strings of special tokens in a text are plain text. Defined results: null and empty texts, and
those whose joined token bytes differ from space + text, have no tokens: zeros and an empty digest;
rows, repeated ones included, count one by one; other columns stay, clashing names are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import CHARACTERS, _field
from .common import Workspace, batches, unused
from .textbytes import Texts, chunks, from_arrow, ranges, table
from .units import Encoded, spaced_words

BLOCK = 16 << 20
SPACE_ONLY = table(0x20)
MARK = "▁"

#: Token intervals a and b (place, unit, id, first byte, end) -> links of A tokens in order.
LINKS = """
WITH low AS (SELECT a.place, a.unit, a.id, a.stop, b.place AS first FROM a ASOF JOIN b ON a.start >= b.start),
span AS (SELECT low.place, low.unit, low.id, low.first, b.place AS last FROM low ASOF JOIN b ON low.stop > b.start)
SELECT span.unit, span.id AS a, b.id AS b FROM span JOIN b ON b.place BETWEEN span.first AND span.last ORDER BY span.unit
"""

#: The same tables -> the group of each token of one side, numbered along the axis.
GROUPS = """
WITH cut AS (SELECT x.place, CASE WHEN y.stop IS NULL THEN 0 ELSE 1 END AS ends FROM {side} x LEFT JOIN {other} y ON x.stop = y.stop)
SELECT CAST(coalesce(sum(ends) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS grp FROM cut ORDER BY place
"""

#: What follows a token: one of its own side and group, the group's other side, the next group, the next unit.
AFTER = (",", "|", ";", "")
_written: list[bytes] = []


def _told(ids: np.ndarray, units: np.ndarray, groups: np.ndarray, sides: np.ndarray, n: int) -> list[bytes]:
    """The groups of each of n units as text."""
    global _written
    if len(_written) < 4 * (int(ids.max(initial=0)) + 1):
        _written = [f"{i}{c}".encode() for i in range(int(ids.max()) + 1) for c in AFTER]
    order = np.lexsort((sides, groups))  # stable, and tokens come in order
    unit, group, side = units[order], groups[order], sides[order]
    after = np.full(len(order), 3)
    same = unit[1:] == unit[:-1]
    after[:-1][same] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])[same]
    parts = [_written[k] for k in (ids[order] * 4 + after).tolist()]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    edges = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(unit, np.arange(n + 1))].tolist()
    whole = b"".join(parts)
    return [whole[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]


class Pair:
    """The two tokenizers: ids of units, and the bytes of ids."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(byte_path, encoding="utf-8") as f:
            self._a = Tokenizer.from_str(f.read())
        self._a.encode_special_tokens = True
        back = {c: b for b, c in enumerate(CHARACTERS)}
        self.a_bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else None for t, i in self._a.get_vocab().items()}
        with open(piece_path, "rb") as f:
            model = f.read()
        # a later field overrides an earlier one: no space is added, as the stream has it already
        self._b = sentencepiece.SentencePieceProcessor(model_proto=model + _field(3, _field(3, 0)))
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        crossing = [p for i, p in enumerate(pieces) if not self._b.is_byte(i) and MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross a space: {crossing[:3]}")

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self._a.encode_batch_fast(units, add_special_tokens=False)], self._b.encode(units, num_threads=1)


class _Aligned(Encoded):
    """Units with their links (flat: pairs of ids, A in the upper half), token counts and groups."""

    limit = 1 << 62  # cleared between blocks

    def __init__(self, pair: Pair):
        import duckdb

        self._pair = pair
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        super().__init__(self._align)

    def clear(self) -> None:
        self._clear()

    def _clear(self) -> None:
        super()._clear()
        self.good = np.zeros(0, bool)
        self.counts = np.zeros((0, 3), np.int64)  # A tokens, B tokens, groups
        self.told = np.empty(0, object)

    def __len__(self) -> int:
        return len(self.good)

    def _align(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        a_ids, b_ids = self._pair.encode([p.decode() for p in pieces])
        n = len(pieces)
        good = np.zeros(n, bool)
        for k, (p, x, y) in enumerate(zip(pieces, a_ids, b_ids, strict=True)):
            a, b = [self._pair.a_bytes[i] for i in x], [self._pair.b_bytes[i] for i in y]
            good[k] = None not in a and b"".join(a) == p == b"".join(b)
        sides = []
        size = np.array([len(p) for p in pieces], np.int64)
        base = np.cumsum(size) - size
        counts = np.zeros((n, 3), np.int64)
        for s, (ids, of) in enumerate(((a_ids, self._pair.a_bytes), (b_ids, self._pair.b_bytes))):
            own = [x if g else [] for x, g in zip(ids, good, strict=True)]
            counts[:, s] = [len(x) for x in own]
            flat = np.array([i for x in own for i in x], np.int64)
            length = np.array([len(of[i]) for x in own for i in x], np.int64)
            unit = np.repeat(np.arange(n), counts[:, s])
            within = np.cumsum(length) - length
            first = np.cumsum(counts[:, s]) - counts[:, s]
            start = within - np.repeat(within[np.minimum(first, max(len(within) - 1, 0))] if len(within) else base, counts[:, s]) + base[unit]
            sides.append(pa.table({"place": np.arange(len(flat)), "unit": unit, "id": flat, "start": start, "stop": start + length}))
        told = np.empty(n, object)
        told[:] = b""
        links, sizes = np.zeros(0, np.int64), np.zeros(n, np.int64)
        if good.any():
            for name, rows in zip("ab", sides, strict=True):
                self._db.register(name, rows)
            found = self._db.execute(LINKS).fetchnumpy()
            links = found["a"].astype(np.int64) << 32 | found["b"].astype(np.int64)
            sizes = np.bincount(found["unit"].astype(np.int64), minlength=n)
            groups = [self._db.execute(GROUPS.format(side=x, other=y)).fetchnumpy()["grp"] for x, y in ("ab", "ba")]
            unit = np.concatenate([x.column("unit").to_numpy() for x in sides])
            ids = np.concatenate([x.column("id").to_numpy() for x in sides])
            group = np.concatenate(groups).astype(np.int64)
            first = np.flatnonzero(np.r_[True, np.diff(groups[0]) != 0])  # groups never cross units
            counts[:, 2] = np.bincount(unit[first], minlength=n)
            told[:] = _told(ids, unit, group, np.repeat([0, 1], [len(x) for x in sides]), n)
        self._fresh = (good, counts, told)
        return links, sizes

    def _added(self, pieces: list[bytes], slots: np.ndarray) -> None:
        good, counts, told = self._fresh
        self.good, self.counts, self.told = np.concatenate([self.good, good]), np.concatenate([self.counts, counts]), np.concatenate([self.told, told])


@functools.cache
def _aligned(byte_path: str, piece_path: str) -> _Aligned:
    return _Aligned(Pair(byte_path, piece_path))


def _streams(texts: Texts) -> Texts:
    """A space before each text that is not empty."""
    some = (texts.sizes > 0).astype(np.int64)
    at = texts.at + np.concatenate([[0], np.cumsum(some)])
    data = np.full(int(at[-1]), 0x20, np.uint8)
    data[ranges(at[:-1] + some, texts.sizes)] = texts.data
    return Texts(data, at)


LONGS = ("n_a", "n_b", "n_groups", "n_links")
LISTS = {"units": pa.int32(), "times": pa.int32(), "d_units": pa.int32(), "d_sizes": pa.int32(), "d_links": pa.int64(), "pairs": pa.int64(), "partial": pa.int64()}


def _lists(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """A list column; None is null."""
    flat = np.concatenate([x for x in rows if x is not None] or [np.zeros(0, np.int64)])
    sizes = np.array([0 if x is None else len(x) for x in rows], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat).cast(kind), mask=pa.array([x is None for x in rows]))


def align(df: DataFrame, byte_path: str, piece_path: str, text: str = "text", block: int = BLOCK) -> DataFrame:
    """df without ``text``, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    ws = Workspace(df.sparkSession, "align")
    long = T.LongType()
    new = [*(T.StructField(n, long) for n in (*LONGS, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())]
    names = {f.name for f in new} | {text.lower()}
    kept = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name.lower() not in names]
    taken = {f.name.lower() for f in kept} | names
    own = {n: unused(n, taken) for n in ("block", "dictionary", *LISTS)}
    as_spark = {pa.int32(): T.IntegerType(), pa.int64(): long}
    inner = T.StructType([
        T.StructField(own["block"], long), T.StructField(own["dictionary"], T.BooleanType()), *kept, *new[:4], new[6],
        *(T.StructField(own[n], T.ArrayType(as_spark[t])) for n, t in LISTS.items()),
    ])

    def work(stream):
        units = _aligned(byte_path, piece_path)
        part, made, held = TaskContext.get().partitionId(), 0, 0
        used = np.zeros(0, np.int64)
        kinds: list[pa.DataType] = []

        def dictionary() -> pa.RecordBatch:
            """The block's own units, their links, and how often its texts hold each pair."""
            slots = np.flatnonzero(used)
            flat, sizes = units.gather(slots)
            pairs, at = np.unique(flat, return_inverse=True)
            partial = np.bincount(at, np.repeat(used[slots], sizes), minlength=len(pairs)).astype(np.int64)
            lists = [None, None, slots, sizes, flat.astype(np.int64), pairs.astype(np.int64), partial]
            told = [pa.nulls(1, k) for k in kinds] + [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made]), pa.array([True]), *told, *(_lists([x], t) for x, t in zip(lists, LISTS.values(), strict=True))], names=inner.names)

        for batch in batches(stream):
            kinds = [batch.column(f.name).type for f in kept]
            for first, last, texts in chunks(from_arrow(batch.column(text))):
                if held and held + len(texts.data) > block:
                    yield dictionary()
                    made, held, used = made + 1, 0, np.zeros(0, np.int64)
                if not held and len(units) > 600_000:
                    units.clear()
                held += len(texts.data)
                streams = _streams(texts)
                starts, ends = spaced_words(streams, SPACE_ONLY)
                slots = units.slots(streams, starts, ends)
                used = np.concatenate([used, np.zeros(len(units) - len(used), np.int64)])
                bounds = np.searchsorted(starts, streams.at)
                longs, digests, lists = np.zeros((len(texts), 4), np.int64), [], {"units": [], "times": []}
                sizes = units.at[slots + 1] - units.at[slots]
                for i in range(len(texts)):
                    mine = slots[bounds[i] : bounds[i + 1]]
                    if not len(mine) or not units.good[mine].all():
                        mine = mine[:0]
                    digests.append(hashlib.sha256(b";".join(units.told[mine])).hexdigest() if len(mine) else "")
                    longs[i, :3] = units.counts[mine].sum(axis=0)
                    longs[i, 3] = sizes[bounds[i] : bounds[i + 1]].sum() if len(mine) else 0
                    distinct, times = np.unique(mine, return_counts=True)
                    used[distinct] += times
                    lists["units"].append(distinct)
                    lists["times"].append(times)
                rows = batch.slice(first, last - first)
                n = len(texts)
                arrays = [pa.array(np.full(n, part << 32 | made)), pa.array(np.zeros(n, bool)), *(rows.column(f.name) for f in kept), *(pa.array(longs[:, k]) for k in range(4)), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(arrays + [_lists(lists.get(k, [None] * n), t) for k, t in LISTS.items()], names=inner.names)
        if held:
            yield dictionary()

    found = ws.save(df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias(text)).mapInArrow(work, inner), "blocks")
    block_, told = F.col(own["block"]), F.explode(F.arrays_zip(F.col(own["pairs"]).alias("pair"), F.col(own["partial"]).alias("times")))
    partial = found.filter(own["dictionary"]).select(block_.alias("block"), told.alias("p")).select("block", "p.pair", "p.times")
    counts = ws.save(partial.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "counts")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    ranked = counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    values = partial.select("block", "pair").join(ranked, "pair").select("block", "pair", "count", "best")

    def sums(rows: pa.Table, values: pa.Table) -> pa.Table:
        flags = rows.column(own["dictionary"]).to_numpy()
        entry, docs = rows.filter(pa.array(flags)), rows.filter(pa.array(~flags))
        take = lambda t, n: t.column(own[n]).combine_chunks().flatten().to_numpy()
        by_unit = np.zeros((2, 0), np.int64)
        if entry.num_rows:
            pair = values.column("pair").to_numpy()
            order = np.argsort(pair)
            at = order[np.searchsorted(pair, take(entry, "d_links"), sorter=order)] if len(pair) else order
            units, size = take(entry, "d_units"), take(entry, "d_sizes").astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(size)])
            by_unit = np.zeros((2, int(units.max()) + 1 if len(units) else 0), np.int64)
            for k, c in enumerate(("best", "count")):
                total = np.concatenate([[0], np.cumsum(values.column(c).to_numpy().astype(np.int64)[at])])
                by_unit[k, units] = total[edge[1:]] - total[edge[:-1]]
        column = docs.column(own["units"]).combine_chunks()
        size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
        edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        units, times = take(docs, "units"), take(docs, "times").astype(np.int64)
        out = []
        for k in range(2):
            total = np.concatenate([[0], np.cumsum(by_unit[k, units] * times)])
            out.append(pa.array(total[edge[1:]] - total[edge[:-1]]))
        columns = [docs.column(f.name) for f in (*kept, *new[:4])] + out + [docs.column("groups_sha256")]
        return pa.table(columns, names=[f.name for f in (*kept, *new)])

    return found.groupBy(own["block"]).cogroup(values.groupBy("block")).applyInArrow(sums, T.StructType(kept + new))
