"""Exact substring dedup with suffix arrays over shards.

Every byte covered by a ``size``-byte string that also starts anywhere else goes, all occurrences
included.

1. Each window of ``size`` bytes owns an anchor, its leftmost least-hashed 64-byte gram. Windows
   in a row with one anchor form a context; each window lies in exactly one context, and equal
   windows have equal anchors, so only contexts of one anchor gram can share a window.
2. Anchor grams that occur once are done. Equal contexts of the others are kept once, with their
   number; a gram with one such context is done as well, as all its windows are repeated. The bytes
   of the others are fetched and dealt to shards by anchor gram.
3. Each shard builds the suffix array of its contexts by induced sorting, computes permuted
   common prefixes, and marks windows whose common prefix with a neighbour reaches ``size``.
   Windows of a context that occurs several times are marked as well.
4. Marked windows go back to the documents, whose covered bytes are cut.

A gram with more than ``hot`` different contexts (a frequent line with different surroundings)
is split by the bytes around it until its parts fit a shard: its contexts are cut into runs of
STEPS[0] windows, keyed by the bytes that all windows of a run share, those of keys that are still
too frequent into runs of STEPS[1], and so on down to single windows, where equal runs are one. Each
cut merges equal runs before they are shuffled, and all of them end in suffix arrays.

``dedup_suffixes`` can count repeats of a smaller size as well (``passage``). Every byte of a
repeat of ``size`` lies in such repeats, so only they are then searched for ``size``.

Rows equal in id and text are searched once, with their number, and all get what was found.

Defined results: null text counts as empty; texts shorter than ``size`` lose nothing; rows, even
equal ones with equal ids, are documents of their own; added columns replace clashing names; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Workspace, batches, unused
from .suffixarray import permuted_common_prefixes, suffix_array
from .textbytes import RangeHash, Texts, chunks, from_arrow, mix, ranges, release

SIZE, GRAM, HOT, SHARD, DEAL = 400, 64, 400, 500_000, 32
STEPS = (16, 4, 1)
PASSAGE = 256  # bytes of fifty words of four letters and their spaces
SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
SPANS_DDL = "array<struct<a:int,b:int>>"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of ``width`` values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def contexts(texts: Texts, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, anchor in it, anchor hash, context hash) of each context."""
    n = len(texts.data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hasher = RangeHash(texts.data)
    grams = hasher.windows(gram)
    bits = np.uint64(32)  # always the same, so that equal windows have equal anchors in any batch; Arrow texts are shorter than 2 ** 31
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(packed, size - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(anchor))
    doc = texts.owner(starts)
    inside = starts + size <= texts.at[doc + 1]
    fresh = inside.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    owner = np.cumsum(fresh) - 1
    windows = np.bincount(owner[inside], minlength=len(first))
    base = texts.at[doc[first]]
    return doc[first], first - base, windows, anchor[first] - base, grams[anchor[first]], hasher(first, first + windows + size - 1)


def repeated_windows(texts: Texts, size: int) -> np.ndarray:
    """For each byte: whether the ``size`` bytes from it, within its text, also start elsewhere in the shard."""
    n = len(texts)
    spaced = np.ones(len(texts.data) + n + 1, np.uint8)  # 1 between texts, 0 at the end, bytes from 2
    place = np.arange(len(texts.data)) + np.repeat(np.arange(n), texts.sizes)
    spaced[place] = texts.data + 2  # UTF-8 never uses the bytes above 0xF4
    spaced[-1] = 0
    sa = suffix_array(spaced)
    common, before = permuted_common_prefixes(spaced, sa)
    hit = common >= size
    both = hit.copy()
    both[before[hit]] = True
    fits = np.arange(len(texts.data)) + size <= np.repeat(texts.at[1:], texts.sizes)
    return both[place] & fits


def _runs(flags: np.ndarray, texts: Texts) -> list[list[dict]]:
    """Runs of flagged bytes of each text, relative to it."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    edge = np.zeros(len(flags) + 1, bool)
    edge[texts.at] = True
    before = np.r_[False, flags[:-1]]
    after = np.r_[flags[1:], False]
    a = np.flatnonzero(flags & (~before | edge[:-1]))
    b = np.flatnonzero(flags & (~after | edge[1:])) + 1
    doc = texts.owner(a)
    for d, x, y in zip(doc.tolist(), (a - texts.at[doc]).tolist(), (b - texts.at[doc]).tolist(), strict=True):
        out[d].append({"a": x, "b": y})
    return out


def _shard(size: int):
    """Arrow rows (k1, k2, times, bytes) -> (k1, k2, spans of marked windows)."""

    def work(rows: pa.Table) -> pa.Table:
        texts = from_arrow(rows.column("bytes"))
        flags = repeated_windows(texts, size)
        many = rows.column("times").to_numpy() > 1
        if many.any():
            fits = np.arange(len(texts.data)) + size <= np.repeat(texts.at[1:], texts.sizes)
            flags |= fits & np.repeat(many, texts.sizes)
        found = _runs(flags, texts)
        some = pa.array([bool(x) for x in found])
        release()
        return pa.table({"k1": rows.column("k1"), "k2": rows.column("k2"), "spans": pa.array(found, SPANS)}).filter(some)

    return work


def _by_shards(ws: Workspace, rows: DataFrame, size: int) -> DataFrame:
    """rows: a stored table (k1, k2, times, bytes). Shards hold about SHARD bytes, and one gram at least.

    Grams are first spread over lots of about DEAL shards each, then laid out in their lot one behind the other.
    """
    grams = ws.save(rows.groupBy("k1").agg(F.sum(F.length("bytes")).alias("held")), "sizes")
    total = grams.agg(F.sum("held")).first()[0] or 0
    lots = max(1, math.ceil(total / (SHARD * DEAL)))
    upto = F.sum("held").over(Window.partitionBy("lot").orderBy("k1").rowsBetween(Window.unboundedPreceding, 0))
    placed = grams.withColumn("lot", F.pmod(F.xxhash64("k1"), F.lit(lots))).withColumn("shard", F.floor((upto - 1) / SHARD))
    dealt = rows.join(placed.select("k1", "lot", "shard"), "k1")
    return dealt.groupBy("lot", "shard").applyInArrow(_shard(size), f"k1 long, k2 long, spans {SPANS_DDL}")


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def _cut_further(rows: DataFrame, size: int, most: int) -> DataFrame:
    """Contexts of hot grams in runs of ``most`` windows: (p1, p2, shift, k1, k2, times, anchor, bytes)."""
    names = ["p1", "p2", "shift", "k1", "k2", "times", "anchor", "bytes"]

    def work(stream):
        for batch in batches(stream):
            for first, last, texts in chunks(from_arrow(batch.column("bytes"))):
                hasher = RangeHash(texts.data)
                part = batch.slice(first, last - first)
                anchor, k1 = part.column("anchor").to_numpy(), part.column("k1").to_numpy()
                windows = texts.sizes - size + 1
                row = np.repeat(np.arange(len(texts)), windows)
                start = ranges(np.zeros(len(texts), np.int64), windows)
                step = (anchor[row] - start) // most
                fresh = np.r_[True, (step[1:] != step[:-1]) | (row[1:] != row[:-1])]
                at = np.flatnonzero(fresh)
                count = np.diff(np.append(at, len(row)))
                row, start, step = row[at], start[at], step[at]
                base = texts.at[row]
                core = base + anchor[row] - most * step
                key = mix(hasher(core, core + size - most + 1) ^ mix(k1[row].astype(np.uint64) + step.astype(np.uint64)))
                lo, hi = base + start, base + start + count + size - 1
                own = hasher(lo, hi) ^ mix((anchor[row] - start).astype(np.uint64))  # equal bytes can hold the key's part at two places
                raw = texts.data.tobytes()
                rows_ = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("k1").take(rows_), part.column("k2").take(rows_), pa.array(start.astype(np.int32)), _i64(key), _i64(own), part.column("times").take(rows_), pa.array((anchor[row] - start).astype(np.int32)), pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())], names=names)

    return rows.mapInArrow(work, "p1 long, p2 long, shift int, k1 long, k2 long, times long, anchor int, bytes binary")


def _hot_spans(ws: Workspace, rows: DataFrame, size: int, hot: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """Marked windows of contexts (k1, k2, times, anchor, bytes) of hot grams."""
    runs = ws.save(_cut_further(rows, size, steps[0]), "runs")
    units = ws.save(runs.groupBy("k1", "k2").agg(F.sum("times").alias("times"), F.any_value("anchor").alias("anchor"), F.any_value("bytes").alias("bytes")), "units")
    keys = ws.save(units.groupBy("k1").agg(F.sum("times").alias("total"), F.count("*").alias("different")).filter("total > 1"), "keys")
    held = units.join(keys, "k1")
    alike = held.filter("different = 1").select("k1", "k2", F.array(F.struct(F.lit(0).alias("a"), (F.length("bytes") - size + 1).alias("b"))).cast(SPANS_DDL).alias("spans"))
    cool = held.filter("different > 1")
    cool = cool if len(steps) == 1 else cool.filter(F.col("different") <= hot)  # single windows of one key are equal
    marked = alike.unionByName(_by_shards(ws, ws.save(cool.select("k1", "k2", "times", "bytes"), "cool"), size))
    if len(steps) > 1:
        still = ws.save(held.filter(F.col("different") > hot).select("k1", "k2", "times", "anchor", "bytes"), "still")
        if not still.isEmpty():
            marked = marked.unionByName(_hot_spans(ws, still, size, hot, steps[1:]))
    marked = ws.save(marked, "marked")
    back = runs.select("p1", "p2", "shift", "k1", "k2").join(marked, ["k1", "k2"])
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("shift")).alias("a"), (s["b"] + F.col("shift")).alias("b")))
    moved = back.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), moved.cast(SPANS_DDL).alias("spans"))
    return moved.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _identity(doc_id: str, text: str) -> tuple[Column, Column]:
    return F.col(doc_id).cast("string"), F.xxhash64(F.col(text))


def _once(docs: DataFrame, ws: Workspace) -> DataFrame:
    """id, th, text -> the same with ``copies``, how many rows there are of an id and text, each kept once.

    Only rows that are repeated are shuffled with their texts, and of those one from each task.
    """
    twice = ws.save(docs.groupBy("id", "th").agg(F.count("*").alias("copies")).filter("copies > 1"), "twice")
    alone = docs.withColumn("copies", F.lit(1).cast("long"))
    if twice.isEmpty():
        return alone
    kept = docs.join(twice.select("id", "th"), ["id", "th"], "left_semi").dropDuplicates(["id", "th"]).join(twice, ["id", "th"])
    kept = ws.save(kept.select(*docs.columns, "copies"), "once")
    return alone.join(twice.select("id", "th"), ["id", "th"], "left_anti").unionByName(kept)


def repeated_spans(docs: DataFrame, size: int = SIZE, hot: int = HOT, workspace: Workspace | None = None) -> DataFrame:
    """docs: id, th, text, copies (each id and th once) -> id, th, spans of repeated window starts, one row per document that has any."""
    ws = workspace or Workspace(docs.sparkSession, "suffix")
    id_type = docs.schema["id"].dataType
    fields = T.StructType([T.StructField("id", id_type), T.StructField("th", T.LongType()), T.StructField("copies", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("lo", "n", "anchor")), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])

    def find(stream):
        for batch in batches(stream):
            for first, _, texts in chunks(from_arrow(batch.column("text"))):
                doc, lo, n, anchor, k1, k2 = contexts(texts, size)
                rows = pa.array(first + doc)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("id", "th", "copies")), *(pa.array(x.astype(np.int32)) for x in (lo, n, anchor - lo)), _i64(k1), _i64(k2)], names=fields.names)

    found = ws.save(docs.mapInArrow(find, fields), "contexts")
    grams = ws.save(found.groupBy("k1").agg(F.sum("copies").alias("c")).filter("c > 1").select("k1"), "grams")
    repeated = ws.save(found.join(grams, "k1"), "repeated")
    ws.drop(found, grams)
    where = F.struct("id", "th", "lo", "n", "anchor")
    distinct = ws.save(repeated.groupBy("k1", "k2").agg(F.sum("copies").alias("times"), F.min(where).alias("at")), "distinct")
    several = distinct.groupBy("k1").agg(F.count("*").alias("c")).filter("c > 1")
    several = ws.save(several.select("k1", (F.col("c") > hot).alias("hot")), "several")
    alike = distinct.join(several, "k1", "left_anti")  # one context, several times: all its windows are repeated
    alike = alike.select("k1", "k2", F.array(F.struct(F.lit(0).alias("a"), F.col("at.n").alias("b"))).cast(SPANS_DDL).alias("spans"))
    wanted = distinct.join(several, "k1").select("at.id", "at.th", F.struct("k1", "k2", "times", "at.lo", "at.n", "at.anchor", "hot").alias("w"))
    wanted = wanted.groupBy("id", "th").agg(F.collect_list("w").alias("w"))

    def fetch(stream):
        for batch in batches(stream):
            lists = batch.column("w")
            w = lists.flatten()
            texts = from_arrow(batch.column("text"))
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            lo, n = w.field("lo").to_numpy(), w.field("n").to_numpy()
            a = texts.at[doc] + lo
            for i in range(0, len(a), 4096):
                part = w.slice(i, 4096)
                raw = [texts.data[x:y].tobytes() for x, y in zip(a[i : i + 4096].tolist(), (a + n + size - 1)[i : i + 4096].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.field("k1"), part.field("k2"), part.field("times"), part.field("anchor"), part.field("hot"), pa.array(raw, pa.binary())], names=["k1", "k2", "times", "anchor", "hot", "bytes"])

    fetched = docs.join(wanted, ["id", "th"]).select("w", "text").mapInArrow(fetch, "k1 long, k2 long, times long, anchor int, hot boolean, bytes binary")
    fetched = ws.save(fetched, "fetched")
    cool = fetched.filter("not hot").select("k1", "k2", "times", "bytes")
    marks = alike.unionByName(_by_shards(ws, cool, size))
    if not several.filter("hot").isEmpty():
        marks = marks.unionByName(_hot_spans(ws, fetched.filter("hot"), size, hot))
    marks = ws.save(marks, "marks")
    ws.drop(fetched, distinct)
    shift = F.transform("spans", lambda s: F.struct((s["a"] + F.col("lo")).alias("a"), (s["b"] + F.col("lo")).alias("b")))
    spans = repeated.join(marks, ["k1", "k2"]).select("id", "th", shift.cast(SPANS_DDL).alias("s"))
    return spans.groupBy("id", "th").agg(F.flatten(F.collect_list("s")).alias("spans"))


def _covered(texts: Texts, counts: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Which bytes lie in a marked window; text i has the next counts[i] of the spans [a, b) of window starts."""
    base = np.repeat(texts.at[:-1], counts)
    steps = np.zeros(len(texts.data) + 1, np.int64)
    np.add.at(steps, base + a, 1)
    np.add.at(steps, base + b + size - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(spans of each row, where its own begin, all a, all b)."""
    counts = np.diff(column.offsets.to_numpy())
    counts = np.where(column.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    flat = column.flatten()
    return counts, np.concatenate([[0], np.cumsum(counts)]), flat.field("a").to_numpy().astype(np.int64), flat.field("b").to_numpy().astype(np.int64)


def _begins(flags: np.ndarray, texts: Texts) -> np.ndarray:
    """Where runs of flagged bytes begin; a text's border ends a run."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[texts.at] = True
    return flags & (~np.r_[False, flags[:-1]] | edge[:-1]) if len(flags) else flags


def _regions(docs: DataFrame, spans: DataFrame, passage: int, size: int) -> DataFrame:
    """(id, th, copies, text): runs of repeats of ``passage`` bytes that are at least ``size`` long; id is start:id."""

    def work(stream):
        for batch in batches(stream):
            counts, at, a, b = _spans_of(batch.column("spans"))
            for first, last, texts in chunks(from_arrow(batch.column("text"))):
                own = slice(at[first], at[last])
                found = _runs(_covered(texts, counts[first:last], a[own], b[own], passage), texts)
                rows = [(first + i, texts.at[i], r["a"], r["b"]) for i, runs in enumerate(found) for r in runs if r["b"] - r["a"] >= size]
                ids = batch.column("id")
                at_row = pa.array([i for i, *_ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{x}:{ids[i].as_py()}" for i, _, x, _ in rows], pa.string()), batch.column("th").take(at_row), batch.column("copies").take(at_row),
                    pa.array([texts.data[z + x : z + y].tobytes() for _, z, x, y in rows], pa.binary()),
                ], names=["id", "th", "copies", "text"])

    return docs.join(spans, ["id", "th"]).select("id", "th", "copies", "text", "spans").mapInArrow(work, "id string, th long, copies long, text binary")


def _in_regions(ws: Workspace, docs: DataFrame, small: DataFrame, passage: int, size: int, hot: int) -> DataFrame:
    """What repeated_spans finds for ``size``, by searching only the repeats of ``passage`` bytes."""
    regions = ws.save(_regions(docs, small, passage, size), "regions")
    found = repeated_spans(regions, size, hot, ws)
    found = found.select("th", "spans", F.substring_index("id", ":", 1).cast("int").alias("start"), F.expr("substring(id, instr(id, ':') + 1)").alias("own"))
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    moved = found.select(F.col("own").alias("id"), "th", moved.cast(SPANS_DDL).alias("spans"))
    return moved.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup_suffixes(df: DataFrame, size: int = SIZE, hot: int = HOT, doc_id: str = "doc_id", text: str = "text", as_text: bool = False, passage: int | None = None) -> DataFrame:
    """Adds kept, n_bytes, n_removed and n_spans; ``text`` stays as it was.

    kept is binary; with ``as_text`` a string without the characters that lost some of their
    bytes, null where ``text`` is null. With ``passage``, a size below ``size``, n_passage_bytes
    counts the bytes that lie in repeats of that size; they stay in ``kept`` unless ``size`` takes them.
    """
    ws = Workspace(df.sparkSession, "suffix")
    id_, th = _identity(doc_id, text)
    id_ = F.coalesce(id_, F.lit("\u0000"))
    docs = _once(df.select(id_.alias("id"), th.alias("th"), F.col(text).alias("text")), ws)
    new = [T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans"))]
    if passage is None:
        spans, small = repeated_spans(docs, size, hot, ws), None
    else:
        if passage > size:
            raise ValueError("passage is larger than size")
        small = ws.save(repeated_spans(docs, passage, hot, ws), "passages")
        spans = _in_regions(ws, docs, small, passage, size, hot)
        new.append(T.StructField("n_passage_bytes", T.LongType()))
    names = {f.name for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    taken = {f.name.lower() for f in kept}
    own_id, own_th, own_spans, own_small = (unused(n, taken) for n in ("id", "th", "spans", "small"))
    joined = df.select(*[F.col(f"`{f.name}`") for f in kept], id_.alias(own_id), th.alias(own_th))
    for found, name in ((spans, own_spans), (small, own_small)):
        if found is not None:
            joined = joined.join(found.select(F.col("id").alias(own_id), F.col("th").alias(own_th), F.col("spans").alias(name)), [own_id, own_th], "left")

    def cut(stream):
        for batch in batches(stream):
            counts, at, a, b = _spans_of(batch.column(own_spans))
            if passage is not None:
                counts2, at2, a2, b2 = _spans_of(batch.column(own_small))
            out, sizes, removed, n_spans, passages = [], [], [], [], []
            for first, last, texts in chunks(from_arrow(batch.column(text))):
                own = slice(at[first], at[last])
                gone = _covered(texts, counts[first:last], a[own], b[own], size)
                left = texts.data[~gone].tobytes()
                ends = np.concatenate([[0], np.cumsum(~gone)])[texts.at]
                out += [left[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                sizes.append(texts.sizes)
                removed.append(texts.sizes - np.diff(ends))
                n_spans.append(np.diff(np.concatenate([[0], np.cumsum(_begins(gone, texts))])[texts.at]))
                if passage is not None:
                    own = slice(at2[first], at2[last])
                    held = _covered(texts, counts2[first:last], a2[own], b2[own], passage)
                    passages.append(np.diff(np.concatenate([[0], np.cumsum(held)])[texts.at]))
            if as_text:
                valid = batch.column(text).is_valid().to_pylist()
                left_over = pa.array([x.decode("utf-8", "ignore") if v else None for x, v in zip(out, valid, strict=True)], pa.string())
            else:
                left_over = pa.array(out, pa.binary())
            longs = [_i64(np.concatenate(x)) for x in (sizes, removed, n_spans, *([passages] if passage is not None else []))]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [left_over] + longs, names=[f.name for f in kept + new])

    return joined.mapInArrow(cut, T.StructType(kept + new))
