"""N-gram Jaccard join with a token-group matrix.

1. Every text becomes its set of word shingles; equal sets form one class. Counting tokens that
   repeat within tasks gives each token a frequency level (a sketch of fixed size).
2. Tokens are ordered by (level, hash). Two sets that link share at least SHARED tokens (or all
   that must overlap, if fewer) among the first |S| - ceil(t |S|) + SHARED of each. Classes with
   fewer prefix tokens that any other class has, link with nothing and are done.
3. The others are partitioned into groups of similar classes before any comparison: a class goes
   by the least of its most frequent prefix tokens and by the magnitude of its size, so members of a
   cluster of near copies, linked or not, meet in few groups. Groups are cut into blocks of at
   most about BLOCK members and TOKENS tokens.
4. The token-group matrix holds for each block, and for each bucket of hashed tokens, the most
   tokens that any member has there. Summed over the buckets, the lesser of two blocks' entries
   bounds the overlap of any two of their members, before any text is moved.
5. Blocks that share enough prefix tokens and pass the matrix meet in one task, which bounds each
   query's overlap with the other block's token union again and opens the block, as one matrix
   product, only for queries that reach the bound. A cluster of N similar classes thus costs
   N * N / BLOCK rows, not N * N. First every block meets itself and, for each of its tokens, the
   least block that has it; components of those links settle all that lies inside one. Then every
   pair of blocks meets that is not inside one component. The result is exact.

Defined results: null or blank text has an empty set and links with nothing; texts of fewer words
than a shingle have their whole word sequence as the only element; repeated rows link with each
other; null ids keep their rows; only the id and text columns are read, so others cannot clash;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, batches, components
from .textbytes import NON_SPACE, Texts, chunks, from_arrow, mix, release
from .textstats import Words

BLOCK = 256  # members of a block
TOKENS = 1 << 19  # and their tokens, about; one member at least
MEETING_BYTES = 4 << 20  # texts of the meetings that one group of rows holds
COLUMNS = 4096  # tokens in one matrix product
SLOTS = 1 << 20  # of the frequency sketch: one byte each, whatever the input
SHARED = 16  # prefix tokens that two linked sets have in common
LEAST = 32  # documents that make a token frequent
BUCKETS = ((1500, 256), (6000, 1024), (None, 4096))  # columns of the token-group matrix for sets below each size
UNBOUNDED = 65535  # a count that two bytes cannot tell


def shingles(texts: Texts, n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of all sets, ascending, without repeats."""
    words = Words(texts, NON_SPACE, fold=True)
    docs, tokens = [], []
    for k in range(1, n + 1):
        first, hashes = words.grams(k)
        doc = words.doc[first]
        keep = slice(None) if k == n else words.counts[doc] == k
        docs.append(doc[keep])
        tokens.append(mix(hashes[keep] + np.uint64(k)))
    doc, token = np.concatenate(docs), np.concatenate(tokens)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[fresh], token[fresh]


def _sets(column: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of all texts of a column, whose bytes are hashed a chunk at a time."""
    parts = [(first, *shingles(texts, n)) for first, _, texts in chunks(from_arrow(column))]
    return np.concatenate([doc + first for first, doc, _ in parts]), np.concatenate([token for _, _, token in parts])


def _set_hashes(doc: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, hash) of each document's set."""
    size = np.bincount(doc, minlength=n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(token ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    at = np.concatenate([[0], np.cumsum(size)])
    return size, mix((total[at[1:]] - total[at[:-1]]) + size.astype(np.uint64))


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def _overview(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (id, th, size, s) and of tokens that repeat in a task (token, df), in one pass."""
    fields = T.StructType([T.StructField("id", T.StringType()), T.StructField("th", T.LongType()), T.StructField("size", T.LongType()), T.StructField("s", T.LongType()), T.StructField("token", T.LongType()), T.StructField("df", T.LongType())])

    def work(stream):
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches(stream):
            for first, last, texts in chunks(from_arrow(batch.column("text"))):
                doc, token = shingles(texts, n)
                size, own = _set_hashes(doc, token, last - first)
                part = batch.slice(first, last - first)
                none = pa.nulls(last - first, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), _i64(size), _i64(own), none, none], names=fields.names)
                tokens, df = np.unique(token, return_counts=True)
                seen.append((tokens[df > 1], df[df > 1]))
        if seen:
            tokens, inverse = np.unique(np.concatenate([t for t, _ in seen]), return_inverse=True)
            df = np.bincount(inverse, np.concatenate([c for _, c in seen]), minlength=len(tokens)).astype(np.int64)
            tokens, df = tokens[df > 3], df[df > 3]
            none = pa.nulls(len(tokens), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(tokens), pa.string()), none, none, none, _i64(tokens), pa.array(df)], names=fields.names)

    return docs.mapInArrow(work, fields)


def _levels(overview: DataFrame) -> np.ndarray:
    """The sketch: log2 of the documents of each slot's most frequent token."""
    slots = overview.filter("token is not null").groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= LEAST)
    slots = slots.groupBy(F.pmod("token", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.floor(F.log2(F.max("df"))).cast("byte").alias("level")).toPandas()  # at most SLOTS rows
    levels = np.zeros(SLOTS, np.uint8)
    levels[slots["slot"].to_numpy(int)] = slots["level"].to_numpy(int)
    return levels


def _prefixes(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(token, s): the prefix tokens of each set."""

    def work(stream):
        for batch in batches(stream):
            for first, last, texts in chunks(from_arrow(batch.column("text"))):
                doc, token = shingles(texts, n)
                size, own = _set_hashes(doc, token, last - first)
                signed = token.astype(np.int64)
                order = np.lexsort((token, levels[signed % SLOTS], doc))
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                overlap = -(-percent * size // 100)
                keep = nth < (size - overlap + np.minimum(overlap, SHARED))[doc]
                yield pa.RecordBatch.from_arrays([pa.array(signed[order][keep]), _i64(own[doc[keep]])], names=["token", "s"])

    return docs.select("text").mapInArrow(work, "token long, s long")


def _bucket_counts(token: np.ndarray) -> np.ndarray:
    """Tokens of one set in each bucket; more buckets for larger sets, always a power of two."""
    columns = next(c for size, c in BUCKETS if size is None or len(token) < size)
    bucket = (token >> np.uint64(32)).astype(np.int64) & (columns - 1)
    return np.minimum(np.bincount(bucket, minlength=columns), UNBOUNDED).astype("<u2")


def _folded(rows: list[np.ndarray]) -> list[np.ndarray]:
    """The rows at the least number of columns among them, as sums of the finer ones."""
    columns = min(map(len, rows))
    wide = (r.astype(np.int64) for r in rows)
    return [np.where((w == UNBOUNDED).any(), UNBOUNDED, np.minimum(w.reshape(-1, columns).sum(axis=0), UNBOUNDED)) for w in wide]


def _with_counts(texts: DataFrame, n: int) -> DataFrame:
    """(s, text) -> (s, size, counts, text): a class's row of the matrix."""

    def work(stream):
        for batch in batches(stream):
            for first, last, part in chunks(from_arrow(batch.column("text"))):
                doc, token = shingles(part, n)
                at = np.searchsorted(doc, np.arange(last - first + 1))
                counts = [_bucket_counts(token[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([rows.column("s"), _i64(np.diff(at)), pa.array([x.tobytes() for x in counts], pa.binary()), rows.column("text")], names=["s", "size", "counts", "text"])

    return texts.mapInArrow(work, "s long, size long, counts binary, text string")


def _matrix(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """(u, top, second): the largest and second largest count of any member of block u in each bucket."""

    def largest(lists: pd.Series, nth: int) -> pd.Series:
        out = []
        for one in lists:
            rows = np.sort(_folded([np.frombuffer(x, "<u2") for x in one]), axis=0)
            out.append((rows[-nth] if len(rows) >= nth else np.zeros_like(rows[0])).astype("<u2").tobytes())
        return pd.Series(out)

    @F.pandas_udf("binary")
    def top(lists: pd.Series) -> pd.Series:
        return largest(lists, 1)

    @F.pandas_udf("binary")
    def second(lists: pd.Series) -> pd.Series:
        return largest(lists, 2)

    grouped = members.join(profiles, "s").groupBy("u").agg(F.collect_list("counts").alias("all"))
    return grouped.select("u", F.when(F.size("all") == 1, F.col("all")[0]).otherwise(top("all")).alias("top"), F.when(F.size("all") > 1, second("all")).alias("second"))


def _bound(a: bytes, b: bytes, second: bytes | None = None) -> int:
    """Most tokens that a set or member of block a can share with a member of block b, other than itself if ``second`` is given."""
    x, y, *z = _folded([np.frombuffer(r, "<u2") for r in (a, b, second) if r is not None])
    if ((x == UNBOUNDED) & (y == UNBOUNDED)).any():
        return 1 << 40
    return int(np.minimum(x, np.where(x == y, z[0], y) if z else y).sum())


def _qualified(pairs: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of blocks whose bound over the matrix allows a link; lo is the least size of the greater side."""

    @F.pandas_udf("long")
    def bound(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([_bound(a, b) for a, b in zip(first, second, strict=True)], dtype="int64")

    left, right = (matrix.select(F.col("u").alias(side), F.col("top").alias(f"top_{side}")) for side in "ab")
    rows = pairs.join(left, "a").join(right, "b").withColumn("bound", bound("top_a", "top_b"))
    return rows.filter(100 * F.col("bound") >= percent * F.col("lo")).select("a", "b")


def _queries(present: DataFrame, matrix: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Of present (a, b, side, s, size) the queries whose bound over the other block's row of the matrix reaches the threshold."""

    @F.pandas_udf("long")
    def bound(counts: pd.Series, top: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([_bound(a, b, c) for a, b, c in zip(counts, top, second, strict=True)], dtype="int64")

    own = F.col("a") == F.col("b")
    other = present.withColumn("u", F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a")))
    rows = other.join(profiles, "s").join(matrix, "u").withColumn("bound", bound("counts", "top", F.when(own, F.col("second"))))
    return rows.filter(100 * F.col("bound") >= percent * F.col("size")).select("a", "b", "side", "s", "size")


def _incidence(doc: np.ndarray, column: np.ndarray, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns), np.float32)
    out[doc, column] = 1
    return out


def _near(doc: np.ndarray, token: np.ndarray, first: int, last: int, rest: int, percent: int, alone: bool) -> np.ndarray:
    """Which rows of [first, last) link with which of [last, rest), or with each other if ``alone``."""
    size = np.bincount(doc, minlength=rest)
    lo, mid, hi = np.searchsorted(doc, [first, last, rest])
    xd, xt = doc[lo:mid] - first, token[lo:mid]
    yd, yt = (xd, xt) if alone else (doc[mid:hi] - last, token[mid:hi])
    nx, ny = last - first, last - first if alone else rest - last
    sx, sy = size[first:last], size[first:last] if alone else size[last:rest]
    union = np.unique(yt)  # of the group; a query whose overlap with it is too small opens nothing

    def inside(t: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, t), len(known) - 1)] == t if len(known) else np.zeros(len(t), bool)

    if not alone:
        for _ in range(2):
            hit = inside(xt, union)
            go = 100 * np.bincount(xd[hit], minlength=nx) >= percent * sx
            xd, xt = xd[hit & go[xd]], xt[hit & go[xd]]
            known = np.unique(xt)
            hit = inside(yt, known)
            go = 100 * np.bincount(yd[hit], minlength=ny) >= percent * sy
            yd, yt = yd[hit & go[yd]], yt[hit & go[yd]]
            union = np.unique(yt)
        xd, xt = xd[inside(xt, union)], xt[inside(xt, union)]
    both = np.zeros((nx, ny), np.float32)  # counts up to 2 ** 24 are exact
    if len(union) and len(xt):
        cx, cy = np.searchsorted(union, xt), np.searchsorted(union, yt)
        ox, oy = np.argsort(cx, kind="stable"), np.argsort(cy, kind="stable")
        xd, cx, yd, cy = xd[ox], cx[ox], yd[oy], cy[oy]
        for at in range(0, len(union), COLUMNS):
            wide = min(COLUMNS, len(union) - at)
            a, b = np.searchsorted(cx, [at, at + wide]), np.searchsorted(cy, [at, at + wide])
            both += _incidence(xd[a[0] : a[1]], cx[a[0] : a[1]] - at, nx, wide) @ _incidence(yd[b[0] : b[1]], cy[b[0] : b[1]] - at, ny, wide).T
    n = np.rint(both).astype(np.int64)
    return (n > 0) & (100 * n >= percent * (sx[:, None] + sy[None, :] - n))


def _spanning(near: np.ndarray, alone: bool) -> list[tuple[int, int]]:
    """Enough of the links (row, column) to join all that they join; rows and columns count on from each other unless ``alone``."""
    if alone:
        full = near.copy()
        np.fill_diagonal(full, False)
    else:
        nx, ny = near.shape
        full = np.zeros((nx + ny, nx + ny), bool)
        full[:nx, nx:], full[nx:, :nx] = near, near.T
    out, seen = [], np.zeros(len(full), bool)
    for i in np.flatnonzero(full.any(axis=0)):
        if not seen[i]:
            seen[i] = True
            frontier = np.array([i])
            while len(frontier):
                frontier = np.flatnonzero(full[frontier].any(axis=0) & ~seen)
                seen[frontier] = True
                out += [(int(i), int(j)) for j in frontier]
    return out


def _meet(n: int, percent: int):
    """Meetings, rows (a, b, side, s, text): block a (side 0) with block b (side 1), or with itself -> links (a, b) of classes."""

    def work(rows: pa.Table) -> pa.Table:
        a, b, side, s = (rows.column(c).to_numpy() for c in ("a", "b", "side", "s"))
        order = np.lexsort((s, side, b, a))
        a, b, side, s = a[order], b[order], side[order], s[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        left, right = [], []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(s)], strict=True):
            alone = a[lo] == b[lo]
            mid = hi if alone else lo + int(np.count_nonzero(side[lo:hi] == 0))
            doc, token = _sets(rows.column("text").take(pa.array(order[lo:hi])), n)
            near = _near(doc, token, 0, mid - lo, hi - lo, percent, alone)
            release()
            for i, j in _spanning(near, alone):
                left.append(int(s[lo + i]))
                right.append(int(s[lo + j]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return work


def _open_blocks(ws: Workspace, present: DataFrame, matrix: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links found in meetings; present: (a, b, side, s, size), the members that may take part."""
    queries = ws.save(_queries(present, matrix, texts.select("s", "counts"), percent), "queries")
    sides = F.when(F.col("a") == F.col("b"), F.count("*")).otherwise(F.count_distinct("side"))
    present = queries.join(queries.groupBy("a", "b").agg(sides.alias("k")).filter("k > 1").select("a", "b"), ["a", "b"])
    present = ws.save(present, "present")
    total = present.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-8 * total // MEETING_BYTES))  # a shingle takes about 8 bytes of text
    dealt = present.select("a", "b", "side", "s", F.pmod(F.xxhash64("a", "b"), F.lit(parts)).alias("part"))
    return ws.save(dealt.join(texts.select("s", "text"), "s").groupBy("part").applyInArrow(_meet(n, percent), "a long, b long"), "links")


def jaccard_components(df: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row; sets link at ``percent`` hundredths."""
    ws = Workspace(df.sparkSession, "jaccard")
    docs = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("\u0000")).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    overview = ws.save(_overview(docs.select("id", "th", "text"), n), "overview")
    levels = _levels(overview)
    known = overview.filter("s is not null").select("id", "th", "size", "s")

    prefixes = ws.save(_prefixes(docs, n, percent, levels), "prefixes")
    shared = prefixes.groupBy("token").agg(F.min("s").alias("lead"), F.max("s").alias("last")).filter("lead <> last").select("token")
    shared = ws.save(shared, "shared")
    postings = ws.save(prefixes.join(shared, "token").distinct(), "postings")
    ws.drop(prefixes, shared)
    classes = ws.save(known.filter("size > 0").groupBy("s").agg(F.max("size").alias("size"), F.min(F.struct("id", "th")).alias("at")), "classes")
    least = lambda size: F.least(F.lit(SHARED), F.ceil(percent * size / 100))

    able = postings.groupBy("s").agg(F.count("*").alias("held")).join(classes.select("s", "size"), "s").filter(F.col("held") >= least(F.col("size"))).select("s", "size")
    able = ws.save(able, "able")
    postings = postings.join(able, "s")
    level = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token", F.floor(F.log2("df")).cast("int").alias("level"))
    postings = ws.save(postings.join(level, "token"), "levelled")

    top = postings.groupBy("s", "size").agg(F.min(F.struct((-F.col("level")).alias("l"), "token")).alias("top"))
    group = F.xxhash64("top.token", F.floor(F.log2("size")))
    member = ws.save(top.select("s", "size", group.alias("g")), "grouped")
    crowd = member.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / TOKENS)).alias("blocks"))
    member = ws.save(member.join(crowd, "g").select("s", "size", F.xxhash64("g", F.pmod(F.xxhash64("s"), F.col("blocks"))).alias("u")), "member")
    placed = ws.save(postings.select("token", "s").join(member, "s"), "placed")
    blocks = ws.save(placed.groupBy("token", "u").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")), "blocks")

    wanted = classes.join(member.select("s"), "s").select("s", "at.id", "at.th")
    texts = docs.select("id", "th", "text").join(wanted, ["id", "th"]).dropDuplicates(["id", "th"]).select("s", "text")
    texts = ws.save(_with_counts(texts, n), "texts")
    matrix = ws.save(_matrix(member.select("u", "s"), texts.select("s", "counts")), "matrix")

    def shared_enough(rows: DataFrame) -> DataFrame:
        """rows: token, a, b and both blocks' sizes lo, hi, lo_b, hi_b there -> pairs (a, b, lo) that may link."""
        pairs = rows.groupBy("a", "b").agg(F.count("*").alias("held"), *[f(c).alias(c) for f, c in ((F.min, "lo"), (F.min, "lo_b"), (F.max, "hi"), (F.max, "hi_b"))])
        pairs = pairs.filter(100 * F.least("hi", "hi_b") >= percent * F.greatest("lo", "lo_b"))
        # a link's greater set has at least the greater of the two least sizes
        return pairs.filter(F.col("held") >= least(F.least("lo", "lo_b"))).select("a", "b", F.greatest("lo", "lo_b").alias("lo"))

    def able_members(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """(a, b, side, s, size): members of pairs that share enough prefix tokens with the other block; rows: (token, a, b)."""
        tokens = ws.save(rows.select("token", "a", "b").join(pairs, ["a", "b"]), "tokens")
        one, two = (tokens.select("token", "a", "b", F.lit(i).alias("side"), F.col(u).alias("u")) for i, u in enumerate("ab"))
        there = placed.join(one.unionByName(two), ["token", "u"]).groupBy("a", "b", "side", "s", "size").agg(F.count("*").alias("held"))
        return there.filter(F.col("held") >= least(F.col("size"))).drop("held")

    twice = placed.join(blocks.filter("n > 1").select("token", "u"), ["token", "u"]).groupBy("u", "s", "size").agg(F.count("*").alias("held"))
    own = twice.filter(F.col("held") >= least(F.col("size"))).select(F.col("u").alias("a"), F.col("u").alias("b"), F.lit(0).alias("side"), "s", "size")
    lead = blocks.groupBy("token").agg(F.min_by(F.struct("u", "lo", "hi"), "u").alias("x"), F.count("*").alias("k")).filter("k > 1").select("token", F.col("x.u").alias("b"), F.col("x.lo").alias("lo_b"), F.col("x.hi").alias("hi_b"))
    stars = blocks.withColumnRenamed("u", "a").join(lead, "token").filter("a <> b")
    first = ws.save(_qualified(shared_enough(stars), matrix, percent), "first")
    # a star has only the tokens whose least block is b; its members share others too
    held = ws.save(blocks.join(lead.select("token"), "token").groupBy("u").agg(F.collect_list("token").alias("held")), "held")
    one, two = (held.select(F.col("u").alias(side), F.col("held").alias(f"held_{side}")) for side in "ab")
    common = first.join(one, "a").join(two, "b").select("a", "b", F.explode(F.array_intersect("held_a", "held_b")).alias("token"))
    links = _open_blocks(ws, own.unionByName(able_members(first, common)), matrix, texts, n, percent)
    joined = components(links, ws)

    labelled = placed.join(joined.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("c", F.coalesce("component", "s"))
    spread = ws.save(labelled.groupBy("token", "u").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("size").alias("lo"), F.max("size").alias("hi")), "spread")
    mixed = ws.save(spread.groupBy("token").agg(F.min("c0").alias("x"), F.max("c1").alias("y"), F.count("*").alias("k")).filter("x <> y AND k > 1").select("token"), "mixed")
    open_ = ws.save(spread.join(mixed, "token"), "open")
    one, two = open_.withColumnRenamed("u", "a"), open_.select("token", F.col("u").alias("b"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    apart = F.expr("a > b AND NOT (c0 = c1 AND d0 = d1 AND c0 = d0)") & F.expr(f"100 * least(hi, hi_b) >= {percent} * greatest(lo, lo_b)")
    meetings = one.join(two, "token").filter(apart)
    more = ws.save(shared_enough(meetings), "more")
    met = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = ws.save(_qualified(more.join(met, ["a", "b"], "left_anti"), matrix, percent), "rest")
    final = components(links.unionByName(_open_blocks(ws, able_members(more, meetings), matrix, texts, n, percent)), ws)

    graph = known.filter("size > 0").join(final.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("component", F.coalesce("component", "s"))
    ids = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("string"), F.lit("\u0000")).alias("id"), F.xxhash64(F.col(text)).alias("th"))
    labelled = graph.groupBy("id", "th").agg(F.max("size").alias("size"), F.max("component").alias("component"))
    out = ws.save(ids.join(labelled, ["id", "th"], "left"), "labelled")
    first = ws.save(out.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("first")), "first")
    return out.join(first, "component", "left").select("doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))
