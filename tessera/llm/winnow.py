"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's fingerprints are the least hashes of K-word grams in every sliding window of W grams, the
leftmost of equal ones, so any K + W - 1 = WINDOW consecutive words shared by a document and a
benchmark item select the same gram in both. Fingerprints of both sides are joined; each hit is
extended to the WINDOW-word windows that hold its gram, and those are joined with the items'
windows word by word, so hash collisions never count. Items of fewer words are one window each;
documents give off all their grams of such an item's length.

Fingerprints of documents are stored once; the items' ones, and hits, are tables whose size Spark
knows, so it broadcasts them where they are small and shuffles them where they are not; texts
without hits are left out first where the hashes of those with hits are few. A passage
in a third of the documents is one row on the items' side of either join, however many items hold
it, so a split of its partition is all that skew needs.

Defined results: null text has no words; a null doc_id keeps its row; rows equal in doc_id and text
have equal results; several items with one item_id count as one; items with a null item_id count as
one item that is listed as "null"; only the id and text columns are read, so others cannot clash; an
empty table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

WINDOW, K = 10, 5
KEYS = 1 << 20  # texts with hits, up to which their hashes are broadcast (16 MB)
W = WINDOW - K + 1
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    plain = F.octet_length(text) == F.length(text)  # then lower() changes A-Z alone
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), ""), F.array().cast("array<string>"))  # several times faster than extraction


def _from_zero(n: Column) -> Column:
    """0 .. n - 1; nothing for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _placed_grams(hashes: Column, size: int) -> Column:
    """A gram's hash in the upper half and its place in the lower half, for every gram of ``size`` words."""
    def at(i: Column) -> Column:
        return F.shiftleft(F.hash(*[F.get(hashes, i + j) for j in range(size)]).cast("long"), 32) + i

    return F.transform(_from_zero(F.size(hashes) - size + 1), at)


def fingerprints(df: DataFrame, lengths: tuple[int, ...] = ()) -> DataFrame:
    """df with a column w of words -> n_words, prints (winnowed grams) and g<m> (all m-word grams) for each of ``lengths`` in place of w."""
    hashed = df.withColumns({"n_words": F.size("w"), "h": F.transform("w", lambda x: F.hash(x))})
    hashed = hashed.withColumn("grams", F.when(F.col("n_words") >= WINDOW, _placed_grams(F.col("h"), K)))
    least = F.transform(_from_zero(F.col("n_words") - WINDOW + 1), lambda i: F.least(*[F.get("grams", i + j) for j in range(W)]))
    made = {"prints": F.array_distinct(least)} | {f"g{m}": _placed_grams(F.col("h"), m) for m in lengths}
    return hashed.withColumns(made).drop("w", "h", "grams")


def windows(items: DataFrame) -> DataFrame:
    """items: item, w -> window (its words), size and the sorted items that hold it; one row a window."""
    n = F.size("w")
    each = F.when(n >= WINDOW, F.transform(_from_zero(n - WINDOW + 1), lambda i: F.array_join(F.slice("w", i + 1, WINDOW), " "))).when(n > 0, F.array(F.array_join("w", " ")))
    found = items.select("item", F.least(n, F.lit(WINDOW)).alias("size"), F.explode(each).alias("window"))
    return found.groupBy("window", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted strings) and contaminated of every document."""
    ws = Workspace(docs.sparkSession, "winnow")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), words(F.col(item_text)).alias("w"))
    items = ws.save(items.filter(F.size("w") > 0), "items")
    tests = ws.save(windows(items), "windows")
    lengths = tuple(sorted(r["size"] for r in tests.filter(F.col("size") < WINDOW).select("size").distinct().collect()))  # below WINDOW

    def prints_of(table: DataFrame, kind: str, *columns: str) -> DataFrame:
        placed = table.select(*columns, F.explode(kind).alias("p"))
        return placed.select(*columns, F.shiftright("p", 32).alias("print"), F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"))

    kinds = {"prints": WINDOW} | {f"g{m}": m for m in lengths}
    own = ws.save(fingerprints(items, lengths), "items-prints")
    whole = [own.filter(F.col("n_words") >= WINDOW)] + [own.filter(F.col("n_words") == m) for m in lengths]
    tested = None
    for kind, table in zip(kinds, whole, strict=True):
        one = prints_of(table, kind).select("print", F.lit(kinds[kind]).alias("size")).distinct()
        tested = one if tested is None else tested.unionByName(one)
    tested = ws.save(tested, "tested")

    key = {"id": F.coalesce(F.col(doc_id).cast("string"), F.lit("\u0000")), "th": F.coalesce(F.xxhash64(text), F.lit(0))}
    read = docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in key.items()], words(F.col(text)).alias("w"))
    prints = ws.save(fingerprints(read, lengths), "prints")
    hits = None
    for kind, size in kinds.items():
        one = prints_of(prints, kind, "id", "th", "n_words").join(tested.filter(F.col("size") == size).select("print"), "print", "left_semi")
        first, last = F.greatest(F.col("at") - (W - 1), F.lit(0)), F.least(F.col("at"), F.col("n_words") - WINDOW)
        starts = F.sequence(first, last) if size == WINDOW else F.array("at")
        one = one.select("id", "th", F.struct(F.lit(size).alias("size"), starts.alias("starts")).alias("hit"))
        hits = one if hits is None else hits.unionByName(one)
    hits = ws.save(hits.groupBy("id", "th").agg(F.collect_set("hit").alias("hits")), "hits")

    again = docs.select(*[c.alias(n) for n, c in key.items()], F.col(text).alias("text"))
    if hits.count() <= KEYS:  # then only texts with hits are shuffled, if any
        again = again.join(F.broadcast(hits.select("th").distinct()), "th", "left_semi")
    again = again.join(hits, ["id", "th"])
    again = again.select("id", "th", "hits", words(F.col("text")).alias("w"))
    spots = F.flatten(F.transform("hits", lambda x: F.transform(x["starts"], lambda s: F.struct(s.alias("start"), x["size"].alias("size")))))
    spots = again.select("id", "th", "w", F.array_distinct(spots).alias("spots"))
    spots = spots.select("id", "th", F.explode(F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), F.array_join(F.slice("w", s["start"] + 1, s["size"]), " ").alias("window")))).alias("s"))
    met = spots.select("id", "th", "s.*").join(tests, ["window", "size"])
    found = met.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spots"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))

    def cover(state: Column, s: Column) -> Column:
        end = s["start"] + s["size"]
        fresh = F.greatest(end - F.greatest(s["start"], state["end"]), F.lit(0))
        return F.struct(F.greatest(end, state["end"]).alias("end"), (state["hit"] + fresh).alias("hit"))

    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    found = found.select("id", "th", F.aggregate("spots", nothing, cover, lambda s: s["hit"]).alias("hit"), F.array_sort("items").alias("items"))
    out = prints.select("doc_id", "id", "th", "n_words").join(found, ["id", "th"], "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
tests AS (
  SELECT DISTINCT item, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win
  FROM (SELECT item, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0)),
windows AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win
  FROM d, (SELECT DISTINCT size FROM tests) WHERE len(w) >= size),
met AS (SELECT r, i, size, item FROM windows JOIN tests USING (size, win)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) FROM met) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""
