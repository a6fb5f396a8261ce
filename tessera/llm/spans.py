"""Substring dedup by sliding sentence spans.

A sentence is everything up to and including its terminators (. ! ? or a newline) and the
terminators and white space after them; the pieces of a text join up to the text. Every run of
``sentences`` consecutive ones with at least ``min_words`` words is hashed over its words, A-Z
lower-cased. The first occurrence of a run in the order (doc_id, position) stays; sentences
covered by any other occurrence are removed. Two sentences of sixteen words to a run by default: a
shared passage of fifty words need not hold more whole ones, and shorter runs recur by chance.

Runs are hashed once and stored. A hot run (a passage in a third of the documents) is
pre-aggregated before its shuffle and then only joined, with one row on the other side, so that
Spark can split its partition; it is never gathered.

Defined results: null text stays null and has no sentences; a null id sorts first; rows equal in
id and text count as one document; other columns stay, clashing names are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, batches, unused
from .textbytes import LOWER, NON_SPACE, SPACE, RangeHash, Texts, _tables, chunks, from_arrow, grams, mix, runs, table

TERMINATOR = table(*b".!?\n")


def sentence_starts(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all sentences, sentences before each text and in total)."""
    loose = TERMINATOR[texts.data] | SPACE[texts.data]
    a, b = runs(loose, texts)
    ends = np.concatenate([[0], np.cumsum(TERMINATOR[texts.data])])
    inner = b[ends[b] > ends[a]]
    inner = inner[inner < len(texts.data)]
    starts = np.unique(np.concatenate([texts.at[:-1][texts.sizes > 0], inner]))
    return starts, np.searchsorted(starts, texts.at)


def sentence_hashes(texts: Texts, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash over the words, number of words) of each sentence."""
    data = LOWER[texts.data]
    pieces = Texts(data, np.append(starts, len(data)))
    a, b = runs(NON_SPACE[data], pieces)
    words = RangeHash(data)(a, b)
    bounds = np.searchsorted(a, pieces.at)
    powers, inverse = _tables(len(words) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[: len(words)])])
    spread = (sums[bounds[1:]] - sums[bounds[:-1]]) * inverse[bounds[:-1]]
    count = np.diff(bounds)
    return mix(spread + count.astype(np.uint64)), count


def _runs_of(texts: Texts, sentences: int, min_words: int):
    """(document, first sentence in it, hash) of each run that counts."""
    starts, bounds = sentence_starts(texts)
    hashes, words = sentence_hashes(texts, starts)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    found = grams(hashes, sentences)
    m = len(found)
    total = np.concatenate([[0], np.cumsum(words)])
    good = (doc[:m] == doc[sentences - 1 :][:m]) & (total[sentences : sentences + m] - total[:m] >= min_words)
    first = np.flatnonzero(good)
    return doc[first], first - bounds[doc[first]], found[first]


def dedup_spans(df: DataFrame, sentences: int = 2, min_words: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with ``text`` after removal, n_sentences and n_removed."""
    key = F.xxhash64(F.col(doc_id), F.col(text))
    keyed = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), key.alias("key"))
    id_type = df.schema[doc_id].dataType
    fields = T.StructType([T.StructField("id", id_type), T.StructField("key", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("h", T.LongType())])

    def emit(stream):
        for batch in batches(stream):
            for first, _, texts in chunks(from_arrow(batch.column("text"))):
                doc, i, h = _runs_of(texts, sentences, min_words)
                rows = pa.array(first + doc)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("key").take(rows), pa.array(i.astype(np.int32)), pa.array(h.astype(np.int64))], names=fields.names)

    found = Workspace(df.sparkSession, "spans").save(keyed.mapInArrow(emit, fields), "runs")
    here = F.struct("id", "key", "i")
    repeated = found.groupBy("h").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    later = found.join(repeated, "h").filter(here != F.col("first")).select("key", "i")
    spots = later.groupBy("key").agg(F.array_sort(F.collect_set("i")).alias("spots"))

    kept = [f for f in df.schema.fields if f.name.lower() not in (text.lower(), "n_sentences", "n_removed")]
    new = [T.StructField(text, T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]
    taken = {f.name.lower() for f in df.schema.fields}
    own_key, own_spots = unused("key", taken), unused("spots", taken)
    joined = df.withColumn(own_key, key).join(spots.select(F.col("key").alias(own_key), F.col("spots").alias(own_spots)), own_key, "left")

    def cut(stream):
        for batch in batches(stream):
            column = batch.column(text)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            spots = batch.column(own_spots)
            texts_out, n_sentences, n_removed = [], [], []
            for first, last, texts in chunks(from_arrow(column)):
                starts, bounds = sentence_starts(texts)
                ends = np.append(starts[1:], len(texts.data))
                removed = np.zeros(len(starts), bool)
                marks = spots.slice(first, last - first).to_pylist()
                for k, at in enumerate(marks):
                    if at:
                        for s in range(sentences):
                            removed[bounds[k] + np.asarray(at) + s] = True
                keep = np.repeat(~removed, ends - starts)
                left = texts.data[keep].tobytes()
                at = np.concatenate([[0], np.cumsum(keep)])[texts.at]
                texts_out += [left[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n_sentences.append(np.diff(bounds))
                n_removed.append(np.diff(np.concatenate([[0], np.cumsum(removed)])[bounds]))
            arrays = [pa.array(texts_out, pa.string(), mask=~valid), pa.array(np.concatenate(n_sentences)), pa.array(np.concatenate(n_removed).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + arrays, names=[f.name for f in kept + new])

    return joined.mapInArrow(cut, T.StructType(kept + new))


SQL = r"""
WITH pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n][.!?\x20\x09-\x0D]*|[^.!?\n]+') AS p FROM documents)),
words AS (
  SELECT *, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM pieces),
spans AS (
  SELECT doc_id, i, array_to_string(w, ' ') || chr(30) || array_to_string(lead(w) OVER d, ' ') AS span, len(w) + len(lead(w) OVER d) AS c
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) AS r FROM spans WHERE c >= 16),
gone AS (SELECT doc_id, i FROM ranked WHERE r > 1 UNION SELECT doc_id, i + 1 FROM ranked WHERE r > 1),
joined AS (
  SELECT w.doc_id, count(*) AS n_sentences, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN w.piece ELSE '' END, '' ORDER BY w.i) AS kept
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, d.text)) AS kept_sha256
FROM documents d LEFT JOIN joined j ON j.doc_id = d.doc_id
"""
