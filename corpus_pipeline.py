"""The corpus pipeline: STAGES over documents, each written as Parquet and read by the next.

1. quality: the classifier is fitted on the labelled documents and rejects scores below 0.3.
2. rules: texts whose repetition is too large are rejected.
3. near duplicates: of each component of similar documents (Jaccard similarity of five-word runs of
   0.80 or more) the smallest doc_id stays; of its different texts the one with the least hash.
4. repeated substrings of 256 bytes (fifty words of four letters and their spaces) are cut out of
   the texts.
5. packing into sequences of 2,048 tokens.

Stages 1 to 4 return the columns of documents; stage 4 replaces text and n_chars (a character
that loses some of its bytes goes altogether). Nulls, empty texts, repeated rows and empty tables
are handled as the operators define. Verdicts are of rows, told apart by doc_id and text: a doc_id on
two texts is two documents, and a row with a null doc_id is rejected like any other but never
dropped as a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, read
from tessera.llm.jaccard import jaccard_components
from tessera.llm.packing import pack_documents
from tessera.llm.quality import classify
from tessera.llm.repetition import judge
from tessera.llm.suffix_dedup import PASSAGE, dedup_suffixes

THRESHOLD = 0.3
HASH, OWN = "_text_hash", "_own_row"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject."""
    hashed = docs.withColumn(HASH, F.xxhash64("text"))
    rejected = classify(hashed, read(spark, sf_dir, "labels"), THRESHOLD, carry=(HASH,)).filter("predicted = 0")
    rejected = rejected.select(F.col("doc_id").alias("rejected_id"), F.col(HASH).alias("rejected_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("rejected_id")) & (F.col(HASH) == F.col("rejected_hash"))
    return hashed.join(rejected, same, "left_anti").select(docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to the repetition rules."""
    return judge(docs).filter("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones, and every row without doc_id."""
    hashed = docs.withColumns({HASH: F.xxhash64("text"), OWN: F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())})
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(HASH).alias("hash"))
    found = jaccard_components(docs.select(F.col("text"), F.xxhash64("text").alias(HASH), "doc_id").select("text", key.alias("key")), n=5, percent=80, doc_id="key")
    copies = found.filter("NOT doc_id.none AND doc_id <> component_id").select("doc_id.doc_id", F.col("doc_id.hash").alias(HASH)).distinct()
    return hashed.join(copies, ["doc_id", HASH], "left_anti").dropDuplicates(["doc_id", "text", OWN]).select(docs.columns)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats."""
    cut = dedup_suffixes(docs, PASSAGE, as_text=True)
    changed = F.col("n_removed") > 0
    length = F.length("kept").cast(docs.schema["n_chars"].dataType)
    cut = cut.withColumns({"text": F.when(changed, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(changed, length).otherwise(F.col("n_chars"))})
    return cut.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_substrings), ("best-fit packing", packing)]

#: Suffix arrays, kernel features and packing are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is stored before the next reads it."""
    workspace = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = workspace.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
