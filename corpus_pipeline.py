"""The corpus pipeline: five stages, each over all that its predecessor kept.

Documents of low quality go, then toxic ones, then all but one of each group of
near copies, then those that hold benchmark items; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.decontaminate import leaks
from kinloom.llm.minhash_dedup import near_duplicates
from kinloom.llm.quality_knn import quality_scores
from kinloom.llm.queries import _fold
from kinloom.llm.scratch import Scratch
from kinloom.llm.sentencepiece_codec import encode
from kinloom.llm.toxicity_fm import toxicity_scores

#: Scores from which a document counts as good, and as toxic.
GOOD, TOXIC = 0.3, 0.3


def _judged(spark: SparkSession, docs: DataFrame, sf_dir: str, operator, parts: int, held: int) -> DataFrame:
    """The rows with a score; labels are read outside the held-out fold, for documents still there."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return operator(docs, labels, train, lambda key: ~_fold(key, parts, held), score="\0score")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 9) doesn't reject; null and empty texts are scored like others.

    Each repeated row is scored, all alike; an empty table gives an empty one; columns of any name are kept.
    """
    return _judged(spark, docs, sf_dir, quality_scores, 5, 0).where(F.col("`\0score`") >= GOOD).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (operator 10) doesn't reject; null and empty texts are scored like others.

    Each repeated row is scored, all alike; an empty table gives an empty one; columns of any name are kept.
    """
    return _judged(spark, docs, sf_dir, toxicity_scores, 4, 2).where(F.col("`\0score`") < TOXIC).select(*docs.columns)


#: A row's number within a stage, and names that no column of documents has.
_ROW, _KEPT = "\0row", "\0kept"


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with a number of their own, written down so that it stays the same; ids may be null or repeated."""
    return scratch.cut(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (operator 5): five words, similarity 0.8 or more.

    Rows are told apart by a number, so null ids and different texts under one
    id are rows like others.  The row with the smallest doc_id stays (null ids
    last, then the first row); rows without words all stay.
    """
    scratch = Scratch(spark, "dedup")
    docs = _numbered(docs, scratch)
    group = near_duplicates(docs, scratch, key=_ROW).select(F.col("doc_id").alias(_ROW), "component_id")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(_ROW).alias("row"))
    ids = docs.select("doc_id", _ROW).join(group, _ROW)
    kept = ids.groupBy("component_id").agg(F.min(first)["row"].alias(_KEPT)).select(_KEPT)
    return docs.join(kept, docs[_ROW] == kept[_KEPT], "left_semi").drop(_ROW)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item (operator 3), whatever their doc_id; null and empty texts stay."""
    scratch = Scratch(spark, "leaks")
    docs = _numbered(docs, scratch)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = leaks(docs, benchmark, scratch, key=_ROW).select(F.col("doc_id").alias(_KEPT)).distinct()
    return docs.join(found, docs[_ROW] == found[_KEPT], "left_anti").drop(_ROW)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: every row's piece ids (operator 2); null and empty texts have none.

    Repeated rows and texts of any length are encoded each; an empty table gives an empty result; other columns are left out.
    """
    out = encode(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encoded),
]

#: No SQL expresses the trained models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again: ``doc_id, n_tokens, ids`` of what all stages keep.

    Null ids, repeated rows and null texts go through the stages by the rules of each; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs, f"stage-{k}")
    return docs
