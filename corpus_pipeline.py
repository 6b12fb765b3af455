"""Five corpus stages, each over all that the stage before kept.

Quality rules reject documents, the n-gram join leaves one document of each group of near
copies, decontamination rejects documents with benchmark passages, the secret scan blanks what
it finds, and the rest is encoded as SentencePiece ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm import decontaminate, ngram_join, pieces, quality, secrets
from satchel.plans.staging import drop_staged, new_path, scope, ship, small, stage

SHINGLE, PERCENT = 5, 80  #: of the near-duplicate stage


def staged(f: Callable[..., DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage first drops what earlier stages staged for themselves: their results are written."""

    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        drop_staged(spark, "pipeline stage")
        with scope("pipeline stage"):
            return f(spark, docs, sf_dir)

    return call


def by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of ``docs`` with ``rows`` (doc_id, text_hash); null ids match null."""
    keys = small(stage(rows.select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash_gone")).distinct(), "keys"), width=32)
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["__gone"]) & (ngram_join.text_hash() == keys["__hash_gone"]), how)


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  Null and empty texts fail the rules; repeated rows are judged alike."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one document stays: that of the least doc_id, a null one last, and of
    the least text hash among texts of that id.

    Rows that repeat a doc_id and its text are one document.  Empty texts are in no component.
    """
    found = ngram_join.members(docs, SHINGLE, PERCENT)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    grouped = found.where("comp is not null")
    best = grouped.groupBy("comp").agg(F.min(key).alias("best"))
    gone = grouped.join(best, "comp").where(key != F.col("best")).select("doc_id", "text_hash")
    left = by_row(docs, gone, "left_anti")
    again = stage(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"), "again")
    if again.limit(1).count():
        twice = by_row(left, again, "left_semi")
        left = by_row(left, again, "left_anti").unionByName(twice.dropDuplicates(["doc_id", "text"]))
    return left


@staged
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Rows are told apart by doc_id and text, so of an id on several texts only those with a window
    go, and repeated rows go or stay together.  Null and empty texts have no window and stay.
    """
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return by_row(docs, found.where("contaminated"), "left_anti")


@staged
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans are blanked; all documents stay, null and empty texts as they are, and
    repeated rows are blanked alike."""
    return secrets.redact(docs)


@staged
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as ids; null and empty texts have none, repeated rows have the same."""
    return pieces.encode(docs, pieces.Pieces.load())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The forest's verdicts and the ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written, and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES):
        found = f(spark, docs, sf_dir)
        with scope("pipeline result"):
            path = new_path(spark, f"stage{k}")
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    drop_staged(spark, "pipeline stage")
    return docs
