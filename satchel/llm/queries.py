"""The queries of the corpus operators: thin calls with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.plans.staging import ship
from satchel.llm import decontaminate, html_text, language, ngram_join, pieces, quality, secrets, sharding, substrings, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt from four fifths of the labelled ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learnt = labels.where(language.fold(F.col("doc_id"), 5) != 0)
    out = toxicity.tag(docs, toxicity.fit(docs, learnt))
    held_out = F.coalesce(language.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    out = language.identify(docs, language.fit(docs.where(~held_out & F.col("doc_id").isNotNull())))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside a 10-word window of a benchmark item."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", "n_near")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes; equal texts stay together."""
    out = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are similar to 0.85."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as piece ids, and whether they decode to it."""
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.Pieces.load())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; weak parts only where complementary ones co-occur."""
    out = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.as_text(base).cast("binary"), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 200-byte strings found elsewhere cover, and what is left."""
    return substrings.deduplicate(table(spark, sf_dir, "documents")).drop("spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document, and the isolation forest's verdict."""
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_ngram_join": op1_ngram_join, "op2_sentencepiece": op2_sentencepiece, "op3_secret_scan": op3_secret_scan, "op4_substring_dedup": op4_substring_dedup, "op5_quality": op5_quality, "op6_toxicity": op6_toxicity, "op7_html_text": op7_html_text, "op8_language": op8_language, "op9_decontamination": op9_decontamination, "op10_sharding": op10_sharding}
ORACLE_SQL: dict[str, str] = {"op1_ngram_join": ngram_join.ORACLE_SQL, "op3_secret_scan": secrets.ORACLE_SQL, "op4_substring_dedup": substrings.ORACLE_SQL, "op9_decontamination": decontaminate.ORACLE_SQL, "op10_sharding": sharding.ORACLE_SQL}
