"""Files or binary columns as fixed-size blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.functions.formats import DATA_BLOCK


def block_count(size: Column, block_size: int = DATA_BLOCK) -> Column:
    """Blocks of a file: none for an empty one."""
    return F.floor((size + block_size - 1) / block_size).cast("long")


def split_blocks(df: DataFrame, keys: list[str], raw: str = "raw", block_size: int = DATA_BLOCK) -> DataFrame:
    """(keys, block_no, raw): each binary value cut into blocks; null and empty ones give none."""
    n = block_count(F.octet_length(raw).cast("long"), block_size)
    numbered = df.where(F.octet_length(raw) > 0).withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return numbered.select(*keys, "block_no", F.substring(F.col(raw), (F.col("block_no") * block_size + 1).cast("int"), F.lit(block_size)).alias("raw"))
