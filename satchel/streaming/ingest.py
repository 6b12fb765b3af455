"""Drop-folder ingest: new files become encoded blocks as they arrive.

An extension beside the batch engine: ``binaryFile`` streams each file once, its blocks are
encoded in the micro-batch and appended as a table, and the checkpoint makes a restart carry on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from satchel.functions.formats import DATA_BLOCK
from satchel.operators.archive import encode_blocks
from satchel.operators.blocks import split_blocks
from satchel.plans.staging import ship

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, mode: int | str = 1, password: str | None = None, block_size: int = DATA_BLOCK, files_per_batch: int = 1000) -> StreamingQuery:
    """Encode every file that comes to ``folder`` into the Parquet table ``out``: path, block_no,
    metadata, payload and batch.  Stops when the folder is read through; run it again for more.

    A batch that is repeated after a failure replaces its own rows.
    """
    ship(spark)
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        blocks = split_blocks(batch.select("path", F.col("content").alias("raw")), ["path"], "raw", block_size)
        encoded = encode_blocks(blocks, ["path", "block_no"], mode, password)
        encoded.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
