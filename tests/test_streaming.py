import time

import pytest
from pyspark.sql import functions as F

from satchel.functions import huffman
from satchel.plans.progress import Cancelled, reported
from satchel.streaming.ingest import ingest


def test_ingest_and_carry_on(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    args = (spark, str(drop), str(tmp_path / "out"), str(tmp_path / "check"))

    def run():
        ingest(*args, block_size=1000).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).orderBy("path", "block_no").collect()
        found = {}
        for r in rows:
            name = r.path.rsplit("/", 1)[1]
            found[name] = found.get(name, b"") + huffman.decompress(bytes(r.metadata), bytes(r.payload))
        return found

    (drop / "a").write_bytes(b"first" * 500)
    assert run() == {"a": b"first" * 500}
    (drop / "b").write_bytes(b"second")
    assert run() == {"a": b"first" * 500, "b": b"second"}


def test_progress(spark):
    seen = []
    with reported(spark, lambda p, label: seen.append((p, label)), "count"):
        assert spark.range(0, 1000, numPartitions=8).where(F.rand() >= 0).count() == 1000
    assert seen[-1] == (100.0, "count") and all(0 <= p <= 100 for p, _ in seen)


def test_cancel(spark):
    def slow(batches):
        for b in batches:
            time.sleep(30)
            yield b

    with pytest.raises(Cancelled):
        with reported(spark, lambda p, label: False, "slow"):
            spark.range(8).mapInArrow(slow, "id long").count()
