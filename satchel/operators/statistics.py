"""Byte statistics and the sizes and lengths that optimal prefix codes have."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(blocks: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """(keys, byte, freq): the bytes of a binary column, counted by key.

    Each Arrow batch is counted in numpy and sends at most 256 rows a block or a key, which the
    grouping adds up; a hot key costs no more.
    """
    schema = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            totals: dict[tuple, np.ndarray] = {}
            for name, value in zip(names, batch.column(raw), strict=True):
                if value.is_valid and (data := np.frombuffer(value.as_buffer(), np.uint8)).size:
                    totals[name] = totals.get(name, 0) + np.bincount(data, minlength=256)
            rows = [(name, np.flatnonzero(t), t) for name, t in totals.items()]
            columns = [pa.array([name[i] for name, at, _ in rows for _ in at], batch.schema.field(k).type) for i, k in enumerate(keys)]
            byte = np.concatenate([np.zeros(0, np.int64), *(at for _, at, _ in rows)])
            freq = np.concatenate([np.zeros(0, np.int64), *(t[at] for _, at, t in rows)])
            yield pa.record_batch([*columns, pa.array(byte.astype(np.int32)), pa.array(freq.astype(np.int64))], [*keys, "byte", "freq"])

    out = blocks.select(*keys, raw).mapInArrow(count, ", ".join(filter(None, (schema, "byte int, freq long"))))
    return out.groupBy(*keys, "byte").agg(F.sum("freq").alias("freq"))


def merge_cost(freqs: Column) -> Column:
    """Bits of an optimal prefix code for an array of frequencies, as a fold over merges.

    A lone symbol takes a bit each time."""
    forest = F.array_sort(freqs)
    start = F.struct(forest.alias("f"), F.lit(0).cast("long").alias("bits"))

    def merge(state: Column, _: Column) -> Column:
        two = F.element_at(state["f"], 1) + F.element_at(state["f"], 2)
        rest = F.slice(state["f"], 3, F.greatest(F.size(state["f"]) - 2, F.lit(0)))
        return F.struct(F.array_sort(F.concat(rest, F.array(two))).alias("f"), (state["bits"] + two).alias("bits"))

    steps = F.when(F.size(freqs) > 1, F.sequence(F.lit(2), F.size(freqs))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(freqs) == 1, F.element_at(freqs, 1)).otherwise(F.aggregate(steps, start, merge, lambda s: s["bits"]))


def block_sizes(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, symbols, bits, metadata_bytes, payload_bytes) from a histogram: what any conforming
    encoder must give, whatever it does with ties."""
    out = counts.groupBy(*keys).agg(F.collect_list("freq").alias("f")).withColumn("bits", merge_cost(F.col("f"))).withColumn("symbols", F.size("f").cast("long"))
    return out.select(*keys, "symbols", "bits", (4 * F.col("symbols") - 1).alias("metadata_bytes"), (1 + F.ceil(F.col("bits") / 8)).cast("long").alias("payload_bytes"))


def code_lengths(counts: DataFrame) -> DataFrame:
    """(byte, freq, code_len) of one code over all rows of (byte, freq), ties to the least byte.

    At most 256 rows are folded, whatever lies under the histogram."""
    node = "struct<freq:bigint,least:int,symbols:array<struct<byte:int,freq:bigint,len:int>>>"
    leaf = F.struct("freq", F.col("byte").alias("least"), F.array(F.struct("byte", "freq", F.lit(0).alias("len"))).alias("symbols")).cast(node)
    forest = counts.groupBy().agg(F.array_sort(F.collect_list(leaf)).alias("f"))

    def merge(f: Column, _: Column) -> Column:
        a, b = F.element_at(f, 1), F.element_at(f, 2)
        longer = F.transform(F.concat(a["symbols"], b["symbols"]), lambda s: F.struct(s["byte"].alias("byte"), s["freq"].alias("freq"), (s["len"] + 1).alias("len")))
        both = F.struct((a["freq"] + b["freq"]).alias("freq"), F.least(a["least"], b["least"]).alias("least"), longer.alias("symbols")).cast(node)
        return F.array_sort(F.concat(F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0))), F.array(both)))

    steps = F.when(F.size("f") > 1, F.sequence(F.lit(2), F.size("f"))).otherwise(F.array().cast("array<int>"))
    return forest.select(F.explode(F.element_at(F.aggregate(steps, F.col("f"), merge), 1)["symbols"]).alias("s")).select(
        F.col("s.byte").alias("byte"), F.col("s.freq").alias("freq"), F.greatest(F.col("s.len"), F.lit(1)).alias("code_len")
    )


def code_statistics(lengths: DataFrame) -> DataFrame:
    """Shortest, longest and total code length, and symbols."""
    return lengths.agg(F.min("code_len").alias("min_len"), F.max("code_len").alias("max_len"), F.sum("code_len").alias("total_len"), F.count("*").alias("symbols"))
