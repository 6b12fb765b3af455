"""Longest-processing-time sharding of groups that must stay together.

Groups (rows of equal text) are placed from the heaviest to the lightest on the least loaded
shard.  Groups of one weight are interchangeable, so the heap runs over the histogram of
weights and not over the groups: W bytes of input have at most sqrt(2 W) distinct weights,
whatever the number of groups.  A class of many groups of one weight is dealt in one step that
gives each shard exactly what the heap would give it group by group.  The heap's state is one load
for each shard, so one task reads the sorted classes as a stream and keeps nothing else.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.plans.staging import small, stage

SLOT_DIGITS = 3  #: slots of a shard are numbered in independent pieces, by so many hex digits of the id's MD5


def deal(weight: int, count: int, heap: list[tuple[int, int]]) -> list[int]:
    """How many of ``count`` groups of ``weight`` each shard gets; updates the heap's loads.

    The heap picks the least of the values load + k * weight (ties: the lower shard).  For many
    groups the level below which all picks lie is found by bisection; the few picks at that
    level are made through the heap.
    """
    got = [0] * len(heap)
    if count > 8 * len(heap):
        loads = sorted((shard, load) for load, shard in heap)
        below = lambda t: [max(0, -(-(t - load) // weight)) for _, load in loads]  # noqa: E731  picks with a value under t
        low, high = min(load for _, load in loads), max(load for _, load in loads) + weight * count + 1
        while low < high - 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
        got = below(low)
        heap[:] = [(load + k * weight, shard) for (shard, load), k in zip(loads, got, strict=True)]
        heapq.heapify(heap)
        count -= sum(got)
    for _ in range(count):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + weight, shard))
        got[shard] += 1
    return got


def lpt_cuts(histogram: Iterator[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For each (weight, groups), the heaviest first, the running counts by shard: group number r
    of a class goes to the first shard whose running count exceeds r."""
    heap = [(0, shard) for shard in range(shards)]
    for weight, count in histogram:
        cuts, total = [], 0
        for k in deal(weight, count, heap):
            total += k
            cuts.append(total)
        yield weight, cuts


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with size, text_crc32, shard and a slot in the shard.

    size is the text's UTF-8 bytes plus 1.  Null texts have no bytes and form one group; empty
    texts another.  Repeated rows are separate rows of one group.  Within a class of equal
    weight groups are taken in the order of their text's SHA-256.  A group above a shard's fair
    share makes its shard that much heavier, since groups are never cut.  An empty table gives
    no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2("text", 256), F.lit("")).alias("grp"),
        ),
        "rows",
    )
    in_class = Window.partitionBy("weight", "sub")
    groups = stage(
        rows.groupBy("grp")
        .agg(F.sum("size").alias("weight"))
        .withColumn("sub", F.substring("grp", 1, 2))
        .withColumn("idx", (F.row_number().over(in_class.orderBy("grp")) - 1).cast("long")),
        "groups",
    )
    # One row per (weight, first hex pair): the pieces of a class are numbered apart.
    pieces = groups.groupBy("weight", "sub").agg(F.count("*").alias("n"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def classes() -> Iterator[tuple[int, int]]:
            for batch in batches:
                yield from zip(batch.column("weight").to_pylist(), batch.column("n").to_pylist(), strict=True)

        own, lists = [], []
        for weight, cuts in lpt_cuts(classes(), shards):
            own.append(weight), lists.append(cuts)
            if len(own) == 1000:
                yield pa.record_batch([pa.array(own, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["weight", "cuts"])
                own, lists = [], []
        yield pa.record_batch([pa.array(own, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["weight", "cuts"])

    histogram = pieces.groupBy("weight").agg(F.sum("n").alias("n"))
    cuts = stage(histogram.repartition(1).sortWithinPartitions(F.desc("weight")).mapInArrow(place, "weight long, cuts array<long>"), "cuts")
    before = F.sum("n").over(Window.partitionBy("weight").orderBy("sub")) - F.col("n")
    placed_pieces = pieces.withColumn("off", before).join(cuts, "weight").select("weight", "sub", "off", "cuts")
    rank = F.col("idx") + F.col("off")
    placed = groups.join(placed_pieces, ["weight", "sub"]).select(
        "grp", F.size(F.filter("cuts", lambda c: c <= rank)).alias("shard")
    )
    bucket = F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, SLOT_DIGITS), F.lit(""))
    dealt = stage(rows.join(placed, "grp").withColumn("bucket", bucket).drop("grp"), "dealt")
    # At most shards * (16 ** SLOT_DIGITS + 1) rows, whatever the input.
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = small(stage(counts.select("shard", "bucket", first.alias("first")), "starts"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return (
        dealt.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"))
    )


def _oracle(shards: int = 8, chunk: int = 256) -> str:
    """The same rows in DuckDB: the heap group by group, and CRC-32 by chunks of bytes."""

    def after(x: int, zeros: int) -> int:  # the register after so many zero bits
        for _ in range(zeros):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        return x

    step = f"xor(c >> 8, {[after(n, 8) for n in range(256)]}[(xor(c, x) & 255) + 1])"
    skip = "x"
    for k in range(32):
        skip = f"xor({skip}, ((c >> {k}) & 1) * {after(1 << k, 8 * chunk)})"
    value = "('0x' || p[2 * i + 1:2 * i + 2])::BIGINT"
    crc = lambda first: f"list_reduce([{first}::BIGINT] || list_transform(range(0, length(p) // 2), lambda i: {value}), lambda c, x: {step})"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(sha256(text), '') AS grp, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT DISTINCT grp, h, length(h) // 2 % {chunk} AS head FROM d),
part AS (SELECT grp, 0 AS k, h[:2 * head] AS p FROM t UNION ALL SELECT grp, k, h[2 * (head + {chunk} * (k - 1)) + 1:2 * (head + {chunk} * k)] FROM (SELECT grp, h, head, unnest(range(1, length(h) // {2 * chunk} + 1)) AS k FROM t)),
crcs AS (SELECT grp, k, CASE WHEN k = 0 THEN {crc("4294967295")} ELSE {crc("0")} END AS c FROM part),
crc AS (SELECT grp, xor(4294967295, list_reduce(list(c ORDER BY k), lambda c, x: {skip})) AS crc FROM crcs GROUP BY grp),
s AS (SELECT r, doc_id, grp, (length(h) // 2 + 1)::BIGINT AS size, crc::BIGINT AS text_crc32 FROM d JOIN crc USING (grp)),
g AS (SELECT grp, sum(size)::BIGINT AS weight FROM s GROUP BY grp),
o AS (SELECT grp, weight, row_number() OVER (ORDER BY weight DESC, grp) AS i FROM g),
heap(i, loads, pick) AS (SELECT 0::BIGINT, list_transform(range(0, {shards}), lambda k: 0::BIGINT), NULL::BIGINT
  UNION ALL SELECT o.i, list_transform(range(1, {shards + 1}), lambda k: loads[k] + CASE WHEN k = list_position(loads, list_min(loads)) THEN weight ELSE 0 END), list_position(loads, list_min(loads))::BIGINT
  FROM heap JOIN o ON o.i = heap.i + 1),
picked AS (SELECT weight, pick, row_number() OVER (PARTITION BY weight ORDER BY pick) AS n FROM heap JOIN o USING (i)),
placed AS (SELECT grp, (pick - 1)::INT AS shard FROM (SELECT grp, weight, row_number() OVER (PARTITION BY weight ORDER BY grp) AS n FROM o) JOIN picked USING (weight, n))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY coalesce(left(md5(doc_id::VARCHAR), {SLOT_DIGITS}), ''), doc_id NULLS FIRST, text_crc32) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM s JOIN placed USING (grp)
"""


ORACLE_SQL = _oracle()
