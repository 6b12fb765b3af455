"""Exact removal of repeated substrings by prefix-free parsing.

Rolling-hash triggers cut the texts into phrases: in every run of ``LENGTH`` bytes the leftmost
least hash of ``GRAM`` bytes is a trigger, so equal runs have equal triggers, none is longer
than a phrase, and no text parses differently in another place.  The *parse* is the sequence of
triggers; a trigger's *context* is the text of all runs that it governs (its phrase and what
follows within ``LENGTH``), and the distinct contexts are the *dictionary*.  Highly repetitive
text has few contexts for its length.

1. The parse is counted by (trigger, context).  Contexts that occur twice repeat as a whole.
2. Triggers with several contexts are where repeats begin and end.  For those alone one text of
   each context is fetched, and the suffixes of this dictionary are sorted by prefix doubling, up
   to ``LENGTH`` bytes; the parse's counts are added up over equal neighbours, which is the order
   of the corpus, made from dictionary and parse.  Runs whose rank two places share are repeats.
   Groups of over ``SORTED`` contexts compare 128 bits of hash (trigger and run) instead of ranks.
3. A trigger with more than ``MANY`` contexts would put an unbounded group into one task; its runs
   are counted one by one in the cluster, by the same hashes.

Rows are dealt by trigger, but for those that have ``DENSE`` contexts within any ``PORTION`` of the
corpus: they are found first and dealt by context.  Any other trigger has under one in 16,000 rows.

Triggers that occur once, most of a varied corpus, never leave the first count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm.textops import mix, slices
from satchel.plans.staging import small, stage

LENGTH, GRAM = 200, 32
SORTED, MANY = 2_000, 30_000
DENSE = 64  #: contexts of a trigger in one portion from which it is counted by context
BLOCK = 1 << 20  #: bytes hashed at once
SORT_BYTES = 1 << 20  #: dictionary text sorted at once
PORTION = 1 << 20  #: triggers that a task counts before it sends their counts
SLOTS = 1 << 20  #: words of 64 bits in a bit map, whatever it holds

_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_TABLES: dict[str, np.ndarray] = {}


def _powers(base: int, n: int, name: str) -> np.ndarray:
    if name not in _TABLES or len(_TABLES[name]) < n:
        out = np.full(n, np.uint64(base))
        out[0] = 1
        _TABLES[name] = np.multiply.accumulate(out)
    return _TABLES[name][:n]


class Rolling:
    """Prefix sums from which the hash of any range of ``data`` follows."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers(_BASE, len(data) + 1, "up")[: len(data)], out=self.sums[1:])
        self.down = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1, "down")

    def hash(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least value of each ``span`` consecutive ones."""
    n = len(values) - span + 1
    padded = np.full(-(-len(values) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


def triggers(data: np.ndarray, begin: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The parse of texts that lie one after the other in ``data`` (text i from begin[i] to
    begin[i+1]): per trigger its text, the first run it governs (lo, from the text's start), the
    number of runs, key and ctx (hashes of the trigger and its context), and the context's place
    in ``data``."""
    names = ("doc", "lo", "runs", "key", "ctx", "at")
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in names}
    n = len(data) - length + 1
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    whole = doc[:n] == doc[length - 1 :]
    rolling = Rolling(data)
    grams = rolling.hash(slice(0, len(data) - gram + 1), slice(gram, None))
    # Ties of the upper bits go to the leftmost place, in every text alike.
    coded = (grams & ~np.uint64(BLOCK * 2 - 1)) | np.arange(len(grams), dtype=np.uint64)
    governor = (sliding_least(coded, length - gram + 1)[:n] & np.uint64(BLOCK * 2 - 1)).astype(np.int64)
    start = np.flatnonzero(whole & np.append(True, (governor[1:] != governor[:-1]) | ~whole[:-1] | (doc[1:n] != doc[: n - 1])))
    stop = np.flatnonzero(whole & np.append((governor[1:] != governor[:-1]) | ~whole[1:] | (doc[1:n] != doc[: n - 1]), True)) + 1
    trigger = governor[start]
    shape = (trigger - start).astype(np.uint64) << np.uint64(32) | (stop - start).astype(np.uint64)
    ctx = mix(rolling.hash(start, stop + length - 1) + mix(shape + np.uint64(1)))
    found = (doc[start], start - begin[doc[start]], stop - start, grams[trigger].view(np.int64), ctx.view(np.int64), start)
    return dict(zip(names, found, strict=True))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(batch, bytes, begins, offset) of at most about ``BLOCK`` bytes; a longer text comes in
    pieces that overlap so that every run lies whole in exactly one."""
    for batch in slices(batches, budget=BLOCK // 2):
        text = pc.fill_null(batch.column("text"), "")
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = np.append(0, ends)
        raw = np.frombuffer("".join(text.to_pylist()).encode(), np.uint8)
        if len(raw) <= BLOCK:
            yield batch, raw, begin, 0
            continue
        for i in range(len(text)):
            own, row = raw[begin[i] : begin[i + 1]], batch.slice(i, 1)
            for a in range(0, max(len(own) - LENGTH + 1, 1), BLOCK - LENGTH):
                part = own[a : a + BLOCK - 1]
                yield row, part, np.array([0, len(part)]), a


def suffix_ranks(data: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Ranks of the suffixes at ``start`` by their first ``length`` bytes (prefix doubling).

    All of ``data`` is ranked, so that a rank of 2k bytes comes from two ranks of k bytes.
    """
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + length]
    rank = np.unique(np.ascontiguousarray(view).view(">u8").ravel(), return_inverse=True)[1].astype(np.int64)
    width = 8
    while width < length:
        step = min(width, length - width)
        shifted = np.append(rank[step:], np.zeros(step, np.int64))
        rank = np.unique(rank * (int(rank.max()) + 1) + shifted, return_inverse=True)[1].astype(np.int64)
        width += step
    return rank[start]


def _grown(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count`` items its owner and its number within the owner."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _count(batches: Iterator[pa.RecordBatch], dense: bool = False) -> Iterator[pa.RecordBatch]:
    """(key, ctx, n, ref) once for each context in a portion of the task's texts; with ``dense``
    only the keys (key) that have many contexts there."""
    kept: list[tuple[np.ndarray, ...]] = []
    size = 0

    def work() -> pa.RecordBatch:
        key, ctx, ref = (np.concatenate(x) for x in zip(*kept, strict=True))
        if dense:  # as many rows as contexts are a quick upper bound
            value, times = np.unique(key, return_counts=True)
            some = np.isin(key, value[times >= DENSE])
            pairs = np.unique(np.stack([key[some], ctx[some]]), axis=1)[0]
            value, times = np.unique(pairs, return_counts=True)
            return pa.record_batch([pa.array(value[times >= DENSE])], ["key"])
        order = np.lexsort((ref, ctx, key))
        key, ctx, ref = key[order], ctx[order], ref[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]))) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(key)))
        return pa.record_batch([pa.array(key[first]), pa.array(ctx[first]), pa.array(n), pa.array(ref[first])], ["key", "ctx", "n", "ref"])

    for batch, data, begin, _ in pieces(batches):
        t = triggers(data, begin)
        kept.append((t["key"], t["ctx"], batch.column("ref").to_numpy()[t["doc"]]))
        size += len(t["key"])
        if size >= PORTION:
            yield work()
            kept, size = [], 0
    if kept:
        yield work()


def _bitmap(table: DataFrame, value: str):
    """A broadcast bit map of a column of hashes: at most ``SLOTS`` rows come to the driver."""
    mask = np.zeros(SLOTS, np.uint64)
    bits = F.expr(f"bit_or(shiftleft(1L, cast(({value}) & 63 as int)))")
    found = table.groupBy(F.expr(f"cast(shiftrightunsigned({value}, 44) as int)").alias("slot")).agg(bits.alias("bits")).toArrow()
    mask[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table.sparkSession.sparkContext.broadcast(mask)


def _inside(mask: np.ndarray, values: np.ndarray) -> np.ndarray:
    value = values.view(np.uint64)
    return (mask[(value >> np.uint64(44)).astype(np.int64)] >> (value & np.uint64(63))) & np.uint64(1) > 0


def _runs_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The dictionary text of rows, and for each run its row, its number, and its place."""
    text = rows.column("context").combine_chunks()
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, number = _grown(size - LENGTH + 1)
    data = np.frombuffer(b"".join(text.to_pylist()), np.uint8)
    return data, owner, number, (np.cumsum(size) - size)[owner] + number


def _judge(rows: pa.Table, by_hash: bool) -> pa.RecordBatch:
    """Repeated runs of contexts that occur once (n = 1); whole groups of a key at a time."""
    data, owner, number, at = _runs_of(rows)
    n, key = rows.column("n").to_numpy(), rows.column("key").to_numpy()
    if by_hash:
        order = np.lexsort((fp := Rolling(data).hash(at, at + LENGTH), key[owner]))
        new = np.append(False, (fp[order][1:] != fp[order][:-1]) | (key[owner[order]][1:] != key[owner[order]][:-1]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
    else:
        rank = suffix_ranks(data, at)
    hit = (np.bincount(rank, weights=n[owner])[rank] > 1) & (n[owner] == 1) if len(rank) else np.zeros(0, bool)
    some, count = np.unique(owner[hit], return_counts=True)
    starts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(number[hit].astype(np.int32)))
    return pa.record_batch([rows.column(c).combine_chunks().take(pa.array(some)) for c in ("key", "ctx")] + [starts], ["key", "ctx", "starts"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key in bounded portions that do not cut a key's rows."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, "context", SORT_BYTES // 4):
        kept.append(batch)
        size += batch.column("context").nbytes
        if size < SORT_BYTES:
            continue
        rows = pa.Table.from_batches(kept)
        key = rows.column("key").to_numpy()
        whole = int(np.argmax(key == key[-1]))  # the last group may go on
        if whole:
            yield rows.slice(0, whole)
            kept = rows.slice(whole).to_batches()
            size = sum(b.column("context").nbytes for b in kept)
    if kept:
        yield pa.Table.from_batches(kept)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ctx, n, context) sorted by key and context: a count and a text of each context
    come in rows of their own."""
    for rows in _whole_groups(batches):
        key, ctx = (rows.column(c).to_numpy() for c in ("key", "ctx"))
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])))
        n = np.add.reduceat(rows.column("n").to_numpy(), first)
        there = np.flatnonzero(rows.column("context").is_valid().to_numpy())
        text = there[np.searchsorted(there, first).clip(max=max(len(there) - 1, 0))] if len(there) else first
        good = n > 0  # a bit map's false positive has no count
        picked = rows.take(pa.array(text[good])).set_column(2, "n", pa.array(n[good]))
        own = picked.column("key").to_numpy()
        start = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)]), len(own))
        large = np.flatnonzero(np.diff(start) > SORTED)
        for a, b in zip(start[large].tolist(), start[large + 1].tolist(), strict=True):
            yield _judge(picked.slice(a, b - a), True)
        small = np.ones(len(own), bool)
        for a, b in zip(start[large].tolist(), start[large + 1].tolist(), strict=True):
            small[a:b] = False
        if small.any():
            yield _judge(picked.filter(pa.array(small)), False)


def _single_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "context", 1 << 18):
        data, owner, number, at = _runs_of(pa.Table.from_batches([batch]))
        fp = Rolling(data).hash(at, at + LENGTH)
        columns = [batch.column(c).take(pa.array(owner)) for c in ("key", "ctx", "n")]
        yield pa.record_batch([*columns, pa.array(number.astype(np.int32)), pa.array(fp.view(np.int64))], ["key", "ctx", "n", "number", "fp"])


def _identity() -> tuple[Column, Column]:
    """128 bits that stand for a document's id and text; rows equal in both share them."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64("doc_id", text).alias("ref"), F.xxhash64(text, F.lit("other"), "doc_id").alias("more")


def reference(docs: DataFrame) -> DataFrame:
    """(ref, more, text), see ``_identity``."""
    return docs.select(*_identity(), F.coalesce("text", F.lit("")).alias("text"))


def repeated_runs(docs: DataFrame, many: int = MANY) -> DataFrame:
    """Where runs of ``LENGTH`` bytes start that start anywhere else too: ref and more (of ``reference``),
    place (the first start << 16 | the number of starts) and starts (those that repeat; null for
    all)."""
    keyed = reference(docs)
    counted = keyed.mapInArrow(_count, "key long, ctx long, n long, ref long")
    total, variants = F.sum("n"), F.count("*")
    dense = keyed.mapInArrow(lambda batches: _count(batches, True), "key long").distinct()
    hot_keys = small(stage(dense, "hot"))
    of_key = Window.partitionBy("key")
    cold = counted.join(hot_keys, "key", "left_anti").repartition("key").groupBy("key", "ctx").agg(total.alias("n"), F.min("ref").alias("ref"))
    parse = cold.withColumn("total", F.sum("n").over(of_key)).withColumn("variants", variants.over(of_key)).where("total > 1").select("key", "ctx", "n", "ref", "variants")
    if hot_keys.limit(1).count():
        hottest = stage(counted.join(hot_keys, "key", "left_semi").groupBy("key", "ctx").agg(total.alias("n"), F.min("ref").alias("ref")), "hottest")
        sizes = small(stage(hottest.groupBy("key").agg(variants.alias("variants")), "sizes"))
        parse = parse.unionByName(hottest.join(sizes, "key").select("key", "ctx", "n", "ref", "variants"))
    parse = stage(parse, "parse")
    spread = parse.where("variants > 1")
    wanted = _bitmap(spread, "ctx ^ ref")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, begin, _ in pieces(batches):
            t = triggers(data, begin)
            pick = np.flatnonzero(_inside(wanted.value, t["ctx"] ^ batch.column("ref").to_numpy()[t["doc"]]))
            at, end, raw = t["at"][pick].tolist(), (t["at"] + t["runs"] + LENGTH - 1)[pick].tolist(), data.tobytes()
            yield pa.record_batch([pa.array(t["key"][pick]), pa.array(t["ctx"][pick]), pa.array(np.zeros(len(pick), np.int64)), pa.array([raw[a:b] for a, b in zip(at, end, strict=True)], pa.binary())], ["key", "ctx", "n", "context"])

    schema = "key long, ctx long, n long, context binary"
    texts = keyed.mapInArrow(fetch, schema)
    counts = spread.where(F.col("variants") <= many).select("key", "ctx", "n", F.lit(None).cast("binary").alias("context"))
    hot = spread.where(F.col("variants") > many)
    some_hot = hot.limit(1).count() > 0
    if some_hot:
        texts = stage(texts, "texts")
        cold = texts.join(hot.select("key", "ctx"), ["key", "ctx"], "left_anti")
    else:
        cold = texts
    marks = counts.unionByName(cold).repartition("key").sortWithinPartitions("key", "ctx").mapInArrow(_sorted_runs, "key long, ctx long, starts array<int>")
    if some_hot:
        hottest = texts.dropDuplicates(["key", "ctx"]).drop("n").join(hot.select("key", "ctx", "n"), ["key", "ctx"]).select("key", "ctx", "n", "context")
        runs = stage(hottest.mapInArrow(_single_runs, "key long, ctx long, n long, number int, fp long"), "runs")
        twice = runs.groupBy("key", "fp").agg(F.sum("n").alias("w")).where("w > 1").drop("w")
        marks = marks.unionByName(runs.where("n = 1").join(twice, ["key", "fp"]).groupBy("key", "ctx").agg(F.sort_array(F.collect_set("number")).alias("starts")))
    whole = parse.where("n > 1").select("key", "ctx", F.lit(None).cast("array<int>").alias("starts"))
    marks = stage(whole.unionByName(marks), "marks")
    marked = _bitmap(marks, "ctx")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, begin, offset in pieces(batches):
            t = triggers(data, begin)
            pick = np.flatnonzero(_inside(marked.value, t["ctx"]))
            place = (t["lo"][pick] + offset) << 16 | t["runs"][pick]
            owner = t["doc"][pick]
            yield pa.record_batch([*(pa.array(batch.column(c).to_numpy()[owner]) for c in ("ref", "more")), pa.array(place), pa.array(t["key"][pick]), pa.array(t["ctx"][pick])], ["ref", "more", "place", "key", "ctx"])

    found = keyed.mapInArrow(places, "ref long, more long, place long, key long, ctx long")
    return found.join(marks, ["key", "ctx"]).select("ref", "more", "place", "starts")


def deduplicate(docs: DataFrame, many: int = MANY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans, an array
    of (start, end) of the maximal removed runs in bytes.

    Null and empty texts have no bytes; texts under ``LENGTH`` bytes keep all.  Repeated rows
    repeat each other's text and so lose what is long enough.  Very long texts are parsed in
    overlapping pieces.  Of equal hashes the leftmost is the trigger.  An empty table gives no
    rows; other columns are ignored.
    """
    found = repeated_runs(docs, many).groupBy("ref", "more").agg(F.collect_set(F.struct("place", "starts")).alias("found"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *_identity(), text.alias("text")).join(found, ["ref", "more"], "left").select("doc_id", "text", "found")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            lists = batch.column("found")
            for text, found in zip(batch.column("text").to_pylist(), (lists[i] for i in range(len(lists))), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int32)
                for f in found.as_py() or []:
                    first, count = f["place"] >> 16, f["place"] & 0xFFFF
                    if f["starts"] is None:
                        edge[first] += 1
                        edge[first + count + LENGTH - 1] -= 1
                    else:
                        at = np.array(f["starts"], np.int64) + first
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + LENGTH, -1)
                gone = np.append(np.cumsum(edge[:-1]) > 0, False)
                turn = np.flatnonzero(np.diff(gone, prepend=False))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                out.append((len(raw), int(gone.sum()), len(spans), hashlib.sha256(raw[~gone[:-1]].tobytes()).hexdigest(), spans))
            n, removed, count, digest, spans = zip(*out, strict=True) if out else [()] * 5
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, kind)]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(remove, f"doc_id {id_kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, sha256(h[s + 1:s + 200]) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS s FROM d WHERE n >= 200)),
rep AS (SELECT doc_id, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
isle AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM rep)),
span AS (SELECT doc_id, g, min(s) AS a, max(s) + 200 AS b FROM isle GROUP BY doc_id, g),
cut AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM span GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(list_sum(b) - list_sum(a), 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
  sha256(CASE WHEN a IS NULL THEN h ELSE unhex(array_to_string(list_transform(range(0, len(a) + 1),
    lambda i: hex(h[(CASE WHEN i = 0 THEN 0 ELSE b[i] END) + 1:(CASE WHEN i = len(a) THEN n ELSE a[i + 1] END)])), '')) END) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
