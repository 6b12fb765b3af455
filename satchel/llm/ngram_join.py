"""Exact n-gram Jaccard self-join by prefix filters under several global token orders.

Sets of word shingles that are equal become one *node* first, so copies cost one row each.  Two
sets with similarity t share a token among the first n - ceil(t n) + 1 of either, under any
order that all sets follow.  The orders used here differ in their hash and agree in placing
tokens by class: first sampled tokens that occur once in the corpus (they can link nothing and
are never stored), then sampled tokens that occur a few times, unsampled ones, and frequent ones
last.  The classes come from counts over the whole corpus, kept as bit maps; a bit map is a
function of the token, so false positives cost time and never a link.

Candidates share a prefix token under the first order; before verification they must share one
under the second order too, have compatible sizes, and pass a bit map bound: two sets differ in
at least as many tokens as their bit maps differ in bits.  Sets are only fetched of nodes that
under either order share a token with a node of a compatible size.  No bucket is expanded into rows for
all its pairs: each bucket's hub is compared with the bucket and linked nodes are contracted;
after that, what is left of a bucket is compared by bit maps inside a task, block by block.  For
a few rounds only each node's nearest partner of another component leaves the task, which
contracts dense groups; then all pairs of different components that pass the bound do.  Every
pair that no component joins already is compared, however large its bucket is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm.components import components
from satchel.llm.textops import Words, mix, slices
from satchel.plans.staging import small, stage

SAMPLED = 5 / 3  #: tokens counted over the corpus for each token of a prefix
FREQUENT = 64  #: documents from which a counted token goes last
SLOTS = 1 << 20  #: 64-bit words of a bit map
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
NEAREST = 3  #: rounds in which nodes meet their nearest only, before all that is left is compared
COMPARED = 4 << 20  #: bytes of bit maps compared at once
PAIRS = 1 << 19  #: pairs that a task holds before it sends them
BLOCK = 2048  #: nodes of a bucket that one task compares with each other or with another block

_STEPS = mix(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)


def shingles(text: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: n words, or all of a shorter text."""
    words = Words(text, lower=True)
    by_word = pd.util.hash_array(words.vocabulary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words.vocabulary) else np.zeros(0, np.uint64)
    code = mix(by_word)[words.code]
    start = np.flatnonzero(words.windows(n))
    total = np.full(len(start), n, np.uint64)
    for k in range(n):
        total += code[start + k] * _STEPS[k]
    total = mix(total)
    end = np.cumsum(np.maximum(words.count - n + 1, 0))
    first = np.cumsum(words.count) - words.count
    out = []
    for i, (b, size) in enumerate(zip(end.tolist(), words.count.tolist(), strict=True)):
        if size >= n:
            own = np.sort(total[b - (size - n + 1) : b])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif size:
            own = (code[first[i] : first[i] + size] * _STEPS[:size]).sum(dtype=np.uint64)
            out.append(mix(np.array([own]) + np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(own: np.ndarray) -> int:
    """A 64-bit identity of a set."""
    return int(mix(np.array([mix(own).sum(dtype=np.uint64) + np.uint64(len(own))]))[0].view(np.int64))


def bitmap(spark: SparkSession, tokens: DataFrame, name: str):
    """A broadcast bit map of a column of longs; ``SLOTS`` words whatever the number of tokens."""
    mask = np.zeros(SLOTS, np.uint64)
    slot = F.expr(f"cast(shiftrightunsigned({name}, 6) % {SLOTS} as int)").alias("slot")
    table = tokens.groupBy(slot).agg(F.expr(f"bit_or(shiftleft(1L, cast({name} & 63 as int)))").alias("bits")).toArrow()
    mask[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(mask)


def inside(mask: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return (mask[((tokens >> np.uint64(6)) % np.uint64(SLOTS)).astype(np.int64)] >> (tokens & np.uint64(63))) & np.uint64(1) > 0


def short(tokens: np.ndarray) -> np.ndarray:
    """40 bits of each token, under which it is counted: more than a bit map tells apart."""
    return tokens >> np.uint64(24)


def text_hash() -> Column:
    """With doc_id the key of a row: rows that repeat both are one document."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def describe(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Staged rows doc_id, text_hash, n_shingles, node (null for empty sets), pre1 and pre2: the
    stored prefix tokens under either order."""
    spark = docs.sparkSession
    sample = np.uint64(max(1, round(100 / max(100 - percent, 1) / SAMPLED)))  # one token in so many is counted

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = np.concatenate([np.zeros(0, np.uint64), *shingles(batch.column("text"), n)])
            token, times = np.unique(short(own[own % sample == 0]), return_counts=True)
            yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(times.astype(np.int32))], ["token", "c"])

    counts = docs.select("text").mapInArrow(count, "token long, c int").groupBy("token").agg(F.sum("c").alias("c")).where("c > 1")
    counts = stage(counts, "counts")
    repeated, frequent = bitmap(spark, counts, "token"), bitmap(spark, counts.where(F.col("c") >= FREQUENT), "token")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(batch.column("text"), n)
            size = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate([np.zeros(0, np.uint64), *sets])
            sampled = every % sample == 0
            rank = np.where(sampled, inside(repeated.value, short(every)).astype(np.uint64), np.uint64(2))
            rank[sampled & inside(frequent.value, short(every))] = 3
            end = np.cumsum(size).tolist()
            columns = []
            for order in ORDERS:
                key = rank << np.uint64(62) | mix(every ^ np.uint64(order)) >> np.uint64(2)
                kept = []
                for b, m in zip(end, size.tolist(), strict=True):
                    length = m + (-percent * m // 100) + 1
                    if not m:
                        kept.append(np.zeros(0, np.int64))
                        continue
                    near = np.argpartition(key[b - m : b], length - 1)[:length] + (b - m)
                    kept.append(every[near[rank[near] > 0]].view(np.int64))
                columns.append(pa.array(kept, pa.list_(pa.int64())))
            node = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(size), node, *columns], ["doc_id", "text_hash", "n_shingles", "node", "pre1", "pre2"])

    schema = f"doc_id {kind}, text_hash long, n_shingles long, node long, pre1 array<long>, pre2 array<long>"
    return stage(docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(prefixes, schema), "described")


def fetch_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Staged (node, tokens, bits): the sets of the nodes in ``wanted`` as sorted 8-byte hashes,
    and their bit maps of eight bits a token or more."""
    mask = bitmap(docs.sparkSession, wanted, "node")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = {node_of(s): s for s in shingles(batch.column("text"), n) if len(s)}
            ids = np.array(list(found), np.int64)
            some = ids[inside(mask.value, ids.view(np.uint64))].tolist()
            for a in range(0, len(some), 500):
                part = some[a : a + 500]
                yield pa.record_batch([pa.array(part, pa.int64()), pa.array([found[i].tobytes() for i in part], pa.binary())], ["node", "tokens"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [bits_of(np.frombuffer(x.as_buffer(), np.uint64)).tobytes() for x in batch.column("tokens")]
            yield pa.record_batch([*batch.columns, pa.array(bits, pa.binary())], ["node", "tokens", "bits"])

    sets = docs.select("text").mapInArrow(pick, "node long, tokens binary").join(wanted, "node", "left_semi")
    return stage(sets.groupBy("node").agg(F.first("tokens").alias("tokens")).mapInArrow(draw, "node long, tokens binary, bits binary"), "sets")


def bits_of(own: np.ndarray) -> np.ndarray:
    """Which of 8 n (a power of two, 64 at least) hash values the tokens have, as 64-bit words."""
    size = max(64, 1 << (8 * len(own) - 1).bit_length())
    at = (own >> np.uint64(7)) % np.uint64(size)
    out = np.zeros(size // 64, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bit map that a smaller size would have given; sizes are powers of two."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


def may_link(differ: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``total`` tokens together may be similar if ``differ`` bits differ."""
    return differ * (100 + percent) <= total * (100 - percent)


def size_class(percent: int) -> Column:
    """Compatible sizes are in one class or in neighbouring ones; the last class is open."""
    width = max(0.01, 1.000001 * math.log(100 / percent))
    return F.least(F.lit(62), F.floor(F.log("n_shingles") / width)).cast("int")


def classes() -> list[Column]:
    """Of a group, its size c, all classes as bits, and those that an odd number of nodes have."""
    return [F.count("*").alias("c"), F.expr("bit_or(shiftleft(1L, cls))").alias("some"), F.expr("bit_xor(shiftleft(1L, cls))").alias("odd")]


def accompanied() -> Column:
    """Whether one of a group's ``c`` nodes may have company in its class or beside it.  A node whose class is
    odd is alone if no class can have more than two: then each even class has two, each odd one has one."""
    beside = F.expr("(some & shiftrightunsigned(shiftleft(5L, cls), 1)) != 0")
    return beside | F.expr("(odd & shiftleft(1L, cls)) = 0 or c - bit_count(some) > bit_count(some & ~odd)")


def paired(nodes: DataFrame, prefix: str, percent: int) -> DataFrame:
    """Rows (key, node, n_shingles) of prefix tokens that a node shares with one of a size that may
    be compatible: sizes that are differ by one class at most, the last class being open.

    Counts of a bucket and of its classes keep a lonely node of some buckets; no pair is lost.
    """
    cls = size_class(percent)
    each = nodes.select(F.explode(prefix).alias("key"), "node", "n_shingles")
    groups = each.withColumn("cls", cls).groupBy("key").agg(*classes()).where("c > 1")
    return each.join(groups, "key").withColumn("cls", cls).where(accompanied()).select("key", "node", "n_shingles")


def of(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``table`` whose node is in the one column of ``nodes``, a staged table."""
    return table.join(small(nodes.toDF("node")), "node", "left_semi")


def by_bits(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that pass the bit map bound."""
    both = pairs.join(bits.withColumnsRenamed({"node": "b", "bits": "right"}), "b").join(bits.withColumnsRenamed({"node": "a", "bits": "left"}), "a")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "right"):
            differ = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(len(x), len(y))
                differ.append(int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()))
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(may_link(np.array(differ, np.int64), total, percent)))

    return both.select("a", "b", "na", "nb", "left", "right").mapInArrow(bound, "a long, b long")


def unique_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(left), np.concatenate(right)
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return pa.record_batch([pa.array(a[new]), pa.array(b[new])], ["a", "b"])


def rest_of_buckets(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of one group (grp) and different components that pass the bit map bound; with
    ``nearest`` for each node only the pair whose bit maps differ least.

    ``rows`` has grp, side (0, or 1 for the second of two blocks that are only compared with each
    other), node, n_shingles, comp and bits; groups are of bounded size.
    """

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, n, comp, side, grp = (rows.column(c).to_numpy() for c in ("node", "n_shingles", "comp", "side", "grp"))
        bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("bits")]
        out_a, out_b, size = [], [], 0
        edge = np.append(np.flatnonzero(np.diff(grp, prepend=grp[0] - 1)), len(grp))
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            order = low + np.argsort(n[low:high], kind="stable")
            words = np.array([len(bits[i]) for i in order])
            tables = {}
            for w in np.unique(words).tolist():  # partners' maps are as large or twice as large
                use = np.flatnonzero((words >= w) & (words <= 2 * w))
                tables[w] = np.stack([folded(bits[order[i]], w) for i in use]), use[0]
            sizes, two = n[order], side[low:high].any()
            reach = np.searchsorted(sizes, sizes * 100 // percent, "right")
            least, best = np.full(len(order), np.iinfo(np.int64).max), np.full(len(order), -1)
            for k in range(high - low - 1):
                j = np.arange(k + 1, reach[k])
                j = j[(comp[order[j]] != comp[order[k]]) & ((side[order[j]] != side[order[k]]) if two else True)]
                if not len(j):
                    continue
                table, first = tables[words[k]]
                step = max(1, COMPARED // (8 * table.shape[1]))
                differ = np.concatenate([np.bitwise_count(table[j[a : a + step] - first] ^ table[k - first]).sum(1, dtype=np.int64) for a in range(0, len(j), step)])
                passed = may_link(differ, sizes[j] + sizes[k], percent)
                j, differ = j[passed], differ[passed]
                if not nearest:
                    out_a.append(np.full(len(j), node[order[k]]))
                    out_b.append(node[order[j]])
                    if (size := size + len(j)) > PAIRS:
                        yield unique_pairs(out_a, out_b)
                        out_a, out_b, size = [], [], 0
                elif len(j):
                    closer = differ < least[j]
                    least[j[closer]], best[j[closer]] = differ[closer], k
                    if differ[i := int(differ.argmin())] < least[k]:
                        least[k], best[k] = differ[i], j[i]
            if nearest:
                some = np.flatnonzero(best >= 0)
                out_a.append(node[order[some]])
                out_b.append(node[order[best[some]]])
        if out_a:
            yield unique_pairs(out_a, out_b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0

        for batch in slices(batches, "bits", 1 << 20):
            kept.append(batch)
            size += batch.column("bits").nbytes
            if size < 4 << 20:
                continue
            rows = pa.Table.from_batches(kept)
            grp = rows.column("grp").to_numpy()
            whole = int(np.argmax(grp == grp[-1]))  # the last group may go on
            if whole:
                yield from compare(rows.slice(0, whole).combine_chunks())
                kept = rows.slice(whole).to_batches()
                size = sum(b.column("bits").nbytes for b in kept)
        if kept:
            yield from compare(pa.Table.from_batches(kept).combine_chunks())

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(work, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The staged pairs (a, b) whose sets are similar enough; ``b`` should be the rarer to repeat."""
    left = of(sets, pairs.select("b")).withColumnsRenamed({"node": "b", "tokens": "right"})
    hubs = of(sets, pairs.select("a")).withColumnsRenamed({"node": "a", "tokens": "left"})
    both = pairs.select("a", "b").join(left, "b").join(hubs, "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "right"):
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


def component_table(docs: DataFrame, described: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, comp) of the nodes that have links."""
    nodes = stage(described.where("node is not null").dropDuplicates(["node"]).drop("doc_id"), "nodes")
    fits = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    first = stage(paired(nodes, "pre1", percent), "buckets")
    met = of(nodes, stage(first.select("node").distinct(), "nodes"))
    wanted = stage(paired(met, "pre2", percent).select("node").distinct(), "nodes")
    buckets = stage(of(first, wanted).withColumn("comp", F.col("node")), "buckets")
    second = nodes.select("node", "pre2")
    tested = links = None

    def linked(pairs: DataFrame) -> int:
        """Compare new pairs (a, b), contract what they link, and return the number of links."""
        nonlocal tested, links, buckets
        pairs = pairs.distinct()
        if tested is not None:
            both = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(both, ["a", "b"], "left_anti")
        pairs = stage(pairs.select("a", "b"), "met")
        left = of(second, pairs.select("a")).withColumnsRenamed({"node": "a", "pre2": "pa"})
        pairs = pairs.join(of(second, pairs.select("b")).withColumnsRenamed({"node": "b", "pre2": "pb"}), "b").join(left, "a")
        pairs = stage(pairs.where(F.arrays_overlap("pa", "pb")).select("a", "b"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = stage(verify(pairs, tokens, percent), "links")
        links = new if links is None else links.unionByName(new)
        if not (n_new := new.count()):
            return 0
        comps = components(links).withColumnsRenamed({"comp": "new"})
        buckets = stage(buckets.join(comps, "node", "left").select("key", "node", "n_shingles", F.coalesce("new", "comp").alias("comp")), "buckets")
        return n_new

    def mixed() -> DataFrame:
        """Buckets of several components, one of each set of nodes, with a hub."""
        hub = F.min_by(F.struct("node", "n_shingles", "comp"), F.xxhash64("node"))
        found = buckets.withColumn("cls", size_class(percent)).groupBy("key").agg(*classes(), F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"), hub.alias("hub"))
        return found.where("x != y").groupBy("c", "same", "some", "odd", "hub").agg(F.min("key").alias("key")).drop("same")

    def prune() -> DataFrame:
        """Keep only buckets that still have pairs to compare, with their size c and hub, and of
        them the nodes that may have a compatible one there."""
        nonlocal buckets
        rows = buckets.join(mixed(), "key").withColumn("cls", size_class(percent)).where(accompanied())
        rows = stage(rows.drop("some", "odd", "cls"), "rows")
        buckets = rows.drop("c", "hub")
        return rows

    rows = prune()
    sets = fetch_sets(docs, stage(rows.select("node").distinct(), "nodes"), n)
    tokens, bits = sets.drop("bits"), sets.drop("tokens")
    star = rows.where(F.col("comp") != F.col("hub.comp"))
    star = star.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n_shingles").alias("na"), F.col("n_shingles").alias("nb"))
    linked(by_bits(star.where(fits("na", "nb")).distinct(), bits, percent))
    n_nodes, round_ = sets.count(), 0
    while round_ <= NEAREST:
        rows = prune().drop("hub")
        if not rows.limit(1).count():
            break
        if round_ < NEAREST:  # contracting dense groups takes one bucket of each node, the largest
            rows = rows.groupBy("node", "n_shingles", "comp").agg(F.max(F.struct("c", "key")).alias("m")).select("m.key", "m.c", "node", "n_shingles", "comp")
        rows = rows.join(bits, "node")
        # A bucket of more than BLOCK nodes is cut into blocks; every two of them make a group.
        blocks = F.ceil(F.col("c") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")
        rows = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        rows = rows.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(group).alias("grp"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n_shingles", "comp", "bits")
        found = linked(rest_of_buckets(rows, percent, round_ < NEAREST))
        if round_ < NEAREST and 100 * found < n_nodes:  # dense groups are contracted
            round_ = NEAREST - 1
        round_ += 1
    if links is None:
        return docs.sparkSession.createDataFrame([], "node long, comp long")
    return components(links)


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their shingle sets;
    component_id is the least doc_id that links reach.  Null and empty texts have empty sets and
    link with nothing, so they keep their own id; a null doc_id never is a component's id if
    another is there.  Repeated rows are one node.  A very long text is one set and goes through
    Python alone; ties between ids cannot be, as the least counts.  An empty table gives no rows;
    other columns are ignored.
    """
    described = describe(docs, n, percent)
    comps = component_table(docs, described, n, percent)
    rows = described.select("doc_id", "n_shingles", "node").join(comps, "node", "left")
    rows = stage(rows.select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("comp")), "rows")
    ids = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("comp is not null").join(ids, "comp").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("comp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def members(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Staged (doc_id, text_hash, comp) of every row of ``docs``: the component by its least node,
    null for empty sets, so that rows whose doc_id is null or repeated are told apart."""
    described = describe(docs, n, percent)
    comps = component_table(docs, described, n, percent)
    rows = described.select("doc_id", "text_hash", "node").join(comps, "node", "left")
    return stage(rows.select("doc_id", "text_hash", F.coalesce("comp", "node").alias("comp")), "members")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a WHERE r.c < e.b),
c AS (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
