"""Quality rules: an isolation forest on rule statistics.

Each document gets a few rule statistics in one pass.  Random cuts of the statistics' span make
the trees; how many of all rows labelled good lie in each node gives the path lengths, as means
over all subsamples of these rows.  Documents that few splits isolate have short paths and a high
anomaly score.  The score from which a document is rejected is calibrated on all labelled rows,
good and bad.  Nothing is fitted on a sample: spans, counts of nodes and counts of scores are
taken over every labelled row in the cluster, and only these tables of fixed size are collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.textops import Words, mix, repeated, slices
from satchel.plans.staging import small, stage

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
TREES, SUBSAMPLE, SEED = 128, 256, 7
GRID = 1 << 16  #: scores are multiples of 1 / GRID, so that a table counts the rows of each
MAX_FALSE = 0.002  #: share of good labelled rows that calibration may reject

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol_share", "word_length", "upper_share", "short_share", "line_words"]


def statistics(text: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of ``COUNTS`` and the matrix of ``FEATURES`` (rows: texts)."""
    words = Words(text)
    length = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(float)
    n_words, word_chars = words.count, words.total(length)
    n_symbols, upper, n_lines, n_dup = (np.zeros(len(text), np.int64) for _ in range(4))
    for i, value in enumerate(text.to_pylist()):
        if not value:
            continue
        raw = value.encode()
        n_symbols[i] = len(raw) - len(raw.translate(None, SYMBOLS))
        upper[i] = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        lines = [line for line in value.split("\n") if line.strip(BLANKS)]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
    code = mix(words.code.astype(np.uint64) + np.uint64(1))
    start = np.flatnonzero(words.windows(3))
    key = mix(mix(mix(words.doc[start].astype(np.uint64)) ^ code[start]) * np.uint64(3) + code[start + 1]) * np.uint64(5) + code[start + 2]
    found = start[repeated(mix(key))]
    covered = np.zeros(len(words.doc), bool)
    for k in range(3):
        covered[found + k] = True
    n_repeat = np.bincount(words.doc, weights=covered, minlength=len(text))
    per_word, per_char = 1 / np.maximum(n_words, 1), 1 / np.maximum(word_chars, 1)
    features = np.stack(
        [
            n_symbols * per_char,
            np.log2(1 + word_chars * per_word),
            upper * per_char,
            words.total((length <= 3).astype(float)) * per_word,
            np.log2(1 + n_words / np.maximum(n_lines, 1)),
        ],
        axis=1,
    )
    counts = dict(zip(COUNTS, (n_words, word_chars, n_symbols, n_dup, n_repeat), strict=True))
    return {k: v.astype(np.int64) for k, v in counts.items()}, features


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Under 50 words, or over half of them in repeated 3-word windows."""
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def unsuccessful(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a search among n points in a random tree."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, n - 1)


class Forest:
    """Random split trees of one depth as arrays; node i has children 2i+1 and 2i+2.

    Cuts are drawn from the node's part of ``box`` (the span of all labelled rows) and not from
    the span of the node's own points, so that values outside all points are cut off too.  Cuts
    so need no points, and a path length is the mean over all subsamples of ``size`` points (with
    replacement): a subsample's path goes on below a node where it has two points or more, which
    has a probability that follows from the share of all points in the node.
    """

    def __init__(self, points: np.ndarray | None, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.size, self.depth = subsample, max(1, int(np.ceil(np.log2(max(subsample, 2)))))
        self.inner = 2**self.depth - 1
        some = np.flatnonzero(box[1] > box[0])
        if not len(some):
            some = np.arange(len(box[0]))
        self.feature = some[rng.integers(len(some), size=(trees, self.inner))].astype(np.int8)
        self.split, at = rng.random((trees, self.inner)), np.arange(trees)
        low, high = (np.empty((2 * self.inner + 1, trees, len(box[0]))) for _ in range(2))
        low[0], high[0] = box
        for i in range(self.inner):
            f = self.feature[:, i]
            cut = low[i, at, f] + self.split[:, i] * (high[i, at, f] - low[i, at, f])
            for child in (2 * i + 1, 2 * i + 2):
                low[child], high[child] = low[i], high[i]
            high[2 * i + 1, at, f] = low[2 * i + 2, at, f] = self.split[:, i] = cut
        self.path = np.zeros((trees, self.inner + 1))
        if points is not None:
            self.settle(self.mass(points))

    def leaves(self, points: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf (from 0) of each point."""
        rows = np.arange(len(points))
        for feature, split in zip(self.feature, self.split, strict=True):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (points[rows, feature[node]] > split[node])
            yield node - self.inner

    def mass(self, points: np.ndarray) -> np.ndarray:
        """The number of points in each tree's leaves; the masses of parts of the points add up."""
        return np.stack([np.bincount(leaf, minlength=self.inner + 1) for leaf in self.leaves(points)])

    def settle(self, mass: np.ndarray) -> None:
        """Set the path lengths of all leaves from the mass of all points."""
        total = int(mass[0].sum())
        self.size = n = min(self.size, total)
        share = mass / max(total, 1)
        self.path = np.zeros(share.shape)
        for k in range(2, n + 1):
            self.path += float(unsuccessful(k)) * math.comb(n, k) * share**k * (1 - share) ** (n - k)
        for d in range(1, self.depth + 1):
            share = np.minimum(share.reshape(len(share), -1, 2).sum(2), 1)
            self.path += np.repeat(1 - (1 - share) ** n - n * share * (1 - share) ** max(n - 1, 0), 2**d, axis=1)

    def score(self, points: np.ndarray) -> np.ndarray:
        """From 0 to 1; the higher, the sooner random splits isolate the point."""
        total = np.zeros(len(points))
        for leaf, path in zip(self.leaves(points), self.path, strict=True):
            total += path[leaf]
        score = 2 ** (-total / len(self.feature) / max(float(unsuccessful(self.size)), 1e-9))
        return np.round(score * GRID) / GRID


def calibrate(score: np.ndarray, good: np.ndarray, bad: np.ndarray, max_false: float = MAX_FALSE) -> float:
    """The score above which rows are rejected, from the good and bad rows counted at each score.

    It maximises the share of bad rows rejected less ``1 / (10 * max_false)`` times the share of
    good ones, among scores that reject at most ``max_false`` of the good ones, and lies midway
    between the last rejected score and the first kept one.
    """
    order = np.argsort(-score)
    own = score[order]
    lost = np.cumsum(good[order]) / max(good.sum(), 1)
    gain = np.cumsum(bad[order]) / max(bad.sum(), 1) - lost / (10 * max_false)
    gain[lost > max_false] = -1
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return np.inf
    return float((own[best] + own[min(best + 1, len(own) - 1)]) / 2)


def measure(docs: DataFrame) -> DataFrame:
    """Staged doc_id, the counts, base_failed and f (the features) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, features = statistics(batch.column("text"))
            f = pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, (*counts.values(), base_failed(counts))), f], ["doc_id", *COUNTS, "base_failed", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, f array<double>"
    return stage(docs.select("doc_id", "text").mapInArrow(work, schema), "measured")


def matrix(f: pa.Array) -> np.ndarray:
    return f.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def fit(measured: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE) -> tuple[Forest | None, float]:
    """A forest and its threshold from all labelled documents; ids with contradicting labels and
    rows that the base rules reject are left out.  Without good rows there is no forest and
    nothing but the base rules rejects."""
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("__most")).where("q = __most and doc_id is not null").select("doc_id", (F.col("q") == 1).alias("good"))
    known = small(stage(known, "known"))
    rows = stage(measured.where("not base_failed").join(known, "doc_id").select("good", "f"), "labelled")
    span = rows.agg(F.count_if("good").alias("n"), *[f(F.col("f")[k]).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(len(FEATURES))]).first()
    if not span.n:
        return None, np.inf
    low, high = (np.array([span[f"{name}{k}"] for k in range(len(FEATURES))]) for name in ("low", "high"))
    forest = Forest(None, (low, high))

    def mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(forest.path.shape, np.int64)
        for batch in batches:
            total += forest.mass(matrix(batch.column("f")))
        leaf = np.flatnonzero(total)
        yield pa.record_batch([pa.array(leaf), pa.array(total.ravel()[leaf])], ["leaf", "n"])

    found = rows.where("good").select("f").mapInArrow(mass, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    every = np.zeros(forest.path.size, np.int64)
    every[found.column("leaf").to_numpy()] = found.column("n").to_numpy()
    forest.settle(every.reshape(forest.path.shape))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, GRID + 1), np.int64)
        for batch in batches:
            score = np.round(forest.score(matrix(batch.column("f"))) * GRID).astype(np.int64)
            np.add.at(total, (batch.column("good").to_numpy(zero_copy_only=False).astype(int), score), 1)
        some = np.flatnonzero(total.any(0))
        yield pa.record_batch([pa.array(some), pa.array(total[1, some]), pa.array(total[0, some])], ["score", "good", "bad"])

    found = rows.mapInArrow(place, "score long, good long, bad long").groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    score, good, bad = (found.column(c).to_numpy() for c in ("score", "good", "bad"))
    return forest, calibrate(score / GRID, good, bad, max_false)


def assess(docs: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE) -> DataFrame:
    """Per row doc_id, the counts, base_failed, anomaly (0 to 1) and kept.

    Null and empty texts have no words and fail the base rules; so does anything of under 50
    words.  Repeated rows are judged apart and alike.  A score equal to the threshold is kept.  Very
    long texts are measured whole, one at a time; an empty table gives no rows.  Other columns are
    ignored.
    """
    measured = measure(docs)
    forest, limit = fit(measured, labels, max_false)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            anomaly = forest.score(matrix(batch.column("f"))) if forest else np.zeros(len(failed))
            yield pa.record_batch([*batch.columns[:-1], pa.array(anomaly), pa.array(~failed & (anomaly <= limit))], [*batch.schema.names[:-1], "anomaly", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, anomaly double, kept boolean"
    return measured.mapInArrow(judge, schema)


def keep(docs: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns; texts are measured twice,
    for the fit and for the verdict, so that no row is joined back."""
    forest, limit = fit(measure(docs), labels, max_false)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, features = statistics(batch.column("text"))
            kept = ~base_failed(counts)
            if forest:
                kept &= forest.score(features) <= limit
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(select, docs.schema)
