"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit per language in every cell: the AND of a gram's cells is
the mask of all languages that contain it.  A text's grams are looked up once for all languages;
per language the set bits are counted, corrected for that slice's false-positive rate, and the
largest count decides.

Words are normalised to lower-case letters and padded with a space on either side; grams are
the runs of ``SIZES`` code points within a padded word.  A gram belongs to a language if the
sample of that language has it ``LEAST`` times and at least ``SHARE`` times as often, relative
to the sample's grams, as the language that has it most often.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm.textops import Words, mix, slices
from satchel.plans.staging import stage

ROWS_PER_LANGUAGE = 800  #: sample of each language that fills the filters, chosen by hash of the text
SIZES = (3, 4)
LEAST, SHARE = 3, 0.05
PROBES = 3
WORD = 64  #: languages of a mask; further languages have masks of their own
_NO_LETTER = re.compile(r"[^\n\w]|[\d_]")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit gram hashes, the number of the word each belongs to, and which words have letters."""
    words = _NO_LETTER.sub("", "\n".join(vocabulary).lower()).split("\n") if vocabulary else []
    lengths = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths + 2)
    keys, owners = [], []
    for n in SIZES:
        if len(chars) < n:
            continue
        m = len(chars) - n + 1
        inside = (word[:m] == word[n - 1 :]) & (lengths[word[:m]] > 0)
        key = np.full(m, n, np.uint64)
        for k in range(n):
            key = (key + chars[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys.append(mix(key[inside]))
        owners.append(word[:m][inside])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(keys) if keys else empty.astype(np.uint64)), (np.concatenate(owners) if owners else empty), lengths > 0


class LanguageFilter:
    """The bit-sliced filter: ``cells`` has an array for every ``WORD`` languages, with a mask of
    them in each place.  ``masks`` are the keys' masks, a row for each array."""

    def __init__(self, languages: list[str], keys: np.ndarray, masks: np.ndarray, prior: int = 0) -> None:
        self.languages, self.prior = languages, prior
        self.bits = max(12, int(np.ceil(np.log2(max(len(keys), 1) * 8))))
        self.cells, full = [], []
        for first, mask in zip(range(0, len(languages), WORD), np.atleast_2d(masks), strict=True):
            size = min(WORD, len(languages) - first)
            kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if t(0).nbytes * 8 >= size)
            cells = np.zeros(1 << self.bits, kind)
            for place in self._places(keys):
                np.bitwise_or.at(cells, place, mask.astype(kind))
            self.cells.append(cells)
            full += [((cells >> kind(k)) & kind(1)).mean() for k in range(size)]
        full = np.array(full)
        self.false_rate = np.minimum(full**PROBES, 0.99)

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        step = (keys >> np.uint64(32)) | np.uint64(1)
        for k in range(PROBES):
            yield ((keys + np.uint64(k) * step) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def masks(self, keys: np.ndarray, number: int = 0) -> np.ndarray:
        """All languages of each gram, as bits; of the array ``number``."""
        out, cells = None, self.cells[number]
        for place in self._places(keys):
            out = cells[place] if out is None else out & cells[place]
        return out

    def counts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text and language the corrected number of grams, the number of grams, and
        whether the text has a letter."""
        words = Words(text)
        keys, owner, letters = grams(words.vocabulary.to_pylist())
        masks, size = None, len(words.vocabulary)
        n = words.total(np.bincount(owner, minlength=size)) if size else np.zeros(len(text))
        found = np.zeros((len(text), len(self.languages)))
        for k in range(len(self.languages)):
            if size:
                if k % WORD == 0:
                    masks = self.masks(keys, k // WORD)
                bit = (masks >> masks.dtype.type(k % WORD)) & masks.dtype.type(1)
                found[:, k] = words.total(np.bincount(owner, weights=bit, minlength=size))
        fixed = (found - n[:, None] * self.false_rate) / (1 - self.false_rate)
        has = words.total(letters.astype(float)) > 0 if size else np.zeros(len(text), bool)
        return np.maximum(fixed, 0), n, has

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        """A language and a score (its share of all languages' counts) for each text."""
        counts, _, has = self.counts(text)
        best = np.where(counts.max(1) > 0, counts.argmax(1), self.prior)
        score = counts[np.arange(len(best)), best] / np.maximum(counts.sum(1), 1e-9)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, has, strict=True)], np.where(has, np.minimum(score, 1), 0.0)


def learn(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray, int] | None:
    """What the filter is made of: languages, gram hashes, their masks (a row for every ``WORD``
    languages) and the number of the most frequent language.  None if there is nothing to learn
    from.

    About ``rows`` different texts of each language of ``labelled`` (doc_id, text, lang) are used;
    rows that repeat a text are drawn alike and count once.
    """
    spark = labelled.sparkSession
    known = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not sizes:
        return None
    languages = sorted(r.lang for r in sizes)
    share = {r.lang: min(1.0, rows / r.n) for r in sizes}
    table = spark.createDataFrame([(x, k, share[x]) for k, x in enumerate(languages)], "lang string, k int, share double")
    draw = F.pmod(F.xxhash64("text", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(table), "lang").where(draw < F.col("share")).select("text", "k").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            keys, owner, _ = grams(words.vocabulary.to_pylist())
            of = np.array(batch.column("k").to_pylist(), np.int64)
            for k in np.unique(of):
                use = np.bincount(words.code[of[words.doc] == k], minlength=len(words.vocabulary))[owner]
                seen = use > 0
                key, back = np.unique(keys[seen], return_inverse=True)
                n = np.bincount(back, weights=use[seen], minlength=len(key)).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(key), k, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["k", "gram", "n"])

    counts = stage(sample.mapInArrow(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), "grams")
    totals = F.broadcast(counts.groupBy("k").agg(F.sum("n").alias("total")))
    rate = counts.join(totals, "k").withColumn("rate", F.col("n") / F.col("total"))
    own = rate.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("most"))
    # Only the filter's content comes to the driver: a row for each gram.
    found = own.groupBy("gram").agg(F.collect_list("k").alias("of")).toArrow().combine_chunks()
    of = found.column("of").combine_chunks()
    k, at = of.flatten().to_numpy().astype(np.int64), pc.list_parent_indices(of).to_numpy().astype(np.int64)
    masks = np.zeros((-(-len(languages) // WORD), found.num_rows), np.uint64)
    np.bitwise_or.at(masks, (k // WORD, at), np.uint64(1) << (k % WORD).astype(np.uint64))
    return languages, found.column("gram").to_numpy().view(np.uint64), masks, languages.index(sizes[0].lang)


def fit(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> LanguageFilter | None:
    """The filter of what ``learn`` finds.  Every language is learnt, however many there are."""
    found = learn(labelled, rows)
    return LanguageFilter(*found) if found else None


def identify(docs: DataFrame, model: LanguageFilter | None) -> DataFrame:
    """Per row doc_id, lang_pred and score.

    Texts that are null or have no letter are ``und`` with score 0, and so is everything when
    there is no model.  A text with letters but without known grams gets the most frequent
    language with score 0; of languages with equal counts the first by name is taken.  Repeated
    rows are judged apart and alike, very long texts whole; an empty table gives no rows, and other
    columns are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column("text")
            lang, score = model.predict(text) if model else (["und"] * len(text), np.zeros(len(text)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double")
