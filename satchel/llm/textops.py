"""Vectorised text helpers over Arrow arrays, shared by the operators that run in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20  #: text handled at once in a Python worker; one longer text goes alone


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about ``budget`` bytes in ``column``."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(size, dtype=np.int64) // budget
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words (runs without ASCII white space) of an array of texts.

    ``doc`` has each word's text number, ``code`` its place in ``vocabulary``, ``count`` the
    words of each text.  Null texts have none.
    """

    def __init__(self, text: pa.Array, lower: bool = False) -> None:
        text = pc.fill_null(text, "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
        flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
        there = pc.greater(pc.binary_length(flat), 0)
        flat, doc = flat.filter(there), doc.filter(there)
        coded = flat.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.doc = doc.to_numpy(zero_copy_only=False)
        self.count = np.bincount(self.doc, minlength=len(text))

    def total(self, by_word: np.ndarray) -> np.ndarray:
        """Per text the sum of a value given by vocabulary entry."""
        return np.bincount(self.doc, weights=by_word[self.code], minlength=len(self.count))

    def windows(self, n: int) -> np.ndarray:
        """Whether n words of one text start at each place."""
        out = np.zeros(len(self.doc), bool)
        if len(out) >= n:
            out[: len(out) - n + 1] = self.doc[: len(out) - n + 1] == self.doc[n - 1 :]
        return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.flatnonzero(np.diff(twice, prepend=~twice[0]))]
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys
