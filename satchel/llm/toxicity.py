"""Toxicity by a linear-chain conditional random field over words.

The field tags each word as clean or toxic.  Words are described by their normalised form and
its prefixes; a transition matrix links neighbours.  Token labels come from labelled documents:
in documents labelled toxic, words with a form or prefix that many more of them have, or have
repeatedly, than clean documents.  Training maximises the likelihood of these tags; forward-backward marginals
of a document are then aggregated to a score by a logistic function fitted on the same sample,
and words whose marginal is at least one half give the offending offsets.

Forward and backward passes run over all documents of a slice at once.  Documents are cut into
chunks; transfer matrices of all chunks are multiplied in step, chained within each document,
and the marginals follow chunk by chunk.  The result is that of the plain recursion, for texts
of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.textops import Words, slices

FIT_ROWS = 1_500  #: labelled documents of either class that fit the model, by hash of the id
FIT_CHARS = 20_000  #: longer texts fit nothing, so that the sample's bytes are bounded as well
PREFIXES = (3, 4, 5, 6)
MIN_DOCS, MIN_ODDS = 4, 3.0  #: what makes a form or prefix toxic evidence
CHUNK = 128
ROUNDS, RATE, DECAY = 60, 0.3, 1e-3
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def forms(vocabulary: pa.Array) -> list[pa.Array]:
    """The describing strings of each vocabulary entry: its letters and digits, and prefixes."""
    whole = pc.replace_substring_regex(pc.utf8_lower(vocabulary), r"[^\p{L}\p{N}]+", "")
    long_enough = [pc.greater(pc.utf8_length(whole), k) for k in PREFIXES]
    cut = [pc.if_else(ok, pc.binary_join_element_wise(pc.utf8_slice_codeunits(whole, 0, k), "", "~"), None) for k, ok in zip(PREFIXES, long_enough, strict=True)]
    return [pc.if_else(pc.equal(whole, ""), None, whole), *cut]


class Chain:
    """Marginals of two-state chains with emission log-odds ``e`` per word, for many documents."""

    def __init__(self, doc: np.ndarray, n_docs: int) -> None:
        size = np.bincount(doc, minlength=n_docs)
        chunks = -(-size // CHUNK)
        first = np.cumsum(chunks) - chunks
        within = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        self.row, self.col = first[doc] + within // CHUNK, within % CHUNK
        self.total = int(chunks.sum())
        owner = np.repeat(np.arange(n_docs), chunks)
        number = np.arange(self.total) - first[owner]
        order = np.argsort(number, kind="stable")
        self.layers = np.split(order, np.cumsum(np.bincount(number))[:-1]) if self.total else []
        self.last = number == chunks[owner] - 1
        self.there = np.zeros((CHUNK, self.total), bool)
        self.there[self.col, self.row] = True

    def run(self, e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of state 1 per word, and the expected number of each transition.

        ``move`` has the potentials from state to state; a document starts after a clean word.
        """
        n, ratio = self.total, np.ones((CHUNK, self.total))
        ratio[self.col, self.row] = np.exp(np.clip(e, -30, 30))
        # Transfer matrices: rows are the state before the chunk, columns the state at its end.
        p = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, n)).copy()
        for c in range(CHUNK):
            on = self.there[c]
            q0 = p[:, 0] * move[0, 0] + p[:, 1] * move[1, 0]
            q1 = (p[:, 0] * move[0, 1] + p[:, 1] * move[1, 1]) * ratio[c]
            scale = 1 / (q0 + q1).max(0)
            p[:, 0], p[:, 1] = np.where(on, q0 * scale, p[:, 0]), np.where(on, q1 * scale, p[:, 1])
        enter, leave = np.zeros((2, n)), np.ones((2, n))
        for k, layer in enumerate(self.layers):
            if k == 0:
                enter[0, layer] = 1
            else:  # the chunk before is the previous row
                a = np.einsum("an,abn->bn", enter[:, layer - 1], p[:, :, layer - 1])
                enter[:, layer] = a / a.sum(0)
        for layer in reversed(self.layers):
            inner = layer[~self.last[layer]]
            b = np.einsum("abn,bn->an", p[:, :, inner + 1], leave[:, inner + 1])
            leave[:, inner] = b / b.sum(0)
        alpha = np.empty((CHUNK + 1, 2, n))
        alpha[0] = enter
        for c in range(CHUNK):
            a0 = alpha[c, 0] * move[0, 0] + alpha[c, 1] * move[1, 0]
            a1 = (alpha[c, 0] * move[0, 1] + alpha[c, 1] * move[1, 1]) * ratio[c]
            s = 1 / (a0 + a1)
            on = self.there[c]
            alpha[c + 1, 0], alpha[c + 1, 1] = np.where(on, a0 * s, alpha[c, 0]), np.where(on, a1 * s, alpha[c, 1])
        marginal, beta, pairs = np.zeros((CHUNK, n)), leave.copy(), np.zeros((2, 2))
        for c in reversed(range(CHUNK)):
            on = self.there[c]
            both = alpha[c + 1] * beta
            marginal[c] = both[1] / (both[0] + both[1])
            w = np.stack([beta[0], beta[1] * ratio[c]])
            joint = alpha[c][:, None] * move[:, :, None] * w[None]
            pairs += (joint / joint.sum((0, 1)))[:, :, on].sum(2)
            b = np.einsum("ab,bn->an", move, w)
            beta = np.where(on, b / b.sum(0), beta)
        return marginal[self.col, self.row], pairs


class ToxicModel:
    """Forms with their weights, transitions, and the document-level logistic function."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float, move: np.ndarray, outer: np.ndarray) -> None:
        self.names, self.weights, self.bias, self.move, self.outer = pa.array(names, pa.string()), weights, bias, move, outer

    def emission(self, vocabulary: pa.Array) -> np.ndarray:
        out = np.full(len(vocabulary), self.bias)
        for form in forms(vocabulary):
            at = pc.index_in(form, value_set=self.names)
            out += np.append(self.weights, 0.0)[pc.fill_null(at, len(self.weights)).to_numpy(zero_copy_only=False)]
        return out

    def marginals(self, words: Words) -> np.ndarray:
        if not len(words.doc):
            return np.zeros(0)
        return Chain(words.doc, len(words.count)).run(self.emission(words.vocabulary)[words.code], self.move)[0]

    def score(self, words: Words, p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-summary(words, p) @ self.outer))


def summary(words: Words, p: np.ndarray) -> np.ndarray:
    """What the document score is made of: 1, the largest marginal's log-odds, and the expected
    number of words that are more toxic than not, in logs."""
    most = np.zeros(len(words.count))
    np.maximum.at(most, words.doc, p)
    most = np.clip(most, 1e-3, 1 - 1e-3)
    sure = np.bincount(words.doc, weights=np.where(p >= 0.5, p, 0), minlength=len(most))
    return np.stack([np.ones(len(most)), np.log(most / (1 - most)), np.log1p(sure)], 1)


def train(texts: list[str], toxic: np.ndarray, share: float) -> ToxicModel:
    """A model of labelled texts; ``share`` is the part of toxic documents among all labelled."""
    words = Words(pa.array(texts, pa.string()))
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    described = forms(words.vocabulary)
    names: dict[str, int] = {}
    rows, ids = [], []
    for form in described:
        for row, value in enumerate(form.to_pylist()):
            if value is not None:
                rows.append(row)
                ids.append(names.setdefault(value, len(names)))
    rows, ids = np.array(rows, np.int64), np.array(ids, np.int64)
    # Documents of either class that have each form: (document, form) pairs and how often.
    seen, often = np.unique(words.doc.astype(np.int64) << 32 | words.code, return_counts=True)
    order = np.argsort(rows, kind="stable")
    start = np.searchsorted(rows[order], np.arange(len(words.vocabulary) + 1))
    code, doc = seen & 0xFFFFFFFF, seen >> 32
    count = (start[1:] - start[:-1])[code]
    at = np.repeat(start[:-1][code] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    pair, back = np.unique(np.repeat(doc, count) << 32 | ids[order][at], return_inverse=True)
    often = np.bincount(back, weights=np.repeat(often, count), minlength=len(pair))
    use = np.bincount((pair & 0xFFFFFFFF)[toxic[pair >> 32]], minlength=len(names)) >= MIN_DOCS
    odds = np.full(len(names), -np.inf)
    for least in (1, 2):  # a form that clean documents have by chance may stand out where it is repeated
        held = pair[often >= least]
        in_toxic = toxic[held >> 32]
        with1 = np.bincount((held & 0xFFFFFFFF)[in_toxic], minlength=len(names))
        with0 = np.bincount((held & 0xFFFFFFFF)[~in_toxic], minlength=len(names))
        own = np.log((with1 + 0.5) / (n1 + 1)) - np.log((with0 + 0.5) / (n0 + 1))
        # Likelihood ratio of "toxic share differs"; it must stand out among all forms looked at.
        part = lambda k, p: k * np.log(np.maximum(k, 1e-9) / np.maximum((with1 + with0) * p, 1e-9))  # noqa: B023, E731
        ratio = 2 * (part(with1, n1 / len(texts)) + part(with0, n0 / len(texts)))
        own[(ratio < 2 * np.log(10 * max(use.sum(), 1))) | (with1 < MIN_DOCS)] = -np.inf
        odds = np.maximum(odds, own)
    number = np.cumsum(use) - 1
    keep = use[ids]
    rows, ids = rows[keep], number[ids[keep]]
    evidence = np.full(len(words.vocabulary), -np.inf)
    np.maximum.at(evidence, rows, odds[use][ids])
    tag = (evidence[words.code] >= MIN_ODDS) & toxic[words.doc]
    weights, bias, move = np.zeros(int(use.sum())), -4.0, np.zeros((2, 2))
    chain = Chain(words.doc, len(texts))
    before = np.append(False, tag[:-1])
    before[np.append(True, words.doc[1:] != words.doc[:-1])[: len(before)]] = False
    observed = np.array([[(~before & ~tag).sum(), (~before & tag).sum()], [(before & ~tag).sum(), (before & tag).sum()]], float)
    squares = [np.full(len(weights), 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    scale = 1 / max(tag.sum(), 1)
    for _ in range(ROUNDS if len(words.doc) else 0):
        e = np.full(len(words.vocabulary), bias)
        np.add.at(e, rows, weights[ids])
        p, pairs = chain.run(e[words.code], np.exp(move))
        gap = np.bincount(words.code, weights=tag - p, minlength=len(words.vocabulary)) * scale
        grads = [np.bincount(ids, weights=gap[rows], minlength=len(weights)) - DECAY * weights, gap.sum(), (observed - pairs) * scale - DECAY * move]
        squares = [s + g * g for s, g in zip(squares, grads, strict=True)]
        step = [RATE * g / np.sqrt(s) for g, s in zip(grads, squares, strict=True)]
        weights, bias, move = weights + step[0], float(bias + step[1]), move + step[2]
    model = ToxicModel([k for k, u in zip(names, use, strict=True) if u], weights, bias, np.exp(move), np.zeros(3))
    x = summary(words, model.marginals(words))
    weight = np.where(toxic, share / max(n1, 1), (1 - share) / max(n0, 1)) * len(texts)
    for _ in range(30):  # Newton steps of a logistic regression with a small ridge
        mu = 1 / (1 + np.exp(-x @ model.outer))
        ridge = np.diag([1e-3, 1e-1, 1e-1])
        hess = (x * (weight * mu * (1 - mu))[:, None]).T @ x + ridge
        model.outer = model.outer + np.linalg.solve(hess, x.T @ (weight * (toxic - mu)) - ridge @ model.outer)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicModel | None:
    """A model from at most ``rows`` documents of either class; ids with contradicting labels are
    left out.  None if a class is missing."""
    known = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most")).where("toxic = __most and toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    drawn = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").where(F.coalesce(F.char_length("text"), F.lit(0)) <= FIT_CHARS).select("text", "toxic").collect()
    sample.sort(key=lambda r: (r.toxic, r.text or ""))
    toxic = np.array([r.toxic == 1 for r in sample], bool)
    if not toxic.any() or toxic.all():
        return None
    return train([r.text or "" for r in sample], toxic, sizes[1] / (sizes[0] + sizes[1]))


def tag(docs: DataFrame, model: ToxicModel | None) -> DataFrame:
    """Per row doc_id, score (0 to 1) and spans, an array of (start, end, p) of toxic words in
    code points, end exclusive.

    Null and empty texts have no words: they get the score of a text without toxic words.
    Without a model all scores are 0.  Repeated rows are scored apart and alike, an empty table
    gives no rows, and other columns are ignored.  A very long text is scored whole; its chunks
    take about 100 bytes a word.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column("text")
            score, spans = np.zeros(len(text)), [[] for _ in range(len(text))]
            if model:
                words = Words(text)
                p = model.marginals(words)
                score = model.score(words, p)
                first = np.cumsum(words.count) - words.count
                hot = np.flatnonzero(p >= 0.5)
                for i in np.unique(words.doc[hot]):
                    places = [m.span() for m in WORD.finditer(text[int(i)].as_py())]
                    spans[i] = [{"start": places[k][0], "end": places[k][1], "p": float(p[first[i] + k])} for k in hot[words.doc[hot] == i] - first[i]]
            yield pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {id_kind}, score double, spans array<struct<start:int,end:int,p:double>>")
