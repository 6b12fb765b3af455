"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation maximises the sum of the pieces' log-probabilities.  The encoder reads
characters in order and keeps the scores of a window of the longest piece's length, and the
backpointers from the last committed boundary on.  Whenever all surviving backpointer paths pass
through one boundary, the ids before it are committed and their backpointers are forgotten.

``Streams`` runs many such streams in step, one character of each at a time.  A stream starts
where two characters stand side by side inside no piece, since every path has a boundary there;
a text without such a place is one stream, however long it is.

Scores are sums of whole 65,536ths, so they are exact, and ties go to the piece that starts first.
A merge-rank vocabulary says only in which order pieces were merged; its ranks become
log-probabilities by Zipf's law, -ln(rank + SHIFT) - ln(sum of 1 / (rank + SHIFT)).

A character at which no piece ends becomes byte pieces.  A text is prefixed with a space and
spaces are written as U+2581; a literal U+2581 is written as bytes, so decoding gives back every
text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from satchel.llm.textops import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0  #: how far an unknown character scores below the worst piece
SHIFT = 2.7  #: of Zipf's law for merge ranks
UNIT = 1 << 16  #: scores are multiples of 1 / UNIT
CHECK = 32  #: characters between two looks for a common boundary
STREAM = 512  #: characters after which a stream ends at the next sure boundary
STREAMS_BYTES = 1 << 20  #: text encoded at once; one longer text goes alone
LITERAL, BETWEEN = 0x110000, 0x110001  #: codes for a literal U+2581, and for what stands between texts
NONE, NO_PIECE = -(1 << 30), -(3 << 29)  #: of a boundary that no path reaches; and of a piece that is not there


class HashMap:
    """A read-only map from non-negative longs to ints as arrays; absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.levels = []
        while len(keys):
            bits = max(4, int(len(keys) * 8).bit_length())
            slot = self._slot(keys, len(self.levels), bits)
            table, value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            table[slot], value[slot] = keys, values  # the last one of a slot stays
            rest = table[slot] != keys
            full = np.zeros(1 << bits, bool)
            full[slot[rest]] = True
            self.levels.append((bits, table, value, full))
            keys, values = keys[rest], values[rest]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0x5851F42D4C957F2D & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        if level == len(self.levels):
            return np.full(len(keys), -1, np.int32)
        bits, table, value, full = self.levels[level]
        slot = self._slot(keys, level, bits)
        hit = table[slot] == keys
        out = np.where(hit, value[slot], np.int32(-1))
        more = np.flatnonzero(full[slot] & ~hit)
        if len(more):
            out[more] = self.get(keys[more], level + 1)
        return out


class Pieces:
    """A vocabulary: pieces with scores, byte pieces, and the pairs that occur inside pieces."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int, size: int) -> None:
        self.scores = {p: (i, round(s * UNIT) / UNIT) for p, (i, s) in scores.items()}
        self.byte_ids, self.unknown, self.size = byte_ids, unknown, size
        self.longest = max(map(len, scores), default=1)
        self.floor = min((s for _, s in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        self.table = [b""] * size
        for piece, (i, _) in scores.items():
            self.table[i] = piece.replace(SPACE, " ").encode()
        for value, i in enumerate(byte_ids):
            self.table[i] = bytes([value])
        # A tree of prefixes: node 0 is the root, `step` leads on, `ends` has the id of a piece that ends there.
        nodes = {"": 0}
        for p in scores:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.first = np.zeros(BETWEEN + 1, np.int32)
        keys, values = [], []
        for p, node in nodes.items():
            if len(p) == 1:
                self.first[ord(p)] = node
            elif p:
                keys.append(nodes[p[:-1]] << 21 | ord(p[-1]))
                values.append(node)
        self.step = HashMap(np.array(keys, np.int64), np.array(values, np.int32))
        self.ends, self.worth = np.full(len(nodes), -1, np.int32), np.full(len(nodes), NO_PIECE, np.int32)
        self.width = np.ones(size + 1, np.int32)  # characters of an id; `size` stands for a character in bytes
        for p, (i, s) in self.scores.items():
            self.ends[nodes[p]], self.worth[nodes[p]], self.width[i] = i, round(s * UNIT), len(p)
        joined = np.array(sorted({ord(p[i]) << 21 | ord(p[i + 1]) for p in scores for i in range(len(p) - 1)}), np.int64)
        self.joined = HashMap(joined, np.ones(len(joined), np.int32))

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, byte_ids = {}, [model.unk_id()] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                scores.setdefault(piece, (i, float(model.get_score(i))))
        if scores and all(s == int(s) for _, s in scores.values()):  # merge ranks
            order = sorted(scores, key=lambda p: (-scores[p][1], scores[p][0]))
            weight = 1 / (np.arange(len(order)) + SHIFT)
            scores = {p: (scores[p][0], float(w)) for p, w in zip(order, np.log(weight / weight.sum()), strict=True)}
        return Pieces(scores, byte_ids, model.unk_id(), model.get_piece_size())

    def stream(self, chars: Iterator[str]) -> Iterator[int]:
        """Ids of one stream of characters in which spaces already are U+2581 and None stands for a
        literal U+2581; committed as soon as they are certain."""
        text: list[str] = []  # from the last committed boundary on
        best, back = [0.0], [-1]  # best score of each boundary, and the boundary before it
        seen = 0

        def path(to: int) -> list[int]:
            out = []
            while to > 0:
                at = back[to]
                piece = text[at:to]
                found = self.scores.get("".join(piece)) if None not in piece else None
                if found:
                    out.append([found[0]])
                else:
                    out.append([self.byte_ids[b] for b in (piece[0] or SPACE).encode()])
                to = at
            return [i for part in reversed(out) for i in part]

        for c in chars:
            text.append(c)
            end = len(text)
            top, at = -np.inf, end - 1
            window = text[max(0, end - self.longest) : end]
            joined = "".join(x or "\0" for x in window)
            for k in range(len(joined)):
                found = self.scores.get(joined[k:])
                if found and None not in window[k:] and (score := best[end - len(joined) + k] + found[1]) > top:
                    top, at = score, end - len(joined) + k
            if top == -np.inf:  # no piece ends here: bytes
                top = best[end - 1] + self.floor
            best.append(top)
            back.append(at)
            seen += 1
            if seen % CHECK == 0:
                # Boundaries from which later pieces may start; follow them back till they meet.
                alive = set(range(max(0, end - self.longest + 1), end + 1))
                while len(alive) > 1:
                    last = max(alive)
                    alive.discard(last)
                    alive.add(back[last] if last else 0)
                common = alive.pop()
                if common > 0:
                    yield from path(common)
                    text = text[common:]
                    best, back = best[common:], [b - common for b in back[common:]]
        yield from path(len(text))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids begin and end."""
        spaced = [" " + t if t else "" for t in texts]
        chars = np.frombuffer(("\0".join(spaced) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64) if texts else np.zeros(0, np.int64)
        end = np.cumsum([len(t) + 1 for t in spaced], dtype=np.int64)
        chars[chars == ord(SPACE)] = LITERAL
        chars[chars == ord(" ")] = ord(SPACE)
        chars[end - 1] = BETWEEN
        streams = Streams(self, chars)
        found = streams.run()
        kept = np.flatnonzero((found >= 0) & (chars != BETWEEN))
        ids = found[kept]
        times = np.ones(len(chars), np.int64)
        times[chars == BETWEEN] = 0
        times[found < 0] = 0
        odd = np.flatnonzero(ids == self.size)
        if len(odd):  # characters in bytes
            code, which = np.unique(chars[kept[odd]], return_inverse=True)
            each = [[self.byte_ids[b] for b in (SPACE if c == LITERAL else chr(c)).encode()] for c in code.tolist()]
            n = np.array([len(x) for x in each])
            times[kept[odd]] = n[which]
            at = np.concatenate([[0], np.cumsum(times[kept])])
            ids = np.repeat(ids, times[kept])
            flat, start = np.array([i for x in each for i in x], np.int32), np.cumsum(n) - n
            k = n[which]
            inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            ids[np.repeat(at[odd], k) + inner] = flat[np.repeat(start[which], k) + inner]
        total = np.concatenate([[0], np.cumsum(times)])
        return ids, total[np.concatenate([[0], end])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        table = self.table
        return b"".join([table[i] for i in ids])[1:].decode("utf-8", "replace")


class Streams:
    """Streaming Viterbi over many streams in step.

    ``chars`` holds the streams one after the other.  ``run`` gives for each character the id of
    the piece that ends there (``size`` for a character in bytes, -1 for none).  ``seen`` counts
    the characters that went through streams, ``kept`` is the most backpointers of one stream
    that waited for a commit.
    """

    def __init__(self, pieces: Pieces, chars: np.ndarray) -> None:
        self.pieces, self.n, self.seen, self.kept = pieces, len(chars), 0, 0
        self.chars = np.append(chars, np.full(pieces.longest, BETWEEN))
        self.out = np.full(self.n, -1, np.int32)
        sure = np.flatnonzero(np.append(True, pieces.joined.get(chars[:-1] << 21 | chars[1:]) < 0)[: self.n])
        start = sure[np.append(True, np.diff(sure // STREAM) > 0)[: len(sure)]]
        length = np.diff(np.append(start, self.n))
        order = np.argsort(-length, kind="stable")
        self.start, self.length = start[order], length[order]

    def lattice(self, at: int, streams: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the pieces that start at the next characters of the first streams, by
        character, length and stream."""
        p, shape = self.pieces, (CHECK, self.pieces.longest, streams)
        worth, ids = np.full(shape, NO_PIECE, np.int32), np.full(shape, -1, np.int32)
        here = (np.arange(CHECK)[:, None] + (self.start[:streams] + at)[None, :]).ravel()
        cell = (np.arange(CHECK)[:, None] * (p.longest * streams) + np.arange(streams)[None, :]).ravel()
        there = here < self.n
        here, cell = here[there], cell[there]
        node = p.first[self.chars[here]]
        for k in range(p.longest):
            on = np.flatnonzero(node > 0)
            if not len(on):
                break
            here, cell, node = here[on], cell[on], node[on]
            found = p.ends[node]
            some = np.flatnonzero(found >= 0)
            where = cell[some] + k * streams
            worth.ravel()[where], ids.ravel()[where] = p.worth[node[some]], found[some]
            if k + 1 < p.longest:
                node = p.step.get(node.astype(np.int64) << 21 | self.chars[here + k + 1])
        return worth, ids

    def run(self) -> np.ndarray:
        p, reach = self.pieces, self.pieces.longest
        floor = round(p.floor * UNIT)
        streams, base, at = len(self.start), 0, 0
        best = np.full((reach + 1, streams), NONE, np.int32)  # of the boundaries from `at` on
        best[0] = 0
        back = np.full((8 * CHECK + reach + 1, streams), -1, np.int32)  # ids that end at the boundaries from `base` on
        done, look = np.zeros(streams, np.int64), np.zeros(streams, np.int64)  # committed boundary, and where to look for the next one
        while streams:
            if at - base + CHECK + reach >= len(back):  # forget what is committed, and make room
                low = int(done.min())
                rest = back[low - base : at - base + reach + 1]
                back = np.full((2 * len(rest) + 8 * CHECK + reach + 1, streams), -1, np.int32)
                back[: len(rest)], base = rest, low
            worth, ids = self.lattice(at, streams)
            best = np.concatenate([best, np.full((CHECK, streams), NONE, np.int32)])
            for t in range(CHECK):
                ahead, own = best[t + 1 : t + 1 + reach], back[at - base + t + 1 : at - base + t + 1 + reach]
                score = worth[t] + best[t]
                better = score > ahead
                np.copyto(ahead, score, where=better)
                np.copyto(own, ids[t], where=better)
                none = ahead[0] == NONE  # no piece ends there: bytes
                if none.any():
                    ahead[0][none] = best[t][none] + floor
                    own[0][none] = p.size
            self.seen += int(np.minimum(self.length[:streams] - at, CHECK).sum())
            at += CHECK
            best = best[CHECK:]
            ended = self.length[:streams] <= at
            common = np.where(ended, self.length[:streams], done)
            some = np.flatnonzero(~ended & (look <= at))
            if len(some):
                common[some] = np.maximum(self.meet(best[:, some], back, some, base, at, int(done[some].min())), done[some])
                look[some] = at + np.maximum(at - common[some], 1)  # a path that is open for long is looked at less often
            self.commit(back, base, common, done)
            self.kept = max(self.kept, int((at - common).max()))
            left = int((~ended).sum())  # the longest streams come first
            best, back, done, look, streams = best[:, :left], back[:, :left], common[:left], look[:left], left
            if left:
                best = np.where(best > NONE, best - best[0], NONE).astype(np.int32)
        return self.out

    def meet(self, best: np.ndarray, back: np.ndarray, some: np.ndarray, base: int, at: int, low: int) -> np.ndarray:
        """The last boundary of each of some streams through which all its surviving paths pass."""
        own = back[low - base : at - base + len(best)][:, some]
        alive = np.zeros(own.shape, bool)
        alive[at - low :] = best > NONE
        count = alive.sum(0)
        for b in range(len(own) - 1, 0, -1):
            open_ = count > 1
            move = np.flatnonzero(alive[b] & open_)
            if not len(move):
                if not open_.any():
                    break
                continue
            alive[b, move] = False
            to = b - self.pieces.width[own[b, move]]  # not before what is committed
            count[move] -= alive[to, move]
            alive[to, move] = True
        return low + len(own) - 1 - np.argmax(alive[::-1], axis=0)

    def commit(self, back: np.ndarray, base: int, common: np.ndarray, done: np.ndarray) -> None:
        """Write the ids of the paths from ``done`` to ``common``."""
        now, stream = common.copy(), np.arange(len(common))
        while len(stream):
            on = np.flatnonzero(now > done[stream])
            now, stream = now[on], stream[on]
            found = back[now - base, stream]
            self.out[self.start[stream] + now - 1] = found
            now = now - self.pieces.width[found]



def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Per row of ``docs``: doc_id, ids, n_ids, round_trip (decoding the ids gives the text) and
    decoded_sha256 of what they decode to.

    Null and empty texts have no ids and decode to nothing.  A very long text is cut into streams
    at sure boundaries; without any it is one stream.  Ties go to the piece that starts first.
    Repeated rows are encoded alike, an empty table gives no rows, and other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, budget=STREAMS_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, at = model.encode_all(texts)
            every, same, digest = ids.tolist(), [], []
            for text, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True):
                back = model.decode(every[a:b])
                same.append(back == text)
                digest.append(hashlib.sha256(back.encode()).hexdigest())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            columns = [batch.column("doc_id"), lists, pa.array(np.diff(at)), pa.array(same, pa.bool_()), pa.array(digest, pa.string())]
            yield pa.record_batch(columns, ["doc_id", "ids", "n_ids", "round_trip", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, ids array<int>, n_ids long, round_trip boolean, decoded_sha256 string")


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids): doc_id and text.  Null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else shared.value.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {kind}, text string")
