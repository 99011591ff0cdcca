"""SentencePiece encoding and decoding with batched numpy Viterbi over a public BPE model.

The model file holds merges, not piece probabilities: the best path by its scores is another segmentation than the
one the model stands for. What is right follows from a known property of such models: a sequence of pieces is the
encoding of a text exactly if every two neighbours are the encoding of their own concatenation, and every prefix of a
text has exactly one encoding. So the Viterbi pass goes over prefixes: at each end position it tries every piece that
ends there, and the one that fits the last piece of the prefix before it wins. Words of equal length advance together;
hashes of all their substrings probe the sorted hashes of the pieces; the maximum over the lengths is the backpointer.

Where two characters stand side by side in no piece, such as a letter before a blank or a comma, nothing merges across
them: texts fall into words there that are encoded apart, each distinct one once while a bounded table remembers it. Characters without a piece
become their UTF-8 byte pieces. Ids equal those of the public library; decoding gives the text back, byte for byte.

Null and empty texts have no pieces and decode to the empty text. Repeated rows are encoded one by one; tables may be
empty; only the id and text columns are read, other columns may have any name. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.common import table, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words remembered by a task, besides those of the batch at hand.
REMEMBERED = 300_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NONE, _FREE = -1, -2
_BITS, _SLOTS = 20, 21
_LOW = np.uint64((1 << _BITS) - 1)


def _mix(state: np.ndarray, char: np.ndarray) -> np.ndarray:
    out = (state ^ (char.astype(np.uint64) + np.uint64(1)) * _B) * _A
    return out ^ (out >> np.uint64(31))


def _sides(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left << np.uint64(21) | right) * _A) >> np.uint64(64 - _BITS)


class Pieces:
    """Tables of a model: sorted piece hashes, merge ranks, byte pieces, and what two neighbours allow."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.bytes_of = [p.replace(MARK, " ").encode() for p in self.texts]
        self.byte_ids = np.zeros(256, np.int64)
        usable = []
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.texts[i][3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(self.texts[i][3:-1], 16)])
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of[i] = b""
            else:
                usable.append(i)
        self.id_of = {self.texts[i]: i for i in usable}
        self.score = {self.texts[i]: model.get_score(i) for i in usable}
        # Only pieces that the merges reach can end a prefix.
        usable = [i for i in usable if self.merged(self.texts[i]) == [i]]
        self.longest = max(len(self.texts[i]) for i in usable)
        hashes = self.hashes([self.texts[i] for i in usable])
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(usable, np.int64)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.keys & _LOW] = True
        # Where two characters stand side by side in no piece, nothing merges across them.
        sides = {(ord(x), ord(y)) for i in usable for x, y in zip(self.texts[i], self.texts[i][1:])}
        self.inside = np.zeros(1 << _BITS, bool)
        self.inside[_sides(*np.array(sorted(sides), np.uint64).T)] = True
        # Worked-out pairs of neighbours in fixed slots: a later pair of the same slot takes its place.
        self.slot_pair, self.slot_fits = np.full(1 << _SLOTS, _NONE, np.int64), np.zeros(1 << _SLOTS, bool)

    @staticmethod
    def hashes(texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.uint64)
        sizes = np.array([len(t) for t in texts])
        for size in np.unique(sizes):
            pick = np.flatnonzero(sizes == size)
            chars = np.array([[ord(c) for c in texts[i]] for i in pick], np.uint64)
            state = np.zeros(len(pick), np.uint64)
            for k in range(size):
                state = _mix(state, chars[:, k])
            out[pick] = state
        return out

    def merged(self, text: str) -> list[int]:
        """Ids of a short text by its definition: join the neighbours of the best piece, leftmost first, until none is left."""
        parts, score, worst = list(text), self.score.get, float("-inf")
        while len(parts) > 1:
            scores = [score(a + b, worst) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == worst:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.id_of.get(p, _NONE) for p in parts]

    def fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces is the encoding of its concatenation."""
        pairs = left * len(self.texts) + right
        slots = ((pairs.astype(np.uint64) * _A) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = self.slot_fits[slots]
        fresh = np.flatnonzero(self.slot_pair[slots] != pairs)
        if len(fresh):
            codes, back = np.unique(pairs[fresh], return_inverse=True)
            fits = np.array([self.merged(self.texts[a] + self.texts[b]) == [a, b] for a, b in zip(*np.divmod(codes, len(self.texts)))])
            out[fresh] = fits[back]
            self.slot_pair[slots[fresh]] = pairs[fresh]
            self.slot_fits[slots[fresh]] = out[fresh]
        return out

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, how many each has) for words of one common length."""
        size, n = len(words[0]), len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size)
        last = np.full((n, size + 1), _NONE, np.int64)  # last piece of each prefix; none at the start and at unknown characters
        step = np.ones((n, size + 1), np.int64)
        state = np.zeros((n, 0), np.uint64)  # hash of the last 1, 2, ... characters
        for end in range(1, size + 1):
            state = np.concatenate([np.zeros((n, 1), np.uint64), state[:, : self.longest - 1]], axis=1)
            state = _mix(state, chars[:, end - 1 : end])
            rows, back = np.nonzero(self.bits[state & _LOW])
            sought = state[rows, back]
            at = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
            real = self.keys[at] == sought
            rows, back, ids = rows[real], back[real], self.ids[at[real]]
            before = last[rows, end - 1 - back]
            fit = before == _NONE
            pairs = np.flatnonzero(~fit)
            if len(pairs):
                fit[pairs] = self.fitting(before[pairs], ids[pairs])
            rows, back, ids = rows[fit], back[fit], ids[fit]
            best = np.zeros(n, np.int64)
            np.maximum.at(best, rows, back + 1)
            won = best[rows] == back + 1
            last[rows[won], end] = ids[won]
            step[:, end] = np.maximum(best, 1)
        # All words go back together, filling their pieces from the right.
        grid, spot, every = np.full((n, size), _FREE, np.int64), np.full(n, size), np.arange(n)
        for column in range(size - 1, -1, -1):
            going = spot > 0
            if not going.any():
                break
            grid[going, column] = last[every[going], spot[going]]
            spot -= np.where(going, step[every, spot], 0)
        counts = (grid != _FREE).sum(axis=1)
        flat = grid[grid != _FREE]
        if (flat == _NONE).any():
            flat, counts = self._with_bytes(words, flat, counts)
        return flat.astype(np.int32), counts

    def _with_bytes(self, words, flat, counts) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece replaced by the pieces of their bytes."""
        out, at = [], 0
        for k, word in enumerate(words):
            ids, spot = [], 0
            for piece in flat[at : at + counts[k]].tolist():
                if piece == _NONE:
                    ids.extend(self.byte_ids[list(word[spot].encode("utf-8", "replace"))].tolist())
                    spot += 1
                else:
                    ids.append(piece)
                    spot += len(self.texts[piece])
            at += counts[k]
            out.append(ids)
        return np.array([i for ids in out for i in ids], np.int64), np.array([len(ids) for ids in out])


class Encoder:
    """Encodes and decodes texts; remembers a bounded number of words."""

    def __init__(self, path: str = MODEL):
        self.path = path
        self.forget()

    @cached_property
    def pieces(self) -> Pieces:
        return Pieces(self.path)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends, self.chars = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        """Encode new words; those of equal length advance together in bounded groups."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        flats, counts = [self.flat], []
        for size, same in by_size.items():
            room = max(1, 500_000 // (size + 1))
            for start in range(0, len(same), room):
                part = same[start : start + room]
                flat, count = self.pieces.viterbi(part)
                flats.append(flat)
                counts.append(count)
                first = len(self.known)
                self.known.update(zip(part, range(first, first + len(part))))
            self.chars += size * len(same)
        self.flat = np.concatenate(flats)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: a mark is put in front, blanks become marks, as the model's own rules say."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        text = "".join(marked)
        if not text:
            return [np.zeros(0, np.int32) for _ in texts]
        starts = np.cumsum([0, *map(len, marked)])
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        apart = np.ones(len(chars) + 1, bool)
        apart[1:-1] = ~self.pieces.inside[_sides(chars[:-1], chars[1:])]
        apart[starts] = True
        cuts = np.flatnonzero(apart)
        bounds = cuts.tolist()
        words = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        distinct = set(words)
        fresh = [w for w in distinct if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED or self.chars > REMEMBERED * 40:
            self.forget()
            fresh = list(distinct)
        if fresh:
            self._learn(fresh)
        look = self.known
        index = np.array([look[w] for w in words])
        first, size = self.ends[index], self.ends[index + 1] - self.ends[index]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(first - ends + size, size) + np.arange(ends[-1])]
        parts = np.concatenate([[0], ends])[np.searchsorted(cuts, starts)]
        return [ids[a:b] for a, b in zip(parts[:-1].tolist(), parts[1:].tolist())]

    def decode(self, ids) -> str:
        """The text of ``ids``; the mark in front is taken off. Bytes that are no UTF-8 become replacement characters."""
        look = self.pieces.bytes_of
        raw = b"".join([look[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_ENCODER: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    return _ENCODER.setdefault(path, Encoder(path))


def encode(docs: DataFrame, path: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, round_trip): ids of every whole text, and whether they decode to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for keys, texts in text_slices(batches, 1_000_000):
            ids = encoder.encode(texts)
            same = [encoder.decode(i.tolist()) == t for i, t in zip(ids, texts)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(same)], names=["doc_id", "ids", "round_trip"])
        # A worker outlives its task and may serve other stages: it keeps the model's tables, not the words, nor freed buffers.
        encoder.forget()
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with ``doc_id`` and ``ids``; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [encoder.decode(i.as_py() or ()) for i in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(ids: np.ndarray) -> int:
    """XXH64 of the ids as little-endian 32-bit numbers."""
    return xxhash.xxh64_intdigest(np.asarray(ids, "<i4").tobytes())


def op7(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of every document."""
    return encode(table(spark, sf_dir, "documents")).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
