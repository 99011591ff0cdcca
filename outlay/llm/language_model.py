"""Language-model scores by a weighted backoff automaton over the whole corpus.

States of the automaton are the root and every word seen in training. A known pair (h, w) is an arc from state h with
weight log p(w | h) = log (c(hw) + MU * p(w)) / (c(h) + MU); every state has a failure arc to the root with weight
log MU / (c(h) + MU); the root has an arc for each word with log p(w) = log (c(w) + 1) / (N + V + 1), the last one for
any unknown word. Probabilities of a state sum to one. A text is read once from left to right: the state is the last
word if it is known, the root otherwise; the start of a text is a state too.

The automaton grows with the corpus and is never held whole. Documents are dealt into blocks of about
``BLOCK_CHARS`` by a hash. Each block counts its words and pairs and sends the keys, packed, to shards by key range; a
shard adds up all blocks and sends back to each block the totals that differ from its own; with those the block holds
exactly the arcs that its texts can take, and walks them. A key comes at most once from a block, so no key is hot, and
shards and blocks are as many as the corpus needs. The texts are shuffled once, keys once, differing totals once.

Words are 63-bit hashes: a corpus of 10 million distinct words confuses two of them with odds of 1e-5. Null and empty
texts have the end token alone. Repeated rows are learned from and scored one by one; a null id is in training, as its
remainder is unknown. Without training rows N and V are 0 and every token has probability one. Only id and text are
read, other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.common import table

BLOCK_CHARS = 8_000_000
#: Weight of the word distribution against the counts of a state.
MU = 50.0
FOLDS, HELD = 7, 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)
END = np.uint64(xxhash.xxh64_intdigest(b"\x00end") & ~1)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Odd keys of pairs; words have even keys."""
    out = (left * _A) ^ (right * _B)
    out ^= out >> np.uint64(32)
    out *= _A
    return (out ^ (out >> np.uint64(29))) | _ONE


class Block:
    """Tokens of a block of texts and the pairs they make with the token before; the end token precedes each text."""

    def __init__(self, texts: list[str | None]):
        words, sizes = [], []
        for t in texts:
            own = (t or "").encode("utf-8", "surrogatepass").lower().split()
            words += own
            words.append(None)
            sizes.append(len(own) + 1)
        known: dict[bytes | None, int] = {}
        index = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        keys = np.array([END if w is None else xxhash.xxh64_intdigest(w) & ~1 for w in known], np.uint64)
        self.sizes = np.array(sizes, np.int64)
        self.tokens = keys[index] if len(index) else np.zeros(0, np.uint64)
        # The token before the first one of a text is the end of the text before it: one start state for all.
        self.before = np.concatenate([[END], self.tokens[:-1]]) if len(index) else self.tokens
        self.pairs = _pair(self.before, self.tokens)

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys of words and pairs, how often each is in training texts; 0 for keys of other texts)."""
        weight = np.repeat(train, self.sizes).astype(np.int64)
        keys, back = np.unique(np.concatenate([self.tokens, self.pairs]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([weight, weight]), len(keys)).astype(np.int64)

    def walk(self, keys: np.ndarray, counts: np.ndarray, n: int, v: int, mu: float) -> dict[str, np.ndarray]:
        """Sums by text along the arcs; counts are totals of the corpus."""
        at = lambda x: counts[np.searchsorted(keys, x)]
        c, state, arc = at(self.tokens), at(self.before), at(self.pairs)
        word = np.log10(c + 1.0) - np.log10(n + v + 1.0)
        with np.errstate(divide="ignore"):
            along = np.log10(arc + mu * 10.0**word) - np.log10(state + mu)
        failed = np.log10(mu) - np.log10(state + mu) + word
        score = np.where(state == 0, word, np.where(arc > 0, along, failed))
        first = np.cumsum(self.sizes) - self.sizes
        add = lambda x: np.add.reduceat(x, first)
        return {"n_tokens": self.sizes, "n_known": add((c > 0).astype(np.int64)), "base_score": add(word), "score": add(score)}


_PACKED = "shard long, block long, keys binary, counts binary"
_TOTALS = "block long, shard long, changed binary, totals binary, n long, v long"


def _planes(values: np.ndarray) -> bytes:
    """Numbers as eight planes of bytes: the upper ones of sorted keys and small counts compress to little."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _cuts(keys: np.ndarray, shards: int) -> list[int]:
    """Where each shard begins in sorted keys: shards are equal ranges of the keys' upper half."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64)).tolist()


def _count_block(shards: int, held: int):
    def run(group: pa.Table) -> pa.Table:
        number = group.column("block")[0].as_py()
        block = Block(group.column("text").to_pylist())
        keys, counts = block.counts(_training(group, held))
        cuts = _cuts(keys, shards)
        # Every block writes to every shard, so that it hears the sums of all.
        parts = list(zip(cuts[:-1], cuts[1:]))
        return pa.table({
            "shard": pa.array(np.arange(shards), pa.int64()), "block": pa.array(np.full(shards, number), pa.int64()),
            "keys": pa.array([_planes(keys[a:b]) for a, b in parts], pa.binary()),
            "counts": pa.array([_planes(counts[a:b]) for a, b in parts], pa.binary()),
        })

    return run


def _training(group: pa.Table, held: int) -> np.ndarray:
    return np.array([f != held for f in group.column("fold").to_pylist()], bool)


def _sum_shard(group: pa.Table) -> pa.Table:
    number = group.column("shard")[0].as_py()
    blocks = group.column("block").to_pylist()
    keys = [_numbers(k.as_py()) for k in group.column("keys")]
    counts = [_numbers(c.as_py()).astype(np.int64) for c in group.column("counts")]
    all_keys, back = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(back, np.concatenate(counts), len(all_keys)).astype(np.int64)
    words = (all_keys & _ONE) == 0
    n, v = int(totals[words].sum()), int((totals[words] > 0).sum())
    changed, news, at = [], [], 0
    for k, c in zip(keys, counts):
        total = totals[back[at : at + len(k)]]
        at += len(k)
        new = total != c
        changed.append(np.packbits(new).tobytes())
        news.append(_planes(total[new]))
    many = len(blocks)
    return pa.table({
        "block": pa.array(blocks, pa.int64()), "shard": pa.array([number] * many, pa.int64()), "changed": pa.array(changed, pa.binary()),
        "totals": pa.array(news, pa.binary()), "n": pa.array([n] * many, pa.int64()), "v": pa.array([v] * many, pa.int64()),
    })


_SCORED = "doc_id long, fold long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_block(shards: int, held: int, mu: float):
    def run(group: pa.Table, totals: pa.Table) -> pa.Table:
        block = Block(group.column("text").to_pylist())
        keys, counts = block.counts(_training(group, held))
        cuts = _cuts(keys, shards)
        for shard, changed, news in zip(totals.column("shard").to_pylist(), totals.column("changed"), totals.column("totals")):
            own = counts[cuts[shard] : cuts[shard + 1]]
            own[np.unpackbits(np.frombuffer(changed.as_py(), np.uint8), count=len(own)).astype(bool)] = _numbers(news.as_py())
        n, v = sum(totals.column("n").to_pylist()), sum(totals.column("v").to_pylist())
        found = block.walk(keys, counts, n, v, mu)
        return pa.table({
            "doc_id": group.column("doc_id"), "fold": group.column("fold"), "n_tokens": pa.array(found["n_tokens"], pa.int64()),
            "n_known": pa.array(found["n_known"], pa.int64()), "train_tokens": pa.array(np.full(group.num_rows, n), pa.int64()),
            "base_score": pa.array(found["base_score"], pa.float64()), "score": pa.array(found["score"], pa.float64()),
        })

    return run


def scores(docs: DataFrame, folds: int = FOLDS, held: int = HELD, mu: float = MU, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, fold, n_tokens, n_known, train_tokens, base_score, score); fold ``held`` is not learned from."""
    chars = docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    many = int(chars // block_chars) + 1
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)), F.lit(-1)).cast("long")
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), "text")
    packed = rows.groupBy("block").applyInArrow(_count_block(many, held), _PACKED)
    totals = packed.groupBy("shard").applyInArrow(_sum_shard, _TOTALS)
    return rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_score_block(many, held, mu), _SCORED)


def op3(spark, sf_dir: str) -> DataFrame:
    out = scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.col("fold") == HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
