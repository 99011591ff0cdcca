"""Periodic runs against a plain search over all periods; the query against a plain version of its contract."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from outlay.llm import periodic_runs
from tests.llm.test_edges import KIND, LONG, TEXTS, rows

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(words):
    """(start, length, period) of every run, by comparing all words q apart for every q."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        k = 0
        while k < len(words) - q:
            begin = k
            while k < len(words) - q and words[k] == words[k + q]:
                k += 1
            length = k - begin + q
            if k > begin and length >= max(6, 4 * q):
                found.setdefault((begin, length), q)
            k += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def fast(texts):
    flat = np.array([x for w in texts for x in w], np.int64)
    got = [[] for _ in texts]
    for t, s, n, q in zip(*[x.tolist() for x in periodic_runs.runs(flat, np.array([len(w) for w in texts], np.int64))]):
        got[t].append((s, n, q))
    return got


def made(rng):
    n, kinds = rng.choice([0, 3, 6, 20, 60, 200]), rng.choice([1, 2, 2, 3, 20])
    words = [rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3 + 1))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.5:
            words[rng.randrange(n)] = rng.randrange(kinds)
    return words


def test_equals_plain_search():
    rng = random.Random(1)
    for _ in range(150):
        texts = [made(rng) for _ in range(rng.randint(1, 12))]
        assert fast(texts) == [plain(w) for w in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4))
def test_equals_plain_search_on_small_alphabets(texts):
    assert fast(texts) == [plain(w) for w in texts]


def test_two_runs_of_one_period_with_a_gap():
    unit = [1, 2, 3]
    texts = [unit * 5 + [9, 1, 2, 9] + unit * 6, [4] * 6 + [5] * 5 + [6] * 7]
    assert fast(texts) == [plain(w) for w in texts] and len(fast(texts)[1]) == 2


def test_extension_equals_word_by_word():
    rng = random.Random(7)
    words = [w for _ in range(40) for w in made(rng)] + [1] * 300
    laid = np.array([-1, *words, -2], np.int64)
    grammar = periodic_runs.Grammar(laid)
    x = np.array([rng.randrange(1, len(words) + 1) for _ in range(2_000)])
    y = np.array([rng.randrange(1, len(words) + 1) for _ in range(2_000)])
    x, y = x[x != y], y[x != y]
    for step in (1, -1):
        for a, b, n in zip(x, y, grammar.extension(x, y, step)):
            assert (laid[a : a + n * step : step] == laid[b : b + n * step : step]).all() if a + n * step >= 0 and b + n * step >= 0 else True
            assert laid[a + n * step] != laid[b + n * step]


def test_long_texts_in_time():
    begin = time.monotonic()
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 50_000, 50_000)
    texts = [np.tile(unit, 5), rng.integers(0, 50_000, 300_000), np.zeros(100_000, np.int64)]
    t, s, n, q = periodic_runs.runs(np.concatenate(texts), np.array([len(x) for x in texts]))
    assert list(zip(t.tolist(), s.tolist(), n.tolist(), q.tolist())) == [(0, 0, 250_000, 50_000), (2, 0, 100_000, 1)]
    assert time.monotonic() - begin < 60


def test_edges(spark):
    docs, none = rows(spark), rows(spark, [])
    got = periodic_runs.scanned(docs).collect()
    assert len(got) == len(TEXTS) and sum(r.doc_id is None for r in got) == 1
    by = {r.doc_id: r for r in got}
    assert [by[k].n_words for k in (1, 2, 3, 4, 7)] == [0, 0, 0, 30_000, 1]
    assert [tuple(r) for r in by[4].runs] == [(0, 30_000, 997)] and by[4].collapsed == " ".join(LONG.split()[:997])
    assert by[5].collapsed == "one two three four five six seven eight nine" and by[1].collapsed == ""
    assert periodic_runs.scanned(none).count() == 0 and periodic_runs.planted(none).count() == 0
    assert periodic_runs.without_repeats(docs).columns == ["doc_id", "text"]
    assert set(KIND.replace(",", "").split()[::2]) >= {"row", "words", "t"}
    same = periodic_runs.planted(docs).where("doc_id IS NULL").first()
    assert same.text == "no id here at all"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not here")
def test_query(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        words, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain(words)
        gone = {i for s, k, q in found for i in range(s + q, s + k)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        want[r.doc_id] = (
            len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
        )
    got = periodic_runs.op11(spark, FOLDER)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert sum(w[0] > 0 for w in want.values()) > 5
