"""Hard negatives against plain sorting, the certificate of the shared lists, and odd input."""

import math
import os
import random

import numpy as np
import pytest

from outlay.llm import hard_negatives as hn
from outlay.llm.queries import QUERIES, SQL
from tests.check_queries import compare, database

FOLDER = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int, vec string, slab string, block string, aid string, cluster string"


def rows(spark, data):
    return spark.createDataFrame([(i, v, k, "v", "s", "b", "a", "c") for i, k, v in data], KIND)


def plain(data, every=100):
    """Result rows by sorting all scores of every anchor."""
    ok = [(i, k, [math.floor(256 * x) for x in v]) for i, k, v in data
          if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for i, k, v in ok:
        if i % every:
            continue
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, m) for j, m, w in ok if j != i)
        for s, p, _ in [x for x in scored if x[2] == k][:5]:
            fits = [x for x in scored if x[2] != k and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, p, r, j, -s, -t) for r, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, data):
    usable = hn.usable(rows(spark, data))
    return sorted(tuple(r) for r in hn.mined(usable, usable.where("vec_id % 100 = 0")).collect())


def test_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 5)
    rng = np.random.default_rng(5)
    near = rng.normal(size=8)
    data = []
    for i in range(0, 4_000, 4):
        # A third of the rows are near copies of one vector, some rows are equal, some are zeros.
        v = near + rng.normal(size=8) * 0.01 if i % 3 == 0 else np.zeros(8) if i % 41 == 0 else rng.integers(-3, 4, 8) / 4
        data.append((i, int(rng.integers(0, 4)), [float(x) for x in v]))
    got = mined(spark, data)
    assert got == plain(data) and len(got) > 500


@pytest.mark.parametrize("powers", [(0, 5, 6), (0, 7, 8)])
def test_exact_where_numbers_are_large(spark, powers):
    """The second case leaves the range of a long, where scores count as the nearest one."""
    rng = random.Random(2)
    data = [(i, i // 20 % 2, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice(powers) for _ in range(4)]) for i in range(0, 1_000, 20)]
    got = mined(spark, data)
    assert got == plain(data) and max(abs(r[4]) for r in got) > 2**53


def test_edges(spark):
    one = [0.5, 0.25]
    data = [
        (0, 1, one), (None, 1, one), (1, None, one), (2, 1, None), (3, 1, [None, 1.0]), (4, 2, [math.nan, 1.0]), (5, 2, [math.inf, 1.0]), (6, 1, one),
        (7, 2, [0.3, 0.1]), (8, 2, [0.3]), (9, 2, []), (100, 2, one), (200, 5, [0.0, 0.0]), (300, 1, [-0.5, -0.5]), (11, 1, [1e308, 1.0]),
    ]
    assert mined(spark, data) == plain(data)
    again = data + [(6, 1, one), (7, 2, [0.3, 0.1])]
    got = mined(spark, again)
    assert got and set(got) >= {r for r in got if r[1] == 6} and sum(r[:2] == (0, 6) and r[2] == 1 for r in got) == 2
    assert mined(spark, []) == [] and mined(spark, data[1:6]) == []
    assert mined(spark, [(100, 1, one)]) == []


def test_lists_bound_every_score():
    rng = np.random.default_rng(0)
    members, vectors = rng.normal(size=(30, 6)) * 5, rng.normal(size=(500, 6)) * rng.random((500, 1)) * 9
    directions, lengths = hn._unit(vectors)
    own, sizes = hn._unit(members)
    order, bound = hn.shared_list(own, directions, lengths)
    assert (np.diff(bound) <= 0).all()
    assert (members @ vectors[order].T <= sizes[:, None] * bound + 1e-6).all()


def test_walk_ends_early_on_a_tight_cluster():
    rng = np.random.default_rng(0)
    members = np.round(np.array([1.0, 0, 0, 0]) * 200 + rng.normal(size=(20, 4)))
    far = np.round(rng.normal(size=(20_000, 4)) * 20)
    far[:, 0] = -np.abs(far[:, 0])
    vectors = np.concatenate([members + 1, far])
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                seen.append(len(key))
            return np.asarray(super().__getitem__(key))

    own, sizes = hn._unit(members)
    directions, lengths = hn._unit(vectors)
    order, bound = hn.shared_list(own, directions, lengths)
    low, high = np.full((20, 1), -math.inf, object), np.full((20, 1), math.inf, object)
    a, b = hn.alike(members, vectors)
    zeros = np.zeros(20, np.int64)
    found = hn.walk(a, zeros - 1, zeros, sizes, low, high, b.view(Counted), np.arange(len(b)), np.zeros(len(b), np.int64), order, bound, True, 5)
    assert len(found[0][0]) == 100 and sum(seen) < 2_000


def test_blocks():
    place, blocks = hn.dealt({0: 3, 1: 4, 2: 25, 3: 2, 4: 9}, 10)
    assert place == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 4: (5, 1)} and blocks == 6
    assert hn.dealt({}, 10) == ({}, 0)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not here")
def test_sql(spark):
    ok, message = compare("op13", QUERIES["op13_hard_negatives"], SQL["op13_hard_negatives"], spark, FOLDER, database(FOLDER))
    assert ok, message
