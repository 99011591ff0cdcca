"""Exact duplicates: groups against a dictionary of texts, odd input, and what each step reads."""

import random
import re

from outlay.llm import exact_dedup
from tests.llm.test_edges import TEXTS, rows

RUNS = re.compile("[\x20\x09-\x0d]+")


def test_equals_dictionary(spark):
    rng = random.Random(3)
    head = "same beginning " * 30
    texts = [(i, head + rng.choice("abc") * rng.randint(1, 3)) for i in range(300)]
    texts += [(1_000 + i, rng.choice(["a b", "a  b", "a\n\tb", "ab", " a b", "a b ", "x" * i])) for i in range(200)]
    rng.shuffle(texts)
    got = exact_dedup.judged(exact_dedup.refined(rows(spark, texts), ["doc_id"]).drop("norm")).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(RUNS.sub(" ", t), []).append(i)
    want = {i: (min(g), len(g), i == min(g)) for g in groups.values() for i in g}
    assert {r.row.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want and len(got) == len(texts)


def test_whole_texts_are_hashed_only_where_length_and_head_repeat(spark):
    texts = [(1, "a" * 300 + "x"), (2, "a" * 300 + "y"), (3, "b" * 301), (4, "short"), (5, "other"), (6, "unlike any in length")]
    full = {r.row.doc_id: r.full for r in exact_dedup.refined(rows(spark, texts), ["doc_id"]).collect()}
    assert {k for k, v in full.items() if v} == {1, 2} and full[1] != full[2]


def test_edges(spark):
    docs, none = rows(spark), rows(spark, [])
    got = exact_dedup.judged(exact_dedup.refined(docs, ["doc_id"]).drop("norm")).collect()
    assert len(got) == len(TEXTS)
    by = {r.row.doc_id: r for r in got if r.row.doc_id != 5}
    assert [(by[k].keep_id, by[k].group_size, by[k].kept) for k in (1, 2, 3, 4, 7, None)] == [
        (1, 2, True), (1, 2, False), (3, 1, True), (4, 1, True), (7, 1, True), (None, 1, True),
    ]
    # Rows that share an id: one of them stays; the third copy has its own id.
    assert sorted(r.kept for r in got if r.row.doc_id == 5) == [False, True]
    assert (by[6].keep_id, by[6].group_size, by[6].kept) == (5, 3, False)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 7]
    assert exact_dedup.keep_one(none).count() == 0
    nulls = exact_dedup.judged(exact_dedup.refined(rows(spark, [(None, "t"), (None, "t"), (9, "t")]), ["doc_id"]).drop("norm")).collect()
    assert sorted((r.row.doc_id or 0, r.keep_id, r.kept) for r in nulls) == [(0, 9, False), (0, 9, False), (9, 9, True)]


def test_main_path_has_no_python(spark):
    plan = exact_dedup.refined(rows(spark), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
