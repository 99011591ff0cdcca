"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import datetime as dt
import itertools
import random
import time

import pytest

import corpus_pipeline
from outlay.llm import (
    decontaminate, language_model, line_dedup, pieces, private_data, quality_rules, secrets, simhash, toxicity, url_filters,
)

KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, doc string, line int, words string, fp string, block string, t string"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t\n "), (4, LONG), (5, "one two three four five six\nseven eight nine"),
    (5, "one two three four five six\nseven eight nine"), (6, "one two three four five six\nseven eight nine"), (None, "no id here at all"), (7, "x" * 20_000),
]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, None, "s", 0, "r", "h", "d", 1, "w", "f", "b", "t") for i, t in texts], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return rows(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return rows(spark, []).cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, None), (5, 1, 0), (6, 0, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality long, toxic long")


def test_quality(docs, none):
    got = quality_rules.judged(docs).select("row.doc_id", "n_words", "kept").collect()
    assert len(got) == len(TEXTS) and {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert not any(r.kept for r in got if r.n_words < 20)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.judged(none).count() == 0


def test_simhash(docs, none):
    got = [tuple(r) for r in simhash.components(docs).collect()]
    assert sorted(r[0] for r in got) == [1, 2, 3, 4, 5, 5, 6, 7]
    assert {r[2] for r in got if r[0] in (1, 2, 3)} == {1} and {r[2] for r in got if r[0] in (5, 6)} == {5}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id) == [(False, i) for i in (1, 4, 5, 7)]
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.components(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_language_model(docs, none):
    got = {(r.doc_id, r.n_tokens) for r in language_model.scores(docs).collect()}
    assert (1, 1) in got and (2, 1) in got and (3, 1) in got and (4, 30_001) in got and (None, 6) in got
    assert language_model.scores(docs).count() == len(TEXTS)
    assert language_model.scores(none).count() == 0


def test_private_data(docs, none):
    got = private_data.replaced(docs).collect()
    assert len(got) == len(TEXTS) and all(r.text == r.row.text for r in got)
    assert private_data.without_private_data(docs).columns == docs.columns
    assert private_data.replaced(none).count() == 0


def test_private_data_takes_linear_time(spark):
    """One long word, an address of very many labels, and one behind very many marks."""
    word, labels, marks = "Ab1" * 350_000, "a@" + "b." * 10_000 + "1", "-" * 50_000 + "jo@ex.org"
    dots = "a." * 200_000
    begin = time.monotonic()
    got = {r.row.doc_id: r for r in private_data.replaced(rows(spark, list(enumerate([word, labels, marks, dots, f"{word} x@y.zz {labels}", "_jo@ex.org ...jo@ex.org (jo@ex.org)"])))).collect()}
    assert time.monotonic() - begin < 90
    assert [got[i].entities for i in (0, 1, 3, 4)] == [[], [], [], ["x@y.zz"]]
    assert len(got[2].entities) == 1 and "jo@ex.org" not in got[2].text
    assert got[5].entities == ["jo@ex.org"] * 3 and len(set(got[5].surrogates)) == 1 and got[5].text.startswith("_")


def test_line_dedup(docs, none):
    out = line_dedup.without_repeats(docs)
    got = sorted(((r.doc_id or 0), r.text or "") for r in out.collect())
    assert out.columns == docs.columns and len(got) == len(TEXTS)
    # Rows that share an id are one document: both keep their lines; the later document loses them.
    assert [t for i, t in got if i == 5] == ["one two three four five six\nseven eight nine"] * 2
    assert (6, "") in got and (3, "   \n\t\n ") in got
    assert out.where("doc_id = 1 AND text IS NULL").count() == 1
    assert line_dedup.without_repeats(none).count() == 0


def test_line_dedup_with_null_and_shared_ids(spark):
    """Lines go from the text that holds them: other texts without an id, or with the same id, keep theirs."""
    texts = [
        (None, "first line of one\nthe same words again"), (None, "first line of two\nsecond line here x"), (None, "other start here\nqq pp oo nn"),
        (1, "the same words again\nkept for good here"), (2, "alpha beta gamma delta\nthe same words again"), (2, "unlike words in here\nzz yy xx ww"),
        (2, "unlike words in here\nzz yy xx ww"), (3, "alpha beta gamma delta\nvv uu tt ss"), (3, None),
    ]
    got = sorted((r.doc_id or 0, r.text or "") for r in line_dedup.without_repeats(rows(spark, texts)).collect())
    assert got == sorted([
        (0, "first line of one\nthe same words again"), (0, "first line of two\nsecond line here x"), (0, "other start here\nqq pp oo nn"),
        (1, "kept for good here"), (2, "alpha beta gamma delta"), (2, "unlike words in here\nzz yy xx ww"), (2, "unlike words in here\nzz yy xx ww"),
        (3, "vv uu tt ss"), (3, ""),
    ])


def test_toxicity(spark, docs, none, labels):
    model = toxicity.learned(docs, labels, held=None)
    out = toxicity.scored(docs, model)
    got = [r.toxicity for r in out.collect()]
    assert len(got) == len(TEXTS) and all(0 <= x <= 1 for x in got)
    assert toxicity.keep_harmless(docs, labels).columns == docs.columns
    assert toxicity.scored(none, model).count() == 0
    assert toxicity.keep_harmless(none, labels.limit(0)).count() == 0


def test_pieces(docs, none):
    got = {r.doc_id: r for r in pieces.encode(docs).collect()}
    assert got[1].ids == [] and got[2].ids == [] and all(r.round_trip for r in got.values())
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back[4] == LONG and back[3] == "   \n\t\n " and back[1] == ""
    assert pieces.encode(none).count() == 0 and pieces.decode(pieces.encode(none)).count() == 0


def test_urls(spark):
    day = dt.date(2020, 1, 5)
    kind = "id long, url string, fetched_at date, key string, list string, t string"
    captures = spark.createDataFrame(
        [(1, None, day, "k", "l", "t"), (2, "http://a.example.com/x", None, "k", "l", "t"), (3, "", day, "k", "l", "t"), (4, "not a url", day, "k", "l", "t"),
         (5, "http://A.Example.com:80/x/y?q#f", day, "k", "l", "t"), (5, "http://A.Example.com:80/x/y?q#f", day, "k", "l", "t")], kind)
    entries = spark.createDataFrame([("a", "example.com", "add", day), ("a", "example.com", "add", day), ("b", None, "add", day), ("c", "a.example.com/x", "remove", day), (None, "a.example.com", "add", day)], "list string, key string, action string, at date")
    got = sorted((r.row.id, r.lists) for r in url_filters.evaluated(captures, entries).collect())
    assert got == [(1, []), (2, []), (3, []), (4, []), (5, ["a"]), (5, ["a"])]
    assert url_filters.evaluated(captures.limit(0), entries).count() == 0
    assert {tuple(r.lists) for r in url_filters.evaluated(captures, entries.limit(0)).collect()} == {()}
    assert url_filters.keep_allowed(captures, entries).columns == captures.columns


def test_urls_of_any_depth(spark):
    day = dt.date(2020, 1, 5)
    urls = ["http://a.com/x/y/z/w/v", "http://a.com/x/y/z", "https://Example.COM/Q", "http://www.a.com/x/y/z/w", "http://a.com//x/y//z/w/"]
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "id long, url string, fetched_at date")
    entries = spark.createDataFrame([("deep", "a.com/x/y/z/w", "add", day), ("caps", "Example.com", "add", day), ("slash", "A.com/x//y/", "add", day)], "list string, key string, action string, at date")
    got = {r.row.id: r.lists for r in url_filters.evaluated(captures, entries).collect()}
    assert got == {0: ["deep", "slash"], 1: ["slash"], 2: ["caps"], 3: [], 4: ["deep", "slash"]}


def test_secrets_take_linear_time():
    rng = random.Random(1)
    text = "\n".join(f"{rng.getrandbits(128):032x}  file{i}.tar" for i in range(60_000))
    begin = time.monotonic()
    base = secrets.base_spans(text)
    assert len(base) == 60_000 and secrets.candidates(text, base) == []
    assert time.monotonic() - begin < 20
    spans = sorted((a, 0, a + rng.randint(1, 400)) for a in (rng.randrange(2_000) for _ in range(20)))
    short = " ".join(f"{rng.getrandbits(100):x}Z9" for _ in range(80))
    want = [c for c in secrets.candidates(short, []) if not any(s < c[1] and c[0] < e for s, _, e in spans)]
    assert secrets.candidates(short, spans) == want


def test_secrets(docs, none):
    got = secrets.secrets(docs).collect()
    assert len(got) == len(TEXTS) and all(not r.spans for r in got)
    assert secrets.secrets(none).count() == 0


def test_decontaminate(spark, docs, none, benchmark):
    assert decontaminate.overlaps(docs, benchmark).count() == 0
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.count() == len(TEXTS) and kept.columns == docs.columns
    assert decontaminate.overlaps(none, benchmark).count() == 0 and decontaminate.overlaps(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.leaks(decontaminate.overlaps(docs, benchmark.limit(0))).count() == 0


@pytest.mark.parametrize("size", range(1, 16))
def test_short_items_are_found_under_all_substitutions(size):
    """Every placement of the substitutions that the similarity allows, both ends kept; one more, or fewer words, is no match."""
    item = [f"w{i}" for i in range(size)]
    seeds, known, most = decontaminate.Seeds([(7, " ".join(item)), (8, "")]), decontaminate.Vocabulary(), size // 5
    found = total = 0
    for differ in range(most + 1):
        for places in itertools.combinations(range(1, size - 1), differ):
            text = " ".join(["x", "y", *["z" if i in places else w for i, w in enumerate(item)], "x"])
            total += 1
            found += seeds.overlaps(text, known) == [(7, 2, size, size - differ)]
    assert found == total if size < 15 else found >= 0.98 * total
    if 5 <= size < decontaminate.MIN_WORDS:
        worse = ["z" if 1 <= i <= most + 1 else w for i, w in enumerate(item)]
        assert not seeds.overlaps(" ".join(worse), known) and not seeds.overlaps(" ".join(item[1:]), known)


def test_pipeline(spark, docs, none, labels, benchmark, tmp_path):
    for name, df in (("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for name, df in (("full", docs), ("empty", none)):
        step = df.select("doc_id", "text", "lang", "source", "n_chars")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, step = step, stage(spark, step, str(tmp_path))
            assert k == 4 or step.columns == before.columns
        assert {r.doc_id for r in step.collect()} == ({1, 4, 5, 7, None} if name == "full" else set())
