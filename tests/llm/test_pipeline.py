"""The corpus pipeline: every stage against brute force on its own input, and odd tables."""

import inspect
from collections import Counter

import pytest

import corpus_pipeline as cp
from strata.llm import langid, packing, toxicity
from strata.llm.common import stage
from tests.llm.conftest import ODD
from tests.llm.test_dedup import brute_lines, brute_near

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark):
    """What each stage was given, and what it made of it."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, function in cp.STAGES:
        made = stage(function(spark, docs, SF), f"test-{name}")
        out.append((name, docs, made))
        docs = made
    return {name: (given, made) for name, given, made in out}


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_are_as_listed():
    assert [n for n, _ in cp.STAGES] == ["language_id", "toxicity", "line_dedup", "near_dedup", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in cp.STAGES)


def test_columns_and_types(outputs):
    for name, (given, made) in outputs.items():
        if name != "packing":
            assert made.dtypes == given.dtypes, name


def test_language_id(outputs):
    given, made = outputs["language_id"]
    languages, model = langid.learn(given.where(~langid.held_out()).select("text", "lang"))
    told = {r.doc_id: r["__lang"] for r in langid.predict(given, languages, model).collect()}
    kept = {i for i, _ in pairs(made)}
    assert kept <= {i for i, x in told.items() if x != "und"}
    assert len(kept) >= 0.99 * sum(x != "und" for x in told.values())  # clean documents stay


def test_toxicity(spark, outputs):
    given, made = outputs["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model, curve = toxicity.train(given.where(~langid.held_out()).join(labels, "doc_id"))
    told = {r.doc_id: r["__predicted"] for r in toxicity.score(given, model, curve).collect()}
    assert sorted(i for i, _ in pairs(made)) == sorted(i for i, x in told.items() if not x)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    dropped = [i for i, x in told.items() if x]
    assert sum(truth.get(i) == 0 for i in dropped) <= 0.02 * len(told)


def test_line_dedup(outputs):
    given, made = outputs["line_dedup"]
    want = Counter((i, t) for i, _, _, t in brute_lines(pairs(given)))
    assert Counter(pairs(made)) == want
    assert all(r.n_chars == len(r.text) for r in made.collect())


def test_near_dedup(outputs):
    given, made = outputs["near_dedup"]
    rows = pairs(given)
    want = sorted(i for i, _, c in brute_near(rows, 5) if i == c)
    assert sorted(i for i, _ in pairs(made)) == want
    assert len(want) < len(rows)


def test_packing(spark, outputs):
    given, made = outputs["packing"]
    rows = made.collect()
    by_doc = Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
    encoding = packing.byte_bpe(packing.BYTE_BPE)
    assert by_doc == {i: len(packing._ids(encoding, t)) // 4 + 1 for i, t in pairs(given)}
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert all(fill[k] == packing.WINDOW for k in range(len(fill) - 1))


def test_run_is_the_stages_in_a_row(spark, outputs):
    got = cp.run(spark, SF).groupBy().sum("length", "doc_tokens").first()
    want = outputs["packing"][1].groupBy().sum("length", "doc_tokens").first()
    assert got == want


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, `__x` int, `odd name.` string"


@pytest.mark.parametrize("data", [ODD, []])
def test_odd_tables(spark, data):
    docs = spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None, None, "k", 1, 2, "o") for k, (i, t) in enumerate(data)], EXTRA)
    for name, function in cp.STAGES:
        docs = stage(function(spark, docs, SF), f"odd-{name}")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "score", "__x", "odd name."]
    if not data:
        assert docs.count() == 0
