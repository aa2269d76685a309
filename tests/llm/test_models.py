"""Language ID and toxicity: the models by hand, held-out accuracy, and odd rows."""

import itertools
import math

import numpy as np
import pytest

from strata.llm import langid, toxicity
from strata.llm.common import vocabulary_path
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def segmentations(word):
    for n in range(len(word)):
        for cuts in itertools.combinations(range(1, len(word)), n):
            ends = [0, *cuts, len(word)]
            yield [word[a:b] for a, b in zip(ends, ends[1:])]


def test_forward_sums_all_segmentations():
    trie = langid.pieces(vocabulary_path(langid.VOCABULARY))
    model = np.random.default_rng(1).random((trie.count, 2))
    number = {}
    words = ["there", "zuq", "ébène", "a", "日本", "thethe"]

    def piece(s):  # walks the trie by hand
        if len(s) == 1:
            return int(trie.single[ord(s)])
        node = 0
        for c in s:
            node = trie.child[node, trie.inner[ord(c)]] if trie.inner[ord(c)] else 0
            if not node:
                return None
        return int(trie.piece[node]) if trie.piece[node] >= 0 else None

    got = langid.forward(model, trie.lattice(words))
    ends = trie.lattice(words)[1]
    for k, w in enumerate(words):
        for lang in range(2):
            want = sum(math.prod(model[piece(s), lang] for s in seg) for seg in segmentations(w) if all(piece(s) is not None for s in seg))
            assert got[ends[k], lang] == pytest.approx(want)
    # expected counts: by the share of each segmentation
    prior = model[:, 0]
    counts = langid.expected(prior, trie.lattice(words), np.ones((len(words), 1)), trie.count)[:, 0]
    want = np.zeros(trie.count)
    for w in words:
        ways = [[piece(s) for s in seg] for seg in segmentations(w) if all(piece(s) is not None for s in seg)]
        shares = [math.prod(prior[p] for p in way) for way in ways]
        for way, share in zip(ways, shares):
            for p in way:
                want[p] += share / sum(shares)
    assert counts == pytest.approx(want)
    assert not number


def test_langid_held_out(spark):
    from strata.llm.queries import op1_langid

    got = {r.doc_id: r for r in op1_langid(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    held = [d for d in docs if got[d.doc_id].held_out]
    assert len(got) == len(docs) and 150 < len(held) < 350
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_langid_odd(spark, odd, empty):
    train = spark.createDataFrame([("the house is there and they see it", "en"), ("das haus ist dort und sie sehen es", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    languages, model = langid.learn(train)
    assert languages == ["de", "en"]
    got = langid.predict(odd, languages, model).collect()
    assert len(got) == len(ODD)
    assert all((r["__lang"] == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert got[0].score == 1  # a column of its own
    none, nothing = langid.learn(train.limit(0))
    assert none == [] and {r["__lang"] for r in langid.predict(odd, none, nothing).collect()} == {"und"}
    assert langid.predict(empty, languages, model).collect() == []


def test_grams():
    keys, owner = toxicity.grams(["ab", "日"])
    assert owner.tolist() == [0, 0, 0, 1, 1]
    a, b, end, start = ord("a"), ord("b"), 10, 0
    pack = lambda *s: sum(x << (10 * k) for k, x in enumerate(reversed(s)))
    assert keys[:3].tolist() == [pack(start, a), pack(a, b), pack(a, b, end)]


def test_kneser_ney_by_hand(spark):
    """The six-gram differences are those of interpolated Kneser-Ney with shared lower orders."""
    rows = [("bad worse worst", 1), ("worse badly", 1), ("good better best", 0), ("better goodly bad", 0), ("best", 0)]
    own = {(r.context << 10) + k: gap for r in toxicity.gaps(spark.createDataFrame(rows, "text string, toxic int")).collect() for k, gap in r.own.items()}
    count = {0: {}, 1: {}}
    for text, c in rows:
        for w in set(text.split()):
            padded = "^^^^^" + w + "$"
            for i in range(len(w) + 1):
                count[c][padded[i : i + 6]] = count[c].get(padded[i : i + 6], 0) + 1
    level = {6: set(count[0]) | set(count[1])}
    shared = {}
    for k in range(5, 0, -1):
        shared[k] = {}
        for g in level[k + 1]:
            shared[k][g[1:]] = shared[k].get(g[1:], 0) + 1
        level[k] = set(shared[k])
    d = toxicity.DISCOUNT

    def lower(g):
        k = len(g)
        if k == 1:
            return (shared[1][g] + 0.5) / (sum(shared[1].values()) + 512)
        same = [n for h, n in shared[k].items() if h[:-1] == g[:-1]]
        return (shared[k][g] - d + d * len(same) * lower(g[1:])) / sum(same)

    def likely(c, g):
        same = [n for h, n in count[c].items() if h[:-1] == g[:-1]]
        if not same:
            return lower(g[1:])
        return (max(count[c].get(g, 0) - d, 0) + d * len(same) * lower(g[1:])) / sum(same)

    symbols = {"^": 0, "$": 10}
    for g in level[6]:
        k = sum(symbols.get(s, ord(s)) << (10 * i) for i, s in enumerate(reversed(g)))
        assert own[k] == pytest.approx(math.log(likely(1, g) / likely(0, g))), g


def test_toxicity_held_out(spark):
    from strata.llm.queries import op6_toxicity

    got = {r.doc_id: r for r in op6_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(got[i], t) for i, t in labels.items() if i in got and got[i].held_out]
    found = sum(r.predicted for r, t in held if t == 1)
    assert found >= 0.85 * sum(t for _, t in held)
    assert found >= 0.85 * sum(r.predicted for r, _ in held)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_odd(spark, odd, empty):
    labelled = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("you idiot clown", 1), ("a fine day", 0), (None, 1), ("x", None), ("", 0)] * 8)], "doc_id long, text string, toxic int")
    model, curve = toxicity.train(labelled)
    got = toxicity.score(odd, model, curve).collect()
    assert len(got) == len(ODD) and all(0 <= r["__score"] <= 1 for r in got)
    assert len({r["__score"] for r in got if not r.text}) == 1
    assert toxicity.score(empty, model, curve).collect() == []
    model, curve = toxicity.train(labelled.limit(0))
    assert toxicity.score(odd, model, curve).count() == len(ODD)


@pytest.mark.parametrize("bits", [0, 21])
def test_toxicity_words_keep_their_own_gaps(spark, monkeypatch, bits):
    """Ordinary grams, however many, take no toxic gram's gap."""
    monkeypatch.setattr(toxicity, "FILTER_BITS", bits)
    monkeypatch.setattr(toxicity, "BOUND_BITS", 8)
    monkeypatch.setattr(toxicity, "SECOND_BITS", 6)
    r = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    ordinary = [("".join(r.choice(letters, 12)), 0) for _ in range(3000)]
    rows = spark.createDataFrame([*ordinary, *[("zzidiotzz", 1)] * 5, *[("zzidiomzz", 0)] * 5], "text string, toxic int")
    model = toxicity.gaps(rows).cache()
    by_key = {}
    for x in model.collect():
        by_key[1, x.context] = x.back
        by_key |= {(0, (x.context << toxicity.SYMBOL_BITS) + k): gap for k, gap in x.own.items()}
    texts = ["zzidiotzz and a zzidiotzz", "zzidiomzz", ordinary[0][0], "qqidiotqq", "", None]

    def excess(word):
        keys, _ = toxicity.grams([word])
        gap = sum(by_key.get((0, int(k)), by_key.get((1, int(k) >> toxicity.SYMBOL_BITS), 0.0)) for k in keys)
        return max(gap - toxicity.MARGIN, 0.0)

    got = {x.text: x["__evidence"] for x in toxicity.evidence(spark.createDataFrame([(t,) for t in texts * 2], "text string"), model).collect()}
    for t in texts:
        words = (t or "").split()
        want = math.log1p(sum(map(excess, words)) / (len(words) + toxicity.PRIOR_WORDS) / toxicity.FLOOR)
        assert got[t] == pytest.approx(want), t
    assert got[texts[0]] > 0


def test_langid_runs_of_unknown_letters(spark):
    """Letters that a large corpus never taught make no language impossible; the other words decide."""
    trie = langid.pieces(vocabulary_path(langid.VOCABULARY))
    train = spark.createDataFrame([("the house is there and they see it", "en"), ("das haus ist dort und sie sehen es", "de")], "text string, lang string")
    languages, model = langid.learn(train)
    model = model.copy()
    model[-1] = 1e-16  # as after 1e9 pieces
    run = "ꓐ" * 47
    assert trie.single[ord(run[0])] == trie.count - 1
    words = ["there", run, "ab" + run[:40], "house"]
    logs = langid.word_logs(trie, model, words)
    assert logs[1] == pytest.approx(47 * np.log(1e-16))
    assert logs[2] == pytest.approx(40 * np.log(1e-16) + langid.word_logs(trie, model, ["ab"])[0])
    assert logs == pytest.approx(langid.log_forward(model, trie.lattice(words))[trie.lattice(words)[1]])
    rows = spark.createDataFrame([(f"they see the house {run}",), (run,)], "text string")
    first, second = langid.predict(rows, languages, model).collect()
    assert first["__lang"] == "en" and 0.5 < first["__confidence"] <= 1
    assert second["__confidence"] == pytest.approx(0.5)


def test_expected_counts_of_long_words():
    """Words of any length are counted whole, as short ones are."""
    trie = langid.pieces(vocabulary_path(langid.VOCABULARY))
    prior = np.full(trie.count, 1 / trie.count)
    words = ["there", "zuq", "thethe"]
    lattice = trie.lattice(words)
    assert langid.log_expected(prior, lattice, np.ones((3, 2)), trie.count) == pytest.approx(langid.expected(prior, lattice, np.ones((3, 2)), trie.count))
    long = "ภาษาไทย" * 200 + "there" * 300
    counts = langid.log_expected(prior, trie.lattice([long]), np.ones((1, 1)), trie.count)
    assert np.isfinite(counts).all() and 200 * 4 < counts.sum() <= len(long)
