"""Exact, line and near dedup, and components, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from strata.llm import exact_dedup as ex
from strata.llm import line_dedup as ld
from strata.llm import near_dedup as nd
from strata.llm.components import components

from tests.llm.conftest import LONG, ODD


def test_exact_brute_force(odd):
    got = ex.exact_dedup(odd).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for i, t in ODD:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min(i for i in ids if i is not None)
    # one row of each group is kept, also where ids repeat
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_empty(empty):
    assert ex.exact_dedup(empty).collect() == []


def test_exact_splits_large_buckets(docs_of):
    rows = [(i, f"text {i % 40} " + "x" * 500) for i in range(200)]
    got = {r.doc_id: r for r in ex.exact_dedup(docs_of(rows), limit=1500).collect()}
    assert all(got[i].keep_id == i % 40 and got[i].group_size == 5 and got[i].kept == (i < 40) for i in range(200))


def test_content_table_tells_equal_digests_apart():
    table = ex.ContentTable()
    same = b"d" * 32
    assert [table.put(same, t, k)[0] for k, t in enumerate(("a", "b", "a", "b", "c"))] == [0, 1, 0, 1, 2]
    for k in range(500):
        table.put(hashlib.sha256(str(k).encode()).digest(), str(k), k)
    assert table.put(hashlib.sha256(b"77").digest(), "77", 0) == (80, False)


def brute_lines(rows, min_chars=20, min_docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    docs = defaultdict(set)
    order = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs[key(line)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs[key(x)]) < min_docs or max(docs[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows(seed):
    r = random.Random(seed)
    common = ["A line that very many hold", "  a LINE that very many hold\t", "Ünïcode Ä line, exactly 20", "short one"]
    rows = []
    for i in range(120):
        lines = [r.choice([r.choice(common), f"a line of its own, number {r.randint(0, 60)}", "", "x"]) for _ in range(r.randint(0, 8))]
        rows.append((i if r.random() < 0.95 else None, "\n".join(lines)))
    return [*rows, rows[3], (4, rows[3][1]), (5, None), (6, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_brute_force(docs_of, seed):
    rows = line_rows(seed)
    got = ld.line_dedup(docs_of(rows))
    assert got.columns[:6] == ["doc_id", "text", "lang", "kept", "score", "text_hash"]
    found = Counter((r.doc_id, r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in got.collect())
    assert found == Counter(brute_lines(rows))


def test_lines_one_hot_line_over_many_ranges(spark, docs_of):
    rows = [(i, "the very same line in all documents\nand a line of number %d only" % i) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = ld.line_dedup(docs_of(rows)).select("doc_id", "__n_dropped").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.doc_id for r in got if not r["__n_dropped"]) == [2999]


def test_lines_odd_and_empty(odd, empty):
    found = Counter((r.doc_id, r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in ld.line_dedup(odd).collect())
    assert found == Counter(brute_lines(ODD))
    assert ld.line_dedup(empty).collect() == []


def brute_near(rows, size, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and name[i] != name[j]:
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    ids = defaultdict(list)
    for k, (i, _) in zip(name, rows, strict=True):
        if i is not None:
            ids[k].append(i)
    return Counter((i, len(s), i if not s else min(ids[k], default=None)) for (i, _), s, k in zip(rows, sets, name, strict=True))


def near_rows(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(2, 120))]
        for _ in range(r.randint(1, 9)):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(text) // 12))):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows) * 7 % 1009, (" ".join(text)).upper() if r.random() < 0.2 else "\t".join(text)))
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 2), (3, 5)])
def test_near_brute_force(docs_of, seed, size):
    rows = near_rows(seed)
    got = nd.near_dedup(docs_of(rows), size=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_odd_and_empty(odd, empty):
    got = nd.near_dedup(odd, size=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(ODD, 2)
    assert nd.near_dedup(empty).collect() == []


def test_near_one_large_group(docs_of):
    """Hundreds of near copies share all prefixes: neighbours and the confirmed rest must still link them all."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(6):
            text[r.randrange(300)] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, f"other text number {i} of quite some words that differ {i * i} {i + 7}") for i in range(50)]
    got = nd.near_dedup(docs_of(rows), size=2).collect()
    assert {x.component_id for x in got if x.doc_id < 1000} == {0}
    assert all(x.kept for x in got if x.doc_id >= 1000)


def test_neighbours_take_all_of_small_regions():
    key = np.array([[1, 1], [1, 2], [1, 2], [3, 1]], np.uint8)
    key = np.pad(key, ((0, 0), (0, nd.DEPTH - 2)))
    tree = np.zeros(4, np.int32)
    pairs = {(int(a), int(b)) for i, j in nd.neighbours(tree, key) for a, b in zip(i, j, strict=True)}
    assert pairs == {(0, 1), (1, 2), (0, 2), (2, 3), (1, 3), (0, 3)}
    assert nd.neighbours(tree[:1], key[:1]) == []


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100)]])
def test_components(spark, edges):
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    name = {v: v for e in edges for v in e}
    for _ in edges:
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    assert got == name


def test_long_texts_are_read_whole():
    assert next(nd.shingle_sets([LONG], 2)).size < next(nd.shingle_sets([LONG + " a b c"], 2)).size


def test_overlaps_are_exact(monkeypatch):
    monkeypatch.setattr(nd, "SLAB", 7)
    r = np.random.default_rng(5)
    sets = [np.unique(np.r_[r.choice(60, 30), r.choice(10**6, 40)]).astype(np.uint64) for _ in range(90)]
    got = nd.overlaps(sets[:50], sets[50:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[50:]] for x in sets[:50]]
    assert nd.overlaps(sets[:1], [np.array([1 << 60], np.uint64)]).tolist() == [[0]]


def test_near_one_link_hidden_in_a_crowd(docs_of, monkeypatch):
    """Pairs just above the threshold among a thousand just below it, over many blocks."""
    monkeypatch.setattr(nd, "BLOCK", 100)
    r = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    fresh = (f"x{k}" for k in range(10**6))
    rows = []
    for i in range(1200):
        text = list(base)
        for k in r.sample(range(200), 15 if i % 3 else 12):
            text[k] = next(fresh)
        rows.append((i, " ".join(text)))
    got = nd.near_dedup(docs_of(rows), size=1).collect()
    want = brute_near(rows, 1)
    assert 20 < len({c for _, _, c in want}) < 1200
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == want
