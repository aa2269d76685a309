"""Ranked lexical search, near copies among vectors, and the Merkle manifest, each against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import merkle, nra, rotated_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ranked(docs, items, k):
    """(item, rank, id, score) by the formula, all documents scored."""
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            n = sum(bag.values())
            score = 0
            for t in TERM.findall(lower(text)):
                if t in bag:
                    m = 100 - 25 + (25 * n * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return out


QUERIES = "item_id long, text string, score long, rank int"


def posed(spark, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], QUERIES)


def tuples(df):
    return [tuple(r) for r in df.collect()]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("shard", "k"), [(32_768, 20), (17, 3)])
def test_search_is_exact(spark, docs_of, monkeypatch, shard, k):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    weight = 1 / np.arange(1, 301)
    docs = [(int(i), " ".join(r.choice(words, int(r.integers(1, 80)), p=weight / weight.sum()))) for i in r.permutation(400)]
    docs += [(1000 + i, docs[0][1]) for i in range(60)]  # copies: ties
    items = [(i, " ".join(r.choice(words, 12))) for i in range(25)] + [(90, "w0 w0 w1"), (91, docs[0][1])]
    monkeypatch.setattr(nra, "SHARD_DOCS", shard)
    monkeypatch.setattr(nra, "CHUNK", 4)
    got = tuples(nra.search(docs_of(docs), posed(spark, items), k))
    assert order(got) == order(ranked(docs, items, k))


def test_shards_end_before_they_hold_too_much(spark, docs_of, monkeypatch):
    docs = [(i, "a b c d " * (i % 3) + "e") for i in range(50)]
    items = [(1, "a b c d e"), (2, "E e"), (3, "nothing here")]
    monkeypatch.setattr(nra, "SHARD_PLACES", 7)
    got = tuples(nra.search(docs_of(docs), posed(spark, items), 5))
    assert order(got) == order(ranked(docs, items, 5))


def test_items_in_blocks(spark, docs_of, monkeypatch):
    docs = [(i, f"x{i % 5} y{i % 7} z") for i in range(60)]
    items = [(i, f"x{i % 5} y{i % 7}") for i in range(11)]
    monkeypatch.setattr(nra, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(nra, "BLOCK_TERMS", 6)
    assert order(tuples(nra.search(docs_of(docs), posed(spark, items), 4))) == order(ranked(docs, items, 4))


def test_search_odd(spark, docs_of, odd, empty):
    from tests.llm.conftest import ODD

    items = [(1, "one"), (1, "one"), (2, None), (3, ""), (None, "WORD5 and7 日本語"), (4, "ÀÉ σας ½"), (5, "word5 word5 end")]
    got = tuples(nra.search(odd, posed(spark, items), 3))
    assert order(got) == order(ranked(ODD, items, 3))
    assert tuples(nra.search(empty, posed(spark, items))) == []
    assert tuples(nra.search(odd, posed(spark, []))) == []
    assert tuples(nra.search(docs_of([(1, None), (2, "")]), posed(spark, items))) == []


# -- vectors ------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>, label int, n_links string, component_id string, kept string, no int, v int, id int, digest int"


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "b", "c", 1, 2, 3, 4) for i, v, label in rows], VECTORS).repartition(3)


def near_brute(rows, threshold=0.98):
    def ok(v, label):
        return label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)

    unit = {j: np.array(v) / np.linalg.norm(v) for j, (_, v, label) in enumerate(rows) if ok(v, label)}
    near = {j: [o for o in unit if o != j and rows[o][2] == rows[j][2] and len(unit[o]) == len(unit[j]) and unit[o] @ unit[j] >= threshold] for j in unit}
    out = []
    for j, (i, _, _) in enumerate(rows):
        reach, edge = {j}, [j]
        while edge:
            edge = [o for e in edge for o in near.get(e, []) if o not in reach]
            reach |= set(edge)
        least = min((rows[r][0] for r in reach if rows[r][0] is not None), default=None)
        out.append((i, len(near.get(j, [])), least, i is not None and i == least))
    return out


def clustered(seed, dim, sizes):
    """Clusters with cosines on both sides of the threshold, and scattered vectors."""
    r = np.random.default_rng(seed)
    rows, i = [], 0
    for size in sizes:
        middle = r.normal(size=dim)
        middle /= np.linalg.norm(middle)
        for _ in range(size):
            v = middle + r.normal(size=dim) * r.choice([0.02, 0.11, 0.15, 0.2]) / math.sqrt(dim)
            rows.append((i, [float(c) for c in v * r.uniform(0.1, 10)], int(r.integers(0, 2))))
            i += 1
    rows += [(i + j, [float(c) for c in r.normal(size=dim)], j % 3) for j in range(200)]
    return rows + [(5000 + j, rows[0][1], rows[0][2]) for j in range(50)]  # equal vectors


@pytest.mark.parametrize(("cell", "block", "dim"), [(4096, 2048, 64), (20, 16, 48), (3, 1000, 100)])
def test_near_vectors(spark, cell, block, dim):
    rows = clustered(1, dim, [40, 25, 10, 5, 2, 2, 2])
    got = tuples(rotated_codes.near_vectors(vector_rows(spark, rows), cell=cell, block=block))
    assert order(got) == order(near_brute(rows))


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * np.linalg.qr(np.stack([x, r.normal(size=x.shape)], axis=2))[0][:, :, 1]
    a, b = rotated_codes.Codes.of(x), rotated_codes.Codes.of(y)
    estimate = (a.rounded * np.where(b.signs, 1.0, -1.0)).sum(axis=1) * a.step / (8 * b.factor)
    assert abs(estimate.mean() - 0.98) < 4 * estimate.std() / 20 + 1e-3
    assert a.may_reach(b, 0.98).diagonal().all()
    far = a.may_reach(b, 0.98)
    assert far.mean() < 0.02  # scattered vectors need no exact computation


def test_layout_leaves_few_apart():
    assert rotated_codes.layout(4096, 0.98) == (0, 1)
    bits, tables = rotated_codes.layout(1 << 24, 0.98)
    assert bits == 12 and (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables <= 1e-6


def test_near_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 1.0], None), (8, [1.0, 1.0], None)]
    rows += [(9, [1.0, 1.0], 0), (10, [2.0, 2.0], 0), (10, [2.0, 2.0], 0), (None, [1.0, 1.0], 0), (None, [1.0, -1.0], 1), (None, [1.0, -1.0], 1), (11, [1.0, 1.0], 1)]
    rows += [(12, [1e300, 1e300], 0), (13, [1e-300, 1e-300], 0), (14, [1.0, 1.0, 0.0], 0), (15, [-0.0, 1.0], 2), (16, [0.0, 1.0], 2), (17, [3.0], 3), (18, [-3.0], 3)]
    want = near_brute([(i, [c * (1e-300 if c == 1e300 else 1e300 if c == 1e-300 else 1) if c is not None else c for c in v] if v else v, n) for i, v, n in rows])
    assert order(tuples(rotated_codes.near_vectors(vector_rows(spark, rows)))) == order(want)
    assert tuples(rotated_codes.near_vectors(vector_rows(spark, []))) == []


# -- manifest -----------------------------------------------------------------------------------
MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, bits int"


def manifest_rows(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], MANIFEST).repartition(3)


def h(*nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def manifest_brute(rows, fanout=2):
    def leaf(row):
        return h(*("-" if c is None else f"{len(str(c).encode())}:{c}" for c in row))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            start = i // fanout * fanout
            run = level[start : start + fanout]
            out.append((run[: i - start], run[i - start + 1 :]))
            i //= fanout
        return out

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf(row)))
        trees[g] = tree([leaf(row) for row in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for rank, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, rank)
            node = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                node = leaf((*row[:3], row[3] + 1, row[4]))
            for left, right in steps:
                node = h(*left, node, *right)
            proof = h(*(n for left, right in steps for n in [*left, *right]))
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def manifest_of(df, **kw):
    tamper = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, tamper, **kw)
    return [
        (r.doc_id, r["__leaf"], r["__subroot"], r["__root"], h(bytes(r["__proof"]).hex()), r["__folded"], r["__folded"] == r["__root"]) for r in got.collect()
    ]


@pytest.mark.parametrize(("fanout", "span"), [(2, 256), (2, 4), (3, 9)])
def test_manifest(spark, fanout, span):
    r = np.random.default_rng(2)
    ids = [*range(-70, 150), *(int(i) for i in r.integers(-(1 << 62), 1 << 62, 60)), (1 << 63) - 1, -(1 << 63), 63, 64, 1 << 22, 1 << 38, 1 << 54]
    rows = [(i, f"s{i % 3}", [None, "", "de", "en", "é"][int(r.integers(0, 5))], int(r.integers(0, 99)), f"text {i} ü") for i in dict.fromkeys(ids)]
    rows += [(7_777, "s", "alone", 3, "one leaf")]
    assert order(manifest_of(manifest_rows(spark, rows), fanout=fanout, span=span)) == order(manifest_brute(rows, fanout))


def test_manifest_odd(spark):
    rows = [(1, None, None, None, None), (2, "", "", 0, ""), (None, "a", "en", 1, "x"), (None, "a", "en", 1, "x"), (None, "b", "en", 2, "y"), (5, "a", "en", 1, "x" * 2_000_000)]
    rows += [(9, f"s{i % 4}", "en", i % 3, "same id") for i in range(300)] + [(10, "s", "en", 3, "z"), (8, "s", "en", 3, "z"), (77, "s", "en", (1 << 63) - 2, "z")]
    assert order(manifest_of(manifest_rows(spark, rows))) == order(manifest_brute(rows))
    assert manifest_of(manifest_rows(spark, [])) == []
    assert order(manifest_of(manifest_rows(spark, [(3, "s", "en", 1, "t")]))) == order(manifest_brute([(3, "s", "en", 1, "t")]))


def test_proof_can_be_checked_alone(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"t{i}") for i in range(20)]
    for r in merkle.manifest(manifest_rows(spark, rows), ["doc_id", "text"], "lang", "doc_id").collect():
        node, rest = merkle.fold(r["__leaf"].encode(), r["__place"], r["__leaves"], bytes(r["__proof"]))
        assert node.decode() == r["__subroot"]
        assert merkle.fold(node, r["__rank"], r["__groups"], rest) == (r["__root"].encode(), b"") and r["__folded"] == r["__root"]
