"""Nearest neighbours, archives and extraction."""

import base64
import hashlib
import html.parser
import io
import zipfile

import numpy as np
import pytest

from strata.llm import ann, warc_zip, wrapper

VECTORS = "vec_id long, embedding array<float>, score string, rank string, cell long"


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v, "s", "r", 1) for i, v in vectors], VECTORS)


def brute(vectors, queries, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in ok:
        if q in queries:
            found = sorted((-float((x * y).sum()), i) for i, y in ok if i != q)[:k]
            out[q] = found
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_search_recall(spark, scale):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32)) + 2 * r.normal(size=(10, 32))[r.integers(0, 10, 3000)]
    if not scale:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    rows = rows_of(spark, vectors)
    got = ann.search(rows, rows.where("vec_id % 20 = 0"), k=10).collect()
    want = brute(vectors, set(range(0, 3000, 20)), 10)
    found = {}
    for g in got:
        found.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    assert all([f[0] for f in sorted(v)] == list(range(1, 11)) for v in found.values())
    hit = sum(len({v for _, v, _ in found[q]} & {i for _, i in w}) for q, w in want.items())
    assert hit >= 0.9 * 10 * len(want)
    x32 = np.float32(x).astype(float)
    assert all(s == pytest.approx(float(x32[q] @ x32[v]), rel=1e-12) for q, f in found.items() for _, v, s in f)


@pytest.mark.parametrize("hashes", [2, 3])
def test_cells_of_several_hashes_reach_the_recall(spark, hashes):
    r = np.random.default_rng(6)
    vectors = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(r.normal(size=(1200, 8)))]
    rows = rows_of(spark, vectors)
    got = ann.search(rows, rows.where("vec_id % 20 = 0"), k=10, hashes=hashes).collect()
    want = brute(vectors, set(range(0, 1200, 20)), 10)
    hit = sum(g.vec_id in {i for _, i in want[g.query_id]} for g in got)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_ranks_of_cells():
    hasher = ann.Hasher(4, 1.0, False, 2, 3)
    x = np.random.default_rng(1).normal(size=(5, 4))
    order = hasher.probes(x, 8**3)
    for i in range(5):
        cells = order[i, :, ::37].T
        assert (hasher.ranks(x[i], cells) <= np.arange(0, 512, 37)[:, None]).all()
        assert (hasher.ranks(x[i], order[i, :, :1].T) == 0).all()


def test_search_odd(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    vectors += [(20, [2.0, 1.0]), (40, [2.0, 1.0]), (40, [2.0, 1.0]), (60, [-1.0, -1.0]), (80, [2.0, 1.0])]
    rows = rows_of(spark, vectors)
    got = sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in ann.search(rows, rows.where("vec_id % 20 = 0"), k=3).collect())
    assert [g[2] for g in got if g[0] == 0] == [20, 40, 80]  # ties to the smaller id
    assert [g[2] for g in got if g[0] == 40] == [20, 80, 0]
    assert [g[3] for g in got if g[0] == 60] == [-1.0, -3.0, -3.0]
    assert ann.search(rows.limit(0), rows, 3).collect() == []
    assert ann.search(rows, rows.limit(0), 3).collect() == []
    assert ann.search(rows.where("vec_id = 0"), rows.where("vec_id = 0"), 3).collect() == []


def test_search_many_equal_vectors(spark):
    vectors = [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(400)] + [(1000 + i, [float(i % 7), 1.0, float(i % 3), -1.0]) for i in range(100)]
    rows = rows_of(spark, vectors)
    got = ann.search(rows, rows.where("vec_id = 20"), k=5).collect()
    want = brute(vectors, {20}, 5)[20]
    assert sorted((-g.score, g.vec_id) for g in got) == want


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    h = ann.hadamard(x)
    assert np.allclose(np.linalg.norm(h, axis=1), np.linalg.norm(x, axis=1)) and np.allclose(ann.hadamard(h), x)


PAGES = "page_id long, url string, html string, record_type string, text string, path string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES).repartition(2)


def test_warc_round_trip(spark):
    rows = [(1, "http://a.example/ü?x=1\r\ny", "<p>one</p>"), (2, None, None), (3, "http://a.example/3", ""), (4, "x", "<p>one</p>"), (5, "", "日本"), (6, "u", "y" * 3_000_000), (7, "u", "<p>one</p>"), (7, "u", "<p>one</p>"), (None, "u", "<p>one</p>"), (None, "v", "alone")]
    got = warc_zip.round_trip(pages_of(spark, rows)).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    want = []
    for i, _, h in rows:
        data, first = (h or "").encode(), top.get(h or "")
        revisit = first is not None and i != first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert warc_zip.round_trip(pages_of(spark, [])).collect() == []


def test_warc_small_payloads_are_never_revisits(spark):
    got = warc_zip.round_trip(pages_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), min_bytes=3).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, offset):
        return self.data[offset : offset + n]


def test_zip_directories(monkeypatch):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc.gz", b"0123456789")
        z.writestr("ü.txt", b"abc")
        z.writestr(zipfile.ZipInfo("deflated"), b"x" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK a comment"
    found = warc_zip.ZipDirectory(Bytes(raw.getvalue()))
    start, size = found.place("archive/data.warc.gz")
    assert raw.getvalue()[start : start + size] == b"0123456789"
    assert set(found.members) == {"archive/data.warc.gz", "ü.txt", "deflated"}
    with pytest.raises(ValueError):
        found.place("deflated")
    with pytest.raises(ValueError):
        warc_zip.ZipDirectory(Bytes(b"no zip"))
    # ZIP64: make the writer think that everything is large
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for k in range(3):
            z.writestr(f"m{k}", f"content {k}".encode())
    assert b"PK\x06\x06" in raw.getvalue()
    found = warc_zip.ZipDirectory(Bytes(raw.getvalue()))
    for k in range(3):
        start, size = found.place(f"m{k}")
        assert raw.getvalue()[start : start + size] == f"content {k}".encode()


def page(k, article, extra=""):
    return (
        f"<html><head><title>t</title><script>if (a < b) x('<p>')</script></head><body class='with-sidebar'><nav><ul><li><a href=/>Home {k}</a></ul></nav>"
        f"<header><h2>Site</h2></header><div class='cookie-notice'>We use cookies</div>{article}{extra}<div id=comments><p>First! {k}</div><footer>&copy; {k}</footer></body></html>"
    )


def test_extract(spark):
    rows = []
    for k in range(12):
        rows.append((k, f"http://one.example/{k}", page(k, f"<article><h1>Title &amp; {k}</h1><p>Some  text&nbsp;{k}<br>more <b>bold<p>Next {k % 5}</p><div class=ad>Buy</div><p>Next</p><p>Read our terms.</p></article>")))
        rows.append((100 + k, f"http://two.example/{k}", page(k, f"<div class=body><div class=x1><p>Long text of page {k}, in words. <p>Another paragraph, {k * 7}.</div></div>", "<div class=box><p>Follow us</div>")))
    rows += [(200, None, None), (201, "http://[bad", "<p>alone"), (202, "http://one.example/x", ""), (203, None, "plain &lt;text&gt; < 5"), (200, None, None)]
    got = {r.page_id: r.text for r in wrapper.extract(pages_of(spark, rows)).collect()}
    for k in range(12):
        # lines that stand on all pages, which differ, are template, inside the article too
        assert got[k] == f"Title & {k}\nSome text {k} more bold\nNext {k % 5}"
        assert got[100 + k] == f"Long text of page {k}, in words.\nAnother paragraph, {k * 7}."
    assert got[200] == "" and got[201] == "alone" and got[202] == "" and got[203] == "plain <text> < 5"
    assert wrapper.extract(pages_of(spark, [])).collect() == []


def test_copies_keep_their_text(spark):
    rows = [(k, "http://one.example/", page(0, "<article><p>The same page again and again.</article>")) for k in range(20)]
    assert {r.text for r in wrapper.extract(pages_of(spark, rows)).collect()} == {"The same page again and again."}


def test_markup_never_fails():
    r = np.random.default_rng(3)
    parts = ["<p", ">", "</div>", "<div class='", "'", "<script>", "</script", "<!--", "-->", "text", "<", "&amp", "<td>", "</table>", "<a href=\"x>", "<li>", "<body>", "\x00"]
    for _ in range(500):
        text = "".join(r.choice(parts, 12))
        assert isinstance(wrapper.alone(text), str)
    deep = "<div>" * 30_000 + "x"
    assert wrapper.alone(deep) == "x"


def test_matching_is_largest():
    """Children of matched blocks only, in order: of two crossing matches the heavier one is taken."""
    page = wrapper.merged([wrapper.parse("<div class=a><p>x</div><div class=b><ul><li>y</ul><table><tr><td>z</table></div><section>s</section>")])
    slots = wrapper.wrapper_of("html", [wrapper.parse("<div class=b><ul><li>y</ul><table><tr><td>z</table></div><div class=a><p>x</div><section>s</section>")])[2]
    size, pairs = wrapper.align(page, slots)
    assert [label for label, _ in pairs] == ["div class=b", "section"] and size == 7
    assert [label for label, _ in pairs[0][1]] == ["ul", "table"]


def texts(spark, rows):
    return {r.page_id: r.text for r in wrapper.extract(pages_of(spark, rows)).collect()}


def test_constant_line_beside_many_varying_ones(spark):
    lines = lambda k: "".join(f"<p>line {i} of page {k}</p>" for i in range(9))
    rows = [(k, "http://h.example/", f"<div class=body>{lines(k)}<p>{'The same legal notice. ' * 30}</p></div>") for k in range(200)]
    assert texts(spark, rows) == {k: "\n".join(f"line {i} of page {k}" for i in range(9)) for k in range(200)}


@pytest.mark.parametrize("parts", [1, 9])
def test_many_slots_are_all_kept(spark, parts):
    part = lambda k, i: f"<div class={'abcdefgh'[i % 8]}{'xyzuvw'[i // 8 % 6]}{'klmnop'[i // 48 % 6]}{'qrs'[i // 288 % 3]}><p>constant {i}</p><p>own {i} {k}</p></div>"
    rows = [(k, "http://h.example/", "<main>" + "".join(part(k, i) for i in range(821)) + "</main>") for k in range(12)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES).repartition(parts)).collect()}
    assert got == {k: "\n".join(f"own {i} {k}" for i in range(821)) for k in range(12)}


def test_names_do_not_lose_articles(spark):
    bodies = {
        1: "<article><div class=elementor-widget><p>Real article {k} and its words.</div><p class=social-policy>Of policy {k}.</article>",
        2: "<form action=/><nav><a href=/>Menu</a></nav><h1>Title {k}</h1><p>A whole page {k} inside a form.</form>",
        3: "<div class=widget><p>All text {k} of this site is in a widget.</div><div class=comment-list><p>First {k}!</div>",
        4: "<div class='post'><h1>Title {k}</h1><div class=entry><p>Words of entry {k}, quite a few of them.<div class='ad-box'>Buy {k}</div></div></div><div id=share-price><p>Up {k}</div>",
    }
    rows = [(100 * b + k, f"http://h{b}.example/{k}", body.replace("{k}", str(k))) for b, body in bodies.items() for k in range(6)]
    got = texts(spark, rows)
    for k in range(6):
        assert got[100 + k] == f"Real article {k} and its words.\nOf policy {k}."
        assert got[200 + k] == f"Title {k}\nA whole page {k} inside a form."
        assert got[300 + k] == f"All text {k} of this site is in a widget."
        assert got[400 + k] == f"Title {k}\nWords of entry {k}, quite a few of them."


def test_content_is_where_text_varies(spark):
    """A long constant part does not win over a short varying one, whatever the names; on a page of another form, markup decides."""
    fixed = "<div class=x><p>" + "About us, at great length. " * 40 + "</p></div>"
    rows = [(k, "http://h.example/", f"<body>{fixed}<div class=y><p>Short news {k}.</p></div></body>") for k in range(8)]
    rows += [(50, "http://h.example/", f"<body><section><p>Another form of page, all alone.</section>{fixed}</body>")]
    got = texts(spark, rows)
    assert all(got[k] == f"Short news {k}." for k in range(8))
    assert got[50] == "Another form of page, all alone."


def test_long_pages_take_time_in_proportion():
    page = "<table>" + "".join(f"<tr class={'odd' if i % 2 else 'even'}><td>row {i}" for i in range(20_000)) + "</table>"
    import time

    began = time.process_time()
    assert wrapper.alone(page) == "\n".join(f"row {i}" for i in range(20_000))
    assert time.process_time() - began < 20


def test_heaviest_sequences():
    import itertools
    import random

    r = random.Random(4)
    for _ in range(200):
        n = r.randint(0, 7)
        places, weights = r.sample(range(20), n), [r.randint(1, 5) for _ in range(n)]
        got = wrapper.heaviest(places, weights)
        rising = lambda c: all(places[a] < places[b] for a, b in itertools.pairwise(c))
        assert got == sorted(got) and rising(got)
        assert sum(weights[i] for i in got) == max(sum(weights[i] for i in c) for m in range(n + 1) for c in itertools.combinations(range(n), m) if rising(c))


class Article(html.parser.HTMLParser):
    """The text of article elements by Python's own parser, a block to a line."""

    BLOCKS = {"p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "div", "blockquote", "pre", "table", "tr", "td", "section", "aside", "figure"}

    def __init__(self, page):
        super().__init__()
        self.depth, self.lines, self.quiet = 0, [[]], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("script", "style"):
            self.quiet += 1
        if tag in self.BLOCKS:
            self.lines.append([])
        if tag == "br":
            self.lines[-1].append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("script", "style"):
            self.quiet -= 1
        if tag in self.BLOCKS:
            self.lines.append([])

    def handle_data(self, data):
        if self.depth > 0 and not self.quiet:
            self.lines[-1].append(data)

    def text(self):
        found = (" ".join("".join(x).split()) for x in self.lines)
        return "\n".join(x for x in found if x)


def test_every_page_gives_its_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in wrapper.extract(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(got) == len(rows)
    wrong = [r.page_id for r in rows if got[r.page_id] != Article(r.html or "").text()]
    assert not wrong, (len(wrong), got[wrong[0]], Article(next(r.html for r in rows if r.page_id == wrong[0])).text())
