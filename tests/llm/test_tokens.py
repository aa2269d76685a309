"""The tokenization automaton and packing, against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from strata.llm import bpe, packing
from strata.llm.common import vocabulary_path
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    r = random.Random(3)
    yield from (t for _, t in ODD if t)
    yield from ("aaaaaaaaaaaa", "!!!!!!!", "It's we'll I'D", "</w> a</w>b", "` ͅ", "<|endoftext|><|startoftext|>hm", "<|x|>")
    for _ in range(300):
        yield "".join(r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice([2, 4, 26])]) for _ in range(r.randint(1, 14)))
    for _ in range(200):
        yield "".join(chr(r.choice([r.randint(32, 0x24F), r.randint(0x300, 0x36F), r.randint(0x370, 0xD7FF)])) for _ in range(20))


def test_bpe_like_the_library(library):
    own = bpe.word_bpe(vocabulary_path("word_bpe_49k.json"))
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        mine = own.encode(t)
        assert np.frombuffer(mine, "<u4").tolist() == ids, repr(t)
        assert own.decode(mine) == library.decode(ids, skip_special_tokens=False)


def test_automaton_accepts_one_path_per_word():
    """Of all ways to spell a word in tokens, the automaton has exactly the one that merging yields."""
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), ("aa", "b"), ("ab", "ab")]
    vocab = {s: i for i, s in enumerate(["a", "b", *(x + y for x, y in merges)])}
    auto = bpe.MergeAutomaton(vocab, merges)
    live = set(auto.token_at)

    def merged(word):
        parts = list(word)
        for x, y in merges:
            out, i = [], 0
            while i < len(parts):
                if parts[i : i + 2] == [x, y]:
                    out.append(x + y)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [vocab[p] for p in parts]

    def paths(word, before=-1):
        if not word:
            yield []
        for token, i in vocab.items():
            if i in live and word.startswith(token) and auto.follows(before, i):
                yield from ([i, *rest] for rest in paths(word[len(token) :], i))

    for n in range(1, 9):
        for k in range(1 << n):
            word = "".join("ab"[k >> b & 1] for b in range(n))
            assert list(paths(word)) == [merged(word)], word
            ids, _ = auto.encode(np.array([ord(c) for c in word]), np.array([n]))
            assert ids.tolist() == merged(word)


def test_encode_decode_rows(odd, empty, library):
    got = bpe.encode_decode(odd).collect()
    found = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got)
    want = Counter()
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert found == want
    assert bpe.encode_decode(empty).collect() == []


def test_pack_round_trip(odd, empty):
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    rows = packing.pack(odd, window=64).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    sizes = []
    for k in range(len(sequences)):
        at = 0
        for r in sorted(sequences[k], key=lambda r: r.offset):
            assert r.offset == at and r.length * 4 == len(r.ids) and r.length > 0
            at += r.length
        sizes.append(at)
    assert all(s == 64 for s in sizes[:-1]) and 0 < sizes[-1] <= 64
    # each document's pieces, put together, are its ids
    want = Counter((i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, x in ODD)
    pieces = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    found, text = Counter(), b""
    for r in pieces:
        assert len(text) == r.start * 4
        text += bytes(r.ids)
        if len(text) == r.doc_tokens * 4:
            found[r.doc_id, text] += 1
            text = b""
    assert found == want and not text
    assert packing.pack(empty).collect() == []


def test_query_columns(spark):
    from strata.llm.queries import op8_packing

    rows = op8_packing(spark, "/root/testdata/sf0.001")
    assert set(rows.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    r = packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).first()
    same = rows.where(f"sequence_id = {r.sequence_id} AND `offset` = {r['offset']}").first()
    assert zlib.crc32(r.ids) == same.ids_crc32
