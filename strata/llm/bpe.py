"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens whose paths are
exactly the token sequences that BPE yields.  It starts as one state with a loop for each base
symbol.  The gadget of a merge ``a b -> c`` copies the state behind ``a`` without its arc ``b``,
redirects the ``a`` arcs to the copy, and adds an arc ``c`` from where ``a`` began to where ``b``
ended.  Every arc of one token ends in the same state at all times, so the automaton is kept as

* ``cut``: which gadget took arc ``b`` out behind ``a`` (its number in merge order),
* each token's spines: the tokens its last (first) part is made of, with the gadget that covered
  them up.  The state behind a token is the chain of copies made for its right spine; an arc of
  ``c`` leaves a state if no copy in that chain took out ``c`` or a token on its left spine.

Every prefix of a word has exactly one accepted path, so determinising over symbols gives a
table ``(state, symbol) -> (state, last token of the prefix)``, filled where words lead it.
Encoding a word is one table step per symbol, then following last tokens back from the end.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import slices, vocabulary_path, word_groups

WORD_BPE = "word_bpe_49k.json"
#: Distinct words, and characters of text, that are encoded together (memory bounds; results are the same).
GROUP_WORDS = 200_000
GROUP_CHARS = 16 << 20
#: Table states a worker remembers before it starts afresh.
CACHE_STATES = 400_000
_NEVER = 1 << 40

# How the vocabulary file splits lower-cased text (fixed values), written out for code points below
# U+0250, where normal form C changes nothing; other texts go through the file's own splitter.
_SPACES, _LETTERS, _NUMBERS = "\t-\r \x85\xa0", "a-zªµºß-öø-\u024f", "0-9²³¹¼½¾"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_OTHER = re.compile("[^\\x00-\u024f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """``vocab``: label -> id; ``merges``: label pairs in order; ``suffix``: marks a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.size = max(vocab.values(), default=0) + 1
        self.cut: dict[int, int] = {}
        self.left: dict[int, tuple[int, int]] = {}  # token -> (first part, gadget)
        self.right: dict[int, tuple[int, int]] = {}
        self._spines: dict[int, tuple[list, list]] = {-1: ([], [])}
        spelled: dict[int, tuple[int, ...]] = {}
        for byte, char in enumerate(byte_symbols()):
            if char in vocab:
                spelled[vocab[char]] = (byte,)
            if suffix and char + suffix in vocab:
                spelled[vocab[char + suffix]] = (256 + byte,)
        for k, (a, b) in enumerate(merges):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b], spelled)
        self.length_of = np.zeros(self.size, np.int64)
        for t, symbols in spelled.items():
            self.length_of[t] = len(symbols)
        self.arcs: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, symbols in spelled.items():
            node = 0
            for s in symbols:
                nxt = self.arcs[node].get(s)
                if nxt is None:
                    nxt = self.arcs[node][s] = len(self.arcs)
                    self.arcs.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = token
        self._reset()

    def _gadget(self, k: int, a: int, b: int, c: int, spelled: dict) -> None:
        if c in spelled:
            raise ValueError(f"merge {k} makes a token that an earlier one made")
        if a not in spelled or b not in spelled or not self.follows(a, b):
            return  # earlier gadgets left no path through this pair: the merge never happens
        self.cut[a * self.size + b] = k
        self.left[c], self.right[c] = (a, k), (b, k)
        spelled[c] = spelled[a] + spelled[b]

    def _spine(self, token: int) -> tuple[list, list]:
        found = self._spines.get(token)
        if found is None:
            found = ([], [])
            for side, parts in zip(found, (self.left, self.right), strict=True):
                t, covered = token, _NEVER
                side.append((t, covered))
                while t in parts:
                    t, covered = parts[t]
                    side.append((t, covered))
            self._spines[token] = found
        return found

    def follows(self, before: int, token: int) -> bool:
        """Whether the state behind ``before`` (-1: the start) has an arc ``token``."""
        for r, r_covered in self._spine(before)[1]:
            for c, c_covered in self._spine(token)[0]:
                k = self.cut.get(r * self.size + c)
                if k is not None and k < r_covered and k <= c_covered:
                    return False
        return True

    def _reset(self) -> None:
        self.table: dict[int, int] = {}
        self.last: list[int] = [-1]  # state -> last token of the prefix
        self._live: list[tuple] = [((-1, 0),)]
        self._number = {self._live[0]: 0}

    def _fill(self, key: int) -> int:
        """A table entry: the live (token before, place in the trie of labels) pairs one symbol on."""
        state, symbol = divmod(key, 512)
        last, live = -1, []
        for before, node in self._live[state]:
            node = self.arcs[node].get(symbol)
            if node is None:
                continue
            if self.arcs[node]:
                live.append((before, node))
            t = self.token_at[node]
            if t >= 0 and self.follows(before, t):
                last = t
        if last < 0:
            raise ValueError(f"symbol {symbol} is not in the vocabulary")
        live.append((last, 0))
        name = tuple(live)
        to = self._number.get(name)
        if to is None:
            to = self._number[name] = len(self._live)
            self._live.append(name)
            self.last.append(last)
        self.table[key] = to
        return to

    def encode(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, all one table step at a time, and each word's number of ids.

        ``symbols``: the words' symbols end to end (a byte, or 256 + byte where marked).
        """
        if len(self._live) > CACHE_STATES:
            self._reset()
        ends = np.cumsum(lengths)
        order = np.argsort(-lengths, kind="stable")  # the words still going on are always a prefix
        at, sizes = (ends - lengths)[order], lengths[order]
        state, lasts, get = np.zeros(len(order), np.int64), np.empty(len(symbols), np.int32), self.table.get
        for i in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -i, "left"))
            keys, back = np.unique(state[:n] * 512 + symbols[at[:n] + i], return_inverse=True)
            to = np.array([v if (v := get(k)) is not None else self._fill(k) for k in keys.tolist()], np.int64)
            state[:n] = to[back]
            lasts[at[:n] + i] = np.array([self.last[t] for t in to.tolist()], np.int32)[back]
        length = self.length_of
        begins, place, words = ends - lengths, ends.copy(), np.arange(len(ends))
        tokens, owners = [], []
        while len(words):  # the last token of each word, then of what precedes it, and so on
            t = lasts[place[words] - 1]
            tokens.append(t)
            owners.append(words)
            place[words] -= length[t]
            words = words[place[words] > begins[words]]
        if not tokens:
            return np.empty(0, np.uint32), np.zeros(len(lengths), np.int64)
        t, w = np.concatenate(tokens[::-1]), np.concatenate(owners[::-1])
        by_word = np.argsort(w, kind="stable")
        return t[by_word].astype(np.uint32), np.bincount(w, minlength=len(lengths))


class WordBpe:
    """Encodes and decodes whole texts with a ``word_bpe`` file, as the tokenizers library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.config = json.load(f)
        model = self.config["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in self.config["added_tokens"]}
        labels = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self._text = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
        self._path = path
        self._library = None

    def split(self, text: str) -> list[str]:
        """A text's words, normalised; a special token comes as its string after a space."""
        if not _OTHER.search(text) and "<|" not in text:
            return _WORD.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        words, at = [], 0
        for start, end, mark in [*((m.start(), m.end(), m[0]) for m in self._special.finditer(text)), (len(text), len(text), "")]:
            normal = self._library.normalizer.normalize_str(text[at:start])
            for w, _ in self._library.pre_tokenizer.pre_tokenize_str(normal):
                words.append(b"".join(self._text[c] for c in w).decode())
            words += [f" {mark}"] * bool(mark)
            at = end
        return words

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = {i: self.special[w[1:]] for i, w in enumerate(words) if w[0] == " "}
        spelled = [b"a" if i in special else w.encode() for i, w in enumerate(words)]
        lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        symbols = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64)
        symbols[np.cumsum(lengths) - 1] += 256
        ids, counts = self.automaton.encode(symbols, lengths)
        starts = np.cumsum(counts) - counts
        for i, token in special.items():
            ids[starts[i]] = token
        return ids, counts

    def encode_groups(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        """Ids of whole texts, in order, as little-endian unsigned 32-bit integers; a group of texts at a time."""
        for words, group in word_groups(texts, lambda t: self.split(t) if t else [], GROUP_WORDS, GROUP_CHARS):
            yield self._join(words, group)

    def _join(self, words: list[str], group: list[np.ndarray]) -> list[bytes]:
        if not words:
            return [b""] * len(group)
        ids, counts = self._encode_words(words)
        starts = np.cumsum(counts) - counts
        out = []
        for text in group:
            n = counts[text]
            ends = np.cumsum(n)
            place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[text] - (ends - n), n)
            out.append(ids[place].astype("<u4", copy=False).tobytes())
        return out

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_groups([text]))[0]

    def decode(self, ids: bytes) -> str:
        """The labels of the ids in order; the file names no decoder, so a space stands between them."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE) -> DataFrame:
    """Per row: ``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens``, ``decoded``.

    A null or empty text has no ids and decodes to the empty text.  Rows are handled alone, so
    ties, repeated rows and null ids pass through; only the two named columns are read.
    One narrow pass: no shuffle, and a lost task is simply run again.
    """

    def run(batches):
        bpe = word_bpe(vocabulary_path(vocabulary))
        for whole in batches:
            for batch in slices(whole, "text"):
                at = 0
                for ids in bpe.encode_groups(batch.column("text").to_pylist()):
                    yield pa.record_batch(
                        {
                            "doc_id": batch.column("doc_id").slice(at, len(ids)),
                            "ids": pa.array(ids, pa.binary()),
                            "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                            "decoded": pa.array([bpe.decode(i) for i in ids], pa.string()),
                        }
                    )
                    at += len(ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")
