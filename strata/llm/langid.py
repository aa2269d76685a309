"""Language ID by segmentation-marginalised unigrams.

A word's probability in a language is the sum over all its segmentations into pieces of a
fixed public vocabulary of the product of the pieces' probabilities there: a forward pass over
the word's lattice.  Piece probabilities are learned by expectation maximisation: a forward and
a backward pass give each piece's expected count in the training words, which are summed up by
language over all training texts.  The model has a row for each piece of the vocabulary and a
column for each language, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import code_points, column, lent, letter_words, map_beside, slices, vocabulary_path, word_groups

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
#: Longer words' expected counts are worked out in logarithms, since uniform probabilities leave the range of doubles.
LONGEST = 48
#: Distinct words that a task works on together: their lattices lie in memory.
WORDS = 20_000
#: Words whose probability is below this in a language are summed in logarithms.
LEAST = 1e-290
#: Weight, in pieces, of all languages' shared distribution in each language's.
SHARED_WEIGHT = 200.0


class Pieces:
    """A trie over the vocabulary's pieces of lower-case letters, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size())}
        names = sorted(n for n in names if n and n.isalpha() and n == n.lower())
        inner = sorted({c for n in names if len(n) > 1 for c in n})
        self.count = len(names) + 1  # the last is any character that is not a piece
        self.inner = np.zeros(0x110000, np.int16)  # symbols of longer pieces, numbered from 1
        self.inner[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.single = np.full(0x110000, self.count - 1, np.int32)
        width, nodes, piece = len(inner) + 1, {"": 0}, [-1]
        links = []
        for number, name in enumerate(names):
            if len(name) == 1:
                self.single[ord(name)] = number
                if not self.inner[ord(name)]:
                    continue
            for i in range(1, len(name) + 1):
                if name[:i] not in nodes:
                    nodes[name[:i]] = len(nodes)
                    piece.append(-1)
                    links.append((nodes[name[: i - 1]], self.inner[ord(name[i - 1])], nodes[name[:i]]))
            piece[nodes[name]] = number
        self.child = np.zeros((len(nodes), width), np.int32)
        for parent, symbol, node in links:
            self.child[parent, symbol] = node
        self.piece = np.array(piece, np.int32)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Starts and ends of the words in a row of places, and arcs (from, to, piece) by distance of ``to`` from its word's start."""
        flat, starts, lengths = code_points(words)
        offset = np.arange(len(flat)) - np.repeat(starts, lengths + 1)
        symbol = self.inner[flat]
        begin = np.flatnonzero(flat != 10)
        arcs = [(begin, begin + 1, self.single[flat[begin]])]
        at, node, size = begin, self.child[0, symbol[begin]], 1
        while len(at):
            live = node > 0
            at, node = at[live], node[live]
            if size > 1:
                found = self.piece[node] >= 0
                arcs.append((at[found], at[found] + size, self.piece[node[found]]))
            node = self.child[node, symbol[at + size]]  # a word's end has symbol 0, which leads nowhere
            size += 1
        a, b, p = (np.concatenate(x) for x in zip(*arcs, strict=True))
        step = offset[b]  # at a word's end, its place is that of the 10 after it
        order = np.lexsort((b, step))
        a, b, p, step = a[order], b[order], p[order], step[order]
        cuts = np.searchsorted(step, np.arange(1, int(lengths.max(initial=0)) + 2))
        parts = [(a[i:j], b[i:j], p[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return starts, starts + lengths, parts


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _sum_at(target: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
    """Adds values at places that come in runs."""
    if len(places):
        heads = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        target[places[heads]] += np.add.reduceat(values, heads, axis=0)


def forward(model: np.ndarray, lattice: tuple) -> np.ndarray:
    """Sums over all segmentations up to each place; ``model``: pieces by languages."""
    starts, ends, parts = lattice
    total = np.zeros((int(ends[-1]) + 1 if len(ends) else 0, model.shape[1]))
    total[starts] = 1.0
    for a, b, p in parts:
        _sum_at(total, b, total[a] * model[p])
    return total


def log_forward(model: np.ndarray, lattice: tuple) -> np.ndarray:
    """Logarithms of ``forward``'s sums, at any scale."""
    starts, ends, parts = lattice
    total, logs = np.full((int(ends[-1]) + 1 if len(ends) else 0, model.shape[1]), -np.inf), np.log(model)
    total[starts] = 0.0
    for a, b, p in parts:
        if len(b):
            heads = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            values = total[a] + logs[p]
            top = np.maximum.reduceat(values, heads, axis=0)
            values -= np.repeat(top, np.diff(np.r_[heads, len(b)]), axis=0)
            total[b[heads]] = top + np.log(np.add.reduceat(np.exp(values), heads, axis=0))
    return total


def word_logs(trie: Pieces, model: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probabilities, words by languages; a sum that is large enough has lost no path that matters."""
    lattice = trie.lattice(words)
    found = forward(model, lattice)[lattice[1]]
    low = np.flatnonzero((found < LEAST).any(axis=1))
    with np.errstate(divide="ignore"):
        logs = np.log(found)
    if len(low):
        again = trie.lattice([words[i] for i in low])
        logs[low] = log_forward(model, again)[again[1]]
    return logs


def expected(prior: np.ndarray, lattice: tuple, weights: np.ndarray, count: int) -> np.ndarray:
    """Expected piece counts by language of words with ``weights`` (words by languages) under one model."""
    starts, ends, parts = lattice
    ahead = forward(prior[:, None], lattice)[:, 0]
    behind = np.zeros(len(ahead))
    behind[ends] = 1.0
    out = np.zeros((count, weights.shape[1]))
    word_of = np.zeros(len(ahead), np.int64)
    word_of[starts] = 1
    word_of = np.cumsum(word_of) - 1
    for a, b, p in reversed(parts):
        np.add.at(behind, a, prior[p] * behind[b])
    for a, b, p in parts:
        share = ahead[a] * prior[p] * behind[b] / ahead[ends[word_of[a]]]
        for k in range(weights.shape[1]):
            out[:, k] += np.bincount(p, share * weights[word_of[a], k], count)
    return out


def log_expected(prior: np.ndarray, lattice: tuple, weights: np.ndarray, count: int) -> np.ndarray:
    """``expected`` for words of any length."""
    starts, ends, parts = lattice
    ahead, logs = log_forward(prior[:, None], lattice)[:, 0], np.log(prior)
    behind, word_of = np.full(len(ahead), -np.inf), np.zeros(len(ahead), np.int64)
    behind[ends], word_of[starts] = 0.0, 1
    word_of = np.cumsum(word_of) - 1
    for a, b, p in reversed(parts):
        np.logaddexp.at(behind, a, logs[p] + behind[b])
    out = np.zeros((count, weights.shape[1]))
    for a, b, p in parts:
        share = np.exp(ahead[a] + logs[p] + behind[b] - ahead[ends[word_of[a]]])
        for k in range(weights.shape[1]):
            out[:, k] += np.bincount(p, share * weights[word_of[a], k], count)
    return out


def learn(rows: DataFrame, vocabulary: str = VOCABULARY, shared_weight: float = SHARED_WEIGHT) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (pieces by languages) from all rows of ``text, lang``.

    What reaches the driver is one number for each piece of the vocabulary and language.
    """
    languages = sorted(r[0] for r in rows.select("lang").where("lang IS NOT NULL AND text IS NOT NULL").distinct().collect())
    number = {name: k for k, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = pieces(vocabulary_path(vocabulary))
        prior, total = np.full(trie.count, 1 / trie.count), np.zeros((trie.count, len(number)))
        for whole in batches:
            for batch in slices(whole, "text"):
                of, at = [number[x] for x in batch.column("lang").to_pylist()], 0
                for words, group in word_groups(batch.column("text").to_pylist(), words=WORDS):
                    weights = np.zeros((len(words), len(number)))
                    for k, text in zip(of[at : at + len(group)], group, strict=True):
                        weights[:, k] += np.bincount(text, minlength=len(words))
                    at += len(group)
                    long = np.fromiter((len(w) > LONGEST for w in words), bool, len(words))
                    for some, count in ((~long, expected), (long, log_expected)):
                        if some.any():
                            total += count(prior, trie.lattice([w for w, x in zip(words, some, strict=True) if x]), weights[some], trie.count)
        p, k = np.nonzero(total)
        yield pa.record_batch({"piece": p.astype(np.int32), "lang": k.astype(np.int32), "n": total[p, k]})

    counted = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(run, "piece int, lang int, n double")
    found = counted.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((pieces(vocabulary_path(vocabulary)).count, len(languages)))
    counts[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    shared = counts.sum(axis=1) + 0.5
    shared /= shared.sum()
    model = (counts + shared_weight * shared[:, None]) / (counts.sum(axis=0) + shared_weight)
    return languages, model


def predict(rows: DataFrame, languages: list[str], model: np.ndarray, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with ``__lang`` and ``__confidence``, the posterior of that language (equal priors).

    A null text, or one without a letter, is ``und`` with confidence 0, and so are all texts if
    no language was learned.  A tie goes to the language whose name comes first.
    """
    shared = lent(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, model = pieces(vocabulary_path(vocabulary)), shared.value
        for whole in batches:
            for batch in slices(whole, "__text"):
                names, scores = [], []
                for words, group in word_groups(batch.column("__text").to_pylist(), words=WORDS):
                    if words and languages:
                        logs = word_logs(trie, model, words)
                    for text in group:
                        if not len(text) or not languages:
                            names.append(UNKNOWN)
                            scores.append(0.0)
                            continue
                        sums = logs[text].sum(axis=0)
                        best = int(np.argmax(sums))
                        names.append(languages[best])
                        scores.append(float(1 / np.exp(sums - sums[best]).sum()))
                rest = [c for c in batch.schema.names if c != "__text"]
                yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "__lang", "__confidence"])

    return map_beside(rows, {"__text": column(text_col).cast("string")}, run, {"__lang": "string", "__confidence": "double"})


def held_out(id_col: str = "doc_id") -> Column:
    """The rows no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
