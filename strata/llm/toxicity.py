"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a model of the letters of words given the five before
(interpolated Kneser-Ney, word starts and ends included; a document counts each of its words
once).  Orders below the sixth use continuation counts of both classes together, so what is
rare in either backs off to the same estimate.  A word's gap is the difference of its two
log-likelihoods.  A text's evidence is the sum of what its words' gaps have above a margin,
over its number of words; the margin keeps the small gaps that all words have by chance from
adding up.  A logistic curve, fitted on labelled rows kept out of the counts, turns the
evidence (on a log scale) into a score.

For a six-gram seen in neither class the difference is that of the back-off weights of its
context, whatever the letter, and 0 if the context is new too.  So the model is a table of
differences by context, with those of its six-grams, whole grams at any corpus size.  For
scoring, the grams of the texts' distinct words meet it by one shuffle, each word once; texts then meet
the words whose gap is above the margin.  Two broadcasts of fixed size, gaps or bounds on them by
``2**BOUND_BITS`` slots (:class:`Bounds`) and excesses of words by ``2**FILTER_BITS``, keep most other words from being shuffled; they never
lose a word that counts.  Words that share a slot of the second are told apart by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import code_points, column, lent, map_beside, slices, stage, word_groups

ORDER = 6
SYMBOL_BITS = 10
DISCOUNT = 0.75
BOUND_BITS = 21
SECOND_BITS = 19
#: In place of a key: a slot without one, and one with several.
NONE, SEVERAL = -1, -2
FILTER_BITS = 21
THRESHOLD = 0.3
#: A word's gap counts above this.
MARGIN = 2.0
#: Words without a gap that each text is taken to have besides its own.
PRIOR_WORDS = 20
#: Evidence is put on a log scale from here.
FLOOR = 0.005
#: Bins of the histogram of evidence on which the curve is fitted.
BINS = 2048
_SLOT = 0x9E3779B97F4A7C15
_LOW = 0x250


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Six-grams of all words (10 bits a symbol), letter by letter and the word's end; the word of each."""
    flat, _, lengths = code_points(words)
    symbols = np.where(flat < _LOW, flat, _LOW + flat % (1023 - _LOW)).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    out = symbols.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(symbols)  # 0: before the word's start
        before[back:] = symbols[:-back] if back < len(symbols) else 0
        before[place < back] = 0
        out |= before << (SYMBOL_BITS * back)
    return out, owner


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(_SLOT)) >> np.uint64(64 - bits)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, toxic, ordinary): a group's counts."""
    for whole in batches:
        for batch in slices(whole, "text"):
            toxic, at = batch.column("toxic").to_pylist(), 0
            for words, group in word_groups(batch.column("text").to_pylist()):
                weights = np.zeros((2, len(words)))
                for label, text in zip(toxic[at : at + len(group)], group, strict=True):
                    weights[1 - label, np.unique(text)] += 1
                at += len(group)
                if words:
                    keys, owner = grams(words)
                    found, back = np.unique(keys, return_inverse=True)
                    yield pa.record_batch(
                        {
                            "gram": found,
                            "toxic": np.bincount(back, weights[0][owner]).astype(np.int64),
                            "ordinary": np.bincount(back, weights[1][owner]).astype(np.int64),
                        }
                    )


def gaps(rows: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """``context, back, own``: the difference of log-likelihoods of each context, and of its six-grams by last symbol, from all rows of ``text, toxic`` (0 or 1)."""
    counted = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_count, "gram long, toxic long, ordinary long")
    top = stage(counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")
    mask = lambda k: F.lit((1 << (SYMBOL_BITS * k)) - 1)
    # shared continuation counts: of a k-gram, the different symbols seen before it
    shared = {ORDER: top.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        shared[k] = shared[k + 1].groupBy(F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(F.count("*").alias("n"))
    whole = shared[1].agg((F.sum("n") + 512.0).alias("sum"))
    lower = shared[1].crossJoin(F.broadcast(whole)).select("gram", ((F.col("n") + 0.5) / F.col("sum")).alias("p"))  # one row, of two numbers
    for k in range(2, ORDER):
        of = Window.partitionBy(F.shiftright("gram", SYMBOL_BITS))
        totals = shared[k].withColumns({"sum": F.sum("n").over(of), "kinds": F.count("*").over(of), "suffix": F.col("gram").bitwiseAND(mask(k - 1))})
        back = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("back"))
        p = (F.col("n") - discount + discount * F.col("kinds") * F.col("back")) / F.col("sum")
        lower = totals.join(back, "suffix").select("gram", p.alias("p"))
    parts = top.withColumn("suffix", F.col("gram").bitwiseAND(mask(ORDER - 1))).join(lower.select(F.col("gram").alias("suffix"), "p"), "suffix")
    entry = F.struct(F.col("gram").bitwiseAND(mask(1)).cast("int").alias("symbol"), "toxic", "ordinary", "p")
    of = lambda c: [F.sum(c).alias(f"{c}_sum"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds")]
    # a context has no more entries than there are symbols
    met = parts.groupBy(F.shiftright("gram", SYMBOL_BITS).alias("context")).agg(F.collect_list(entry).alias("entries"), *of("toxic"), *of("ordinary"))

    def weight(c: str) -> Column:
        return F.when(F.col(f"{c}_sum") > 0, discount * F.col(f"{c}_kinds") / F.col(f"{c}_sum")).otherwise(1.0)

    def likely(c: str, x: Column) -> Column:
        own = F.when(F.col(f"{c}_sum") > 0, F.greatest(x[c] - discount, F.lit(0.0)) / F.col(f"{c}_sum")).otherwise(0.0)
        return own + weight(c) * x["p"]

    own = F.transform("entries", lambda x: F.struct(x["symbol"].alias("symbol"), (F.log(likely("toxic", x)) - F.log(likely("ordinary", x))).alias("gap")))
    return met.select("context", (F.log(weight("toxic")) - F.log(weight("ordinary"))).alias("back"), F.map_from_entries(own).alias("own"))


def both_slots(keys: np.ndarray, bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return slots(keys, bits[0]), slots(keys ^ (keys >> 23), bits[1])


def _word(word: str) -> bytes:
    return xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass"))


class Bounds:
    """Gaps by key for six-grams (kind 0) and contexts (1), in two tables of slots of fixed size.

    A slot of the first holds its least key; the others of that slot go to the second.  A slot of the
    second that several keys share holds the largest gap among them, as a bound.
    """

    def __init__(self, tables: tuple[pa.Table, pa.Table], bits: tuple[int, int]):
        self.bits, self.only, self.most = bits, [], []
        for n, table in zip(bits, tables, strict=True):
            only, most = np.full((2, 1 << n), NONE, np.int64), np.zeros((2, 1 << n), np.float16)
            at = table["kind"].to_numpy(), table["slot"].to_numpy()
            only[at] = table["key"].to_numpy()
            most[at] = np.nextafter(table["gap"].to_numpy().astype(np.float16), np.float16(np.inf))  # rounded up
            self.only.append(only)
            self.most.append(most)

    def of(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The gap of each key or a bound on it, whether the key is known for sure, and whether it may be."""
        one, two = both_slots(keys, self.bits)
        here, there = self.only[0][kind][one] == keys, self.only[1][kind][two]
        sure, may = here | (there == keys), here | (there == keys) | (there == SEVERAL)
        gap = np.where(here, self.most[0][kind][one], self.most[1][kind][two]).astype(np.float64)
        return gap, sure, may


def bounds(model: DataFrame) -> Bounds:
    """The model's gaps, or bounds on them where two keys share a slot twice."""
    bits = BOUND_BITS, SECOND_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = both_slots(b.column("key").to_numpy(), bits)
            yield pa.record_batch({"kind": b.column("kind"), "slot": one.astype(np.int32), "second": two.astype(np.int32), "key": b.column("key"), "gap": b.column("gap")})

    whole = model.select(F.lit(0).alias("kind"), "context", F.explode("own").alias("symbol", "gap"))
    whole = whole.select("kind", (F.shiftleft("context", SYMBOL_BITS) + F.col("symbol")).alias("key"), "gap")
    keyed = whole.unionByName(model.select(F.lit(1).alias("kind"), F.col("context").alias("key"), F.col("back").alias("gap")))
    hashed = keyed.mapInArrow(run, "kind int, slot int, second int, key long, gap double")
    first = hashed.groupBy("kind", "slot").agg(F.min(F.struct("key", F.col("gap").cast("float").alias("gap"))).alias("x"))
    first = stage(first.select("kind", "slot", "x.*"), "bounds")
    rest = hashed.join(first.select("kind", "slot", F.col("key").alias("least")).hint("merge"), ["kind", "slot"]).where("key <> least")
    one = F.when(F.min("key") == F.max("key"), F.min("key")).otherwise(SEVERAL).alias("key")
    second = rest.groupBy("kind", F.col("second").alias("slot")).agg(one, F.max("gap").cast("float").alias("gap"))
    return Bounds((first.toArrow(), second.toArrow()), bits)


def _words(shared):
    """Words whose gap may be above the margin; where several keys share a slot twice, the largest that may hold counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                for words, _ in word_groups(batch.column("text").to_pylist()):
                    if words:
                        keys, owner = grams(words)
                        own, known, may_own = shared.value.of(0, keys)
                        back, sure, may_back = shared.value.of(1, keys >> SYMBOL_BITS)
                        back = np.where(sure, back, np.where(may_back, np.maximum(back, 0), 0))  # unknown contexts: 0
                        gap = np.where(known, own, np.where(may_own, np.maximum(own, back), back))
                        may = np.bincount(owner, gap, len(words)) > MARGIN - 0.01
                        yield pa.record_batch({"word": pa.array(words, pa.string()).filter(pa.array(may))})

    return run


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "word"):
            keys, owner = grams(batch.column("word").to_pylist())
            symbols = (keys & ((1 << SYMBOL_BITS) - 1)).astype(np.int32)
            yield pa.record_batch({"no": batch.column("no").take(pa.array(owner)), "context": keys >> SYMBOL_BITS, "symbol": symbols})


#: Each model's bounds, for as long as the model is used.
_BOUNDS: WeakKeyDictionary[DataFrame, Broadcast] = WeakKeyDictionary()


def excesses(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``word, excess`` of the distinct words of ``text`` whose gap is above the margin.

    Words are numbered; their grams go to the contexts once, which know both a gram's gap and
    its context's, and only gaps that are not 0 go back to the words.
    """
    if model not in _BOUNDS:
        _BOUNDS[model] = lent(rows.sparkSession, bounds(model))
    words = rows.mapInArrow(_words(_BOUNDS[model]), "word string").distinct()
    words = stage(words.select(F.monotonically_increasing_id().alias("no"), "word"), "words")
    own = words.mapInArrow(_grams_of, "no long, context long, symbol int")
    met = own.join(model.hint("merge"), "context").select("no", F.coalesce(F.try_element_at("own", F.col("symbol")), "back").alias("gap")).where("gap <> 0")
    summed = met.groupBy("no").agg((F.sum("gap") - MARGIN).alias("excess")).where("excess > 0")
    named = words.join(summed, "no").mapInArrow(_digests, "word binary, excess double")
    return stage(named, "excesses")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch({"word": pa.array([_word(w) for w in b.column("word").to_pylist()], pa.binary()), "excess": b.column("excess")})


def evidence(rows: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with ``__evidence``: see the module's text; 0 without letters, else up to some 8.

    A word alone in its slot has its excess there, in a broadcast; the others, if any, meet theirs by shuffle.
    """
    text = column(text_col).cast("string")
    texts = rows.select(text.alias("text")).where("text IS NOT NULL")
    found, mask = excesses(texts, model), (1 << FILTER_BITS) - 1
    slot = F.conv(F.hex(F.substring("word", 1, 4)), 16, 10).cast("long").bitwiseAND(mask)
    held = found.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.first("word").alias("word"), F.first("excess").alias("excess")).orderBy("slot").toArrow()
    several = held["n"].to_numpy() > 1
    table = (held["slot"].to_numpy(), several, np.frombuffer(b"".join(held["word"].to_pylist()), "V16"), held["excess"].to_numpy())
    shared = lent(rows.sparkSession, table)

    def known(words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Digests, excesses of words that are alone in their slots, and which words share one."""
        places, many, names, excess = shared.value
        digests = [_word(w) for w in words]
        if not len(places) or not words:
            return digests, np.zeros(len(words)), np.zeros(len(words), bool)
        wanted = np.fromiter((int.from_bytes(d[:4], "big") & mask for d in digests), np.int64, len(digests))
        at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
        here = places[at] == wanted
        same = here & ~many[at] & (names[at] == np.frombuffer(b"".join(digests), "V16"))
        return digests, np.where(same, excess[at], 0.0), here & many[at]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                sums, sizes = [], []
                for words, group in word_groups(batch.column("__text").to_pylist()):
                    _, excess, _ = known(words)
                    sums += [float(excess[t].sum()) for t in group]
                    sizes += [len(t) for t in group]
                rest = [c for c in batch.schema.names if c != "__text"]
                yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())], names=[*rest, "__sum", "__size"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                names, at = batch.column("digest").to_pylist(), 0
                for words, group in word_groups(batch.column("text").to_pylist()):
                    digests, _, may = known(words)
                    out = []
                    for name, t in zip(names[at : at + len(group)], group, strict=True):
                        numbers, times = np.unique(t[may[t]], return_counts=True)
                        out += [(name, digests[w], n) for w, n in zip(numbers.tolist(), times.tolist(), strict=True)]
                    at += len(group)
                    if out:
                        d, w, n = zip(*out, strict=True)
                        yield pa.record_batch({"digest": pa.array(d, pa.binary()), "word": pa.array(w, pa.binary()), "n": pa.array(n, pa.int64())})

    name = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    met = map_beside(rows, {"__text": text}, add, {"__sum": "double", "__size": "long"})
    if several.any():
        more = texts.select("text", name(F.col("text")).alias("digest")).mapInArrow(others, "digest binary, word binary, n long")
        once = more.groupBy("digest", "word").agg(F.first("n").alias("n"))  # copies of a text count once
        told = once.join(found.hint("merge"), "word").groupBy(F.col("digest").alias("__digest")).agg(F.sum(F.col("excess") * F.col("n")).alias("__more"))
        met = met.withColumn("__digest", name(text)).join(told.hint("merge"), "__digest", "left").withColumn("__sum", F.col("__sum") + F.coalesce("__more", F.lit(0.0)))
    value = F.log1p(F.col("__sum") / (F.col("__size") + PRIOR_WORDS) / FLOOR)
    return met.select(*(column(c) for c in rows.columns), value.alias("__evidence"))


def fit_curve(x: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through weighted points, with a weak pull to 2 and -5."""
    weight, at, pull = toxic + ordinary, np.array([2.0, -5.0]), 0.05
    design = np.stack([x, np.ones_like(x)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ design, -35, 35)))
        slope = design @ (weight * p - toxic) + pull * (at - [2.0, -5.0])
        curve = (design * (weight * p * (1 - p))) @ design.T + pull * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at - np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def train(labelled: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """The model, a written table, and the curve from all rows of ``doc_id, text, toxic``: an eighth of them, by hash of the id, fits the curve."""
    rows = labelled.where("text IS NOT NULL AND toxic IN (0, 1)")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0
    model = stage(gaps(rows.where(~apart)), "gaps")
    scored = evidence(stage(rows.where(apart).select("text", "toxic"), "curve"), model)
    binned = F.least(F.greatest(F.floor(F.col("__evidence") * (BINS / 8)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    found = scored.groupBy(binned.alias("bin")).agg(F.avg("__evidence").alias("x"), F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("ordinary")).orderBy("bin").toArrow()
    return model, fit_curve(*(found[c].to_numpy().astype(float) for c in ("x", "toxic", "ordinary")))


def score(docs: DataFrame, model: DataFrame, curve: tuple[float, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``__score`` (0 to 1) and ``__predicted`` (1 from ``threshold`` up).

    A null or empty text, or one without letters, has no evidence and gets the curve's value
    at 0.  Rows are scored alone; a table without usable labels gives a curve without slope
    to speak of, and an empty table no rows.
    """
    slope, intercept = curve
    z = F.least(F.greatest(F.lit(slope) * F.col("__evidence") + F.lit(intercept), F.lit(-30.0)), F.lit(30.0))
    scored = evidence(docs, model, text_col).withColumn("__score", 1 / (1 + F.exp(-z))).drop("__evidence")
    return scored.withColumn("__predicted", (F.col("__score") >= threshold).cast("int"))
