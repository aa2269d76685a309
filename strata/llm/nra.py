"""Ranked lexical search by no random access (NRA) over impact-sorted lists.

One pass over the documents counts, for each of them, all its terms and those that some item asks
for; Spark sums the corpus' statistics (documents, terms, documents by term).  Documents are then
searched in shards of bounded size: a shard has, for each asked term, its documents by falling
impact, and every item reads its lists from the top, a chunk of each in turn.  A document that was
met has a lower bound (the impacts read) and an upper one (for each list where it was not met, what
the list still holds at most).  A document is dropped once its upper bound is below the ``k``-th
lower bound, and reading goes on until no unseen document can come in and the bounds of all that
are left meet, so members, ties and scores are exact.  A task hands an item's threshold on
from shard to shard, so that later shards are read less far; tasks hand in ``k`` rows for each item,
which Spark merges.

Items are taken in blocks of bounded numbers of terms, so what tasks hold depends neither on the
number of items nor of documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import column, slices, stage

#: Maximal runs of ASCII digits and letters and of all bytes of other characters, in UTF-8 (fixed values).
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Items, and terms of items, of a block.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 200_000
#: Documents, and their places in lists, of a shard.
SHARD_DOCS, SHARD_PLACES = 32_768, 4_000_000
#: Places of each list that are read at first; each turn reads twice as many.
CHUNK = 64
#: Parts into which an item's finds are dealt before they are merged.
PARTS = 64
FOUND = "item int, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    """A text's terms, in order; only A-Z are lower-cased."""
    return TERM.findall(text.lower())


def _counted(docs: DataFrame, asked: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, term (array), tf (array)`` of every document: all its terms, and the counts of asked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n, numbers, tfs, ends = [], [], [], [0]
                for text in batch.column("text").to_pylist():
                    found = terms(text) if text else []
                    n.append(len(found))
                    for term, tf in Counter(found).items():
                        if (number := asked.get(term)) is not None:
                            numbers.append(number)
                            tfs.append(tf)
                    ends.append(len(numbers))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (numbers, tfs)]
                yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


class Shard:
    """Documents with their asked terms, and the terms' lists by falling impact."""

    def __init__(self, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, part: np.ndarray):
        """``doc_ids``: ascending, -1 for none is not told apart here; ``part``: impact over the term's weight."""
        order = np.lexsort((doc, -part, term))
        self.doc_ids, self.doc, self.part = doc_ids, doc[order], part[order]
        self.terms, self.starts = np.unique(term[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        at = int(np.searchsorted(self.terms, term))
        if at == len(self.terms) or self.terms[at] != term:
            return None
        span = slice(self.starts[at], self.ends[at])
        return self.doc[span], self.part[span]


def read(shard: Shard, item: list[tuple[int, int]], k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard that are among the item's ``k`` best here with a score of ``least`` or more, and their scores.

    ``item``: its terms' numbers and what one unit of impact is worth there.  Ties at the ``k``-th place
    go to the smaller document number.
    """
    lists = [(docs, parts * worth) for term, worth in item if worth and (found := shard.list_of(term)) is not None for docs, parts in (found,)]
    low = np.zeros(len(shard.doc_ids), np.int64)
    if not lists:
        return np.empty(0, np.int64), low[:0]
    seen = np.zeros((len(lists), len(low)), bool)
    ceiling = np.array([gains[0] for _, gains in lists], np.int64)  # what an unseen place of each list holds at most
    depth, chunk, open_, alive = 0, CHUNK, True, np.empty(0, np.int64)
    met = np.zeros(len(low), bool)
    while True:
        if not open_:  # nothing new comes in: places of others are passed over
            wanted = np.zeros(len(low), bool)
            wanted[alive] = True
            needed = ~seen[:, alive].all(axis=1)
        for i, (docs, gains) in enumerate(lists):
            if ceiling[i] == 0 or not (open_ or needed[i]):
                continue
            here, gain = docs[depth : depth + chunk], gains[depth : depth + chunk]
            if not open_:
                keep = wanted[here]
                here, gain = here[keep], gain[keep]
            low[here] += gain  # a list holds a document once
            seen[i, here] = True
            met[here] = True
            ceiling[i] = gains[depth + chunk] if depth + chunk < len(gains) else 0
        depth, chunk = depth + chunk, 2 * chunk
        if open_:
            alive = np.flatnonzero(met)
        lows = low[alive]
        bound = max(least, int(np.partition(lows, len(lows) - k)[len(lows) - k])) if len(lows) >= k else least
        highs = lows + ceiling.sum() - ceiling @ seen[:, alive]
        alive = alive[highs >= bound]
        if open_:
            met[:] = False
            met[alive] = True
            open_ = int(ceiling.sum()) >= bound
        if not open_ and not (ceiling[:, None] * ~seen[:, alive]).any():
            break
    order = np.lexsort((alive, -low[alive]))[:k]
    alive = alive[order]
    return alive, low[alive]


class _Best:
    """The best of a task for each item, so far."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(items)]

    def least(self, item: int) -> int:
        scores = self.held[item][1]
        return int(scores[-1]) if len(scores) == self.k else 1

    def add(self, item: int, ids: np.ndarray, none: np.ndarray, scores: np.ndarray) -> None:
        old = self.held[item]
        ids, scores, none = (np.concatenate(x) for x in ((old[0], ids), (old[1], scores), (old[2], none)))
        order = np.lexsort((ids, ~none, -scores))[: self.k]
        self.held[item] = ids[order], scores[order], none[order]

    def table(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.held), dtype=np.int32), [len(h[0]) for h in self.held])
        ids, scores, none = (np.concatenate([h[j] for h in self.held]) if self.held else np.empty(0, np.int64) for j in range(3))
        return pa.record_batch([pa.array(item), pa.array(ids, pa.int64(), mask=none.astype(bool)), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])


def _find(counted: DataFrame, items: list[list[tuple[int, int]]], docs: int, total: int, k: int) -> DataFrame:
    """``item, doc_id, score``: the ``k`` best for each item (its terms' numbers and worth), from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(items), k)

        def search(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table["doc_id"].combine_chunks()
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            order = np.lexsort((ids, ~none))  # by id, those without one first: ties go by it
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            term, tf = (table[c].combine_chunks() for c in ("term", "tf"))
            doc = np.repeat(number, np.diff(term.offsets.to_numpy()))
            m = 75 + 25 * table["n"].to_numpy() * docs // total
            size = np.repeat(m, np.diff(term.offsets.to_numpy()))
            tfs = tf.flatten().to_numpy().astype(np.int64)
            shard = Shard(ids[order], doc, term.flatten().to_numpy(), 1_000_000_000 * tfs // (1000 * tfs + 12 * size))
            for item, asked in enumerate(items):
                found, scores = read(shard, asked, k, best.least(item))
                if len(found):
                    best.add(item, shard.doc_ids[found], none[order][found], scores)

        held, rows, places = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a shard ends before it holds too much, but for one document alone
                sizes = np.cumsum(np.diff(batch.column("term").slice(at).offsets.to_numpy()))
                take = min(SHARD_DOCS - rows, max(int(np.searchsorted(sizes, SHARD_PLACES - places, "right")), not rows))
                if take:
                    piece = batch.slice(at, take)
                    held.append(piece)
                    rows, places, at = rows + piece.num_rows, places + int(sizes[piece.num_rows - 1]), at + piece.num_rows
                if at < batch.num_rows:
                    search(held)
                    held, rows, places = [], 0, 0
        if held:
            search(held)
        yield best.table()

    return counted.mapInArrow(run, FOUND)


def _blocks(queries: list[tuple[int | None, bytes | None]]) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with their terms, in blocks; an item alone may be larger than a block."""
    block: list[tuple[int | None, Counter]] = []
    known: set[bytes] = set()
    for item, text in queries:
        found = Counter(terms(text or b""))
        if block and (len(block) == BLOCK_ITEMS or len(known | found.keys()) > BLOCK_TERMS):
            yield block
            block, known = [], set()
        block.append((item, found))
        known |= found.keys()
    if block:
        yield block


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring rows, highest first, scores above 0 only.

    A score sums, over the item's terms (repeats included), ``floor(1000 ln((2N+2)/(2df+1)))`` times
    ``(1000000000 tf) div (1000 tf + 12 m)`` with ``m = 75 + (25 n N) div L``; N: rows with a term, L: all their
    terms, n: the row's.  Equal scores go by ascending id, rows without an id first.  Texts that are null or
    have no term are never found; an item without terms, or of terms that no row holds, has no rows.
    Repeated rows are rows of their own and rank one after another, repeated items are answered
    each on its own (with equal ranks).  Empty tables give no rows.  Columns not named take no part.
    """
    spark = rows.sparkSession
    docs = rows.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("binary").alias("text"))
    out = None
    posed = queries.select(column(item_col).cast("long").alias("i"), column(text_col).cast("binary").alias("t"))
    # the stated queries come to the driver one partition at a time and go out again in blocks
    for block in _blocks((r["i"], bytes(r["t"]) if r["t"] is not None else None) for r in posed.toLocalIterator()):
        found = _search_block(spark, docs, block, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.withColumnRenamed("item_id", item_col).withColumnRenamed("doc_id", id_col) if (item_col, id_col) != ("item_id", "doc_id") else out


def _search_block(spark, docs: DataFrame, block: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    asked: dict[bytes, int] = {}
    for _, found in block:
        for term in found:
            asked.setdefault(term, len(asked))
    counted = stage(_counted(docs, asked), "nra-counted")
    held = F.col("n") > 0
    whole = counted.agg(F.count(F.when(held, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    weight = F.floor(1000 * F.log((2 * F.lit(whole["docs"]) + 2) / (2 * F.count("*") + 1))).cast("long")
    worth = {r["t"]: r["w"] for r in counted.select(F.explode("term").alias("t")).groupBy("t").agg(weight.alias("w")).collect()}  # a block's terms at most
    items = [[(asked[t], worth.get(asked[t], 0) * times) for t, times in found.items()] for _, found in block]
    best = _find(counted.where(F.size("term") > 0), items, whole["docs"], max(1, whole["total"]), k)
    by = lambda *part: Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    part = F.spark_partition_id() % PARTS
    some = best.withColumn("part", part).withColumn("rank", F.row_number().over(by("item", "part"))).where(F.col("rank") <= k)
    merged = some.withColumn("rank", F.row_number().over(by("item"))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], "item int, item_id long")
    return merged.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
