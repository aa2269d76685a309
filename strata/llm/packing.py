"""Packing by concatenate and cut.

Pass one tokenizes every document once and writes its ids with the number of its input
partition and its place in that partition's stream (a running total kept by the task).  The
partition totals, one number each, are summed up in partition order; a document's place in the
one long concatenation is its partition's base plus its place in the partition.  Pass two cuts
at multiples of the window: a window that begins or ends inside a document gets a boundary
piece of it.  All sequences but the last are full.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import slices, stage, vocabulary_path

BYTE_BPE = "byte_bpe_50k"
WINDOW = 2048
SEPARATOR = 1
#: The split pattern of the vocabulary (a fixed value), without backtracking into letter runs.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def byte_bpe(name: str):
    """The byte-level vocabulary's ranks with its special token, from the installed files."""
    import json

    import tiktoken

    with open(vocabulary_path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(vocabulary_path(f"{name}.json"), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _ids(encoding, text: str | None) -> bytes:
    if not text:
        return b""
    return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, separator: int = SEPARATOR) -> DataFrame:
    """Pass one: ``doc_id``, ``part`` (input partition), ``start`` (tokens before it there), ``tokens``, ``ids``."""
    end = separator.to_bytes(4, "little")

    def run(batches):
        encoding, part, at = byte_bpe(vocabulary), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [_ids(encoding, t) + end for t in batch.column("text").to_pylist()]
                sizes = [len(i) // 4 for i in ids]
                starts = list(accumulate(sizes, initial=at))
                at = starts.pop()
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"),
                        "part": pa.array([part] * len(ids), pa.int32()),
                        "start": pa.array(starts, pa.int64()),
                        "tokens": pa.array(sizes, pa.int64()),
                        "ids": pa.array(ids, pa.binary()),
                    }
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part int, start long, tokens long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str = BYTE_BPE, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``start`` counts the document's ids before the piece, ``doc_tokens`` its ids with the
    separator.  A null or empty text is the separator alone.  Every input row is a document of its
    own, so repeated rows are packed each time; an empty table gives no rows.  Only the two
    named columns are read.

    The totals that meet on the driver are one number per input partition, so their count
    follows the number of tasks, not of documents.
    """
    spark = docs.sparkSession
    staged = stage(tokenize(docs, id_col, text_col, vocabulary, separator), "pack")
    totals = sorted(staged.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    bases = list(accumulate((r["n"] for r in totals), initial=0))
    base = spark.createDataFrame([(r["part"], b) for r, b in zip(totals, bases)], "part int, base long")
    placed = staged.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("start"))
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("tokens") - 1) / window)
    cut = placed.select("doc_id", "at", "tokens", "ids", F.explode(F.sequence(first, last)).alias("sequence_id"))
    begin = F.greatest(F.col("at"), F.col("sequence_id") * window)
    end = F.least(F.col("at") + F.col("tokens"), (F.col("sequence_id") + 1) * window)
    piece = cut.withColumns({"begin": begin, "length": end - begin})
    return piece.select(
        "doc_id",
        (F.col("begin") - F.col("at")).alias("start"),
        "length",
        F.substring("ids", ((F.col("begin") - F.col("at")) * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"),
        F.col("tokens").alias("doc_tokens"),
        "sequence_id",
        (F.col("begin") - F.col("sequence_id") * window).alias("offset"),
    )
