"""Line dedup by range-partitioned hashes.

Lines become (128-bit hash, document, position) rows, range-partitioned and sorted by hash,
then by document from the largest down, then by position.  Ranges end between documents of one
hash too, so a line that a third of the documents hold spreads over many tasks.  Each task
streams its range: the first document of a hash keeps the line, the others lose it once a
third document has shown up.  Only the first and last hash of a task may go on next door; for
these it leaves a boundary record (hash, documents, largest document) and open rows, which the
sum of the boundary records decides.  The result is a compressed keep bitmap for each document
that loses lines; no text is moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import column, map_beside, slices, stage

MIN_CHARS = 20
MIN_DOCS = 3
_STRIP = b" \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> tuple[int, list[int], list[bytes]]:
    """The number of lines, and position and key hash of those whose key is long enough."""
    if not text:
        return 1, [], []
    places, hashes = [], []
    lines = text.encode().lower().split(b"\n")  # bytes.lower changes A-Z only
    for i, line in enumerate(lines):
        key = line.strip(_STRIP)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            places.append(i)
            hashes.append(xxhash.xxh3_128_digest(key))
    return len(lines), places, hashes


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                places, hashes, counts, lines = [], [], [], []
                for text in batch.column("text").to_pylist():
                    n, p, h = line_keys(text, min_chars)
                    places += p
                    hashes += h
                    counts.append(len(p))
                    lines.append(n)
                pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                doc, row = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in ("doc", "text_hash"))
                yield pa.record_batch(
                    {"hi": pair[:, 0], "lo": pair[:, 1], "doc": doc, "pos": np.array(places, np.int32), "text_hash": row, "n_lines": np.repeat(np.array(lines, np.int32), counts)}
                )

    return run


_LOST, _OPEN, _BOUNDARY = 0, 1, 2
_STREAMED = "kind int, hi long, lo long, doc long, pos int, text_hash long, n_lines int"


def _stream(min_docs: int):
    """Streams one sorted range.  Holds back lines of fewer than ``min_docs`` documents at most.

    Yields lines that are lost, lines of the range's first and last hash that are still open,
    and for these hashes a boundary record (``doc``: the largest document, ``pos``: documents).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        first = key = top = last = None
        docs, held = 0, []
        for batch in batches:
            for hi, lo, *line in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "doc", "pos", "text_hash", "n_lines")), strict=True):
                doc = line[0]
                if key != (hi, lo):
                    if key is not None and key == first:
                        out.append((_BOUNDARY, *key, top, docs, 0, 0))
                    key, top, last, docs, held = (hi, lo), doc, doc, 1, []
                    first = first or key
                elif doc != last:
                    last = doc
                    docs += 1
                    if docs == min_docs:
                        out += [(_LOST, *key, *h) for h in held]
                        held = []
                if key == first:
                    out.append((_OPEN, hi, lo, *line))
                elif doc != top:
                    if docs >= min_docs:
                        out.append((_LOST, hi, lo, *line))
                    else:
                        held.append(line)
            yield _batch(out)
            out = []
        if key is not None:
            yield _batch([*((_OPEN, *key, *h) for h in held), (_BOUNDARY, *key, top, docs, 0, 0)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    names = ["kind", "hi", "lo", "doc", "pos", "text_hash", "n_lines"]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for n, lost in zip(batch.column("n_lines").to_pylist(), batch.column("lost").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[lost] = False
            packed.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch({"doc": batch.column("doc"), "text_hash": batch.column("text_hash"), "keep": pa.array(packed, pa.binary())})


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, text_hash, keep`` for each document that loses lines.

    ``keep``: zlib-compressed bits, one for each line of the text, most significant first.
    ``text_hash`` tells rows apart that repeat a document id with another text; they count as
    one document.  Null ids are one document, smaller than all others.
    """
    spark = docs.sparkSession
    lines = stage(_named(docs, id_col, text_col).mapInArrow(_line_rows(min_chars), "hi long, lo long, doc long, pos int, text_hash long, n_lines int"), "lines")
    order = [F.col("hi"), F.col("lo"), F.col("doc").desc()]
    ranges = lines.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    streamed = stage(ranges.sortWithinPartitions(*order, "pos").mapInArrow(_stream(min_docs), _STREAMED), "streamed")
    # two boundary records a task at most, so this is as small as the list of tasks
    edges = streamed.where(F.col("kind") == _BOUNDARY).groupBy("hi", "lo").agg(F.sum("pos").alias("docs"), F.max("doc").alias("top"))
    opened = streamed.where(F.col("kind") == _OPEN).join(F.broadcast(edges), ["hi", "lo"])
    opened = opened.where((F.col("docs") >= min_docs) & (F.col("doc") != F.col("top")))
    columns = ["doc", "text_hash", "pos", "n_lines"]
    lost = streamed.where(F.col("kind") == _LOST).select(columns).unionByName(opened.select(columns))
    by_doc = lost.groupBy("doc", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("lost"))
    return by_doc.mapInArrow(_bitmaps, "doc long, text_hash long, keep binary")


def kept_text(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text without its lost lines, the number of lines, and how many are lost."""
    if keep is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    kept = [line for line, bit in zip(lines, bits.tolist(), strict=True) if bit]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "__text"):
            done = [kept_text(t, k) for t, k in zip(batch.column("__text").to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), strict=True)]
            rest = batch.schema.names[:-1]
            yield pa.record_batch(
                [*(batch.column(c) for c in rest), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
                names=[*rest, "__kept", "__n_lines", "__n_dropped"],
            )


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, and ``__kept`` (text), ``__n_lines``, ``__n_dropped``; names of its own don't clash."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    keyed = docs.select("*", F.coalesce(column(id_col).cast("long"), F.lit(_NO_ID)).alias("__doc"), F.xxhash64(text).alias("__hash"))
    found = bitmaps.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("keep").alias("__keep"))
    # sort-merge at any size: no size decides the plan, and the skew join can split it
    rows = keyed.join(found.hint("merge"), ["__doc", "__hash"], "left").select(*map(column, docs.columns), "__keep")
    added = {"__kept": "string", "__n_lines": "long", "__n_dropped": "long"}
    return map_beside(rows, {"__text": text}, _apply, added).drop("__keep")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of ``docs``: its columns, and ``__kept``, ``__n_lines``, ``__n_dropped``.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case.  Keys of
    at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their
    lines but those of the largest document.  A null or empty text is one empty line and stays
    as the empty text; a document may lose all its lines and stays too, empty.  An empty table
    gives no rows.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return drop_lines(docs, stage(keep_bitmaps(named, "id", "text", min_chars, min_docs), "bitmaps"), id_col, text_col)
