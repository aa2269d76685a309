"""Exact dedup by Grace hashing.

1. Every task normalises its texts and keeps one content record for each text it meets (an
   open-addressing table compares whole texts; rows with a text the table holds refer to its
   record).  A text that a third of all rows share thus moves once for each task.
2. Records are dealt to buckets by digest bits.  A bucket whose different texts would not fit
   the table is split again by further bits of the digest, and so on; this runs on sizes alone.
3. One shuffle brings each bucket's records together in order (Spark's shuffle and sort files
   are the spill files) and a table for each bucket compares complete contents: equal texts
   get one class, different texts with one digest get different ones.
4. Rows take their class from the record they refer to, a join on a key without hot values.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import slices, stage

#: Bytes of different texts that the table of a bucket, or of a task, may hold.
TABLE_BYTES = 48 << 20
#: A bucket that is too large is split into so many.
FANOUT = 16
_RUNS = re.compile("[\x20\x09-\x0d]{2,}|[\x09-\x0d]")


def normalise(text: str | None) -> str:
    """Each run of ASCII white space as one space; null as the empty text."""
    return _RUNS.sub(" ", text) if text else ""


class ContentTable:
    """Open addressing with linear probing; a slot is taken over only by an equal digest and text."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 64
        self.entries: list[tuple[bytes, str, object]] = []
        self.bytes = 0

    def put(self, digest: bytes, text: str, value: object) -> tuple[int, bool]:
        """The entry's number for a text, and whether it is new (then holding ``value``)."""
        if len(self.entries) * 2 >= len(self.slots):
            self.slots = [-1] * (len(self.slots) * 2)
            for n, (d, _, _) in enumerate(self.entries):
                self.slots[self._free(d)] = n
        mask = len(self.slots) - 1
        i = int.from_bytes(digest[8:16], "little") & mask
        while (n := self.slots[i]) >= 0:
            entry = self.entries[n]
            if entry[0] == digest and entry[1] == text:
                return n, False
            i = (i + 1) & mask
        self.slots[i] = len(self.entries)
        self.entries.append((digest, text, value))
        self.bytes += len(text) + 200
        return self.slots[i], True

    def _free(self, digest: bytes) -> int:
        mask = len(self.slots) - 1
        i = int.from_bytes(digest[8:16], "little") & mask
        while self.slots[i] >= 0:
            i = (i + 1) & mask
        return i


_RECORD = "row long, lead long, doc_id long, digest binary, size long, text string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a number of their own and that of the row that carries their text."""
    row, table = TaskContext.get().partitionId() << 40, ContentTable()
    for whole in batches:
        for batch in slices(whole, "text"):
            rows, leads, digests, sizes, texts = [], [], [], [], []
            for raw in batch.column("text").to_pylist():
                text = normalise(raw)
                data = text.encode()
                digest = hashlib.sha256(data).digest()
                if table.bytes > TABLE_BYTES:
                    table = ContentTable()
                entry, new = table.put(digest, text, row)
                rows.append(row)
                leads.append(table.entries[entry][2])
                digests.append(digest)
                sizes.append(len(data))
                texts.append(text if new else None)
                row += 1
            yield pa.record_batch(
                [pa.array(rows, pa.int64()), pa.array(leads, pa.int64()), batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(texts, pa.string())],
                names=["row", "lead", "doc_id", "digest", "size", "text"],
            )


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in bucket order -> the record that stands for each record's text (the first met)."""
    bucket, table = None, ContentTable()
    for whole in batches:
        for batch in slices(whole, "text"):
            out = []
            for b, digest, text, lead in zip(*(batch.column(c).to_pylist() for c in ("bucket", "digest", "text", "lead")), strict=True):
                if b != bucket:
                    bucket, table = b, ContentTable()
                entry, _ = table.put(digest, text, lead)
                out.append(table.entries[entry][2])
            yield pa.record_batch([batch.column("lead"), pa.array(out, pa.int64())], names=["lead", "class"])


def bucketed(rows: DataFrame, first: int, splits: list[DataFrame]) -> DataFrame:
    """``rows`` with the bucket of their digest: one of ``first``, and further bits in each bucket that ``splits`` names."""
    out = rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(first)).cast("string"))
    for level, large in enumerate(splits, 1):
        bits = F.pmod(F.xxhash64(F.lit(level), "digest"), F.lit(FANOUT)).cast("string")
        split = F.when(F.col("split"), F.concat_ws(".", "bucket", bits)).otherwise(F.col("bucket"))
        out = out.join(large.withColumn("split", F.lit(True)), "bucket", "left").withColumn("bucket", split).drop("split")
    return out


def split_buckets(records: DataFrame, limit: int = TABLE_BYTES) -> tuple[int, list[DataFrame]]:
    """How content records are dealt to buckets whose different texts fit ``limit``; see :func:`bucketed`.

    Only digests and sizes are read.  A bucket of one digest is never split.  The names of the
    oversized buckets, if there are any, are a table of their own for each round.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    first = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // max(1, limit // 2)))
    splits: list[DataFrame] = []
    while True:
        texts = bucketed(records.select("digest", "size"), first, splits).groupBy("bucket", "digest").agg(F.max("size").alias("size"))
        large = texts.groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        large = stage(large.where((F.col("size") > limit) & (F.col("n") > 1)).select("bucket"), "grace")
        if large.isEmpty():
            return first, splits
        splits.append(large)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after :func:`normalise`; null counts as empty, so all null
    and empty texts are one group.  Of equal texts the row with the smallest ``doc_id`` stays
    (a null id comes after all others); of rows that repeat that id too, the first read stays
    and the others are not ``kept``, though ``keep_id`` names their id.  Only the two named
    columns are read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(rows.mapInArrow(_records, _RECORD), "exact")
    records = rows.where(F.col("text").isNotNull())
    texts = bucketed(records.select("lead", "digest", "text"), *split_buckets(records, limit))
    dealt = texts.repartition("bucket").sortWithinPartitions("bucket", "digest")
    classes = stage(dealt.select("bucket", "digest", "text", "lead").mapInArrow(_classes, "lead long, class long"), "classes")
    own = rows.select("row", "lead", "doc_id", "digest").join(classes, "lead")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    groups = own.groupBy("class").agg(first.alias("first"), F.count("*").alias("group_size"))
    # A group's rows meet its one line by way of their records, so a large group is dealt out
    leads = classes.join(groups, "class").select("lead", "first", "group_size")
    return rows.select("row", "lead", "doc_id", "digest").join(leads, "lead").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
