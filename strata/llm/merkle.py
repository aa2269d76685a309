"""Merkle manifest of a table: bitmap ranks give every row its leaf, slot arrays give the tree.

A row's leaf is the hash of its fields.  The leaves of a group (say, a language) ascend by id and
make a tree; the groups' roots, by name, make one more tree above them.  Leaves are not sorted
to find their places:

* Ids of a group are merged into a bitmap, kept as its non-empty words of 64 bits with the number
  of rows in each (combined within tasks before they are shuffled).
* A directory of counts lies above the words, 16 bits of the word's number to a step, so a step
  never sums more than 65,536 numbers, however ids are spread.
* A leaf's place is the directory's count below its word and the bits below its own.

Rows that share an id (or have none) are too many for their bits: the words that hold such rows
are known by their counts, and only their rows are put in order, by ranges, so that one id may
hold any part of the table.

Leaves then go to slots of arrays of ``SPAN`` neighbours, keyed by (group, place / SPAN).  An array is
reduced as a whole; what is left goes to slots again, until a group is one node.  Proofs come
down the same way: an array's own proof is joined to it once and extended for each slot.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import column, stage

#: Neighbours that one array reduces (a power of the fan-out next to it).
SPAN = 256
#: The word of rows without an id: before that of any id.
NO_ID = -(1 << 57) - 1


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: Sequence[Column]) -> Column:
    """The leaf of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, fields)).cast("binary"), 256))


def above(nodes: Sequence[bytes]) -> bytes:
    """The node (hex text) over a run of nodes."""
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def height(count: int, fanout: int) -> int:
    """Levels above ``count`` leaves."""
    levels = 0
    while count > 1:
        count, levels = -(-count // fanout), levels + 1
    return levels


def climb(nodes: list[bytes], levels: int, fanout: int) -> list[list[bytes]]:
    """The nodes and the ``levels`` above them, lowest first."""
    tree = [nodes]
    for _ in range(levels):
        low = tree[-1]
        tree.append([above(low[i : i + fanout]) for i in range(0, len(low), fanout)])
    return tree


def siblings(tree: list[list[bytes]], fanout: int, upper: bytes) -> list[bytes]:
    """For each lowest node the siblings on its way up, level by level, left to right, then ``upper`` (32 bytes a node)."""
    proofs = [upper] * len(tree[-1])
    for low in reversed(tree[:-1]):
        raw = [bytes.fromhex(n.decode()) for n in low]
        proofs = [b"".join([*raw[i // fanout * fanout : i], *raw[i + 1 : i // fanout * fanout + fanout], proofs[i // fanout]]) for i in range(len(low))]
    return proofs


def fold(node: bytes, place: int, count: int, proof: bytes, fanout: int = 2) -> tuple[bytes, bytes]:
    """The root over ``node`` (hex text), the ``place``-th of ``count``, by the siblings in ``proof``; and what is left of these."""
    while count > 1:
        start = place // fanout * fanout
        others = min(fanout, count - start) - 1
        run = [proof[32 * i : 32 * i + 32].hex().encode() for i in range(others)]
        node = above([*run[: place - start], node, *run[place - start :]])
        proof, place, count = proof[32 * others :], place // fanout, -(-count // fanout)
    return node, proof


def directory(leaves: DataFrame) -> DataFrame:
    """``__g, __word, bits, n, below, leaves``: each group's bitmap words, their rows, and the rows of words before them."""
    bit = F.expr("CASE WHEN __id IS NULL THEN 0L ELSE shiftleft(1L, CAST(__id & 63L AS INT)) END")
    steps = [leaves.groupBy("__g", "__word").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))]
    names = ["__word"]
    for step in range(3):  # counts by 16 more bits each; the last step has 2^10 numbers at most
        low = steps[-1].withColumn(f"__b{step}", F.shiftright(names[-1], 16))
        steps[-1] = low
        names.append(f"__b{step}")
        steps.append(low.groupBy("__g", names[-1]).agg(F.sum("n").alias("n")))
    whole = Window.partitionBy("__g")
    before = whole.orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)
    known = steps[-1].select("__g", names[-1], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("leaves"))
    for low, name, up in zip(reversed(steps[:-1]), reversed(names[:-1]), reversed(names[1:]), strict=True):
        before = Window.partitionBy("__g", up).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        inside = low.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
        known = inside.join(known, ["__g", up]).withColumn("base", F.col("base") + F.col("below")).drop("below", up)
        known = known if name == "__word" else known.drop("n")
    return known.withColumnRenamed("base", "below")


def _repeated(rows: DataFrame) -> DataFrame:
    """Places of rows in words with more rows than bits: by id, then leaf; rows are dealt by ranges, so no id is too large."""
    order = ["__g", "__word", "__id", "__leaf", "__row"]
    # a written table, since the ranges come from a sample
    dealt = stage(
        rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "merkle-repeated"
    )
    part = ["__g", "__word", "__part"]
    inside = F.row_number().over(Window.partitionBy(*part).orderBy("__id", "__leaf", "__row")) - 1
    sizes = dealt.groupBy(*part).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__g", "__word").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return dealt.withColumn("__at", inside).join(starts, part).withColumn("__place", F.col("below") + F.col("__start") + F.col("__at"))


def _places(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """``leaves`` with each row's ``__place`` in its group and the group's number of leaves, ``__count``;
    the leaves of the largest group, and the number of groups."""
    words = stage(directory(leaves), "merkle-directory")
    alone = F.bit_count("bits") == F.col("n")
    wanted = ["__g", "__id", "__leaf", "__other", F.col("leaves").alias("__count"), "__place"]
    rank = F.bit_count(F.expr("bits & ~shiftleft(-1L, CAST(__id & 63L AS INT))"))
    placed = leaves.join(words.where(alone), ["__g", "__word"]).withColumn("__place", F.col("below") + rank).select(*wanted)
    crowded = words.where(~alone)
    if not crowded.isEmpty():
        placed = placed.unionByName(_repeated(leaves.join(crowded, ["__g", "__word"])).select(*wanted))
    sizes = words.agg(F.max("leaves").alias("most"), F.count_distinct("__g").alias("groups")).first()
    return placed, sizes["most"] or 0, sizes["groups"]


PATHS = "__g string, __count long, __rank long, __groups long, subroot binary, root binary, __block long, proof binary, __id long, __leaf binary, __other binary"
ARRAYS = "__g string, __block long, __count long, ids array<long>, leaves binary, others array<binary>, root binary"


def _arrays(nodes: DataFrame, level: int, span: int, fanout: int) -> DataFrame:
    """Slot arrays of ``span`` neighbours at a level, each with the node above it; a written table.

    ``nodes``: ``__g, __place, __count`` (leaves of the group), ``__id, __leaf, __other``.
    """
    step = round(math.log(span, fanout))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in ("ids", "leaves", "others", "root")}
            for count, held in zip(batch.column("__count").to_pylist(), batch.column("held").to_pylist(), strict=True):
                slots: list = [None] * len(held)
                for x in held:
                    slots[x["slot"]] = x
                raw = [x["leaf"] for x in slots]
                levels = min(step, max(0, height(count, fanout) - level * step))
                top = climb([r.hex().encode() for r in raw], levels, fanout)[-1]
                out["ids"].append([x["id"] for x in slots])
                out["leaves"].append(b"".join(raw))
                out["others"].append([x["other"] for x in slots] if level == 0 else None)
                out["root"].append(bytes.fromhex(top[0].decode()))
            yield pa.record_batch(
                [
                    *(batch.column(n) for n in ("__g", "__block", "__count")),
                    pa.array(out["ids"], pa.list_(pa.int64())),
                    pa.array(out["leaves"], pa.binary()),
                    pa.array(out["others"], pa.list_(pa.binary())),
                    pa.array(out["root"], pa.binary()),
                ],
                names=["__g", "__block", "__count", "ids", "leaves", "others", "root"],
            )

    slot = F.struct(
        F.pmod("__place", F.lit(span)).cast("int").alias("slot"), F.col("__id").alias("id"), F.col("__leaf").alias("leaf"), F.col("__other").alias("other")
    )
    keyed = nodes.withColumn("__block", F.expr(f"__place div {span}"))
    held = keyed.groupBy("__g", "__block", "__count").agg(F.collect_list(slot).alias("held"))
    return stage(held.mapInArrow(run, ARRAYS), "merkle-arrays")


def _grow(nodes: DataFrame, most: int, span: int, fanout: int) -> list[DataFrame]:
    """The arrays of all levels over ``nodes``, lowest first; ``most``: leaves of the largest group."""
    levels, left = [], most
    while True:
        levels.append(_arrays(nodes, len(levels), span, fanout))
        left = -(-left // span)
        if left <= 1:
            return levels
        none = F.lit(None)
        nodes = levels[-1].select(
            "__g", F.col("__block").alias("__place"), "__count", none.cast("long").alias("__id"), F.col("root").alias("__leaf"), none.cast("binary").alias("__other")
        )


def _descend(paths: DataFrame, arrays: DataFrame, level: int, span: int, fanout: int) -> DataFrame:
    """``paths`` (``__g, __block, proof`` and more by group) taken one level down: a row for each slot."""
    step = round(math.log(span, fanout))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {n: one.column(n)[0].as_py() for n in ("__block", "__count", "ids", "leaves", "others", "proof")}
                size = len(row["ids"])
                raw = [row["leaves"][32 * j : 32 * j + 32] for j in range(size)]
                levels = min(step, max(0, height(row["__count"], fanout) - level * step))
                proofs = siblings(climb([r.hex().encode() for r in raw], levels, fanout), fanout, row["proof"])
                again = pa.array([0] * size)
                yield pa.record_batch(
                    [
                        *(one.column(n).take(again) for n in ("__g", "__count", "__rank", "__groups", "subroot", "root")),
                        pa.array([row["__block"] * span + j for j in range(size)], pa.int64()),
                        pa.array(proofs, pa.binary()),
                        pa.array(row["ids"], pa.int64()),
                        pa.array(raw, pa.binary()),
                        pa.array(row["others"] or [None] * size, pa.binary()),
                    ],
                    names=["__g", "__count", "__rank", "__groups", "subroot", "root", "__block", "proof", "__id", "__leaf", "__other"],
                )

    met = arrays.drop("root").join(paths.select("__g", "__block", "__rank", "__groups", "subroot", "root", "proof"), ["__g", "__block"])
    return met.mapInArrow(run, PATHS)


def _folded(rows: DataFrame, fanout: int) -> DataFrame:
    """``rows`` with the root that the other leaf (else the leaf) and the proof lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("__leaf", "__other", "__block", "__count", "__rank", "__groups", "proof")
        for batch in batches:
            found = []
            for leaf, other, place, count, rank, groups, proof in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                node, rest = fold((leaf if other is None else other).hex().encode(), place, count, proof, fanout)
                found.append(fold(node, rank, groups, rest, fanout)[0].decode())
            yield batch.append_column("folded", pa.array(found, pa.string()))

    return rows.mapInArrow(run, f"{PATHS}, folded string")


def manifest(
    rows: DataFrame, fields: Sequence[str], group_col: str, id_col: str, other: Mapping[str, Column] | None = None, tamper: Column | None = None, fanout: int = 2, span: int = SPAN
) -> DataFrame:
    """One row for each row of the table: its leaf and how it hangs in the tree.

    Columns: ``id_col``, ``group_col`` and ``__leaf`` (hex), ``__place`` (in the group, from 0), ``__leaves`` (of the
    group), ``__rank`` and ``__groups`` (of the group among groups), ``__subroot``, ``__root`` (hex), ``__proof``
    (siblings up to the root, 32 bytes each, level by level, left to right) and ``__folded``: the root
    that follows from the proof and the row's leaf, or, where ``tamper`` holds, the leaf of the row
    with the columns in ``other`` put in place.

    A null group is a group and comes first, others by their UTF-8 bytes.  Rows without an id
    come first in their group; rows that share an id are ordered by leaf (equal leaves are
    alike).  Each row is a leaf of its own, repeated rows too.  Fields may be null, empty or long; columns
    not named take no part.  An empty table has no rows.  Groups' roots (a row each) are
    numbered in one task; all else is dealt by id and place.
    """
    changed = {**{f: column(f) for f in fields}, **(other or {})}
    name = column(group_col).cast("string")
    leaves = rows.select(
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), name)).alias("__g"),
        column(id_col).cast("long").alias("__id"),
        leaf_hash([column(f) for f in fields]).alias("__leaf"),
        (F.when(F.coalesce(tamper, F.lit(False)), leaf_hash([changed[f] for f in fields])) if tamper is not None else F.lit(None).cast("binary")).alias("__other"),
    )
    leaves = stage(leaves.withColumn("__word", F.coalesce(F.shiftright("__id", 6), F.lit(NO_ID))), "merkle-leaves")
    span = fanout ** max(1, round(math.log(span, fanout)))
    placed, most, groups = _places(leaves)
    trees = _grow(placed, most, span, fanout)
    # the groups' tree: their roots are its leaves, in the order of names
    rank = (F.row_number().over(Window.orderBy("__g")) - 1).cast("long")
    subroots = stage(trees[-1].select("__g", F.col("root").alias("subroot"), rank.alias("__rank")), "merkle-subroots")
    number = F.lit(groups).cast("long")
    tops = _grow(
        subroots.select(
            F.lit("").alias("__g"), F.col("__rank").alias("__place"), number.alias("__count"), F.col("__rank").alias("__id"), F.col("subroot").alias("__leaf"), F.lit(None).cast("binary").alias("__other")
        ),
        groups,
        span,
        fanout,
    )
    zero, nothing = F.lit(0).cast("long"), F.lit(b"")
    paths = tops[-1].select("__g", "__block", zero.alias("__rank"), number.alias("__groups"), nothing.alias("subroot"), "root", nothing.alias("proof"))
    for level in reversed(range(len(tops))):
        paths = _descend(paths, tops[level], level, span, fanout)
    above_groups = paths.select(F.col("__block").alias("__rank"), "__groups", "root", "proof")
    paths = subroots.join(above_groups, "__rank").withColumn("__block", zero)
    for level in reversed(range(len(trees))):
        paths = _descend(paths, trees[level], level, span, fanout)
    told = _folded(paths, fanout)
    text = lambda c: F.lower(F.hex(c))
    return told.select(
        F.col("__id").cast(rows.schema[id_col].dataType).alias(id_col),
        F.when(F.col("__g") != "", F.expr("substring(__g, 2)")).cast(rows.schema[group_col].dataType).alias(group_col),
        text("__leaf").alias("__leaf"),
        F.col("__block").alias("__place"),
        F.col("__count").alias("__leaves"),
        "__rank",
        "__groups",
        text("subroot").alias("__subroot"),
        text("root").alias("__root"),
        F.col("proof").alias("__proof"),
        F.col("folded").alias("__folded"),
    )
