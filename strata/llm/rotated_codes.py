"""Near copies among vectors by binary codes of randomly rotated vectors.

A vector, scaled to length 1 and turned at random, is kept as the signs of its components (the
code) with one correction factor: the inner product of the vector and its code.  With them the
inner product of any other vector and this one is estimated without bias: that with the code,
divided by the factor.  Two vectors at the threshold differ but little, so the error
comes only from what is at right angles between them, and the bound on it is narrow.  The
other vector travels as bytes, rounded up or down at random, which adds no bias either.

* Equal vectors of a label are one class with a count; only classes are compared.
* Classes of a label share a cell of a table if some further signs agree; a label with few
  classes is one cell.  More classes call for more signs to a cell and so for more tables: as
  many as leave a pair at the threshold apart with a probability of ``MISS``.
* In a cell, estimates and their bounds tell which pairs may reach the threshold.  Cells larger
  than a block are cut into blocks, and all pairs of blocks meet, each in its own group.
* Vectors that are in such a pair are asked for, once for each meeting, and all such pairs are
  computed again in doubles.  A pair counts in the first table in which it shares a cell.  A
  meeting hands in each vector's links as a count and a forest of edges, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.ann import hadamard
from strata.llm.common import column, stage
from strata.llm.components import components

#: Classes that a cell should hold on average, and at most in a meeting's block.
CELL, BLOCK = 4096, 1024
#: The probability that a pair at the threshold shares no cell, and the bounds' width in standard deviations.
MISS, EPSILON = 1e-6, 6.0
#: Components of a turned vector, at least: shorter ones are filled up with zeros.
LEAST_WIDTH = 64
#: Parts of a crowded cell's rows for the join with its number of blocks.
SALTS = 16
SEED = 12
#: Vectors that are turned at once.
TURN = 4096


def turned(unit: np.ndarray, rotation: int) -> np.ndarray:
    """Rows turned by three rounds of random signs and Hadamard transforms (each row by itself, so always alike)."""
    width = max(LEAST_WIDTH, 1 << max(0, unit.shape[1] - 1).bit_length())
    out = np.zeros((len(unit), width))
    out[:, : unit.shape[1]] = unit
    for signs in np.random.default_rng((SEED, rotation)).choice([-1.0, 1.0], size=(3, width)):
        out = hadamard(out * signs)
    return out


def units(v: Sequence[bytes], dim: int) -> np.ndarray:
    """Vectors (doubles, little-endian) scaled to length 1."""
    x = np.frombuffer(b"".join(v), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(unit: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The cell of each vector in each table: ``bits`` signs of rotations 1, 2, ... of it."""
    if not bits:
        return np.zeros((len(unit), tables), np.int64)
    signs, rotation = np.empty((len(unit), 0), bool), 1
    while signs.shape[1] < tables * bits:
        signs, rotation = np.concatenate([signs, turned(unit, rotation) >= 0], axis=1), rotation + 1
    return (signs[:, : tables * bits].reshape(len(unit), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def layout(classes: int, threshold: float, cell: int = CELL, miss: float = MISS) -> tuple[int, int]:
    """Signs to a cell, and tables, for a label of so many classes."""
    bits = max(0, math.ceil(math.log2(max(1, classes) / cell)))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if alike >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-alike)))


class Codes:
    """Codes, factors and byte vectors of unit vectors."""

    def __init__(self, signs: np.ndarray, factor: np.ndarray, rounded: np.ndarray, step: np.ndarray):
        self.signs, self.factor, self.rounded, self.step = signs, factor, rounded, step

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        x = turned(unit, 0)
        step = np.abs(x).max(axis=1) / 127
        up = np.random.default_rng(SEED).random(x.shape)
        rounded = np.clip(np.floor(x / step[:, None] + up), -127, 127).astype(np.int8)
        return cls(x >= 0, np.abs(x).sum(axis=1) / math.sqrt(x.shape[1]), rounded, step)

    def take(self, rows: np.ndarray) -> Codes:
        return Codes(self.signs[rows], self.factor[rows], self.rounded[rows], self.step[rows])

    def may_reach(self, other: Codes, threshold: float) -> np.ndarray:
        """For each vector of this (as bytes) and of the other (as code): whether the estimate plus its bound reaches the threshold."""
        width = self.signs.shape[1]
        product = self.rounded.astype(np.float32) @ np.where(other.signs, np.float32(1), np.float32(-1)).T
        estimate = product * self.step[:, None] / (math.sqrt(width) * other.factor[None, :])
        apart = math.sqrt(1 - threshold**2) * np.sqrt((1 / np.square(np.minimum(other.factor, 1)) - 1) / (width - 1))
        rounding = self.step[:, None] / (2 * other.factor[None, :])
        return estimate >= threshold - EPSILON * np.hypot(apart[None, :], rounding) - 1e-5


def _read(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, digest, v``: the vector as doubles and its digest, null where it can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, out = [], []
            for x in batch.column("x").to_pylist():
                data = None
                if x and None not in x:
                    y = np.array(x, "<f8") + 0.0  # one zero only
                    if np.isfinite(y).all() and y.any():
                        data = y.tobytes()
                out.append(data)
                digests.append(data and hashlib.blake2b(data, digest_size=16).digest())
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(digests, pa.binary()), pa.array(out, pa.binary())], names=["id", "label", "digest", "v"])

    named = rows.select(column(id_col).cast("long").alias("id"), column(label_col).cast("string").alias("label"), column(vector_col).cast("array<double>").alias("x"))
    return named.mapInArrow(run, "id long, label string, digest binary, v binary")


def _groups(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (not null)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for name in key:
            c = batch.column(name)
            new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            here = tuple(batch.column(name)[start].as_py() for name in key)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = here
    if held:
        yield pa.Table.from_batches(held)


CELL_KEY = ["label", "dim", "table", "cell"]
KEY = [*CELL_KEY, "first", "second"]


def _index(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``no, label, dim, code, factor, rounded, step, cells`` of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim in pc.unique(whole.column("dim")).to_pylist():
                alike = whole.filter(pc.equal(whole.column("dim"), dim))
                for at in range(0, alike.num_rows, TURN):
                    batch = alike.slice(at, TURN)
                    unit = units(batch.column("v").to_pylist(), dim)
                    codes = Codes.of(unit)
                    packed, rounded = np.packbits(codes.signs, axis=1), codes.rounded
                    yield pa.record_batch(
                        [
                            *(batch.column(n) for n in ("no", "label", "dim")),
                            pa.array([r.tobytes() for r in packed], pa.binary()),
                            pa.array(codes.factor, pa.float64()),
                            pa.array([r.tobytes() for r in rounded], pa.binary()),
                            pa.array(codes.step, pa.float64()),
                            pa.array(list(cells(unit, tables, bits)), pa.list_(pa.int64())),
                        ],
                        names=["no", "label", "dim", "code", "factor", "rounded", "step", "cells"],
                    )

    return classes.mapInArrow(run, "no long, label string, dim int, code binary, factor double, rounded binary, step double, cells array<long>")


def _meetings(index: DataFrame, block: int) -> DataFrame:
    """The index by cell of each table, with the two blocks that meet and the one a class is in."""
    placed = index.select("no", "label", "dim", "code", "factor", "rounded", "step", F.posexplode("cells").alias("table", "cell"))
    sizes = placed.groupBy(*CELL_KEY).agg(F.count("*").alias("n")).where(F.col("n") > block)
    # a crowded cell's rows are dealt by salt to the join with its number of blocks
    crowded = stage(sizes.select(*CELL_KEY, F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "codes-crowded")
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("no"), F.lit(SALTS)).cast("int"))
    blocked = salted.join(crowded, [*CELL_KEY, "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocked = blocked.withColumn("mine", F.pmod(F.xxhash64("no", F.lit(1)), "blocks").cast("int"))
    each = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.drop("blocks", "salt").withColumn("first", F.least("mine", "other")).withColumn("second", F.greatest("mine", "other")).drop("other")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a meeting's two blocks (twice the same if a block meets itself)."""
    mine = table["mine"].to_numpy()
    return np.flatnonzero(mine == table["first"][0].as_py()), np.flatnonzero(mine == table["second"][0].as_py())


def _asked(meetings: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Classes that, in a meeting, may be in a pair at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, KEY):
            n = group.num_rows
            if n < 2:
                continue
            rounded = np.frombuffer(b"".join(group["rounded"].to_pylist()), np.int8).reshape(n, -1)
            signs = np.unpackbits(np.frombuffer(b"".join(group["code"].to_pylist()), np.uint8).reshape(n, -1), axis=1)[:, : rounded.shape[1]].astype(bool)
            codes = Codes(signs, group["factor"].to_numpy(), rounded, group["step"].to_numpy())
            left, right = _sides(group)
            may = codes.take(left).may_reach(codes.take(right), threshold)
            if len(left) == len(right) and (left == right).all():
                np.fill_diagonal(may, False)
            wanted = np.zeros(n, bool)
            wanted[left[may.any(axis=1)]] = True
            wanted[right[may.any(axis=0)]] = True
            if wanted.any():
                yield from group.select([*KEY, "no", "mine"]).filter(pa.array(wanted)).combine_chunks().to_batches()

    dealt = meetings.repartition(parts, *KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(run, "label string, dim int, table int, cell long, first int, second int, no long, mine int")


def _parts_of(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row of its component."""
    top = np.full(len(near), -1)
    for start in range(len(near)):
        if top[start] < 0:
            top[start] = start
            edge = np.array([start])
            while len(edge):
                edge = np.flatnonzero(near[edge].any(axis=0) & (top < 0))
                top[edge] = start
    return top


def _linked(asked: DataFrame, classes: DataFrame, threshold: float, bits: int, tables: int, parts: int) -> DataFrame:
    """``no, gain, root``: from each meeting its classes' links (rows, not classes) and an edge of its forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, KEY):
            if group.num_rows < 2:
                continue
            dim, table = group["dim"][0].as_py(), group["table"][0].as_py()
            unit, no, size = units(group["v"].to_pylist(), dim), group["no"].to_numpy(), group["size"].to_numpy()
            left, right = _sides(group)
            near = unit[left] @ unit[right].T >= threshold
            if alone := len(left) == len(right) and bool((left == right).all()):
                np.fill_diagonal(near, False)
            if table and near.any():  # a pair counts in the first table where it shares a cell
                a, b = np.nonzero(near)
                held = cells(unit, table, bits)
                again = np.zeros(len(a), bool)
                for t in range(table):
                    again |= held[left[a], t] == held[right[b], t]
                near[a[again], b[again]] = False
            gain = np.zeros(len(no), np.int64)
            gain[left] += near @ size[right]
            if not alone:
                gain[right] += near.T @ size[left]
            whole = np.zeros((len(no), len(no)), bool)
            whole[np.ix_(left, right)] = near
            whole |= whole.T
            used = np.flatnonzero(gain)
            if len(used):
                top = _parts_of(whole)
                yield pa.record_batch({"no": no[used], "gain": gain[used], "root": no[top[used]]})

    met = asked.join(classes.select("no", "v", "size"), "no").repartition(parts, *KEY).sortWithinPartitions(*KEY)
    return met.mapInArrow(run, "no long, gain long, root long")


def near_vectors(
    rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL, block: int = BLOCK
) -> DataFrame:
    """The rows' ids with ``__n_links``, ``__component`` and ``__kept``, a row for each row.

    Rows of one label (not null) whose vectors have a cosine of ``threshold`` or more, in doubles, are linked.
    ``__n_links`` counts the rows linked directly, copies too; ``__component`` is the smallest id reachable
    (null if no row there has an id); ``__kept``: the row's id is that one.  Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without a label, link with nothing, nor do
    vectors of different lengths.  Repeated rows are rows of their own.  An empty table gives no rows;
    columns not named take no part.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = _read(rows, id_col, vector_col, label_col)
    usable = F.col("digest").isNotNull() & F.col("label").isNotNull()
    grouped = read.where(usable).groupBy("label", "digest").agg(F.count("*").alias("size"), F.min("id").alias("id"), F.first("v").alias("v"))
    classes = stage(grouped.select(F.monotonically_increasing_id().alias("no"), "*", F.expr("CAST(octet_length(v) / 8 AS INT)").alias("dim")), "codes-classes")
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = layout(most, threshold, cell)
    index = stage(_index(classes, bits, tables), "codes-index")
    asked = _asked(_meetings(index, block), threshold, parts)
    linked = stage(_linked(asked, classes, threshold, bits, tables, parts), "codes-links")
    gains = linked.groupBy("no").agg(F.sum("gain").alias("gain"))
    reached = components(linked.select(F.col("no").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"vertex": "no", "component": "top"})
    joined = classes.select("no", "label", "digest", "size", "id").join(gains, "no", "left").join(reached, "no", "left").withColumn("top", F.coalesce("top", "no"))
    least = joined.groupBy("top").agg(F.min("id").alias("least"))
    links: Column = F.coalesce("gain", F.lit(0)) + F.col("size") - 1
    told = joined.join(least, "top").select("label", "digest", links.alias("links"), "least")
    out = read.drop("v").join(told, ["label", "digest"], "left")
    component = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("least"))
    kind = rows.schema[id_col].dataType
    return out.select(
        F.col("id").cast(kind).alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("__n_links"),
        component.cast(kind).alias("__component"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("__kept"),
    )
