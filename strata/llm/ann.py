"""Approximate nearest neighbours by cross-polytope hashing.

Vectors, scaled to the unit sphere, are turned by pseudo-random rotations (three rounds of
random signs and a fast Hadamard transform); the hash is the nearest signed axis.  A table's
cell is the hash, or as many hashes as the number of vectors calls for.  Every vector is
in one cell of each table.  A query probes, in each table, the cells whose axes it is nearest
to, as many as a bounded sample of queries with exact answers shows to be needed.  What the
cells hold is ranked by the exact measure on the original vectors.

Where lengths differ, vectors get one more component that makes all equally long (queries: 0),
so the nearest on the sphere have the largest inner product.

A cell's vectors and its queries meet in blocks of bounded size, however many there are; home
cells go first and give each query a bound that its other cells' finds must reach.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import stage

TABLES = 4
#: Sampled queries with exact answers, and the part of these answers that the probed cells must hold.
SAMPLE = 128
TARGET = 0.97
#: Vectors a cell should hold on average; vectors and queries of a block.
CELL = 1000
BLOCK_POINTS, BLOCK_QUERIES = 8192, 1024
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (their length is a power of two), scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, width) / math.sqrt(width)


@lru_cache(maxsize=64)
def _signs(seed: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, width))


class Hasher:
    """Cells of vectors: ``tables`` of ``hashes`` rotations each, for vectors of ``dim`` components."""

    def __init__(self, dim: int, longest: float, lift: bool, tables: int, hashes: int, seed: int = SEED):
        self.dim, self.longest, self.lift, self.tables, self.hashes, self.seed = dim, longest, lift, tables, hashes, seed
        self.width = 1 << max(0, (dim + lift - 1).bit_length())

    def _sphere(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        length = np.linalg.norm(x, axis=1)
        out[:, : self.dim] = x / (length[:, None] if query or not self.lift else self.longest)
        if self.lift and not query:
            out[:, self.dim] = np.sqrt(np.maximum(0.0, 1 - (length / self.longest) ** 2))
        return out

    def _turned(self, unit: np.ndarray, table: int, hash_: int) -> np.ndarray:
        for signs in _signs(self.seed * 1_000_003 + table * 101 + hash_, self.width):
            unit = hadamard(unit * signs)
        return np.concatenate([unit, -unit], axis=1)  # by signed axis

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table."""
        unit, out = self._sphere(x, False), np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for h in range(self.hashes):
                out[:, t] = out[:, t] * (2 * self.width) + np.argmax(self._turned(unit, t, h), axis=1)
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """For each query and table the ``count`` cells whose axes lie nearest, nearest first."""
        unit, axes = self._sphere(x, True), 2 * self.width
        count = min(count, axes**self.hashes)
        out = np.empty((len(x), self.tables, count), np.int64)
        for t in range(self.tables):
            near, cell = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for h in range(self.hashes):
                turned = self._turned(unit, t, h)
                best = np.argsort(-turned, axis=1, kind="stable")[:, : min(count, axes)]
                near = (near[:, :, None] + np.take_along_axis(turned, best, 1)[:, None, :]).reshape(len(x), -1)
                cell = (cell[:, :, None] * axes + best[:, None, :]).reshape(len(x), -1)
                order = np.argsort(-near, axis=1, kind="stable")[:, :count]
                near, cell = np.take_along_axis(near, order, 1), np.take_along_axis(cell, order, 1)
            out[:, t] = cell
        return out


    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells of each table lie nearer to the query ``x`` than those in ``cells`` (a row of cells by table for each)."""
        unit, axes = self._sphere(x[None], True), 2 * self.width
        out = np.empty(cells.shape, np.int64)
        for t in range(self.tables):
            turned = [self._turned(unit, t, h)[0] for h in range(self.hashes)]
            near = np.zeros(len(cells))
            for h, c in enumerate(turned):  # a cell's number has its first axis in front
                near += c[cells[:, t] // axes ** (self.hashes - 1 - h) % axes]
            head, last = np.zeros(1), np.sort(turned[-1])
            for c in turned[:-1]:
                head = (head[:, None] + c[None, :]).ravel()
            for i, least in enumerate(near):
                out[i, t] = len(head) * axes - np.searchsorted(last, least + 1e-12 - head, "right").sum()
        return out


def _vectors(column) -> np.ndarray:
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(raw.to_pylist()), "<f8").reshape(len(raw), -1)


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` (little-endian doubles): not null, not zero, all components finite."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if i is not None and x and None not in x:
                    x = np.array(x, "<f8")
                    if np.isfinite(x).all() and x.any():
                        ids.append(i)
                        out.append(x.tobytes())
            yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "v": pa.array(out, pa.binary())})

    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return named.mapInArrow(run, "vec_id long, v binary")


def _best(points: pa.Table, queries: pa.Table, k: int) -> list[tuple[int, int, float]]:
    """The ``k`` best of the points for each query (none below its bound), by exact measure, then id.

    Points that share an id count once, with the best of their measures.
    """
    order = np.argsort(points["vec_id"].to_numpy(), kind="stable")
    ids, q_ids = points["vec_id"].to_numpy()[order], queries["query_id"].to_numpy()
    x, q, bound = _vectors(points["v"])[order], _vectors(queries["q"]), queries["bound"].to_numpy()
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    ends = np.append(starts[1:], len(ids))
    names, repeated = ids[starts], len(starts) < len(ids)
    out = []
    for a in range(0, len(q), 256):
        rough = q[a : a + 256] @ x.T
        if repeated:
            rough = np.maximum.reduceat(rough, starts, axis=1)
        rough[q_ids[a : a + 256, None] == names[None, :]] = -np.inf
        for i, row in enumerate(rough):
            least = bound[a + i] if len(row) <= k else max(bound[a + i], -np.partition(-row, k - 1)[k - 1])
            near = np.flatnonzero(row >= least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else row > -np.inf)
            counts = ends[near] - starts[near]
            firsts = np.cumsum(counts) - counts
            copies = np.repeat(starts[near] - firsts, counts) + np.arange(counts.sum())
            exact = np.einsum("ij,j->i", x[copies], q[a + i])
            exact = np.maximum.reduceat(exact, firsts) if len(near) else exact
            best = np.lexsort((names[near], -exact))[:k]
            out += [(int(q_ids[a + i]), int(n), float(s)) for n, s in zip(names[near][best], exact[best], strict=True)]
    return out


def _meet(points: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` from probed cells; a cell's points and queries are cut into blocks."""
    cell = ["table", "cell"]
    held = points.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK_POINTS).alias("p_blocks"))
    asked = probes.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("q_blocks"))
    sizes = held.join(asked, cell)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = points.join(sizes, cell).select(*cell, "vec_id", "v", block("vec_id", "p_blocks").alias("pb"), each("q_blocks").alias("qb"))
    posed = probes.join(sizes, cell).select(*cell, "query_id", "q", "bound", each("p_blocks").alias("pb"), block("query_id", "q_blocks").alias("qb"))
    key = [*cell, "pb", "qb"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _best(left, right, k) if left.num_rows and right.num_rows else []
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return dealt.groupBy(key).cogroup(posed.groupBy(key)).applyInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def _exact(points: DataFrame, queries: list[tuple[int, bytes]], k: int) -> dict[int, list[int]]:
    """Exact answers of a few queries, from all points."""
    posed = pa.table({"query_id": pa.array([q[0] for q in queries], pa.int64()), "q": pa.array([q[1] for q in queries], pa.binary()), "bound": pa.array([-np.inf] * len(queries))})

    def run(batches):
        for batch in batches:
            found = _best(pa.Table.from_batches([batch]), posed, k) if batch.num_rows else []
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    best = _top(points.mapInArrow(run, "query_id long, vec_id long, score double"), k)
    out: dict[int, list[int]] = {}
    for r in best.select("query_id", "vec_id").collect():
        out.setdefault(r[0], []).append(r[1])
    return out


def needed_probes(points: DataFrame, hasher: Hasher, sample: list[tuple[int, bytes]], k: int, target: float = TARGET) -> int:
    """The probes a table needs so that the cells hold the part ``target`` of the sample's exact answers."""
    answers = _exact(points, sample, k)
    wanted = sorted({v for a in answers.values() for v in a})  # at most SAMPLE * k
    if not wanted:
        return 1
    found = {r["vec_id"]: r["v"] for r in points.join(F.broadcast(points.sparkSession.createDataFrame([(v,) for v in wanted], "vec_id long")), "vec_id", "left_semi").collect()}
    vectors = lambda rows: np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    cell_of = dict(zip(found, hasher.cells(vectors(list(found.values()))), strict=True))
    ranks = []
    for query, v in sample:
        near = [cell_of[i] for i in answers.get(query, [])]
        ranks += hasher.ranks(vectors([v])[0], np.array(near)).min(axis=1).tolist() if near else []
    ranks.sort()
    return ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)] + 1


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, target: float = TARGET, hashes: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found by inner product, nearest first.

    Candidates are all rows but those with the query's own id; ties go to the smaller id.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do
    those without an id or of another length than most.  A row that repeats an id counts once,
    with the larger score.  Fewer rows than ``k``: all of them.  Empty tables give no rows.
    """
    spark = rows.sparkSession
    points, asked = stage(usable(rows, id_col, vector_col), "vectors"), stage(usable(queries, id_col, vector_col), "asked")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = points.groupBy(F.octet_length("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return empty
    of_length = F.octet_length("v") == lengths["n"]
    points, asked = points.where(of_length), asked.where(of_length)
    dim, total = lengths["n"] // 8, lengths["count"]

    def norms(batches):
        for batch in batches:
            if batch.num_rows:
                n = np.linalg.norm(_vectors(batch.column("v")), axis=1)
                yield pa.record_batch({"least": [n.min()], "most": [n.max()]})

    least, most = points.mapInArrow(norms, "least double, most double").agg(F.min("least"), F.max("most")).first()
    sample = [(r["vec_id"], r["v"]) for r in asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    if not sample:
        return empty
    axes = 2 << max(0, (dim - 1).bit_length())
    hashes = hashes or max(1, int(math.log(max(total / CELL, 1)) / math.log(axes)))
    hasher = Hasher(dim, most, least < most * (1 - 1e-4), tables, hashes)
    probes = needed_probes(points, hasher, sample, k, target)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                cells = hasher.cells(_vectors(batch.column("v")))
                again = np.repeat(np.arange(batch.num_rows), hasher.tables)
                yield pa.record_batch({"table": np.tile(np.arange(hasher.tables, dtype=np.int32), batch.num_rows), "cell": cells.ravel(), "vec_id": batch.column("vec_id").take(again), "v": batch.column("v").take(again)})

    def pose(batches):
        few = max(1, min(512, (1 << 22) // (probes * min(probes, axes))))  # queries whose cells are ranked at once
        for whole in batches:
            for a in range(0, whole.num_rows, few):
                batch = whole.slice(a, few)
                cells = hasher.probes(_vectors(batch.column("v")), probes)
                n, t, p = cells.shape
                again = np.repeat(np.arange(n), t * p)
                yield pa.record_batch({"table": np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n), "probe": np.tile(np.arange(p, dtype=np.int32), n * t), "cell": cells.ravel(), "query_id": batch.column("vec_id").take(again), "q": batch.column("v").take(again)})

    index = points.mapInArrow(place, "table int, cell long, vec_id long, v binary")
    posed = asked.dropDuplicates(["vec_id", "v"]).mapInArrow(pose, "table int, probe int, cell long, query_id long, q binary")
    home = posed.where("probe = 0").withColumn("bound", F.lit(float("-inf"))).drop("probe")
    first = stage(_top(_meet(index, home, k), k), "ann-home")
    bounds = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    rest = posed.where("probe > 0").drop("probe").join(bounds, "query_id", "left").fillna(float("-inf"), ["bound"])
    found = first.select("query_id", "vec_id", "score").unionByName(_meet(index, rest, k)) if probes > 1 else first
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
