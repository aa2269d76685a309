"""Near-dedup by an LSH forest of MinHash signatures.

1. Texts become sets of word shingles and MinHash signatures.  Texts with one set are one class,
   which goes on as one vertex.
2. Forest: every tree orders the vertices by the signature's components in an order of its own.
   In each sorted order, vertices with long common prefixes are neighbours.  The depth adapts
   to the region: where more than ``REGION`` vertices share a prefix, candidates must share a
   longer one; on the way down to the end of the order the next neighbours are always taken.
   A candidate passes on if set sizes and a sketch of two bits a component don't rule out the
   threshold (more than 4.5 standard deviations below what the threshold gives).
3. Links are confirmed on full sets: first each vertex's best candidate; then, of the others, all
   whose ends are not in one component by then, so no candidate that could matter is left out.
4. Crowded regions, where prefixes of ``CROWDED`` components are shared by more than ``REGION``
   vertices, hide a vertex's one link behind many that are almost as near.  Regions that share a
   vertex make one crowd; in a crowd all pairs of different components are settled by the exact
   sizes of their sets' intersections, in blocks of bounded size that are dealt pair by pair.
5. Components of the confirmed links; their classes' documents follow.

A pair at the threshold shares the first ``d`` components of an order with probability
``0.8**d``; with 32 orders it shares none of the first 4 with probability ``(1 - 0.8**4)**32``, 5e-8,
however large its regions are.  (A region of ``REGION`` or fewer that the end of a sorted range cuts
counts in one order less: 8e-8.)  Pairs that are more alike, or linked by way of others, are safer still.
A crowd's work grows with the square of its vertices; what it sends and gives does with
their number times that of its blocks, and with its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import lent, slices, stage, word_groups
from strata.llm.components import _stars, components

SHINGLE = 5
PERCENT = 80
HASHES = 128
TREES = 32
DEPTH = 20
#: Vertices that may share a prefix before candidates must share more; neighbours that are always taken.
REGION = 12
NEIGHBOURS = 1
#: Crowded regions: the shared depth; a block's vertices, and bytes of its sets.
CROWDED = 4
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Shingles whose intersections are counted at once.
SLAB = 4096
#: Sketch components (of ``HASHES``) that must agree: 0.85 are expected to at the threshold.
AGREE = 90
FILTER_BITS = 22
_NO_ID = -(1 << 63)

_rng = np.random.default_rng(9)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_ORDERS = np.stack([np.random.default_rng(100 + t).permutation(HASHES)[:DEPTH] for t in range(TREES)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of ``size`` words, or of all if there are fewer."""
    for words, group in word_groups(texts, split):
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        for text in group:
            h = hashes[text]
            if not len(h):
                yield h
                continue
            n = min(size, len(h))
            out = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                out = (out ^ h[k : len(h) - n + 1 + k]) * _MIX
                out ^= out >> np.uint64(29)
            yield np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set (32 bits)."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 1024):
        values = (shingles[at : at + 1024, None] * _A + _B) >> np.uint64(32)
        np.minimum(best, values.min(axis=0), out=best)
    return best


def sketch(minima: np.ndarray) -> np.ndarray:
    """Two bits of each component, packed."""
    bits = np.stack([(minima >> np.uint64(8)) & np.uint64(1), (minima >> np.uint64(9)) & np.uint64(1)], axis=1)
    return np.packbits(bits.astype(np.uint8).ravel())


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                counts, digests, heads, sketches = [], [], [], []
                for s in shingle_sets(batch.column("text").to_pylist(), size):
                    counts.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    minima = signature(s)
                    heads.append(minima.astype(np.uint8).tobytes())
                    sketches.append(sketch(minima).tobytes())
                yield pa.record_batch(
                    {"doc": batch.column("doc"), "n": pa.array(counts, pa.int64()), "digest": pa.array(digests, pa.binary()), "head": pa.array(heads, pa.binary()), "sketch": pa.array(sketches, pa.binary())}
                )

    return run


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vertex once for each tree, with its sort key there."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            n = batch.num_rows
            head = np.frombuffer(b"".join(batch.column("head").to_pylist()), np.uint8).reshape(n, HASHES)
            keys = np.ascontiguousarray(head[:, _ORDERS].transpose(1, 0, 2)).reshape(TREES * n, DEPTH)
            again = np.tile(np.arange(n), TREES)
            rest = [c for c in ("component",) if c in batch.schema.names]
            yield pa.record_batch(
                {
                    "tree": np.repeat(np.arange(TREES, dtype=np.int32), n),
                    "key": pa.FixedSizeBinaryArray.from_buffers(pa.binary(DEPTH), TREES * n, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary()),
                    "vertex": batch.column("vertex").take(again),
                    "n": batch.column("n").take(again),
                    "sketch": batch.column("sketch").take(again),
                    **{c: batch.column(c).take(again) for c in rest},
                }
            )


def shared_prefix(tree: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many components each place shares with the next one; -1 at the end of a tree."""
    differs = key[1:] != key[:-1]
    prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), DEPTH)
    prefix[tree[1:] != tree[:-1]] = -1
    return prefix


def neighbours(tree: np.ndarray, key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of places in a sorted order; see the module's text, 2."""
    n = len(tree)
    if n < 2:
        return []
    prefix = shared_prefix(tree, key)
    common, at = prefix.copy(), []  # at[s]: the common prefix of i and i + s + 1
    for s in range(1, REGION + 1):
        at.append(common)
        common = np.minimum(common[:-1], prefix[s:]) if len(common) > 1 else common[:0]
    full = np.full(n, -1)  # the depth at which more than REGION share the place's prefix
    if n > REGION:
        full[: n - REGION] = at[REGION - 1]
        np.maximum(full[REGION:], at[REGION - 1], out=full[REGION:])
    out = []
    for s in range(1, REGION):
        if s >= n:
            break
        c = at[s - 1]
        near = c >= 0
        if s > NEIGHBOURS:
            near &= c > np.minimum(full[:-s], full[s:])
        i = np.flatnonzero(near)
        if len(i):
            out.append((i, i + s))
    return out


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many components two rows of sketches (as 64-bit words) agree in."""
    d = x ^ y
    d = (d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return HASHES - np.bitwise_count(d).sum(axis=1, dtype=np.int64)


def _rows(table: pa.Table) -> tuple[np.ndarray, ...]:
    tree, vertex, size = (table[c].to_numpy() for c in ("tree", "vertex", "n"))
    key = np.frombuffer(b"".join(table["key"].to_pylist()), np.uint8).reshape(-1, DEPTH)
    return tree, key, vertex, size, np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(vertex), -1)


def _chunked(found, rows_at_once: int, overlap: int):
    """``found`` over a sorted stream, some rows at a time; the last rows of each meet the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                held.append(batch.slice(at, rows_at_once))
                rows += held[-1].num_rows
                if rows >= rows_at_once + overlap:
                    table = pa.Table.from_batches(held).combine_chunks()
                    yield found(table)
                    held, rows = table.slice(table.num_rows - overlap).to_batches(), overlap
        if rows:
            yield found(pa.Table.from_batches(held).combine_chunks())

    return run


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of all sets in ``x`` with all in ``y``."""
    out = np.zeros((len(x), len(y)))
    (cx, ox), (cy, oy) = ((np.concatenate(z), np.repeat(np.arange(len(z)), [len(v) for v in z])) for z in (x, y))
    both = np.intersect1d(cx, cy)
    if not len(both):
        return out

    def numbered(c, o):
        at = np.minimum(np.searchsorted(both, c), len(both) - 1)
        known = both[at] == c
        at, o = at[known], o[known]
        order = np.argsort(at, kind="stable")
        return at[order], o[order], np.bincount(at, minlength=len(both))

    (px, ox, nx), (py, oy, ny) = numbered(cx, ox), numbered(cy, oy)
    common = nx * ny * 512 >= len(x) * len(y)  # shingles of many sets: by a matrix product; others: pair by pair
    of = np.cumsum(common) - 1
    for at in range(0, int(common.sum()), SLAB):
        width = min(SLAB, int(common.sum()) - at)
        parts = []
        for p, o, n in ((px, ox, len(x)), (py, oy, len(y))):
            here = common[p] & (of[p] >= at) & (of[p] < at + width)
            part = np.zeros((n, width), np.float32)
            part[o[here], of[p[here]] - at] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    rare = ~common[px]
    px, ox = px[rare], ox[rare]
    starts, times = (np.cumsum(ny) - ny)[px], ny[px]
    ends, at = np.cumsum(times), 0
    while at < len(px):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + (1 << 22), "right")))
        n = times[at:to]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        places = np.repeat(ox[at:to] * len(y), n) + oy[np.repeat(starts[at:to], n) + step]
        out += np.bincount(places, minlength=out.size).reshape(out.shape)
        at = to
    return out


def _settle(percent: int):
    """Components that links of two blocks of a crowd join: stars (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_numpy()
        x, y = (table.filter(pa.array(blocks == table[c][0].as_py())) for c in ("i", "j"))
        sets, names = zip(*(([np.frombuffer(v, np.uint64) for v in z["shingles"].to_pylist()], z["component"].to_numpy()) for z in (x, y)), strict=True)
        links = np.empty((0, 2), np.int64)
        if x.num_rows and y.num_rows and len(np.unique(np.concatenate(names))) > 1:
            both = overlaps(*sets)
            union = np.add.outer(*(np.array([len(v) for v in z], np.float64) for z in sets)) - both
            i, j = np.nonzero((100 * both >= percent * union) & (names[0][:, None] != names[1][None, :]))
            a, b = names[0][i], names[1][j]
            links = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.Table.from_batches(list(_stars(iter([pa.record_batch({"a": links[:, 0], "b": links[:, 1]})]))))

    return run


def _crowds(vertices: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` of components that links within crowds join; ``vertices`` have ``component``, too."""
    planted = vertices.select("vertex", "n", "head", "sketch", "component").mapInArrow(_plant, "tree int, key binary, vertex long, n long, sketch binary, component long")
    placed = planted.select("tree", F.substring("key", 1, CROWDED).alias("prefix"), "vertex", "component")
    regions = placed.groupBy("tree", "prefix").agg(F.count("*").alias("size"), F.min("vertex").alias("first"), F.min("component").alias("low"), F.max("component").alias("high"))
    regions = regions.where((F.col("size") > REGION) & (F.col("low") != F.col("high"))).select("tree", "prefix", "first")
    shared = placed.join(regions.hint("merge"), ["tree", "prefix"]).select(F.col("vertex").alias("a"), F.col("first").alias("b"))
    # a vertex's regions meet in one task, so that a task's stars are few
    crowd = stage(components(shared.repartition("a")).select("vertex", F.col("component").alias("crowd")), "crowds")
    members = vertices.select("vertex", "n", "component").join(crowd.hint("merge"), "vertex")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") * 8 / F.lit(BLOCK_BYTES)))
    crowds = members.groupBy("crowd").agg(blocks.cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("vertex", F.lit(1)), F.col("blocks"))
    dealt = members.join(crowds.hint("merge"), "crowd").select("crowd", "vertex", "component", own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vertex", "component")
    sets = _sets_of(docs, vertices, crowd.select("vertex"), size)
    return dealt.join(sets.hint("merge"), "vertex").drop("vertex").groupBy("crowd", "i", "j").applyInArrow(_settle(percent), "a long, b long")


def _pairs(percent: int):
    """Candidate pairs of a sorted range."""

    def found(table: pa.Table) -> pa.RecordBatch:
        tree, key, vertex, size, sketches = _rows(table)
        a, b, agree = [], [], []
        for i, j in neighbours(tree, key):
            possible = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
            i, j = i[possible], j[possible]
            same = agreement(sketches[i], sketches[j])
            close = same >= AGREE
            a.append(np.minimum(vertex[i[close]], vertex[j[close]]))
            b.append(np.maximum(vertex[i[close]], vertex[j[close]]))
            agree.append(same[close])
        a, b, agree = (np.concatenate([x, *y]) for x, y in zip((vertex[:0], vertex[:0], size[:0]), (a, b, agree), strict=True))
        pair, first = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)
        return pa.record_batch({"a": pair[:, 0], "b": pair[:, 1], "agree": agree[first].astype(np.int32)})

    return _chunked(found, 1 << 18, REGION)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets_of(docs: DataFrame, vertices: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``vertex, shingles`` of the wanted vertices, from their documents' whole texts.

    A filter of fixed size over the documents' ids keeps other texts from being shuffled.
    """
    named = stage(vertices.join(wanted, "vertex", "left_semi").select("vertex", "doc", "digest"), "wanted")
    slot = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slots in batch.column("slots").to_pylist():
                bits = np.zeros(4096, bool)
                bits[np.array(slots, np.int64) % 4096] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.record_batch({"part": batch.column("part"), "bits": pa.array(out, pa.binary())})

    parts = named.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 4096).alias("part")).agg(F.collect_set("slot").alias("slots"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for part, packed in parts.mapInArrow(pack, "part long, bits binary").collect():  # 1024 rows of 512 bytes at most
        bits[part * 512 : part * 512 + 512] = np.frombuffer(packed, np.uint8)
    shared = lent(docs.sparkSession, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.column("slot").to_numpy()
            whole = whole.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for batch in slices(whole, "text"):
                sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), size)]
                yield pa.record_batch({"doc": batch.column("doc"), "digest": pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), "shingles": pa.array(sets, pa.binary())})

    sets = docs.withColumn("slot", slot).mapInArrow(run, "doc long, digest binary, shingles binary")
    return stage(sets.join(named.hint("merge"), ["doc", "digest"]).dropDuplicates(["vertex"]).select("vertex", "shingles"), "sets")


def _confirmed(docs: DataFrame, vertices: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("vertex")).unionByName(pairs.select(F.col("b").alias("vertex"))).distinct()
    sets = _sets_of(docs, vertices, ends, size)
    x = sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    return stage(both.mapInArrow(_confirm(percent), "a long, b long"), "links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if ``100 * common >= percent * union`` for their sets of ``size``-word
    shingles (with fewer words, the whole sequence is the one shingle).  A text without words,
    empty or null has no shingle and is linked with nothing; its component is its own id.
    ``component_id`` is the smallest id reachable.  Rows that repeat an id are separate
    documents if their texts differ and link like all others; ``kept`` says that a row has its
    component's id, so all rows that repeat that id are kept.  A null id is never a
    component's name unless all ids there are null.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    signed = stage(rows.mapInArrow(_sign(size), "doc long, n long, digest binary, head binary, sketch binary"), "signed")
    some = signed.where("n > 0")
    first = [F.first(c).alias(c) for c in ("n", "head", "sketch")]
    classes = some.groupBy("digest").agg(F.min("doc").alias("doc"), F.min(F.when(F.col("doc") != _NO_ID, F.col("doc"))).alias("least"), *first)
    # a vertex's number is the hash of its digest: 64 bits tell vertices apart, sets tell texts apart
    vertices = stage(classes.withColumn("vertex", F.xxhash64("digest")), "vertices")
    planted = vertices.select("vertex", "n", "head", "sketch").mapInArrow(_plant, "tree int, key binary, vertex long, n long, sketch binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["tree", "key", "vertex"]
    forest = planted.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    near = forest.mapInArrow(_pairs(percent), "a long, b long, agree int")
    pairs = stage(near.groupBy("a", "b").agg(F.max("agree").alias("agree")), "pairs")
    best_of = lambda v, o: pairs.groupBy(F.col(v).alias("v")).agg(F.max(F.struct("agree", F.col(o).alias("o"))).alias("m")).select("v", "m.agree", "m.o")
    best = best_of("a", "b").unionByName(best_of("b", "a")).groupBy("v").agg(F.max(F.struct("agree", "o")).alias("m"))
    chosen = stage(best.select(F.least("v", "m.o").alias("a"), F.greatest("v", "m.o").alias("b")).distinct(), "chosen")
    links = _confirmed(rows, vertices, chosen, size, percent)
    joined = stage(components(links), "components")
    of = lambda v, c: joined.select(F.col("vertex").alias(v), F.col("component").alias(c))
    left = pairs.join(chosen, ["a", "b"], "left_anti").join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
    apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    left = stage(left.where(apart).select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "left")
    named = vertices.select("digest", "vertex", "least").join(joined, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    if not left.isEmpty():
        more = _confirmed(rows, vertices, left, size, percent)
        if not more.isEmpty():
            # these links join components, so only components are looked at again
            wider = components(left.join(more, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            wider = wider.select(F.col("vertex").alias("component"), F.col("component").alias("wider"))
            named = named.join(wider, "component", "left").withColumn("component", F.coalesce("wider", "component")).drop("wider")
    named = stage(named, "named")
    met = vertices.select("vertex", "digest", "doc", "n", "head", "sketch").join(named.select("vertex", "component"), "vertex")
    joins = stage(_crowds(met, rows, size, percent), "joins")
    if not joins.isEmpty():
        wider = components(joins)
        wider = wider.select(F.col("vertex").alias("component"), F.col("component").alias("wider"))
        named = stage(named.join(wider, "component", "left").withColumn("component", F.coalesce("wider", "component")).drop("wider"), "named")
    # written first, so that the skew join can split the classes of a large component
    names = stage(named.groupBy("component").agg(F.min("least").alias("component_id")), "names")
    by_digest = stage(named.join(names.hint("merge"), "component").select("digest", "component_id"), "names")
    own = F.when(F.col("doc") != _NO_ID, F.col("doc"))
    out = signed.select("doc", "n", "digest").join(by_digest.hint("merge"), "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(own)
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), own.eqNullSafe(component).alias("kept"))
