"""Successive full snapshots: comparison, change feed, SCD type 1 and type 2.

A snapshot holds each key at most once, so the key joins here cannot be skewed by a hot
key; NULL is treated as a key value (null-safe joins).  Each load is one full outer join
of the open versions with the new snapshot; given the open versions alone, it yields them and
what the load closes, so the cost of a load follows the current state, not the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.keys import END, START, as_ts, comparable, null_safe_eq
from strata.sources.schemas import aligned, merged
from strata.sources.tables import BUCKET


def _attrs(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _outer(old: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Full outer join on keys with prefixed columns ``o_*``/``s_*`` and presence flags."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("_o"))
    s = new.select(*[F.col(c).alias(f"s_{c}") for c in cols], F.lit(True).alias("_s"))
    cond = null_safe_eq([F.col(f"o_{k}") for k in keys], [F.col(f"s_{k}") for k in keys])
    return o.join(s, cond, "full_outer")


def _same(prefix_a: str, prefix_b: str, cols: Sequence[str]) -> Column:
    if not cols:
        return F.lit(True)
    return F.struct(*[F.col(f"{prefix_a}{c}") for c in cols]).eqNullSafe(F.struct(*[F.col(f"{prefix_b}{c}") for c in cols]))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None) -> DataFrame:
    """Keys that were inserted, updated or deleted between two snapshots.

    Columns: the keys and ``change`` (insert / update / delete); unchanged keys are left out.
    ``compare`` limits the columns whose difference counts as an update.
    """
    cols = [*keys, *[c for c in new.columns if c not in keys]]
    comp = list(compare) if compare is not None else [c for c in cols if c not in keys]
    j = _outer(old.select(*cols), new.select(*cols), keys, cols)
    has_o, has_s = F.col("_o").isNotNull(), F.col("_s").isNotNull()
    change = (
        F.when(~has_o, F.lit("insert"))
        .when(~has_s, F.lit("delete"))
        .when(~_same("o_", "s_", comp), F.lit("update"))
    )
    key_out = [F.when(has_s, F.col(f"s_{k}")).otherwise(F.col(f"o_{k}")).alias(k) for k in keys]
    return j.select(*key_out, change.alias("change")).where(F.col("change").isNotNull())


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str], version: int | Column) -> DataFrame:
    """Row-level change feed between two snapshots.

    One row per insert and delete, two per update (``update_preimage`` then
    ``update_postimage``), with ``_change_type`` and ``_commit_version``.
    """
    cols = [*keys, *[c for c in new.columns if c not in keys]]
    j = _outer(old.select(*cols), new.select(*cols), keys, cols)
    has_o, has_s = F.col("_o").isNotNull(), F.col("_s").isNotNull()
    updated = has_o & has_s & ~_same("o_", "s_", [c for c in cols if c not in keys])

    def image(prefix: str, kind: Column) -> Column:
        return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in cols], kind.alias("_change_type"))

    pre = F.when(has_o & ~has_s, image("o_", F.lit("delete"))).when(updated, image("o_", F.lit("update_preimage")))
    post = F.when(~has_o & has_s, image("s_", F.lit("insert"))).when(updated, image("s_", F.lit("update_postimage")))
    ver = version if isinstance(version, Column) else F.lit(version)
    rows = j.select(F.inline(F.filter(F.array(pre, post), lambda x: x.isNotNull())))
    return rows.withColumn("_commit_version", ver)


def scd1_from_snapshot(snapshot: DataFrame) -> DataFrame:
    """SCD type 1 from a full snapshot: upserts plus deletes leave exactly the snapshot."""
    return snapshot


def scd2_start(snapshot: DataFrame, at) -> DataFrame:
    """First load: every row opens a version at ``at``."""
    t = as_ts(at)
    return snapshot.select("*", t.alias(START), F.lit(None).cast(snapshot.select(t).schema[0].dataType).alias(END))


def scd2_apply_snapshot(
    state: DataFrame,
    snapshot: DataFrame,
    keys: Sequence[str],
    at,
    track_history_columns: Sequence[str] | None = None,
    co_partition: str | None = None,
) -> DataFrame:
    """Apply one snapshot taken at ``at`` to an SCD2 table.

    ``co_partition`` names a column present on both sides that is a function of the keys
    (the Silver bucket): both sides are hash-partitioned on it and it joins the keys in the
    join condition, so the one shuffle also leaves the output clustered for a bucketed write.

    Per key (full outer join of the open versions with the snapshot):
    unchanged -> stays open (untracked columns take the snapshot's values);
    tracked change -> closed at ``at`` and a new version opened at ``at``;
    missing from the snapshot -> closed at ``at`` (deleted);
    new key (or a key that returns after a deletion) -> opened at ``at``.
    """
    keys = list(keys)
    attrs = [c for c in _attrs(snapshot, keys) if c != co_partition]
    tracked = list(track_history_columns) if track_history_columns else attrs
    t = as_ts(at)
    cols = [*keys, *attrs]
    open_ = state.where(F.col(END).isNull())
    closed = state.where(F.col(END).isNotNull())
    if co_partition:
        cols = [*cols, co_partition]
        open_, snapshot = open_.repartition(F.col(co_partition)), snapshot.repartition(F.col(co_partition))

    o = open_.select(*[F.col(c).alias(f"o_{c}") for c in [*cols, START]], F.lit(True).alias("_o"))
    s = snapshot.select(*[F.col(c).alias(f"s_{c}") for c in cols], F.lit(True).alias("_s"))
    cond = null_safe_eq([F.col(f"o_{k}") for k in keys], [F.col(f"s_{k}") for k in keys])
    if co_partition:  # never NULL: plain equality keeps the join on the existing partitioning
        cond = (F.col(f"o_{co_partition}") == F.col(f"s_{co_partition}")) & cond
    j = o.join(s, cond, "full_outer")
    end_type = state.schema[END].dataType
    # the load time may be a scalar subquery: evaluate it once into a column
    j = j.withColumn("_t", t.cast(end_type))
    t = F.col("_t")
    has_o, has_s = F.col("_o").isNotNull(), F.col("_s").isNotNull()
    stays = has_o & has_s & _same("o_", "s_", tracked)
    closing = F.when(
        has_o & ~stays,
        F.struct(*[F.col(f"o_{c}").alias(c) for c in cols], F.col(f"o_{START}").alias(START), t.cast(end_type).alias(END)),
    )
    current = F.when(
        has_s,
        F.struct(
            *[F.col(f"s_{c}").alias(c) for c in cols],
            F.when(stays, F.col(f"o_{START}")).otherwise(t.cast(end_type)).alias(START),
            F.lit(None).cast(end_type).alias(END),
        ),
    )
    touched = j.select(F.inline(F.filter(F.array(closing, current), lambda x: x.isNotNull())))
    return closed.select(*cols, START, END).unionByName(touched)


def scd2_from_snapshots(
    snapshots: DataFrame,
    keys: Sequence[str],
    snapshot_col: str = "_snapshot_id",
    time_col: str = "_ingested_at",
    track_history_columns: Sequence[str] | None = None,
    loads: DataFrame | None = None,
) -> DataFrame:
    """SCD type 2 rebuilt at once from stacked snapshots.

    Same result as applying the snapshots one by one with :func:`scd2_apply_snapshot`.
    A key has at most one row per snapshot, so the per-key window holds at most N rows.
    ``loads`` (snapshot_col, time_col: the load log) lists every load, one row each; ids may
    have gaps.  Without it they are taken from the rows, and an empty snapshot is not seen.
    """
    keys = list(keys)
    attrs = [c for c in snapshots.columns if c not in (*keys, snapshot_col, time_col)]
    tracked = list(track_history_columns) if track_history_columns else attrs
    # one row per load, numbered in order: as small as the load log
    times = (loads if loads is not None else snapshots).groupBy(snapshot_col).agg(F.min(time_col).alias("_at"))
    times = times.select(F.col(snapshot_col).alias("_load"), "_at", F.row_number().over(Window.orderBy(snapshot_col)).alias("_no"))
    numbered = snapshots.join(F.broadcast(times.select("_load", "_no")), F.col(snapshot_col) == F.col("_load"))
    w = Window.partitionBy(*keys).orderBy("_no")
    trk = F.struct(*[comparable(snapshots.schema[c].dataType, F.col(c)).alias(c) for c in tracked])
    prev = F.lag("_no").over(w)
    chg = F.when(prev.isNull() | (F.col("_no") - prev > 1), 1).when(trk.eqNullSafe(F.lag(trk).over(w)), 0).otherwise(1)
    flagged = numbered.withColumn("_chg", chg).withColumn(
        "_ver", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    versions = flagged.groupBy(*keys, "_ver").agg(
        F.min(time_col).alias(START),
        F.max("_no").alias("_last_no"),
        F.max_by(F.struct(*attrs), F.col("_no")).alias("_last"),
    )
    following = times.select((F.col("_no") - 1).alias("_prev_no"), F.col("_at").alias("_t"))
    ended = versions.join(F.broadcast(following), F.col("_last_no") == F.col("_prev_no"), "left")
    return ended.select(*keys, *[F.col("_last")[c].alias(c) for c in attrs], START, F.col("_t").alias(END))


def bucket_digests(rows: DataFrame, bucket: str = BUCKET) -> dict[str, list[int]]:
    """For each bucket its rows' count and two hashes over all their values that do not depend on their order.

    One aggregate, combined within tasks; a row for each bucket comes to the driver.  Equal
    digests mean equal rows but for a chance of some 2^-128.
    """
    cols = sorted(c for c in rows.columns if c != bucket)
    values = [comparable(rows.schema[c].dataType, F.col(c)) for c in cols]
    # a name beside each value: NULL leaves a hash as it is, so columns must not change places
    named = [x for c, v in zip(cols, values, strict=True) for x in (F.lit(c), v, v.isNull())]
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), *named)).alias(f"h{i}") for i in range(2)]
    found = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), *hashes).collect()
    return {str(r[bucket]): [r["n"], r["h0"], r["h1"]] for r in found}


def as_table(snapshot: DataFrame, table: T.StructType, keys: Sequence[str]) -> DataFrame:
    """A snapshot under the columns of the table that it is compared with.

    A column that the snapshot does not have any more is NULL from now on, a new one is added at
    the end, and one of another type takes the least type that holds both.  Key columns keep
    their type, since buckets go by it: a snapshot whose keys can't be cast to it fails.
    """
    have = {f.name: f.dataType for f in snapshot.schema.fields}
    for k in keys:
        want = table[k].dataType
        if have[k] != want:
            told = F.concat(F.lit(f"key {k} is not of the table's type {want.simpleString()}: "), F.col(k).cast("string"))
            cast = F.col(k).try_cast(want)
            # back again, so that no two keys become one
            same = cast.cast(have[k]).eqNullSafe(F.col(k))
            snapshot = snapshot.withColumn(k, F.when(same, cast).otherwise(F.raise_error(told).cast(want)))
    return aligned(snapshot, merged([table, snapshot.schema]))


def latest_snapshot(snapshots: DataFrame, snapshot_col: str = "_snapshot_id") -> DataFrame:
    """Rows of the newest snapshot (scalar subquery; prunes partitions when ``snapshot_col`` is one)."""
    newest = snapshots.agg(F.max(snapshot_col).alias("m"))
    return snapshots.where(F.col(snapshot_col) == newest.select("m").scalar())
