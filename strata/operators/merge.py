"""Merging a batch of changes into a table that holds its history: only what the batch changes.

A batch meets each key's last row (the open version, or the row with which the key went) and
nothing else.  Keys whose changes all come after that row go on from it: the open version is
one more row before theirs.  Keys with a change at or before it are late.  A version keeps its last
row only, so late keys, and no others, are built anew from their stored changes, and their
earlier versions are made void.

The result is a layer for :meth:`strata.sources.tables.VersionedTable.write`: the open, closed, gone and void
rows of the batch's keys.  Keys that the batch does not name are neither rewritten nor shuffled
again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.config import TableConfig
from strata.operators.changes import DELETED, HOT_KEY_ROWS, scd1_from_changes, scd2_from_changes
from strata.operators.keys import END, START, null_safe_eq, on_keys
from strata.sources.schemas import aligned, merged
from strata.sources.tables import AREA, BUCKET, CLOSED, GONE, OPEN, VOID

_FROM, _GONE = "__from", "__gone"


def maybe_late(batch: DataFrame, seq: str, latest: Column) -> DataFrame:
    """Changes that may come at or before their key's last row: all but those after ``latest``, which no last row exceeds."""
    return batch.where(F.col(seq).isNull() | (F.col(seq) <= latest))


def late_keys(batch: DataFrame, state: DataFrame, keys: list[str], seq: str, ties_only: bool = False) -> DataFrame:
    """Keys of the batch with a change that does not come after the key's last row (NULL sequences come first).

    ``ties_only``: only those with a change of the very same sequence, for tables that keep the
    newest row and no history.  The batch's rows are combined by key before they meet the state.
    """
    order = F.struct(F.col(seq))
    if ties_only:
        rows = batch.select(*keys, F.col(seq).alias("_first")).distinct()
    else:
        rows = batch.groupBy(*keys).agg(F.min_by(F.col(seq), order).alias("_first"))
    known = state.select(*[F.col(k).alias(f"_mk{i}") for i, k in enumerate(keys)], F.col(seq).alias("_last"))
    met = rows.join(known, null_safe_eq([rows[k] for k in keys], [known[f"_mk{i}"] for i in range(len(keys))]))
    first, last = F.col("_first"), F.col("_last")
    late = first.eqNullSafe(last) if ties_only else first.isNull() | (last.isNotNull() & (first <= last))
    return met.where(F.coalesce(late, F.lit(False))).select(*keys)


def _areas(rows: DataFrame, scd_type: int) -> DataFrame:
    """Where versions go; what lies between two deletes is no version."""
    if scd_type == 1:
        return rows.withColumn(AREA, F.when(F.col(DELETED), F.lit(GONE)).otherwise(F.lit(OPEN))).drop(DELETED)
    over = F.col(END).isNotNull()
    rows = rows.where(~(F.col(DELETED) & over))
    area = F.when(over, F.lit(CLOSED)).when(F.col(DELETED), F.lit(GONE)).otherwise(F.lit(OPEN))
    return rows.withColumn(AREA, area).drop(DELETED)


def _build(rows: DataFrame, cfg: TableConfig, seq: str, drop: tuple[str, ...], few: bool, seeded: bool = False) -> DataFrame:
    deletes = F.expr(cfg.deletes) if cfg.deletes else None
    if seeded and deletes is not None:
        deletes = F.coalesce(F.col(_GONE), deletes)
    drop = (*drop, _GONE) if seeded else drop
    if cfg.scd_type == 1:
        built = scd1_from_changes(rows.drop(_FROM), cfg.keys, seq, drop, deletes, cluster_by=BUCKET, keep_deleted=True)
    else:
        starts = _FROM if seeded else None
        built = scd2_from_changes(
            rows, cfg.keys, seq, cfg.history, drop, apply_as_deletes=deletes, hot_key_rows=None if few else HOT_KEY_ROWS, cluster_by=BUCKET, starts=starts, keep_deleted=True
        )
    return _areas(built, cfg.scd_type)


def merge_changes(
    batch: DataFrame,
    early: DataFrame | None,
    known: T.StructType | None,
    last_rows: Callable[[DataFrame], DataFrame],
    late: DataFrame | None,
    history: DataFrame | None,
    cfg: TableConfig,
    seq: str,
    drop: tuple[str, ...] = (),
    few: bool = False,
    few_before: bool = False,
) -> DataFrame:
    """The layer that a batch of cleaned changes (with their bucket) adds to a table.

    ``early``: the changes that may not come after their key's last row (None: there are none).
    ``known``: the table's columns (None: a new table).  ``last_rows``: gives the last rows, with
    ``_area``, of the keys in a frame.  A table of the newest rows only looks at them for the keys of early
    changes; any other key's changes stand in its last row's place.  ``late``: the batch's late keys (None: there
    are none), with bucket; ``history``: their cleaned changes, the batch's included, with bucket.  ``few``: the
    batch, or the history (``few_before``), has too few rows for a hot key, so none is looked for.
    """
    if known is None:
        return _build(batch, cfg, seq, drop, few)
    keys = [BUCKET, *cfg.keys]
    not_late = lambda df: df if late is None else on_keys(df, late, keys, "left_anti")
    in_order = not_late(batch.drop(*drop))
    seeded = in_order if cfg.scd_type == 2 else None if early is None else not_late(early)
    data = merged([T.StructType([f for f in known.fields if f.name not in (START, END)]), in_order.schema])
    whole = T.StructType([*data.fields, T.StructField(_FROM, data[seq].dataType), T.StructField(_GONE, T.BooleanType())])
    rows = aligned(in_order, whole)
    if seeded is not None:
        seeds = last_rows(seeded.select(*keys).distinct())
        start = F.col(START) if cfg.scd_type == 2 else F.lit(None)
        rows = rows.unionByName(aligned(seeds.withColumns({_FROM: start, _GONE: F.col(AREA) == GONE}).drop(START, END, AREA), whole))
    out = _build(rows, cfg, seq, (), few, seeded=True)
    if late is None:
        return out
    anew = _build(history, cfg, seq, drop, few_before)
    out = out.unionByName(anew, allowMissingColumns=True)
    if cfg.scd_type == 1:
        return out
    return out.unionByName(late.select(*keys, F.lit(VOID).alias(AREA)), allowMissingColumns=True)
