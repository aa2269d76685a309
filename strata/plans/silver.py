"""Silver: raw Bronze rows -> cleaned, checked rows -> SCD table (lazy DataFrame plans).

Order of steps (both paths): transforms first, then expectations on the cleaned values,
then the SCD step.  Consequence on the snapshot path: a row that turns invalid leaves the
compared snapshot, so the SCD step treats its key as deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import TableConfig
from strata.operators.changes import dedupe_key_seq, scd1_from_changes, scd2_from_changes
from strata.operators.quality import CheckedFrame, check
from strata.operators.snapshots import scd2_apply_snapshot, scd2_from_snapshots, scd2_start
from strata.operators.transforms import TECH_COLUMNS, apply_transforms, drop_if_present

SNAPSHOT_ID = "_snapshot_id"
STREAM_EXCEPT = ("_file_path", "_ingested_at")
DEFAULT_SEQUENCE = "_file_modification_time"


def snapshot_view(bronze_snapshot: DataFrame, cfg: TableConfig, observe: bool = False) -> CheckedFrame:
    """One Bronze snapshot cleaned and checked (technical columns dropped before comparing)."""
    df = drop_if_present(bronze_snapshot, [*TECH_COLUMNS, SNAPSHOT_ID])
    return check(apply_transforms(df, cfg), cfg, observe=observe)


def snapshots_view(bronze: DataFrame, cfg: TableConfig, observe: bool = False) -> CheckedFrame:
    """All Bronze snapshots at once, cleaned and checked, keeping ``_snapshot_id``/``_ingested_at``."""
    df = drop_if_present(bronze, ["_file_path", "_file_modification_time"])
    return check(apply_transforms(df, cfg), cfg, observe=observe)


def changes_view(bronze_rows: DataFrame, cfg: TableConfig, observe: bool = False, cluster_by: str | None = None) -> CheckedFrame:
    """Change rows: exact (key, sequence) duplicates removed on the raw key, then cleaned and checked.

    ``cluster_by`` (a column derived from the cleaned key, e.g. the Silver bucket) is carried
    through.  Copies are combined where they lie before the shuffle, and the shuffle deals rows
    by key and sequence, so neither copies nor a long history of one key meet in one task here.
    """
    seq = cfg.sequence_by or DEFAULT_SEQUENCE
    deduped = dedupe_key_seq(bronze_rows, list(cfg.keys), seq, extra_group=[cluster_by] if cluster_by else ())
    return check(apply_transforms(deduped, cfg), cfg, observe=observe)


def scd_from_changes(changes: DataFrame, cfg: TableConfig, cluster_by: str | None = None, clustered: bool = False, **kw) -> DataFrame:
    """SCD1 or SCD2 from cleaned change rows (duplicates after cleaning resolved again)."""
    seq = cfg.sequence_by or DEFAULT_SEQUENCE
    if cfg.scd_type == 1:
        return scd1_from_changes(changes, cfg.keys, seq, STREAM_EXCEPT, cfg.deletes, cluster_by=cluster_by)
    return scd2_from_changes(
        changes, cfg.keys, seq, cfg.history, STREAM_EXCEPT, apply_as_deletes=cfg.deletes, cluster_by=cluster_by, clustered=clustered, **kw
    )


def silver_from_snapshots(
    bronze: DataFrame, cfg: TableConfig, snapshot_ids, *, incremental: bool = True, loads: DataFrame | None = None
) -> DataFrame:
    """Silver after loading the given snapshots of a stacked Bronze table.

    SCD1: the newest cleaned snapshot.  SCD2: applied load by load (``incremental``) or
    rebuilt at once from all snapshots; both give the same table.  ``loads``: the load log (id
    and time); with it the rebuild does not look for load times in the rows.
    """
    ids = sorted(snapshot_ids)
    if cfg.scd_type == 1:
        return snapshot_view(bronze.where(F.col(SNAPSHOT_ID) == ids[-1]), cfg).df
    if not incremental:
        stacked = snapshots_view(bronze.where(F.col(SNAPSHOT_ID).isin(ids)), cfg).df
        return scd2_from_snapshots(stacked, cfg.keys, SNAPSHOT_ID, "_ingested_at", cfg.history, loads)
    state = None
    for i in ids:
        snap = bronze.where(F.col(SNAPSHOT_ID) == i)
        view = snapshot_view(snap, cfg).df
        # the snapshot's load time as a scalar subquery: lazy, and keeps the column's type
        t = snap.agg(F.min("_ingested_at")).scalar()
        state = scd2_start(view, t) if state is None else scd2_apply_snapshot(state, view, cfg.keys, t, cfg.history)
    return state
