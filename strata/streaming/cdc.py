"""Applying change batches to a Silver table (the body of a ``foreachBatch``).

State is the stored change log (append-only) plus the Silver table.  A batch only
recomputes the keys it touches, from their whole stored history, so a late row (older
sequence than rows already applied) lands in the middle of the key's history and the
neighbouring versions are split or merged exactly as if all rows had come in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from strata.config import TableConfig
from strata.operators.keys import null_safe_eq
from strata.plans.silver import scd_from_changes


def _touched(df: DataFrame, batch: DataFrame, keys, how: str) -> DataFrame:
    marks = batch.select(*[batch[k].alias(f"_ak{i}") for i, k in enumerate(keys)]).distinct()
    cond = null_safe_eq([df[k] for k in keys], [marks[f"_ak{i}"] for i in range(len(keys))])
    return df.join(marks, cond, how)


def apply_changes_batch(
    log: DataFrame | None, state: DataFrame | None, batch: DataFrame, cfg: TableConfig, **kw
) -> tuple[DataFrame, DataFrame]:
    """Return (log after the batch, Silver after the batch) for cleaned, checked change rows.

    Keys outside the batch keep their Silver rows untouched (anti join); keys in the batch
    are rebuilt from the log (semi join).  AQE splits hot keys of the log side.
    """
    keys = list(cfg.keys)
    new_log = batch if log is None else log.unionByName(batch)
    if state is None:
        return new_log, scd_from_changes(new_log, cfg, **kw)
    rebuilt = scd_from_changes(_touched(new_log, batch, keys, "left_semi"), cfg, **kw)
    kept = _touched(state, batch, keys, "left_anti")
    return new_log, kept.unionByName(rebuilt)
