"""Metadata-driven column transforms and technical-column handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import Step, TableConfig
from strata.functions.cleaning import lookup, transform, with_function

#: Lineage columns added on ingestion.  Dropped before snapshots are compared (they change on
#: every load); on the change-stream path only the file path and load time are dropped.
TECH_COLUMNS = ("_ingested_at", "_file_path", "_file_modification_time")


def apply_transforms(df: DataFrame, cfg: TableConfig | Sequence[Step], table: str | None = None) -> DataFrame:
    """Replace columns in place, step by step in config order (a later step may reuse a column)."""
    steps = cfg.steps if isinstance(cfg, TableConfig) else tuple(cfg)
    name = table or (cfg.name if isinstance(cfg, TableConfig) else "table")
    for step in steps:
        if step.column not in df.columns:
            raise KeyError(f"{name}: transform {step.fn} targets missing column {step.column}")
        df = with_function(df, step.column, lookup(step.fn, table=name, column=step.column))
    return df


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def cleaned_key(cfg: TableConfig, key: str):
    """The key column as Silver will hold it: the configured transforms of that column, in order."""
    col = F.col(key)
    for step in cfg.steps:
        if step.column == key:
            col = transform(step.fn, col, table=cfg.name, column=key)
    return col
