"""Metadata mirror: the deployed source/table configuration as queryable tables."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from strata.config import read_source

SOURCES_SCHEMA = "source string, type string, ingestion_mode string, config_json string, git_sha string, deployed_at timestamp"
TABLES_SCHEMA = (
    "source string, table string, load_type string, keys array<string>, scd_type bigint, "
    "config_json string, git_sha string, deployed_at timestamp"
)


def mirror(spark: SparkSession, raw: Sequence[dict], git_sha: str = "unknown", deployed_at: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, tables) rows from the raw metadata dicts (one row per source / table)."""
    now = deployed_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    srcs, tabs = [], []
    for m in raw:
        s = read_source(m)
        srcs.append((s.name, s.type, s.mode, json.dumps(m["source"], sort_keys=True), git_sha, now))
        for t_raw, t in zip(m.get("tables", []), s.tables, strict=True):
            load_type = t_raw.get("load", {}).get("type", "full" if s.type == "sqlserver" else "files")
            tabs.append((s.name, t.name, load_type, list(t.keys), t.scd_type, json.dumps(t_raw, sort_keys=True), git_sha, now))
    return spark.createDataFrame(srcs, SOURCES_SCHEMA), spark.createDataFrame(tabs, TABLES_SCHEMA)


def publish(sources: DataFrame, tables: DataFrame, root: str) -> None:
    """Overwrite the mirror (data and schema)."""
    sources.write.mode("overwrite").parquet(f"{root}/sources")
    tables.write.mode("overwrite").parquet(f"{root}/tables")
