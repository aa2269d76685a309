"""Operations views: cost by day, recent job runs, failures per day, table profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.joins import validity_join
from strata.operators.quality import holds


def cost_by_day(usage: DataFrame, list_prices: DataFrame, project: str, env: str) -> DataFrame:
    """Usage and list cost per day and product for one project/env (tags in a map column).

    Each usage row is priced by the list-price range of its SKU that contains its start
    time (half-open, open end allowed).
    """
    tags = F.col("custom_tags")
    u = usage.where((tags["project"] == project) & (tags["env"] == env))
    j = validity_join(u, list_prices, ["sku_name"], "usage_start_time", "price_start_time", "price_end_time")
    return j.groupBy(F.col("f.usage_date").alias("usage_date"), F.col("f.billing_origin_product").alias("billing_origin_product"), F.col("f.custom_tags")["env"].alias("env")).agg(
        F.sum("f.usage_quantity").cast("decimal(22,2)").alias("dbus"),
        F.sum(F.col("f.usage_quantity") * F.col("r.pricing.default")).cast("decimal(38,6)").alias("list_cost"),
    )


def job_runs_recent(runs: DataFrame, jobs: DataFrame, as_of: str | None = None, days: int = 7) -> DataFrame:
    """Runs started in the ``days`` before ``as_of`` (default: today; a given date makes results repeat)."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    since = F.date_sub(day, days)
    r = runs.where(F.col("period_start_time") >= since)
    j = r.join(jobs, ["workspace_id", "job_id"])
    return j.select(
        F.col("name").alias("job_name"),
        "run_id",
        "period_start_time",
        "period_end_time",
        "result_state",
        F.timestamp_diff("SECOND", F.col("period_start_time"), F.col("period_end_time")).alias("duration_s"),
    )


def failures_by_day(runs: DataFrame, checked: DataFrame, day_col: str, rules: Mapping[str, str]) -> DataFrame:
    """Per day: runs, failed runs, and rule violations in a checked table.

    Two independent daily aggregates (one row per day each) joined on the day.
    """
    run_days = runs.groupBy(F.to_date("period_start_time").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("result_state") == "FAILED").alias("failed_runs")
    )
    bad = None
    for expr in rules.values():
        v = (~holds(expr)).cast("int")
        bad = v if bad is None else bad + v
    viol = checked.groupBy(F.col(day_col).alias("day")).agg(F.sum(bad).cast("bigint").alias("violations"))
    j = run_days.join(viol, "day", "full_outer")
    return j.select(
        "day",
        F.coalesce("runs", F.lit(0)).alias("runs"),
        F.coalesce("failed_runs", F.lit(0)).alias("failed_runs"),
        F.coalesce("violations", F.lit(0)).alias("violations"),
    )


def table_profile(df: DataFrame, columns: Sequence[str], ts_col: str) -> DataFrame:
    """Completeness and freshness in one pass: per column rows, nulls, null rate; latest timestamp."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max(ts_col).alias("_max_ts"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)],
    )
    per_col = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("nulls")) for i, c in enumerate(columns)]
    )
    return wide.select("_rows", "_max_ts", F.inline(per_col)).select(
        "column_name",
        F.col("_rows").alias("rows"),
        "nulls",
        F.try_divide(F.col("nulls").cast("double"), F.col("_rows")).alias("null_rate"),
        F.col("_max_ts").alias("max_ts"),
    )
