"""Metadata-driven pipeline: for each configured table, source -> Bronze -> Silver.

``Lake`` names the folders (all under one shared root); ``run_snapshot_table`` and
``run_files_table`` compose the operators for the two kinds of source.  Every step is a
Spark job over whole tables; the driver only handles configuration, counters and the
version manifests.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.config import SourceConfig, TableConfig
from strata.operators.changes import assert_unique
from strata.operators.keys import END, START
from strata.operators.quality import ExpectationFailed, expectation_metrics
from strata.operators.snapshots import as_table, bucket_digests, scd2_apply_snapshot, scd2_start
from strata.operators.transforms import apply_transforms, cleaned_key
from strata.plans import gold
from strata.plans.silver import snapshot_view
from strata.session import sql_conf
from strata.sources import bronze as bz
from strata.sources.schemas import aligned
from strata.sources.tables import BUCKET, DEFAULT_BUCKETS, VersionedTable, bucket_of
from strata.streaming.ingest import apply_changes_stream, apply_loads, ingest_files


@dataclass
class Lake:
    spark: SparkSession
    root: str
    buckets: int = DEFAULT_BUCKETS

    def bronze_path(self, source: str, table: str) -> str:
        return f"{self.root}/bronze/{source}/{table}"

    def silver(self, source: str, cfg: TableConfig) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/silver/{source}/{cfg.name}", cfg.keys, self.buckets)

    def checkpoint(self, *parts: str) -> str:
        return "/".join([self.root, "_checkpoints", *parts])


def load_source_table(
    lake: Lake, source: SourceConfig, cfg: TableConfig, data: DataFrame, ingested_at=None, snapshot_id: int | None = None
) -> bz.LoadResult:
    """Full load: the whole source table becomes the next Bronze snapshot (or snapshot ``snapshot_id``)."""
    return bz.load_snapshot(lake.spark, data, lake.bronze_path(source.name, cfg.name), cfg.name, ingested_at, snapshot_id)


def run_snapshot_table(lake: Lake, source: SourceConfig, cfg: TableConfig, snapshot_id: int | None = None) -> dict:
    """Bring Silver up to one Bronze snapshot (default: the newest) and publish it.

    The load's time comes from the load log, so an empty snapshot ends all open versions like
    any other.  One pass over the snapshot counts the rules and digests its rows by bucket; a
    violated ``fail`` rule raises before anything is written.  Buckets whose digest is that of the
    load before hold the same rows and are neither joined nor written; in the others a key that
    the cleaned snapshot holds twice is refused.  Columns may come, go and widen between
    snapshots: see :func:`strata.operators.snapshots.as_table`.  Snapshots apply in id order; re-running an id at
    or below the last one applied is a no-op.
    """
    spark, path = lake.spark, lake.bronze_path(source.name, cfg.name)
    log = bz.loads(spark, path)
    sid = snapshot_id if snapshot_id is not None else max(log, default=0)
    if sid not in log:
        raise FileNotFoundError(f"{path}: no finished load" + (f" {snapshot_id}" if snapshot_id is not None else ""))
    silver = lake.silver(source.name, cfg)
    before = silver.manifest()
    if before and sid <= before["load"]:
        # already applied (a retried run): published versions are immutable, nothing to do
        return {"table": cfg.name, "version": before["version"], "skipped": True, "rules": {}}
    snap, at = bz.read_loads(spark, path, [sid]), log[sid]["at"]
    known = None if before is None else silver.schema()
    known = None if known is None else T.StructType([f for f in known.fields if f.name not in (START, END)])

    def view(observe: bool):
        checked = snapshot_view(snap, cfg, observe=observe)
        df = checked.df if known is None else as_table(checked.df, known, cfg.keys)
        return checked, silver.with_bucket(df)

    # one pass over the snapshot: rule counters, and what each bucket amounts to
    checked, counted = view(observe=True)
    digests = bucket_digests(counted)
    checked.raise_on_fail()
    old = (before or {}).get("digests") or {}
    # without digests to compare (a table dealt anew) every bucket counts as changed
    comparable = before is not None and (old or not before["rows"])
    changed = sorted(int(b) for b in {*old, *digests} if old.get(b) != digests.get(b)) if comparable else list(range(lake.buckets))
    version = silver.next_version()
    rows = view(observe=False)[1]
    rows = rows.where(F.col(BUCKET).isin(changed)) if len(changed) < lake.buckets else rows
    assert_unique(rows, [BUCKET, *cfg.keys], table=cfg.name)
    if cfg.scd_type == 1:
        silver.write(rows, version, touched=changed)
    elif before is None:
        silver.write(scd2_start(rows, at), version, touched=(), closed=F.col(END).isNotNull())
    else:
        # open versions and the snapshot meet co-partitioned on the Silver bucket: the join's
        # shuffle is also the write's clustering.  Closed history is neither read nor written.
        # The bucket alone (a function of the unique keys, so evenly filled) is enough to
        # co-partition the join; let Spark use it instead of re-shuffling on all join keys
        state = silver.read(buckets=changed, closed=False)
        whole = T.StructType([*rows.schema.fields, *[f for f in state.schema.fields if f.name in (START, END)]])
        with sql_conf(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
            applied = scd2_apply_snapshot(aligned(state, whole), rows, cfg.keys, at, cfg.history, co_partition=BUCKET)
            silver.write(applied, version, touched=changed, clustered=True, closed=F.col(END).isNotNull())
    manifest = silver.commit(version, load=sid, digests=digests, at=at)
    return {"table": cfg.name, "version": version, "buckets": len(manifest["rows"]), "changed": len(changed), "rules": checked.metrics()}


def run_files_table(lake: Lake, source: SourceConfig, cfg: TableConfig, location: str | None = None) -> dict:
    """Ingest new files into Bronze, then apply the new change rows to Silver."""
    loc = location or source.location
    bronze_path = lake.bronze_path(source.name, cfg.name)
    rows = ingest_files(
        lake.spark,
        loc,
        source.format or "csv",
        source.options,
        cfg.pattern,
        bronze_path,
        lake.checkpoint(source.name, cfg.name, "bronze"),
        # bucket by the key as Silver holds it (after cleaning): all raw spellings of one
        # key land in one bucket, so rebuilding a bucket sees the key's whole history
        keys=[cleaned_key(cfg, k) for k in cfg.keys],
        buckets=lake.buckets,
    )
    batches = apply_changes_stream(
        lake.spark, bronze_path, lake.silver(source.name, cfg), cfg, lake.checkpoint(source.name, cfg.name, "silver")
    )
    return {"table": cfg.name, "bronze_rows": rows, "batches": batches}


def read_silver(lake: Lake, source: str, cfg: TableConfig, version: int | None = None) -> DataFrame:
    return lake.silver(source, cfg).read(version).drop(BUCKET)


def run_source(lake: Lake, source: SourceConfig, inputs: dict[str, DataFrame] | None = None, location: str | None = None, ingested_at=None) -> list[dict]:
    """Run every configured table of a source (the per-table loop of the metadata).

    Database sources: each full-load table's DataFrame in ``inputs`` (e.g. a JDBC read)
    becomes the next Bronze snapshot, then Silver is brought up to it.  File sources: new
    files under ``location`` are ingested and applied.
    """
    results = []
    for cfg in source.tables:
        if source.type == "files":
            results.append(run_files_table(lake, source, cfg, location))
            continue
        if cfg.load == "incremental":
            results.append(run_cursor_table(lake, source, cfg, inputs[cfg.name], ingested_at))
            continue
        load_source_table(lake, source, cfg, inputs[cfg.name], ingested_at)
        results.append(run_snapshot_table(lake, source, cfg))
    return results


def refresh_sales_gold(lake: Lake, salesdb: SourceConfig, crm: SourceConfig, gold_root: str | None = None) -> dict[str, str]:
    """Gold for the sales domain from the published Silver tables.

    ``revenue_by_customer_month`` is materialized (replaced); ``product_price_history`` is a
    view over Silver products, re-evaluated on every read.
    """
    root = gold_root or f"{lake.root}/gold/sales"
    orders = read_silver(lake, salesdb.name, salesdb.table("orders"))
    customers = read_silver(lake, salesdb.name, salesdb.table("customers"))
    gold.materialize(gold.revenue_by_customer_month(orders, customers), f"{root}/revenue_by_customer_month")
    view = gold.create_view(gold.price_history(read_silver(lake, crm.name, crm.table("products"))), "product_price_history")
    return {"revenue_by_customer_month": f"{root}/revenue_by_customer_month", "product_price_history": view}


def run_cursor_table(lake: Lake, source: SourceConfig, cfg: TableConfig, data: DataFrame, ingested_at=None) -> dict:
    """Incremental load by cursor column: take what Bronze does not hold yet, then merge it into
    Silver (the cursor is the change sequence).

    The increment is written, its rules are checked, and only then is it entered in the load
    log: what a ``fail`` rule rejects was never loaded, and the next run looks at it afresh.
    Silver takes in every finished load above the last it has, so a run that ended between the two
    is made up for by the next one.
    """
    if not cfg.cursor:
        raise ValueError(f"{cfg.name}: an incremental load needs a cursor column")
    spark, path = lake.spark, lake.bronze_path(source.name, cfg.name)
    scfg = replace(cfg, sequence_by=cfg.sequence_by or cfg.cursor)
    bucket = bucket_of([cleaned_key(cfg, k) for k in cfg.keys], lake.buckets)
    log = bz.loads(spark, path)
    load = max(log, default=0) + 1
    held, mark = bz.cursor_edge(spark, path, cfg.cursor) or (None, None)
    entry = bz.stage_load(spark, bz.cursor_increment(data, held, cfg.cursor, mark), path, load, ingested_at, bucket, lake.buckets, cursor=cfg.cursor)
    rules = {}
    if cfg.rules:
        staged = bz.read_staged(spark, path, load, entry)
        rules = {r["rule"]: r.asDict() for r in expectation_metrics(apply_transforms(staged, cfg), cfg).collect()}
        bad = {k: v["failed"] for k, v in rules.items() if v["action"] == "fail" and v["failed"]}
        if bad:
            raise ExpectationFailed(cfg.name, bad)
    bz.finish_load(spark, path, load, entry)
    silver = lake.silver(source.name, cfg)
    taken = silver.last_load()
    apply_loads(spark, path, silver, scfg, [i for i in [*log, load] if i > taken])
    return {"table": cfg.name, "version": silver.current_version(), "rows": entry["rows"], "rules": rules}
