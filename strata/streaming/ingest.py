"""Incremental file ingestion and change application with Structured Streaming.

Files -> Bronze: a stream over the landing folder's file names (each taken once, tracked in the
checkpoint); each batch of new files is read by header and becomes one load of a Bronze table,
bucketed by cleaned key and entered in its load log with the stream and batch it came from.
Bronze -> Silver: a stream over the load log's entries whose ``foreachBatch`` merges the loads' changes into
the table (:mod:`strata.operators.merge`) and publishes its next version.  The
manifest keeps the stream's last batch, so a batch that is run again changes nothing, and a
stream that starts afresh with a new checkpoint is a stream of its own.
Both run as triggered ``availableNow`` runs.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import TableConfig
from strata.operators.changes import HOT_KEY_ROWS
from strata.operators.keys import null_safe_eq
from strata.operators.merge import late_keys, maybe_late, merge_changes
from strata.operators.quality import ExpectationFailed, expectation_metrics
from strata.operators.transforms import apply_transforms, cleaned_key
from strata.plans.silver import DEFAULT_SEQUENCE, STREAM_EXCEPT, changes_view
from strata.session import checkpoint_dir
from strata.sources import bronze as bz
from strata.sources import files_store as store
from strata.sources.files import read_files
from strata.sources.schemas import union_aligned
from strata.sources.tables import BUCKET, VersionedTable, bucket_of


#: The binary file source's columns; only names are taken, so no content is read.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint."""
    fs, p = store._fs(spark, f"{checkpoint}/metadata")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def ingest_files(
    spark: SparkSession,
    location: str,
    fmt: str,
    options: Mapping[str, str],
    pattern: str,
    bronze_path: str,
    checkpoint: str,
    keys: list[str | Column],
    buckets: int,
) -> int:
    """Append every not-yet-seen file to Bronze; returns the number of rows appended.

    A landing folder without files is no fault: there is nothing to append yet.
    """
    if not store.exists(spark, location):
        return 0
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).load(location).select("path")
    rows = 0

    def take(batch: DataFrame, batch_id: int) -> None:
        nonlocal rows
        origin = [stream_id(spark, checkpoint), batch_id]
        log = bz.loads(spark, bronze_path)
        if any(e.get("origin") == origin for e in log.values()):  # run again after its load was finished
            return
        paths = [r.path for r in batch.collect()]  # names of this batch's files only
        if not paths:
            return
        load = max(log, default=0) + 1
        entry = bz.stage_load(spark, read_files(spark, None, fmt, options, paths=paths), bronze_path, load, bucket=bucket_of(keys, buckets), buckets=buckets)
        bz.finish_load(spark, bronze_path, load, entry | {"origin": origin})
        rows += entry["rows"]

    q = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows


def changes_of(spark: SparkSession, bronze_path: str, cfg: TableConfig, silver: VersionedTable, ids: list[int], late: DataFrame | None = None) -> DataFrame:
    """Cleaned changes of some loads with their Silver bucket; only those of the ``late`` keys, if given.

    Of each load only the folders that hold late keys are read, whatever number of buckets the load
    was dealt to; the rows meet the keys before copies are combined.
    """
    if late is None:
        raw = bz.read_loads(spark, bronze_path, ids)
    else:
        log = bz.loads(spark, bronze_path)
        by_count: dict[int | None, list[int]] = {}
        for i in ids:
            by_count.setdefault(log[i].get("buckets"), []).append(i)
        parts = []
        for count, same in by_count.items():
            part = bz.read_loads(spark, bronze_path, same)
            if count is not None:  # at most `count` values
                wanted = [r[0] for r in late.select(bucket_of(cfg.keys, count)).distinct().collect()]
                part = part.where(F.col(BUCKET).isin(wanted))
            parts.append(part)
        raw = union_aligned(parts)
        cleaned = [cleaned_key(cfg, k) for k in cfg.keys]
        named = late.select(*[F.col(k).alias(f"_lk{i}") for i, k in enumerate(cfg.keys)])
        raw = raw.join(named, null_safe_eq(cleaned, [named[f"_lk{i}"] for i in range(len(cleaned))]), "left_semi")
    return silver.with_bucket(changes_view(raw.drop(BUCKET, bz.SNAPSHOT_ID), cfg).df)


def apply_loads(spark: SparkSession, bronze_path: str, silver: VersionedTable, cfg: TableConfig, ids: list[int], stream: str | None = None, batch: int | None = None) -> dict | None:
    """Merges the change rows of finished loads into Silver and publishes it; the new manifest, or None if there are no rows.

    Reads the loads, the last rows of their keys, and, for keys with late changes, their earlier
    changes; writes a layer of the keys that change.  Changes after all that is stored make no key
    late, and in a table without history they need no last rows.
    """
    log = bz.loads(spark, bronze_path)
    ids = [i for i in sorted(ids) if log[i]["rows"]]
    if not ids:
        return None
    seq = cfg.sequence_by or DEFAULT_SEQUENCE
    earlier = [i for i in sorted(log) if i <= ids[-1]]
    # the log says how many rows a key can have at most
    few = lambda loads: 2 * sum(log[i]["rows"] for i in loads) <= HOT_KEY_ROWS
    checkpoint_dir(spark)
    changes, known, touched = changes_of(spark, bronze_path, cfg, silver, ids), silver.exists(), []
    if known or (cfg.scd_type == 2 and not few(ids)):
        changes = changes.checkpoint()  # read several times below; cleaned once
    late = early = None
    try:
        if known:
            keys, touched = [BUCKET, *cfg.keys], [r[0] for r in changes.select(BUCKET).distinct().collect()]  # at most `buckets` values
            alike = silver.schema()[seq].dataType == changes.schema[seq].dataType
            early = maybe_late(changes, seq, silver.latest(seq, touched)) if alike else changes
            early = None if early.isEmpty() else early
            if early is not None:
                late = late_keys(early, silver.read_state(touched), keys, seq, ties_only=cfg.scd_type == 1).distinct().persist()
                late = None if late.isEmpty() else late
        history = None if late is None else changes_of(spark, bronze_path, cfg, silver, earlier, late).checkpoint()
        layer = merge_changes(changes, early, silver.schema(), partial(silver.read_state, touched), late, history, cfg, seq, STREAM_EXCEPT, few(ids), few(earlier))
        version = silver.next_version()
        silver.write(layer, version, layer=True)
        manifest = silver.commit(version, stream, batch, load=max(ids[-1], silver.last_load()))
    finally:
        if late is not None:
            late.unpersist()
    silver.compact()
    return manifest


def pending(spark: SparkSession, bronze_path: str, silver: VersionedTable) -> list[int]:
    """Finished loads that the table has not taken in, up to the first that is missing: loads are taken in order."""
    log, last = bz.loads(spark, bronze_path), silver.last_load()
    found = []
    while last + 1 in log:
        last += 1
        found.append(last)
    return found


def apply_changes_stream(
    spark: SparkSession,
    bronze_path: str,
    silver: VersionedTable,
    cfg: TableConfig,
    checkpoint: str,
) -> list[dict]:
    """Run the Bronze -> Silver change flow until caught up; returns per-batch rule metrics.

    The stream is over the entries of the load log: a load that is staged and not yet entered is
    no part of a batch, and the manifest says which loads are in the table, so each is taken
    once and none is passed over.  Per batch: rule counters on its cleaned rows (``fail`` aborts
    before anything is written), then the changes are merged and published.  Without any load
    yet there is nothing to do.
    """
    if not bz.loads(spark, bronze_path):
        return []
    entries = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.json").load(bz.log_path(bronze_path)).select("path")
    metrics: list[dict] = []

    def apply(batch: DataFrame, batch_id: int) -> None:
        ids = pending(spark, bronze_path, silver)
        if not ids:  # run again after its version was published
            return
        if cfg.rules and any(bz.loads(spark, bronze_path)[i]["rows"] for i in ids):
            raw = bz.read_loads(spark, bronze_path, ids).drop(BUCKET, bz.SNAPSHOT_ID)
            m = {r["rule"]: r.asDict() for r in expectation_metrics(apply_transforms(raw, cfg), cfg).collect()}
            metrics.append({"batch_id": batch_id, "rules": m})
            bad = {k: v["failed"] for k, v in m.items() if v["action"] == "fail" and v["failed"]}
            if bad:
                raise ExpectationFailed(cfg.name, bad)
        apply_loads(spark, bronze_path, silver, cfg, ids, stream_id(spark, checkpoint), batch_id)

    q = entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return metrics


__all__ = ["apply_changes_stream", "apply_loads", "changes_of", "ingest_files"]
