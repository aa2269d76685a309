"""Change streams: de-duplication, key checks, SCD type 1 and type 2.

A change stream is append-only rows carrying the key columns and a sequence column that
orders the changes of one key.  Everything here is lazily planned DataFrame work; the only
eager steps are the small hot-key survey in :func:`scd2_from_changes` and, when hot keys
exist, a checkpoint of their per-bucket runs.

Skew: one key may own a large share of all rows.  Aggregations here (dedupe, SCD1) combine
map-side before the shuffle, so a hot key costs one row per task.  The ordered SCD2 scan is
the exception: it needs each key's rows in sequence order.  Keys above ``hot_key_rows`` are
therefore cut by rank into sequence buckets of about ``bucket_rows`` rows, scanned in parallel,
and stitched together through a per-bucket summary (a prefix sum over buckets).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.keys import END, START, comparable, has_map, null_safe_eq
from strata.session import checkpoint_dir

HOT_KEY_ROWS = 2_000_000
BUCKET_ROWS = 1_000_000
CUT_SAMPLE = 4096
DELETED = "_deleted"


def _cols(df: DataFrame, except_columns: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(except_columns)]


def _order_by_values(df: DataFrame, cols: Sequence[str]) -> Column:
    return F.struct(*[comparable(df.schema[c].dataType, F.col(c)).alias(f"_o{i}") for i, c in enumerate(cols)])


def _least(df: DataFrame, cols: Sequence[str]) -> Column:
    """The row whose values come first; maps have no order, so they are ordered by their text."""
    if any(has_map(df.schema[c].dataType) for c in cols):
        return F.min_by(F.struct(*cols), _order_by_values(df, cols))
    return F.min(F.struct(*cols))


def dedupe_key_seq(df: DataFrame, keys: Sequence[str], sequence_by: str, extra_group: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, sequence); among copies the smallest row wins (deterministic).

    ``min(struct)`` is combined map-side, so a large group of copies is reduced before the shuffle.
    """
    group = [*keys, *extra_group, sequence_by]
    rest = [c for c in df.columns if c not in group]
    if not rest:
        return df.select(*group).distinct()
    picked = df.groupBy(*group).agg(_least(df, rest).alias("_r"))
    return picked.select(*[c if c in group else F.col("_r")[c].alias(c) for c in df.columns])


def unique_key_check(df: DataFrame, keys: Sequence[str], sequence_by: str | None = None) -> DataFrame:
    """(keys[, sequence]) groups that occur more than once, with their row count ``n``."""
    group = [*keys, *([sequence_by] if sequence_by else [])]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], sequence_by: str | None = None, table: str = "table") -> None:
    """Strict mode of :func:`unique_key_check`: raise with the number of offending groups."""
    bad = unique_key_check(df, keys, sequence_by).agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("r")).first()
    if bad["g"]:
        raise ValueError(f"{table}: {bad['g']} duplicate key groups covering {bad['r']} rows")


def key_collision_report(df: DataFrame, raw_key: str, cleaned: Column, name: str = "key_clean") -> DataFrame:
    """Cleaned key values that merge more than one distinct raw key (keys must be stable)."""
    return (
        df.select(F.col(raw_key).alias("_raw"), cleaned.alias(name))
        .groupBy(name)
        .agg(F.count_distinct("_raw").alias("raw_variants"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("raw_variants") > 1)
    )


def scd1_from_changes(
    changes: DataFrame,
    keys: Sequence[str],
    sequence_by: str,
    except_columns: Sequence[str] = (),
    apply_as_deletes: str | Column | None = None,
    cluster_by: str | None = None,
    keep_deleted: bool = False,
) -> DataFrame:
    """Latest row per key by sequence (SCD type 1).

    ``max(struct(sequence, ...))`` is one map-side-combinable aggregate: ties on the
    sequence are broken by the row values, so the result does not depend on arrival order.
    With ``apply_as_deletes`` a key whose latest change matches the predicate is removed, or,
    with ``keep_deleted``, told by a column ``_deleted``.
    """
    keys = [*keys, cluster_by] if cluster_by else list(keys)
    cols = _cols(changes, except_columns)
    rest = [c for c in cols if c not in keys and c != sequence_by]
    fields = [F.col(sequence_by).alias("_seq")]
    if apply_as_deletes is not None:
        pred = F.expr(apply_as_deletes) if isinstance(apply_as_deletes, str) else apply_as_deletes
        fields.append(F.coalesce(pred, F.lit(False)).alias("_del"))
    fields += [F.col(c) for c in rest]
    if any(has_map(changes.schema[c].dataType) for c in rest):
        order = F.struct(F.col(sequence_by).alias("_s"), _order_by_values(changes, rest).alias("_v"))
        latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_r"))
    else:
        latest = changes.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("_r"))
    if apply_as_deletes is not None and not keep_deleted:
        latest = latest.where(~F.col("_r._del"))
    out = [F.col(c) if c in keys else (F.col("_r._seq") if c == sequence_by else F.col("_r")[c]).alias(c) for c in cols]
    if keep_deleted:
        out.append((F.col("_r._del") if apply_as_deletes is not None else F.lit(False)).alias(DELETED))
    return latest.select(*out)


def _scan_flags(rows: DataFrame, part: list[str], sequence_by: str, tracked: list[str]) -> DataFrame:
    """Per partition ``part`` in sequence order: change flag, local version, next row's flag/seq."""
    w = Window.partitionBy(*part).orderBy(sequence_by)
    trk = F.struct(*[comparable(rows.schema[c].dataType, F.col(c)).alias(c) for c in tracked])
    first = F.lag(F.lit(1)).over(w).isNull()
    flagged = rows.withColumn("_trk", trk).withColumn(
        "_chg", F.when(first, F.lit(1)).when(trk.eqNullSafe(F.lag(trk).over(w)), F.lit(0)).otherwise(F.lit(1))
    )
    return (
        flagged.withColumn("_lver", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_nseq", F.lead(sequence_by).over(w))
        .withColumn("_nchg", F.lead("_chg").over(w))
    )


def _order(c: str) -> Column:
    # a NULL sequence sorts first, as in the ordered scan (min/max_by alone would skip it)
    return F.struct(F.col(c))


def _version_aggs(sequence_by: str, payload: list[str], nseq: Column, nchg: Column, starts: str | None = None) -> list[Column]:
    first = F.col(sequence_by) if starts is None else F.coalesce(starts, sequence_by)
    return [
        F.min_by(first, _order(sequence_by)).alias(START),
        F.max(F.when(nchg == 1, nseq)).alias(END),
        F.max_by(F.struct(*payload), _order(sequence_by)).alias("_last"),
        F.max(sequence_by).alias("_mseq"),
    ]


def _plain_versions(
    rows: DataFrame, keys: list[str], seq: str, payload: list[str], tracked: list[str], part: list[str] | None, clustered: bool, starts: str | None
) -> DataFrame:
    # One hash shuffle serves the dedupe, the ordered scan and the version aggregate: all
    # three only need the rows of a key together (keys here are not hot).  ``part`` may be a
    # column derived from the keys (the Silver bucket), whose partitioning then also serves
    # the bucketed write; ``clustered`` means the input is already partitioned that way.
    by_key = dedupe_key_seq(rows if clustered else rows.repartition(*(part or keys)), keys, seq)
    scanned = _scan_flags(by_key, keys, seq, tracked)
    return scanned.groupBy(*keys, F.col("_lver").alias("_ver")).agg(
        *_version_aggs(seq, payload, F.col("_nseq"), F.col("_nchg"), starts)
    )


def _hot_versions(tagged: DataFrame, keys: list[str], seq: str, payload: list[str], tracked: list[str], starts: str | None) -> DataFrame:
    rows = dedupe_key_seq(tagged, keys, seq, extra_group=["_seqb"])
    part = [*keys, "_seqb"]
    scanned = _scan_flags(rows, part, seq, tracked)
    # Runs of equal tracked values inside each bucket ("parts"); the bucket's last run has no
    # in-bucket successor.  Both the summary and the stitching read the parts; they are
    # checkpointed (shared checkpoint folder) so the dedupe, the two shuffles and the ordered
    # scan of the hot rows run once -- column pruning would otherwise give the two readers
    # different plans and Spark would compute everything twice.  Parts are usually far
    # fewer than rows (one per run of equal values).
    checkpoint_dir(tagged.sparkSession)
    parts = (
        scanned.groupBy(*part, "_lver")
        .agg(
            *_version_aggs(seq, payload, F.col("_nseq"), F.col("_nchg"), starts),
            F.max_by("_trk", _order(seq)).alias("_trk"),
            F.max(F.col("_nseq").isNull()).alias("_blast"),
        )
        .checkpoint()
    )
    # Summary: one row per (key, bucket); bounded by total_rows / bucket_rows.
    wb = Window.partitionBy(*keys).orderBy("_seqb")
    summary = parts.groupBy(*part).agg(
        F.min_by("_trk", F.col("_lver")).alias("_ftrk"),
        F.max_by("_trk", F.col("_lver")).alias("_ltrk"),
        F.min_by(START, F.col("_lver")).alias("_fseq"),
        (F.max("_lver") - F.lit(1)).alias("_nl"),  # changes after the bucket's first run
    )
    first_bucket = F.lag(F.lit(1)).over(wb).isNull()
    bchg = F.when(first_bucket, F.lit(1)).when(F.col("_ftrk").eqNullSafe(F.lag("_ltrk").over(wb)), 0).otherwise(1)
    summary = (
        summary.withColumn("_bchg", bchg)
        .withColumn("_cum", F.sum(F.col("_bchg") + F.col("_nl")).over(wb.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_off", F.col("_cum") - F.col("_nl") - F.lit(1))
        .withColumn("_bseq", F.lead("_fseq").over(wb))
        .withColumn("_bnchg", F.lead("_bchg").over(wb))
        .select(*[F.col(k).alias(f"_sk{i}") for i, k in enumerate(keys)], F.col("_seqb").alias("_sb"), "_off", "_bseq", "_bnchg")
    )
    cond = null_safe_eq([F.col(k) for k in keys] + [F.col("_seqb")], [F.col(f"_sk{i}") for i in range(len(keys))] + [F.col("_sb")])
    joined = parts.join(summary, cond, "left")
    # global version = offset of the bucket + run number (a bucket whose first run continues
    # the previous bucket's last version has that folded into _off); the bucket's last run
    # ends where the next bucket starts, if that bucket opens a new version
    ver = F.col("_off") + F.col("_lver")
    end = F.coalesce(F.col(END), F.when(F.col("_blast") & (F.col("_bnchg") == 1), F.col("_bseq")))
    return joined.groupBy(*keys, ver.alias("_ver")).agg(
        F.min_by(START, _order(START)).alias(START),
        F.max(end).alias(END),
        F.max_by("_last", _order("_mseq")).alias("_last"),
        F.max("_mseq").alias("_mseq"),
    )


def scd2_from_changes(
    changes: DataFrame,
    keys: Sequence[str],
    sequence_by: str,
    track_history_columns: Sequence[str] | None = None,
    except_columns: Sequence[str] = (),
    *,
    apply_as_deletes: str | Column | None = None,
    hot_key_rows: int | None = HOT_KEY_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    cluster_by: str | None = None,
    clustered: bool = False,
    starts: str | None = None,
    keep_deleted: bool = False,
) -> DataFrame:
    """SCD type 2 from an ordered change stream.

    Per key in sequence order a row opens a new version when a tracked column differs
    (NULL-safe) from the row before; ``__START_AT`` is the version's first sequence value,
    ``__END_AT`` the next version's start (NULL for the open one).  Untracked columns take
    the value of the version's last row.  Rows with equal (keys, sequence) are de-duplicated
    first.  A change for which ``apply_as_deletes`` holds closes its key's version at its
    sequence and is no version itself.  Result: the input columns (minus ``except_columns``) plus ``__START_AT``/``__END_AT``;
    the sequence column holds the version's last sequence value.

    ``cluster_by`` names a column that is a function of the keys (the Silver bucket): it is
    carried through, and the single shuffle partitions on it (``clustered``: the input
    already is), so the result can be written bucketed without another shuffle.

    ``starts`` names a column (no result column) that, where it is not NULL, holds the start of
    the version that the row is the last known one of: so open versions can be given as rows
    and history goes on from them.  ``keep_deleted`` keeps versions of deleted keys and tells
    them by a column ``_deleted``.
    """
    keys = [*keys, cluster_by] if cluster_by else list(keys)
    cols = [c for c in _cols(changes, except_columns) if c != starts]
    more = [starts] if starts else []
    attrs = [c for c in cols if c not in keys and c != sequence_by]
    tracked = list(track_history_columns) if track_history_columns else attrs
    payload = [*attrs, sequence_by]
    base = changes.select(*cols, *more)
    if apply_as_deletes is not None:
        # being deleted is one more tracked state; versions in that state are left out at the end
        pred = F.expr(apply_as_deletes) if isinstance(apply_as_deletes, str) else apply_as_deletes
        base = changes.select(*cols, *more, F.coalesce(pred, F.lit(False)).alias(DELETED))
        tracked, payload = [*tracked, DELETED], [*payload, DELETED]

    part = [cluster_by] if cluster_by else None
    hot = None if hot_key_rows is None else _hot_keys(base, keys, sequence_by, hot_key_rows, bucket_rows)
    if hot is None:
        versions = _plain_versions(base, keys, sequence_by, payload, tracked, part, clustered, starts)
    else:
        cond = null_safe_eq([F.col(k) for k in keys], [F.col(f"_hk{i}") for i in range(len(keys))])
        tagged = base.join(hot, cond, "left")
        is_hot = F.col("_cuts").isNotNull()
        # the bucket is the number of cut points at or below the row; NULL sequences sort first
        seq = F.col(sequence_by)
        bucket = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= seq)), F.lit(0)).cast("long")
        plain_in = tagged.where(~is_hot).select(*base.columns)
        hot_in = tagged.where(is_hot).withColumn("_seqb", F.when(seq.isNull(), F.lit(0)).otherwise(bucket)).select(*base.columns, "_seqb")
        versions = _plain_versions(plain_in, keys, sequence_by, payload, tracked, part, clustered, starts).unionByName(
            _hot_versions(hot_in, keys, sequence_by, payload, tracked, starts)
        )
    gone = F.col(f"_last.{DELETED}") if apply_as_deletes is not None else F.lit(False)
    if apply_as_deletes is not None and not keep_deleted:
        versions = versions.where(~gone)
    out = [F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in cols]
    return versions.select(*out, START, END, *([gone.alias(DELETED)] if keep_deleted else []))


def _hot_keys(base: DataFrame, keys: list[str], seq: str, hot_key_rows: int, bucket_rows: int) -> DataFrame | None:
    """Keys of more than ``hot_key_rows`` rows with cut points of about ``bucket_rows`` rows each; None if there are none.

    Cut points are taken by rank, from those sequence values whose hash falls into a part of
    the hash space that leaves about ``CUT_SAMPLE`` of them: any type that has an order will do,
    and one far-off value moves no cut.  The table is written to the shared checkpoint folder
    (at most total rows / ``hot_key_rows`` of them, so it need not be small); it stays on the
    executors, and the join that uses it is planned by its size.
    """
    checkpoint_dir(base.sparkSession)
    counted = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_key_rows)
    counted = counted.select(*[F.col(k).alias(f"_hk{i}") for i, k in enumerate(keys)], "_n").checkpoint()
    if counted.isEmpty():
        return None
    cond = null_safe_eq([F.col(k) for k in keys], [F.col(f"_hk{i}") for i in range(len(keys))])
    taken = F.pmod(F.xxhash64(seq), F.greatest(F.lit(1), F.floor(F.col("_n") / CUT_SAMPLE))) == 0
    sample = base.join(counted, cond).where(F.col(seq).isNotNull() & taken)
    cut = sample.groupBy(*[f"_hk{i}" for i in range(len(keys))], "_n").agg(F.array_sort(F.collect_set(seq)).alias("_s"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / bucket_rows)).cast("int")
    place = lambda i: (i * F.size("_s") / parts).cast("int")
    cuts = F.when(parts > 1, F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_s", place(i))))
    return counted.join(
        cut.select(*[F.col(f"_hk{i}").alias(f"_ck{i}") for i in range(len(keys))], F.array_distinct(cuts).alias("_found")),
        null_safe_eq([F.col(f"_hk{i}") for i in range(len(keys))], [F.col(f"_ck{i}") for i in range(len(keys))]),
        "left",
    ).select(*[f"_hk{i}" for i in range(len(keys))], F.coalesce("_found", F.array().cast(T.ArrayType(base.schema[seq].dataType))).alias("_cuts"))
