"""SCD from change streams: golden scenario, brute-force equality, skew path, late data."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brute import _key, scd2_changes
from rows import PRODUCTS_1, PRODUCTS_2
from strata.operators.changes import dedupe_key_seq, scd1_from_changes, scd2_from_changes, unique_key_check
from strata.operators.keys import END, START
from strata.plans.catalog import table_config
from strata.plans.silver import changes_view, scd_from_changes
from strata.streaming.cdc import apply_changes_batch

T1 = dt.datetime(2026, 10, 1, 8, 0)
T2 = dt.datetime(2026, 10, 8, 8, 0)
SCHEMA = "product_code string, product_name string, category string, price string, valid_from string, _file_path string, _file_modification_time timestamp_ntz, _ingested_at timestamp_ntz"
EXPECTED = [
    ("K-07", "Garden Chair XL", "Outdoor", "412.50", dt.date(2026, 1, 1), T1, T2),
    ("K-07", "Garden Chair XL", "Outdoor", "398.00", dt.date(2026, 10, 1), T2, None),
    ("K-08", 'Lamp 5"', "outdoor", "18.75", dt.date(2026, 2, 1), T1, None),
    ("K-09", "Folding Table", "Outdoor", None, dt.date(2026, 3, 1), T1, None),
    ("M-01", "Sheet Music", "Paper", "7.20", dt.date(2026, 1, 15), T1, None),
    ("M-02", "Notebook", "Paper", "3.10", dt.date(2026, 2, 1), T1, None),
    ("T-55", "Kettle", "Kitchen", "64.00", dt.date(2026, 10, 8), T2, None),
]


def _products(spark):
    rows = [(*r, "r1.csv", T1, T1) for r in PRODUCTS_1] + [(*r, "r2.csv", T2, T2) for r in PRODUCTS_2]
    return spark.createDataFrame(rows, SCHEMA)


def _rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple(_key(x) for x in t))


def test_golden_products(spark):
    cfg = table_config("crm_files", "products")
    view = changes_view(_products(spark), cfg, observe=True)
    out = scd_from_changes(view.df, cfg)
    cols = ["product_code", "product_name", "category", "price", "valid_from", START, END]
    assert _rows(out, cols) == sorted(EXPECTED, key=lambda t: tuple(_key(x) for x in t))
    assert view.metrics()["price_present"]["failed"] == 1


def test_golden_products_in_two_batches(spark):
    cfg = table_config("crm_files", "products")
    cleaned = changes_view(_products(spark), cfg).df
    log, state = None, None
    for t in (T1, T2):
        log, state = apply_changes_batch(log, state, cleaned.where(F.col("_ingested_at") == F.lit(t)), cfg)
    cols = ["product_code", "product_name", "category", "price", "valid_from", START, END]
    assert _rows(state, cols) == sorted(EXPECTED, key=lambda t: tuple(_key(x) for x in t))


def _random_log(seed, n=120, keys=6, hot=0.5):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        k = 0 if rnd.random() < hot else rnd.randint(1, keys)
        if rnd.random() < 0.05:
            k = None
        s = rnd.randint(0, 40) if rnd.random() > 0.03 else None
        rows.append({"k": k, "s": s, "a": rnd.choice([None, "x", "y"]), "b": rnd.choice([1, 2]), "u": rnd.randint(0, 3)})
    return rows


def _log_df(spark, rows):
    return spark.createDataFrame([(r["k"], r["s"], r["a"], r["b"], r["u"]) for r in rows], "k int, s int, a string, b int, u int")


@pytest.mark.parametrize("seed", range(6))
def test_scd2_matches_brute_force_plain_and_bucketed(spark, seed):
    rows = _random_log(seed)
    df = _log_df(spark, rows)
    want = scd2_changes(rows, ["k"], "s", ["a", "b", "u"], ["a", "b"])
    cols = ["k", "a", "b", "u", "s", START, END]
    plain = scd2_from_changes(df, ["k"], "s", ["a", "b"], hot_key_rows=None)
    assert _rows(plain, cols) == want
    # tiny thresholds force the hot-key path: buckets of ~4 rows, stitched by the summary
    bucketed = scd2_from_changes(df, ["k"], "s", ["a", "b"], hot_key_rows=5, bucket_rows=4)
    assert _rows(bucketed, cols) == want
    shuffled = scd2_from_changes(df.orderBy(F.rand(seed)), ["k"], "s", ["a", "b"], hot_key_rows=5, bucket_rows=3)
    assert _rows(shuffled, cols) == want


def test_scd2_invariants(spark):
    rows = _random_log(99, n=300)
    out = scd2_from_changes(_log_df(spark, rows), ["k"], "s", ["a"], hot_key_rows=10, bucket_rows=7).collect()
    per_key = {}
    for r in out:
        per_key.setdefault(r["k"], []).append((r[START], r[END], r["a"]))
    for vs in per_key.values():
        vs.sort(key=lambda v: _key(v[0]))  # a NULL sequence sorts first
        assert sum(1 for v in vs if v[1] is None) == 1
        for (s1, e1, a1), (s2, _e2, a2) in zip(vs, vs[1:]):
            assert e1 == s2 and (s1 is None or s1 < e1)  # contiguous, non-overlapping
            assert a1 != a2  # adjacent versions differ in a tracked column


def test_incremental_batches_equal_all_at_once(spark):
    rows = _random_log(7, n=200)
    df = _log_df(spark, rows).withColumn("batch", F.coalesce(F.col("s") % 3, F.lit(0)))
    cfg = table_config("crm_files", "products").__class__(name="t", keys=("k",), scd_type=2, sequence_by="s", history=("a", "b"))
    log, state = None, None
    for b in (2, 0, 1):  # batches arrive out of sequence order
        log, state = apply_changes_batch(log, state, df.where(F.col("batch") == b).drop("batch"), cfg, hot_key_rows=None)
    cols = ["k", "a", "b", "u", "s", START, END]
    assert _rows(state, cols) == scd2_changes(rows, ["k"], "s", ["a", "b", "u"], ["a", "b"])


def test_scd1_and_deletes(spark):
    rows = [(1, 1, "a", False), (1, 3, "b", False), (2, 1, "c", False), (2, 2, "d", True), (3, 5, "e", True), (3, 6, "f", False)]
    df = spark.createDataFrame(rows, "k int, s int, v string, gone boolean")
    assert _rows(scd1_from_changes(df, ["k"], "s"), ["k", "v"]) == [(1, "b"), (2, "d"), (3, "f")]
    assert _rows(scd1_from_changes(df, ["k"], "s", apply_as_deletes="gone"), ["k", "v"]) == [(1, "b"), (3, "f")]


def test_dedupe_and_unique_check(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 2, "c"), (None, 1, "x"), (None, 1, "x")], "k int, s int, v string")
    assert _rows(dedupe_key_seq(df, ["k"], "s"), ["k", "s", "v"]) == [(None, 1, "x"), (1, 1, "a"), (1, 2, "c")]
    assert _rows(unique_key_check(df, ["k"], "s"), ["k", "s", "n"]) == [(None, 1, 2), (1, 1, 2)]


def test_hot_key_third_of_rows_matches_plain_path(spark):
    """One key owns a third of 300k changes: bucketed scan == single ordered scan."""
    n = 300_000
    ids = spark.range(n)
    hot = F.col("id") % 3 == 0
    log = ids.select(
        F.when(hot, F.lit(-1)).otherwise(F.col("id") % 5000).alias("k"),
        F.col("id").alias("s"),
        # long runs of equal values so versions span bucket boundaries
        (F.floor(F.col("id") / 7000) % 4).cast("int").alias("a"),
        (F.col("id") % 11).cast("int").alias("u"),
    )
    plain = scd2_from_changes(log, ["k"], "s", ["a"], hot_key_rows=None)
    bucketed = scd2_from_changes(log, ["k"], "s", ["a"], hot_key_rows=50_000, bucket_rows=20_000)
    assert "_seqb" in bucketed._jdf.queryExecution().optimizedPlan().toString()  # hot path taken
    assert plain.exceptAll(bucketed).count() == 0 and bucketed.exceptAll(plain).count() == 0
    assert bucketed.where("k = -1").count() == plain.where("k = -1").count() > 1
