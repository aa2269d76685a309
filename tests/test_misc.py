"""Permanent SQL functions, Gold views and tables, composite keys, metadata mirror, bronze loads."""

import random

from pyspark.sql import functions as F

from brute import _key, scd2_changes
from strata.functions.sql import register_functions
from strata.operators.changes import scd2_from_changes
from strata.operators.keys import END, START
from strata.plans.catalog import CRM_FILES, SALESDB
from strata.plans.gold import create_view, materialize
from strata.sources import bronze as bz
from strata.sources.metadata import mirror


def test_permanent_functions_carry_version(spark, tmp_root):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS strata_fn LOCATION '{tmp_root}/db'")
    made = register_functions(spark, schema="strata_fn", version="9.9.9")
    assert "strata_fn.clean_string" in made
    assert spark.sql("SELECT strata_fn.clean_string('  a   b ') AS s").first().s == "a b"
    info = " ".join(r[0] for r in spark.sql("DESCRIBE FUNCTION EXTENDED strata_fn.mask_email").collect())
    assert "9.9.9" in info


def test_views_and_materialized_tables(spark, tmp_root):
    df = spark.range(5).select((F.col("id") % 2).alias("g"))
    name = create_view(df.groupBy("g").count(), "strata_counts")
    assert spark.table(name).count() == 2
    glob = create_view(df, "strata_ids", global_view=True)
    assert spark.table(glob).count() == 5
    back = materialize(df.groupBy("g").count(), f"{tmp_root}/gold")
    assert sorted(r["count"] for r in back.collect()) == [2, 3]


def test_composite_keys_both_paths(spark):
    rnd = random.Random(5)
    rows = [
        {"k1": rnd.randint(0, 2), "k2": rnd.choice(["a", "b", None]), "s": rnd.randint(0, 30), "v": rnd.choice([1, 2, None])}
        for _ in range(150)
    ]
    df = spark.createDataFrame([(r["k1"], r["k2"], r["s"], r["v"]) for r in rows], "k1 int, k2 string, s int, v int")
    want = scd2_changes(rows, ["k1", "k2"], "s", ["v"], ["v"])
    cols = ["k1", "k2", "v", "s", START, END]
    for kw in ({"hot_key_rows": None}, {"hot_key_rows": 8, "bucket_rows": 5}):
        got = scd2_from_changes(df, ["k1", "k2"], "s", **kw).collect()
        got = sorted((tuple(r[c] for c in cols) for r in got), key=lambda t: tuple(_key(x) for x in t))
        assert got == want


def test_metadata_mirror(spark):
    sources, tables = mirror(spark, [SALESDB, CRM_FILES], git_sha="abc")
    assert sorted(r.source for r in sources.collect()) == ["crm_files", "salesdb"]
    t = {r.table: r for r in tables.collect()}
    assert t["customers"].load_type == "full" and t["products"].load_type == "files"
    assert t["customers"].keys == ["customer_id"] and t["customers"].scd_type == 2


def test_bronze_snapshot_ids_and_retry(spark, tmp_root):
    path = f"{tmp_root}/bronze"
    df = spark.range(10).withColumnRenamed("id", "k")
    assert bz.load_snapshot(spark, df, path, "t", "2026-01-01 00:00:00").snapshot_id == 1
    assert bz.load_snapshot(spark, df.limit(3), path, "t", "2026-01-02 00:00:00").snapshot_id == 2
    # retrying load 2 replaces just that snapshot
    assert bz.load_snapshot(spark, df.limit(4), path, "t", "2026-01-02 00:00:00", snapshot_id=2).rows == 4
    assert bz.read_current(spark, path).count() == 4
    assert bz.read_as_of(spark, path, snapshot_id=1).count() == 10
    assert bz.cursor_increment(df, df.where("k < 6"), "k").count() == 4


def test_register_table_with_comment_and_properties(spark, tmp_root):
    path = f"{tmp_root}/bronze_t"
    bz.load_snapshot(spark, spark.range(7).withColumnRenamed("id", "k"), path, "t", "2026-01-01 00:00:00", 1)
    name = bz.register_table(spark, "strata_bronze_t", path, "Bronze full load of t", {"strata.load_type": "full", "strata.change_feed": "true"})
    assert spark.table(name).count() == 7
    props = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    assert props["strata.load_type"] == "full" and props["strata.change_feed"] == "true"
    desc = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    assert desc.get("Comment") == "Bronze full load of t"


def test_validity_join_day_buckets_match_plain(spark):
    import datetime as dt

    from strata.operators.joins import validity_join

    t0 = dt.datetime(2026, 1, 1)
    ranges = []
    for key in ("A", "B"):
        starts = [t0 + dt.timedelta(hours=7 * i) for i in range(60)]
        for i, st in enumerate(starts):
            end = starts[i + 1] if i + 1 < len(starts) else None  # last range open
            ranges.append((key, i, st, end))
    rng = spark.createDataFrame(ranges, "k string, rid int, rs timestamp_ntz, re timestamp_ntz")
    rnd = random.Random(2)
    facts = [(j, rnd.choice("ABC"), t0 + dt.timedelta(minutes=rnd.randint(-60, 60 * 24 * 30))) for j in range(800)]
    facts += [(900, "A", t0 + dt.timedelta(hours=7)), (901, "B", t0 + dt.timedelta(hours=7 * 59))]  # on boundaries
    fct = spark.createDataFrame(facts, "fid int, k string, ts timestamp_ntz")
    for how in ("inner", "left"):
        plain = validity_join(fct, rng, ["k"], "ts", "rs", "re", how, day_buckets=False).select("f.fid", "r.rid")
        bucketed = validity_join(fct, rng, ["k"], "ts", "rs", "re", how, day_buckets=True).select("f.fid", "r.rid")
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, bucketed.collect()), key=str)
    got = {r.fid: r.rid for r in validity_join(fct, rng, ["k"], "ts", "rs", "re").select("f.fid", "r.rid").collect()}
    assert got[900] == 1 and got[901] == 59
