"""What must not get lost or double: empty loads, ties, rejected and unfinished loads, buckets, file headers, deletes."""

import datetime as dt
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strata.config import Rule, SourceConfig, Step, TableConfig, read_source
from strata.operators.changes import dedupe_key_seq, scd1_from_changes, scd2_from_changes
from strata.operators.keys import END, START
from strata.operators.quality import ExpectationFailed
from strata.plans import gold
from strata.plans.catalog import CRM_FILES
from strata.plans.pipeline import Lake, load_source_table, read_silver, run_cursor_table, run_files_table, run_snapshot_table
from strata.sources import bronze as bz
from strata.sources import files_store as store
from strata.sources.files import read_files
from strata.sources.tables import VersionedTable

DB = SourceConfig("db", "sqlserver")
T = [dt.datetime(2026, 1, d, 6) for d in range(1, 9)]


def rows(spark, *data, schema="id int, v string"):
    return spark.createDataFrame(list(data), schema)


def load(lake, cfg, df, day):
    load_source_table(lake, DB, cfg, df, f"2026-01-0{day} 06:00:00")
    return run_snapshot_table(lake, DB, cfg)


@pytest.mark.parametrize("scd_type", [1, 2])
@pytest.mark.parametrize("explicit", [False, True])
def test_empty_load_deletes_all(spark, tmp_root, scd_type, explicit):
    cfg, lake = TableConfig("t", ("id",), scd_type), Lake(spark, tmp_root, 4)
    load(lake, cfg, rows(spark, (1, "a"), (2, "b")), 1)
    load_source_table(lake, DB, cfg, rows(spark), T[1])
    assert "skipped" not in run_snapshot_table(lake, DB, cfg, 2 if explicit else None)
    got = read_silver(lake, "db", cfg).collect()
    assert got == [] if scd_type == 1 else sorted((r.id, r[START], r[END]) for r in got) == [(1, T[0], T[1]), (2, T[0], T[1])]
    load(lake, cfg, rows(spark, (2, "b")), 3)
    got = read_silver(lake, "db", cfg)
    assert got.count() == (1 if scd_type == 1 else 3)


def test_first_load_may_be_empty(spark, tmp_root):
    cfg, lake = TableConfig("t", ("id",), 2), Lake(spark, tmp_root, 4)
    load(lake, cfg, rows(spark), 1)
    assert read_silver(lake, "db", cfg).count() == 0
    load(lake, cfg, rows(spark, (1, "a")), 2)
    assert [(r.id, r[START], r[END]) for r in read_silver(lake, "db", cfg).collect()] == [(1, T[1], None)]


@pytest.mark.parametrize("scd_type", [1, 2])
def test_all_rows_dropped(spark, tmp_root, scd_type):
    cfg = TableConfig("t", ("id",), scd_type, rules=(Rule("none", "id < 0", "drop"),))
    lake = Lake(spark, tmp_root, 4)
    out = load(lake, cfg, rows(spark, (1, "a"), (2, "b")), 1)
    assert out["rules"]["none"] == {"action": "drop", "failed": 2, "passed": 0}
    assert read_silver(lake, "db", cfg).count() == 0


def test_a_column_named_v_and_closed_history_apart(spark, tmp_root):
    cfg, lake = TableConfig("t", ("id",), 2), Lake(spark, tmp_root, 4)
    for day, v in ((1, "a"), (2, "b"), (3, "b"), (4, "c")):
        load(lake, cfg, rows(spark, (1, v), (2, "same")), day)
    got = sorted((r.id, r.v, r[START], r[END]) for r in read_silver(lake, "db", cfg).collect())
    assert got == [(1, "a", T[0], T[1]), (1, "b", T[1], T[3]), (1, "c", T[3], None), (2, "same", T[0], None)]
    # a load reads open rows only, and writes no row that was closed before
    silver = lake.silver("db", cfg)
    assert {v for versions in silver.manifest()["closed"].values() for v in versions} == {2, 4}
    assert all("_area=open" in f for f in silver.read(closed=False).inputFiles())
    assert spark.read.parquet(f"{silver.root}/_ver=4").count() == 2  # one open row, one newly closed; the other bucket is the same
    assert silver.read(2).count() == 3


def test_bucket_count_is_kept(spark, tmp_root):
    cfg = TableConfig("t", ("id",), 1)
    load(Lake(spark, tmp_root, 4), cfg, rows(spark, *((i, "x") for i in range(50))), 1)
    with pytest.raises(ValueError, match="4 buckets"):
        Lake(spark, tmp_root, 16).silver("db", cfg)
    Lake(spark, tmp_root, 4).silver("db", cfg).rebucket(16)
    lake = Lake(spark, tmp_root, 16)
    assert lake.silver("db", cfg).read().select("id").distinct().count() == 50
    assert lake.silver("db", cfg).manifest()["buckets"] == 16


def test_half_written_entries_do_not_count(spark, tmp_root):
    table = VersionedTable(spark, tmp_root, ["id"], 2)
    table.write(rows(spark, (1, "a")), 1)
    table.commit(1)
    os.makedirs(f"{tmp_root}/_commits", exist_ok=True)
    with open(f"{tmp_root}/_commits/2.json", "w") as f:
        f.write('{"version": 2')
    assert table.current_version() == 1 and table.read().count() == 1
    table.write(rows(spark, (2, "b")), 2)
    table.commit(2)
    assert table.current_version() == 2
    with pytest.raises(store.EntryExists):
        store.write_entry(spark, f"{tmp_root}/_commits/2.json", {"version": 2})


def test_a_failing_listing_is_no_empty_table(spark):
    with pytest.raises(Exception, match="nosuchscheme"):
        bz.next_snapshot_id(spark, "nosuchscheme://x/y")


def test_duplicate_keys_are_refused(spark, tmp_root):
    cfg, lake = TableConfig("t", ("id",), 2, steps=(Step("v", "clean_string"),)), Lake(spark, tmp_root, 4)
    with pytest.raises(ValueError, match="duplicate"):
        load(lake, cfg, rows(spark, (1, "a"), (1, "b")), 1)
    assert not lake.silver("db", cfg).exists()


SEEN = "id int, amt int, seen timestamp_ntz"
CURSOR = TableConfig("c", ("id",), 1, load="incremental", cursor="seen", rules=(Rule("sane", "amt < 100", "fail"),))


def cursor(spark, lake, day, *data, cfg=CURSOR):
    return run_cursor_table(lake, DB, cfg, rows(spark, *data, schema=SEEN), f"2026-02-0{day} 00:00:00")


def test_cursor_ties_and_nulls(spark, tmp_root):
    lake = Lake(spark, tmp_root, 4)
    assert cursor(spark, lake, 1, (1, 1, T[0]))["rows"] == 1
    assert cursor(spark, lake, 2, (1, 1, T[0]), (2, 2, T[0]), (3, 3, None))["rows"] == 2
    assert cursor(spark, lake, 3, (1, 1, T[0]), (2, 2, T[0]), (3, 3, None), (4, 4, None))["rows"] == 1
    assert cursor(spark, lake, 4)["rows"] == 0
    assert sorted(r.id for r in read_silver(lake, "db", CURSOR).collect()) == [1, 2, 3, 4]


def test_first_cursor_load_may_be_empty(spark, tmp_root):
    lake = Lake(spark, tmp_root, 4)
    assert cursor(spark, lake, 1)["rows"] == 0
    assert cursor(spark, lake, 2, (1, 1, T[0]))["rows"] == 1


def test_rejected_increment_is_never_published(spark, tmp_root):
    lake = Lake(spark, tmp_root, 4)
    cursor(spark, lake, 1, (1, 1, T[0]))
    for _ in range(2):
        with pytest.raises(ExpectationFailed):
            cursor(spark, lake, 2, (1, 1, T[0]), (2, 500, T[1]))
    cursor(spark, lake, 3, (1, 1, T[0]), (2, 50, T[1]), (3, 3, T[2]))
    assert sorted((r.id, r.amt) for r in read_silver(lake, "db", CURSOR).collect()) == [(1, 1), (2, 50), (3, 3)]


def test_unfinished_increment_is_made_up_for(spark, tmp_root):
    lake = Lake(spark, tmp_root, 4)
    cursor(spark, lake, 1, (1, 1, T[0]))
    path = lake.bronze_path("db", "c")
    from strata.sources.tables import bucket_of

    entry = bz.stage_load(spark, rows(spark, (2, 2, T[1]), schema=SEEN), path, 2, T[1], bucket_of(["id"], 4))
    bz.finish_load(spark, path, 2, entry)  # the run ended here, before Silver
    cursor(spark, lake, 3, (1, 1, T[0]), (2, 2, T[1]), (9, 9, T[2]))
    assert sorted(r.id for r in read_silver(lake, "db", CURSOR).collect()) == [1, 2, 9]


def write_csv(folder, name, lines, when):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    os.utime(path, (when.replace(tzinfo=dt.timezone.utc).timestamp(),) * 2)


def test_csv_columns_go_by_name(spark, tmp_root):
    write_csv(tmp_root, "a.csv", ["code;name;price", "A;x;1.00"], T[0])
    write_csv(tmp_root, "b.csv", ["price;code;name", "2.00;B;y"], T[1])
    write_csv(tmp_root, "c.csv", ["code;name;price;color", "C;z;3.00;red"], T[2])
    got = read_files(spark, tmp_root, "csv", {"header": "true", "delimiter": ";", "schemaHints": "price DECIMAL(5,2)"}, with_lineage=False)
    assert sorted((r.code, r.name, str(r.price), r.color) for r in got.collect()) == [("A", "x", "1.00", None), ("B", "y", "2.00", None), ("C", "z", "3.00", "red")]


def test_file_table_waits_and_survives_a_new_checkpoint(spark, tmp_root):
    src = read_source(CRM_FILES)
    cfg = src.table("products")
    landing = os.path.join(tmp_root, "landing")
    lake = Lake(spark, os.path.join(tmp_root, "lake"), 4)
    assert run_files_table(lake, src, cfg, landing)["bronze_rows"] == 0  # no folder yet
    os.makedirs(landing)
    assert run_files_table(lake, src, cfg, landing)["bronze_rows"] == 0  # no file yet
    head = "product_code;product_name;category;price;valid_from"
    write_csv(landing, "products_1.csv", [head, "A;n;c;1.00;2026-01-01"], T[0])
    run_files_table(lake, src, cfg, landing)
    # the Silver stream loses its checkpoint: its batches count from 0 again
    stale = lake.checkpoint(src.name, cfg.name, "silver")
    os.rename(stale, stale + "-lost")
    write_csv(landing, "products_2.csv", ["product_name;product_code;category;price;valid_from", "m;B;c;2.00;2026-01-02"], T[1])
    run_files_table(lake, src, cfg, landing)
    assert sorted((r.product_code, r.product_name) for r in read_silver(lake, src.name, cfg).collect()) == [("A", "n"), ("B", "m")]


def test_deletes_close_versions(spark):
    data = [(1, 1, "a", False), (1, 2, "a", True), (1, 3, "a", False), (2, 1, "b", True), (3, 1, "c", False)]
    df = rows(spark, *data, schema="k int, s int, v string, gone boolean")
    for kw in ({"hot_key_rows": None}, {"hot_key_rows": 1, "bucket_rows": 1}):
        got = scd2_from_changes(df, ["k"], "s", ["v"], ["gone"], apply_as_deletes="gone", **kw)
        assert sorted((r.k, r[START], r[END], r.v) for r in got.collect()) == [(1, 1, 2, "a"), (1, 3, None, "a"), (3, 1, None, "c")]


def test_map_columns(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, map('a', 1, 'b', 2)), (1, 1, map('b', 2, 'a', 1)), (1, 2, map('a', 1, 'b', 2)), (1, 3, map('a', 5)) AS t(k, s, m)")
    assert dedupe_key_seq(df, ["k"], "s").count() == 3
    assert scd1_from_changes(df, ["k"], "s").first().m == {"a": 5}
    got = scd2_from_changes(df, ["k"], "s").collect()
    assert sorted((r[START], r[END]) for r in got) == [(1, 3), (3, None)]


@pytest.mark.parametrize("text", [False, True])
def test_hot_key_with_an_outlier_is_cut_by_rank(spark, text):
    n = 30_000
    seq = F.when(F.col("id") == 0, F.lit(-10**12)).otherwise(F.col("id"))
    seq = F.format_string("%020d", seq + 10**12) if text else seq
    log = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), seq.alias("s"), F.floor(F.col("id") / 700).alias("a"))
    plain = scd2_from_changes(log, ["k"], "s", ["a"], hot_key_rows=None)
    cut = scd2_from_changes(log, ["k"], "s", ["a"], hot_key_rows=3000, bucket_rows=1000)
    assert plain.exceptAll(cut).count() == 0 and cut.exceptAll(plain).count() == 0
    from strata.operators.changes import _hot_keys

    cuts = _hot_keys(log, ["k"], "s", 3000, 1000).first()["_cuts"]
    at = log.where("k = 0").select(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("s"))).alias("b")).groupBy("b").count().collect()
    assert len(at) == 10 and max(r["count"] for r in at) < 2000


def test_hot_key_through_the_files_pipeline(spark, tmp_root):
    src = read_source(CRM_FILES)
    cfg = replace(src.table("products"), sequence_by="valid_from", steps=(Step("product_code", "clean_string"),), history=("price",))
    landing = os.path.join(tmp_root, "landing")
    os.makedirs(landing)
    head = "product_code;product_name;category;price;valid_from"
    lines = [f"{'H' if i % 3 == 0 else f'K{i}'};n;c;{i // 90};{'1000-01-01' if i == 0 else f'2026-{i:06d}'}" for i in range(3000)]
    for part in range(3):
        write_csv(landing, f"products_{part}.csv", [head, *lines[part::3]], T[part])
    lake = Lake(spark, os.path.join(tmp_root, "lake"), 4)
    run_files_table(lake, src, cfg, landing)
    got = read_silver(lake, src.name, cfg)
    assert got.where("product_code = 'H'").count() == 34 and got.where(f"product_code <> 'H' AND {END} IS NULL").count() == 2000


def test_gold_table_is_replaced_whole(spark, tmp_root):
    path = f"{tmp_root}/gold"
    first = gold.materialize(rows(spark, (1, "a")), path)
    gold.materialize(rows(spark, (2, "b"), (3, "c")), path)
    assert first.count() == 1 and gold.read_materialized(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        gold.read_materialized(spark, f"{tmp_root}/none")


def test_long_ranges_are_not_listed_by_day(spark):
    from strata.operators.joins import validity_join

    t = lambda s: dt.datetime.fromisoformat(s)
    prices = rows(spark, ("A", t("0001-01-01"), t("2026-01-05"), 1), ("A", t("2026-01-05"), t("2026-01-06"), 2), ("A", t("2026-01-06"), None, 3), schema="k string, a timestamp_ntz, b timestamp_ntz, p int")
    facts = rows(spark, ("A", t("1990-05-05")), ("A", t("2026-01-05")), ("A", t("2026-01-05T23:59:59")), ("A", t("2026-01-06")), ("B", t("2026-01-06")), schema="k string, ts timestamp_ntz")
    joined = validity_join(facts, prices, ["k"], "ts", "a", "b")
    assert sorted(r.p for r in joined.select("r.p").collect()) == [1, 2, 2, 3]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2  # facts are read once
