"""Change batches merged into a table: the same table as from all changes at once, and work that follows the batch."""

import datetime as dt
import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.config import Rule, SourceConfig, TableConfig, read_source
from strata.operators.keys import END, START
from strata.plans.catalog import CRM_FILES
from strata.plans.pipeline import Lake, load_source_table, read_silver, run_cursor_table, run_files_table, run_snapshot_table
from strata.plans.silver import changes_view, scd_from_changes
from strata.sources import bronze as bz
from strata.sources.files import read_files
from strata.sources.schemas import merged, promoted
from strata.sources.tables import AREA, BUCKET, VERSION, VersionedTable, bucket_of
from strata.streaming.ingest import apply_changes_stream, apply_loads

SCHEMA = "k string, s int, v string, note string, gone boolean"
ALL = ["k", "s", "v", "note", "gone"]


def table(spark, root, cfg, buckets=4):
    return VersionedTable(spark, f"{root}/silver", cfg.keys, buckets)


def stage(spark, root, cfg, data, load, buckets=4, schema=SCHEMA):
    df = spark.createDataFrame(data, schema)
    return bz.stage_load(spark, df, f"{root}/bronze", load, "2026-01-01", bucket_of(cfg.keys, buckets), buckets)


def take(spark, root, cfg, data, load, silver=None, buckets=4, schema=SCHEMA):
    bz.finish_load(spark, f"{root}/bronze", load, stage(spark, root, cfg, data, load, buckets, schema))
    silver = silver or table(spark, root, cfg, buckets)
    return apply_loads(spark, f"{root}/bronze", silver, cfg, [load])


def shown(df, cols):
    return sorted((tuple(str(r[c]) for c in cols) for r in df.collect()), key=repr)


def batches(seed, deletes):
    r = random.Random(seed)
    out, high = [], 0
    for _ in range(3):
        rows = []
        for _ in range(r.randint(1, 25)):
            s = None if r.random() < 0.05 else r.randint(high, high + 6) if r.random() < 0.7 else r.randint(0, max(1, high))
            rows.append((r.choice(["a", "b", "c", None, "e", "f"]), s, r.choice("xy"), r.choice("mno"), deletes and r.random() < 0.2))
        high += 4
        out.append(rows)
    return out


@pytest.mark.parametrize(("scd_type", "deletes", "seed"), [(2, True, 3), (1, True, 5)])
def test_batches_give_what_all_changes_give(spark, tmp_root, scd_type, deletes, seed):
    cfg = TableConfig("t", ("k",), scd_type, history=("v",) if scd_type == 2 else None, sequence_by="s", deletes="gone" if deletes else None)
    everything = []
    for load, rows in enumerate(batches(seed, deletes), 1):
        everything += rows
        take(spark, tmp_root, cfg, rows, load)
        whole = scd_from_changes(changes_view(spark.createDataFrame(everything, SCHEMA), cfg).df, cfg)
        cols = ALL + ([START, END] if scd_type == 2 else [])
        assert shown(table(spark, tmp_root, cfg).read(), cols) == shown(whole, cols), load


def test_work_follows_the_batch(spark, tmp_root):
    cfg = TableConfig("t", ("k",), 2, history=("v",), sequence_by="s")
    take(spark, tmp_root, cfg, [(f"k{i}", 1, "x", "m", False) for i in range(500)], 1)
    silver = table(spark, tmp_root, cfg)
    take(spark, tmp_root, cfg, [("k7", 2, "y", "m", False), ("new", 2, "y", "m", False), ("k8", 2, "x", "n", False)], 2)
    written = spark.read.option("basePath", f"{silver.root}/{VERSION}=2").parquet(f"{silver.root}/{VERSION}=2")
    assert sorted((r.k, r.s, r[AREA]) for r in written.collect()) == [("k7", 1, "closed"), ("k7", 2, "open"), ("k8", 2, "open"), ("new", 2, "open")]
    # a late change rewrites its key's versions and no other's, and reads the key's bucket of Bronze only
    take(spark, tmp_root, cfg, [("k7", 0, "z", "m", False)], 3)
    written = spark.read.option("basePath", f"{silver.root}/{VERSION}=3").parquet(f"{silver.root}/{VERSION}=3")
    assert {r.k for r in written.collect()} == {"k7"} and written.where(f"{AREA} = 'void'").count() == 1
    assert shown(silver.read().where("k = 'k7'"), ["s", "v", START, END]) == [("0", "z", "0", "1"), ("1", "x", "1", "2"), ("2", "y", "2", "None")]
    assert silver.read().count() == 501 + 2


def test_changes_after_all_that_is_stored_look_at_no_last_rows(spark, tmp_root, monkeypatch):
    cfg = TableConfig("t", ("k",), 1, sequence_by="s", deletes="gone")
    looked, read_state = [], VersionedTable.read_state
    monkeypatch.setattr(VersionedTable, "read_state", lambda self, *a, **kw: looked.append(1) or read_state(self, *a, **kw))
    everything = []
    for load, (rows, looks) in enumerate(
        [
            ([(k, 5, "x", "m", False) for k in ("a", "b", "c", None, "e")] + [("d", None, "x", "m", False)], False),
            ([("a", 6, "y", "m", False), (None, 7, "y", "m", True), ("d", 6, "y", "m", False), ("new", 6, "y", "m", False)], False),
            ([("a", 8, "z", "m", False), ("b", 4, "old", "m", False), (None, 6, "old", "m", False), ("c", 5, "a", "tie", False), ("e", None, "old", "m", False), ("n2", 1, "z", "m", False)], True),
            ([("c", 9, "w", "m", False), (None, 9, "w", "m", False)], False),
        ],
        1,
    ):
        everything += rows
        looked.clear()
        take(spark, tmp_root, cfg, rows, load)
        assert bool(looked) == looks, load
        whole = scd_from_changes(changes_view(spark.createDataFrame(everything, SCHEMA), cfg).df, cfg)
        assert shown(table(spark, tmp_root, cfg).read(), ALL) == shown(whole, ALL), load


def test_increment_compares_rows_in_one_aggregate(spark):
    schema = "k int, v string, at timestamp_ntz, x bigint"
    day = [dt.datetime(2026, 1, d) for d in (1, 2)]
    held = spark.createDataFrame([(1, "a", day[0], None), (1, "a", day[0], None), (2, None, None, 1), (3, "c", day[0], 2)], schema)
    new = [(2, "b", None, 1), (4, None, day[0], None), (5, "e", day[1], 3), (5, "e", day[1], 3)]
    source = spark.createDataFrame([(1, "a", day[0], None), (2, None, None, 1), (3, "c", day[0], 2), *new], schema)
    many = spark.range(2500).selectExpr("cast(3 as int) k", "'copy' v", "timestamp_ntz '2026-01-01' at", "2L x")
    out = bz.cursor_increment(source.unionByName(many), held, "at")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.k, r.v, r.at): r.n for r in out.groupBy("k", "v", "at").agg(F.count("*").alias("n")).collect()}
    assert got == {(2, "b", None): 1, (4, None, day[0]): 1, (5, "e", day[1]): 2, (3, "copy", day[0]): 2500}
    # floating point keeps the join: grouping would make 0.0 of -0.0
    some = spark.createDataFrame([(1, -0.0)], "k int, f double")
    assert str(bz.cursor_increment(some, some.where("false"), "k", F.lit(1)).first().f) == "-0.0"


def test_compaction_keeps_the_table_and_bounds_scans(spark, tmp_root, monkeypatch):
    monkeypatch.setattr(VersionedTable.compact, "__defaults__", (3,))
    cfg = TableConfig("t", ("k",), 2, history=("v",), sequence_by="s", deletes="gone")
    everything = []
    for load in range(1, 7):
        rows = [("a", load, "xy"[load % 2], "m", load % 4 == 0), (f"b{load % 3}", load, "x", "m", False)] + ([("a", load - 3, "z", "m", False)] if load % 5 == 0 else [])
        everything += rows
        take(spark, tmp_root, cfg, rows, load, buckets=2)
    silver = table(spark, tmp_root, cfg, 2)
    whole = scd_from_changes(changes_view(spark.createDataFrame(everything, SCHEMA), cfg).df, cfg)
    assert shown(silver.read(), [*ALL, START, END]) == shown(whole, [*ALL, START, END])
    assert max(len(v) for v in silver.manifest()["rows"].values()) < 3
    assert silver.read()._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 4
    assert silver.current_version() > 6  # compactions are versions of their own
    assert silver.last_load() == 6


def test_changes_after_another_number_of_buckets(spark, tmp_root):
    cfg = TableConfig("t", ("k",), 2, history=("v",), sequence_by="s")
    rows = [(f"k{i}", 1, "x", "m", False) for i in range(50)]
    take(spark, tmp_root, cfg, rows, 1, buckets=4)
    silver = table(spark, tmp_root, cfg).rebucket(16)
    more = [("k3", 2, "y", "m", False), ("k4", 0, "y", "m", False), ("k5", 2, "x", "m", False)]
    take(spark, tmp_root, cfg, more, 2, table(spark, tmp_root, cfg, 16), buckets=16)
    late = [("k3", 0, "w", "m", False)]
    take(spark, tmp_root, cfg, late, 3, table(spark, tmp_root, cfg, 16), buckets=16)
    whole = scd_from_changes(changes_view(spark.createDataFrame(rows + more + late, SCHEMA), cfg).df, cfg)
    assert shown(silver.read(), [*ALL, START, END]) == shown(whole, [*ALL, START, END])


# -- the three load paths over a table that is dealt anew --------------------------------------
DB = SourceConfig("db", "sqlserver")


def snap(spark, lake, cfg, data, day, schema="id int, v string"):
    load_source_table(lake, DB, cfg, spark.createDataFrame(data, schema), f"2026-01-0{day} 06:00:00")
    return run_snapshot_table(lake, DB, cfg)


@pytest.mark.parametrize("scd_type", [1, 2])
def test_snapshot_after_rebucket(spark, tmp_root, scd_type):
    cfg = TableConfig("t", ("id",), scd_type)
    snap(spark, Lake(spark, tmp_root, 4), cfg, [(i, "a") for i in range(50)], 1)
    Lake(spark, tmp_root, 4).silver("db", cfg).rebucket(16)
    lake = Lake(spark, tmp_root, 16)
    out = snap(spark, lake, cfg, [(i, "b" if i < 3 else "a") for i in range(50)], 2)
    assert "skipped" not in out and out["version"] == 3
    got = read_silver(lake, "db", cfg)
    assert got.where("v = 'b'").count() == 3 and got.count() == (50 if scd_type == 1 else 53)
    assert run_snapshot_table(lake, DB, cfg)["skipped"]


def test_cursor_load_after_rebucket(spark, tmp_root):
    cfg = TableConfig("c", ("id",), 1, load="incremental", cursor="seen")
    t = [dt.datetime(2026, 1, d) for d in range(1, 6)]
    schema = "id int, amt int, seen timestamp_ntz"
    run = lambda lake, data: run_cursor_table(lake, DB, cfg, spark.createDataFrame(data, schema))
    run(Lake(spark, tmp_root, 4), [(i, 0, t[0]) for i in range(47)])
    Lake(spark, tmp_root, 4).silver("db", cfg).rebucket(16)
    lake = Lake(spark, tmp_root, 16)
    run(lake, [(i, 0, t[0]) for i in range(47)] + [(1, 1, t[1]), (2, 1, t[1]), (47, 1, t[1])])
    run(lake, [(48, 1, t[2]), (49, 1, t[2])])
    got = read_silver(lake, "db", cfg)
    assert got.count() == 50 and got.where("amt = 1").count() == 5


def export(folder, name, lines, when):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    os.utime(path, (when.replace(tzinfo=dt.timezone.utc).timestamp(),) * 2)


DAY = [dt.datetime(2026, 1, d, 6) for d in range(1, 9)]


def test_files_after_rebucket(spark, tmp_root):
    src = read_source(CRM_FILES)
    cfg, landing = src.table("products"), os.path.join(tmp_root, "landing")
    os.makedirs(landing)
    head = "product_code;product_name;category;price;valid_from"
    export(landing, "products_1.csv", [head, *(f"P{i};n;c;1.00;2026-01-01" for i in range(50))], DAY[2])
    root = os.path.join(tmp_root, "lake")
    run_files_table(Lake(spark, root, 4), src, cfg, landing)
    Lake(spark, root, 4).silver(src.name, cfg).rebucket(16)
    lake = Lake(spark, root, 16)
    export(landing, "products_2.csv", [head, *(f"P{i};n;c;2.00;2026-01-01" for i in range(3))], DAY[3])
    run_files_table(lake, src, cfg, landing)
    assert read_silver(lake, src.name, cfg).count() == 53
    export(landing, "products_0.csv", [head, "P0;n;c;0.50;2026-01-01"], DAY[0])
    run_files_table(lake, src, cfg, landing)
    got = sorted((r[START].day, r.price) for r in read_silver(lake, src.name, cfg).where("product_code = 'P0'").collect())
    assert got == [(1, "0.50"), (3, "1.00"), (4, "2.00")]


def test_a_staged_load_is_taken_after_it_is_finished(spark, tmp_root):
    cfg = TableConfig("t", ("k",), 2, history=("v",), sequence_by="s", rules=(Rule("named", "k IS NOT NULL", "warn"),))
    silver, path, point = table(spark, tmp_root, cfg), f"{tmp_root}/bronze", f"{tmp_root}/checkpoint"
    bz.finish_load(spark, path, 1, stage(spark, tmp_root, cfg, [("a", 1, "x", "m", False)], 1))
    entry = stage(spark, tmp_root, cfg, [("b", 1, "x", "m", False)], 2)
    assert [m["rules"]["named"]["passed"] for m in apply_changes_stream(spark, path, silver, cfg, point)] == [1]
    assert sorted(r.k for r in silver.read().collect()) == ["a"]
    bz.finish_load(spark, path, 2, entry)
    apply_changes_stream(spark, path, silver, cfg, point)
    assert sorted(r.k for r in silver.read().collect()) == ["a", "b"]
    assert apply_changes_stream(spark, path, silver, cfg, point) == []


# -- buckets of a snapshot that did not change -------------------------------------------------
@pytest.mark.parametrize("scd_type", [1, 2])
def test_one_changed_key_writes_one_bucket(spark, tmp_root, scd_type):
    cfg, lake = TableConfig("t", ("id",), scd_type, rules=(Rule("id", "id IS NOT NULL", "drop"),)), Lake(spark, tmp_root, 8)
    data = [(i, None if i % 3 else "a") for i in range(200)]
    assert snap(spark, lake, cfg, data, 1)["changed"] == 8
    assert snap(spark, lake, cfg, data[::-1], 2)["changed"] == 0
    out = snap(spark, lake, cfg, [(7, "new"), *(d for d in data if d[0] != 7)], 3)
    assert out["changed"] == 1 and out["rules"]["id"] == {"action": "drop", "failed": 0, "passed": 200}
    silver = lake.silver("db", cfg)
    assert set(os.listdir(f"{silver.root}/{VERSION}=3")) - {"_SUCCESS"} <= {"_area=open", "_area=closed", "._SUCCESS.crc"}
    assert len([n for n in os.listdir(f"{silver.root}/{VERSION}=3/_area=open") if n.startswith(BUCKET)]) == 1
    assert silver.read().count() == (200 if scd_type == 1 else 201)
    assert snap(spark, lake, cfg, [d for d in data if d[0] != 9], 4)["changed"] == 2  # 7 is back at its value, 9 is gone
    assert {r.id for r in silver.read().where(F.lit(True) if scd_type == 1 else F.col(END).isNull()).collect()} == set(range(200)) - {9}


def test_a_repeated_key_is_refused_in_changed_buckets(spark, tmp_root):
    cfg, lake = TableConfig("t", ("id",), 2), Lake(spark, tmp_root, 8)
    snap(spark, lake, cfg, [(i, "a") for i in range(50)], 1)
    with pytest.raises(ValueError, match="duplicate"):
        snap(spark, lake, cfg, [(3, "b"), *((i, "a") for i in range(50))], 2)
    assert lake.silver("db", cfg).current_version() == 1


# -- columns that come, go and change their type -----------------------------------------------
def test_columns_come_and_go(spark, tmp_root):
    cfg, lake = TableConfig("t", ("id",), 2), Lake(spark, tmp_root, 4)
    snap(spark, lake, cfg, [(1, "a"), (2, "b")], 1)
    snap(spark, lake, cfg, [(1, "a", 5), (2, "b", None)], 2, "id int, v string, n int")
    snap(spark, lake, cfg, [(1, 5_000_000_000), (2, None)], 3, "id int, n bigint")
    got = read_silver(lake, "db", cfg)
    assert got.schema["n"].dataType == T.LongType()
    day = lambda t: t and t.day
    rows = {(r.id, r.v, r.n, day(r[START]), day(r[END])) for r in got.collect()}
    assert rows == {(1, "a", None, 1, 2), (1, "a", 5, 2, 3), (1, None, 5_000_000_000, 3, None), (2, "b", None, 1, 3), (2, None, None, 3, None)}


def test_a_key_of_another_type_is_the_same_key_or_refused(spark, tmp_root):
    cfg, lake = TableConfig("t", ("id",), 2), Lake(spark, tmp_root, 4)
    snap(spark, lake, cfg, [(1, "a"), (2, "b")], 1, "id bigint, v string")
    snap(spark, lake, cfg, [("1", "a"), ("2", "c")], 2, "id string, v string")
    got = sorted((r.id, r.v, r[END] is None) for r in read_silver(lake, "db", cfg).collect())
    assert got == [(1, "a", True), (2, "b", False), (2, "c", True)]
    with pytest.raises(Exception, match="not of the table's type"):
        snap(spark, lake, cfg, [("x1", "a")], 3, "id string, v string")
    assert lake.silver("db", cfg).last_load() == 2


def test_json_values_change_their_type(spark, tmp_root):
    base = read_source(CRM_FILES)
    cfg = TableConfig("j", ("id",), 2, history=("v",), sequence_by="_file_modification_time", pattern="*.json")
    src, landing = replace(base, format="json", options={}, tables=(cfg,)), os.path.join(tmp_root, "landing")
    os.makedirs(landing)
    lake = Lake(spark, os.path.join(tmp_root, "lake"), 2)
    for i, v in enumerate(("1", "1.5", '"x"', "true")):
        export(landing, f"{i}.json", ['{"id": "a", "v": %s%s}' % (v, ', "w": [1, 2]' if i == 2 else "")], DAY[i])
        run_files_table(lake, src, cfg, landing)
    got = read_silver(lake, src.name, cfg)
    assert [r.v for r in got.orderBy(START).collect()] == ["1", "1.5", "x", "true"]
    assert [r.w for r in got.orderBy(START).collect()] == [None, None, ["1", "2"], None]
    hinted = read_files(spark, landing, "json", {"schemaHints": "v DOUBLE"}, with_lineage=False, paths=[os.path.join(landing, n) for n in ("0.json", "1.json")])
    assert sorted(r.v for r in hinted.collect()) == [1.0, 1.5]


def test_bronze_loads_of_different_types(spark, tmp_root):
    for load, (data, schema) in enumerate([([(1, 1)], "k int, v int"), ([(2, 2.5)], "k int, v double"), ([(3, "z")], "k int, v string")], 1):
        bz.finish_load(spark, tmp_root, load, bz.stage_load(spark, spark.createDataFrame(data, schema), tmp_root, load, "2026-01-01"))
    assert sorted((r.k, r.v) for r in bz.read_loads(spark, tmp_root).collect()) == [(1, "1"), (2, "2.5"), (3, "z")]
    assert sorted((r.k, r.v) for r in bz.read_loads(spark, tmp_root, [1, 2]).collect()) == [(1, 1.0), (2, 2.5)]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("int", "bigint", "bigint"), ("int", "decimal(5,2)", "decimal(12,2)"), ("decimal(12,2)", "decimal(10,4)", "decimal(14,4)"), ("int", "double", "double"),
        ("float", "double", "double"), ("bigint", "double", "string"), ("date", "timestamp_ntz", "timestamp_ntz"), ("boolean", "int", "string"), ("int", "string", "string"),
        ("array<int>", "array<bigint>", "array<bigint>"), ("struct<a:int>", "struct<a:double,b:string>", "struct<a:double,b:string>"),
    ],
)
def test_promotion(a, b, want):
    a, b, want = (T.StructType.fromDDL(f"x {t}")["x"].dataType for t in (a, b, want))
    assert promoted(a, b) == want and promoted(b, a) == want


def test_no_type_for_nested_and_plain():
    with pytest.raises(TypeError):
        merged([T.StructType.fromDDL("x int"), T.StructType.fromDDL("x array<int>")])


# -- what the log and the versions hold ---------------------------------------------------------
def test_profiles_add_up_without_reading_rows(spark, tmp_root):
    schema = "id int, v string, at timestamp_ntz, x double"
    parts = [[(i, None if i % 4 else f"v{i}", DAY[i % 3], float(i)) for i in range(a, a + 300)] for a in (0, 200)]
    for load, data in enumerate([*parts, []], 1):
        bz.load_snapshot(spark, spark.createDataFrame(data, schema), tmp_root, "t", "2026-01-01", sketches=True)
    bz.load_snapshot(spark, spark.createDataFrame([(1,)], "id int"), tmp_root, "t", "2026-01-01")
    told = bz.load_profile(spark, tmp_root, ["v", "x", "id"], "at")
    assert told.inputFiles() == []
    got = {r.column_name: r for r in told.collect()}
    assert got["v"].asDict() == {"column_name": "v", "rows": 601, "nulls": 451, "null_rate": 451 / 601, "max_ts": DAY[2], "distinct_about": 125, "median_about": None}
    assert got["x"].nulls == 1 and abs(got["x"].median_about - 250) < 15 and abs(got["id"].distinct_about - 500) < 25
    one = bz.load_profile(spark, tmp_root, ["v"], "at", [1]).first()
    assert (one.rows, one.nulls, one.distinct_about) == (300, 225, 75)


def test_stored_feed(spark, tmp_root):
    from strata.operators.snapshots import change_feed

    cfg, lake = TableConfig("t", ("id",), 2), Lake(spark, tmp_root, 4)
    loads = [[(1, "a"), (2, "b"), (3, None), (None, "n")], [(1, "a"), (2, "c"), (4, "d"), (None, "m")], [(2, "c"), (3, None), (4, None)], []]
    for day, data in enumerate(loads, 1):
        snap(spark, lake, cfg, data, day)
    silver = lake.silver("db", cfg)
    silver.rebucket(3)
    silver = VersionedTable(spark, silver.root, ["id"], 3)
    cols = ["id", "v", "_change_type", "_commit_version"]
    frames = [spark.createDataFrame(x, "id int, v string") for x in [[], *loads]]
    for k in range(4):
        assert shown(silver.change_feed(k, k + 1), cols) == shown(change_feed(frames[k], frames[k + 1], ["id"], k + 1), cols)
    whole = [r for k in range(4) for r in shown(change_feed(frames[k], frames[k + 1], ["id"], k + 1), cols)]
    assert shown(silver.change_feed(0), cols) == sorted(whole, key=repr)
    assert all(f"{VERSION}=2" in f for f in silver.change_feed(1, 2).inputFiles())


def test_cursor_marks_come_from_the_log(spark, tmp_root):
    cfg = TableConfig("c", ("id",), 1, load="incremental", cursor="n")
    lake, path = Lake(spark, tmp_root, 2), Lake(spark, tmp_root, 2).bronze_path("db", "c")
    run = lambda data: run_cursor_table(lake, DB, cfg, spark.createDataFrame(data, "id int, n int"))["rows"]
    assert run([(1, 5), (2, 10)]) == 2 and run([(1, 5), (2, 10), (3, 10), (4, 9)]) == 1 and run([(5, 100), (6, None)]) == 2
    assert run([(2, 10), (5, 100), (6, None), (7, 100)]) == 1
    edge, mark = bz.cursor_edge(spark, path, "n")
    assert spark.range(1).select(mark).first()[0] == 100
    assert {f.split("_snapshot_id=")[1][0] for f in edge.inputFiles()} == {"3", "4"}
    assert read_silver(lake, "db", cfg).count() == 6


def test_rejected_increment_is_not_in_the_registered_table(spark, tmp_root):
    cfg = TableConfig("c", ("id",), 1, load="incremental", cursor="n", rules=(Rule("sane", "n < 100", "fail"),))
    lake = Lake(spark, tmp_root, 2)
    run_cursor_table(lake, DB, cfg, spark.createDataFrame([(1, 5)], "id int, n int"))
    with pytest.raises(Exception, match="sane"):
        run_cursor_table(lake, DB, cfg, spark.createDataFrame([(2, 500)], "id int, n int"))
    name = bz.register_table(spark, "strata_rejected", lake.bronze_path("db", "c"))
    try:
        assert [r.id for r in spark.table(name).collect()] == [1]
    finally:
        spark.sql(f"DROP TABLE {name}")
