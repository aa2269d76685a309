"""The reference's data model derived from the driver's TPC-H-like tables.

The reference works on a CRM/ERP model (customers, orders, a product price list in CSV
files, usage, job runs).  These functions derive that model deterministically from
``customer``, ``nation``, ``orders``, ``part`` and ``events`` so that every pipeline runs
over whole tables and its work grows with them.  Each derivation is one scan plus narrow
projections (snapshot and file indices are generated with ``explode``, not joins).
The same rules are written in DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values of the derivation --------------------------------------------------------
# snapshot k: source change time and Bronze load time
SNAPSHOT_CHANGED_AT = {1: "2026-01-01 05:00:00", 2: "2026-01-02 05:00:00", 3: "2026-01-03 05:00:00"}
SNAPSHOT_LOADED_AT = {1: "2026-01-01 06:00:00", 2: "2026-01-02 06:00:00", 3: "2026-01-03 06:00:00"}
# product files f: modification time (the sequence) and arrival time; file 4 arrives last but is older
FILE_MODIFIED_AT = {1: "2026-02-01 08:00:00", 2: "2026-02-02 08:00:00", 3: "2026-02-03 08:00:00", 4: "2026-02-01 20:00:00"}
FILE_ARRIVED_AT = {1: "2026-02-01 09:00:00", 2: "2026-02-02 09:00:00", 3: "2026-02-03 09:00:00", 4: "2026-02-03 10:00:00"}
# price list validity boundaries (the last range is open)
PRICE_FROM = ("2024-01-01 00:00:00", "2024-01-10 12:00:00", "2024-01-20 00:00:00")
NEW_CUSTOMER_OFFSET = 1_000_000
NEW_ORDER_OFFSET = 10_000_000
PROJECT = "strata"
# -------------------------------------------------------------------------------------------

DATE_TEXT_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "yyyyMMdd")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


def _case(k: Column, mapping: dict[int, str]) -> Column:
    out = None
    for key, val in mapping.items():
        out = (F.when(k == key, _ts(val))) if out is None else out.when(k == key, _ts(val))
    return out


def _s(c: Column) -> Column:
    return c.cast("string")


def _gen(pairs: list[tuple[int, int]], a: str, b: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for x, y in pairs])).alias("_g")


def customers_snapshots(spark: SparkSession, sf_dir: str, snapshots=(1, 2, 3)) -> DataFrame:
    """Raw customer snapshots (as a source database would deliver them), stacked.

    Columns: _snapshot_id, customer_id, name, email, city, segment, updated_at, _ingested_at.
    Snapshot 2: cities move (id%10=2), segment+email change (id%10=7), name-only change
    (id%10=4), id%20=0 deleted, new customers (id%50=1, id+1e6).  Snapshot 3: id%40=0 return,
    city change (id%10=3).
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pairs = [(k, cp) for k in snapshots for cp in (0, 1)]
    g = c.join(n, c.c_nationkey == n.n_nationkey, "left").select("*", _gen(pairs, "k", "cp")).select("*", "_g.*")
    m, k, cp = F.col("c_custkey"), F.col("k"), F.col("cp")
    present = ((cp == 0) & ((k == 1) | (m % 20 != 0) | ((k == 3) & (m % 40 == 0)))) | (
        (cp == 1) & (k >= 2) & (m % 50 == 1)
    )
    name_base = (
        F.when(m % 4 == 0, F.col("c_name"))
        .when(m % 4 == 1, F.concat(F.lit("  "), F.col("c_name")))
        .when(m % 4 == 2, F.replace(F.col("c_name"), F.lit("#"), F.lit("   ")))
        .otherwise(F.upper(F.col("c_name")))
    )
    ev = m % 13 % 4
    email_base = (
        F.when(ev == 0, F.concat(F.lit("customer"), _s(m), F.lit("@example.com")))
        .when(ev == 1, F.concat(F.lit(" CUSTOMER"), _s(m), F.lit("@Example.COM ")))
        .when(ev == 2, F.concat(F.lit("customer"), _s(m), F.lit("example.com")))
    )
    city_base = (
        F.when(m % 7 == 0, F.concat(F.lit(" "), F.lower(F.col("n_name")), F.lit("  ")))
        .when(m % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("n_name"))
    )
    seg_base = F.when(m % 9 == 0, F.concat(F.lit(" "), F.lower(F.col("c_mktsegment")))).otherwise(F.col("c_mktsegment"))
    changed2 = (k >= 2) & (m % 10).isin(2, 4, 7)
    return g.where(present).select(
        k.alias("_snapshot_id"),
        (m + cp * NEW_CUSTOMER_OFFSET).alias("customer_id"),
        F.when((k >= 2) & (m % 10 == 4), F.concat(name_base, F.lit("  Jr."))).otherwise(name_base).alias("name"),
        F.when((k >= 2) & (m % 10 == 7), F.concat(F.lit("new.address"), _s(m), F.lit("@example.com")))
        .otherwise(email_base)
        .alias("email"),
        F.when((k >= 2) & (m % 10 == 2), F.lit(" Dresden"))
        .when((k >= 3) & (m % 10 == 3), F.lit("Bonn"))
        .otherwise(city_base)
        .alias("city"),
        F.when((k >= 2) & (m % 10 == 7), F.lit("ENTERPRISE")).otherwise(seg_base).alias("segment"),
        F.when((k >= 3) & (m % 10 == 3), _ts(SNAPSHOT_CHANGED_AT[3]))
        .when(changed2 | (cp == 1), _ts(SNAPSHOT_CHANGED_AT[2]))
        .otherwise(_ts(SNAPSHOT_CHANGED_AT[1]))
        .alias("updated_at"),
        _case(k, SNAPSHOT_LOADED_AT).alias("_ingested_at"),
    )


def orders_snapshots(spark: SparkSession, sf_dir: str, snapshots=(1, 2, 3)) -> DataFrame:
    """Raw order snapshots, stacked.

    Columns: _snapshot_id, order_id, customer_id, order_date (text in 4 formats, some junk),
    amount decimal(12,2) (id%101=0 negative), status (messy text), is_deleted, updated_at,
    _ingested_at.  Snapshot 2: open orders ship, id%31=0 soft-deleted, new orders (id%50=3,
    id+1e7, for the new customers).  Snapshot 3: id%53=0 gone, amount +1 for id%10=9.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    pairs = [(k, cp) for k in snapshots for cp in (0, 1)]
    g = o.select("*", _gen(pairs, "k", "cp")).select("*", "_g.*")
    m, k, cp = F.col("o_orderkey"), F.col("k"), F.col("cp")
    present = ((cp == 0) & ~((k == 3) & (m % 53 == 0))) | ((cp == 1) & (k >= 2) & (m % 50 == 3))
    d = F.col("o_orderdate")
    fmt = (
        F.when(m % 4 == 0, F.date_format(d, DATE_TEXT_FORMATS[0]))
        .when(m % 4 == 1, F.date_format(d, DATE_TEXT_FORMATS[1]))
        .when(m % 4 == 2, F.date_format(d, DATE_TEXT_FORMATS[2]))
        .otherwise(F.date_format(d, DATE_TEXT_FORMATS[3]))
    )
    date_text = (
        F.when(m % 97 == 0, F.lit("n/a"))
        .when(m % 89 == 0, F.lit("31/12/1995"))
        .when(m % 8 == 5, F.concat(F.lit(" "), fmt, F.lit(" ")))
        .otherwise(fmt)
    )
    base_amount = F.col("o_totalprice").cast("decimal(12,2)")
    amount = F.when(m % 101 == 0, -base_amount).otherwise(base_amount)
    amount = F.when((k >= 3) & (m % 10 == 9), amount + F.lit(1)).otherwise(amount).cast("decimal(12,2)")
    st = F.col("o_orderstatus")
    status = (
        F.when(st == "O", F.when(k >= 2, F.lit("shipped")).otherwise(F.lit(" open")))
        .when(st == "F", F.when(m % 2 == 0, F.lit("SHIPPED")).otherwise(F.lit("shipped")))
        .otherwise(F.when(m % 3 == 0, F.lit("cancelled ")).otherwise(F.lit("Cancelled")))
    )
    cust = F.when(cp == 1, F.col("o_custkey") - F.col("o_custkey") % 50 + 1 + NEW_CUSTOMER_OFFSET).otherwise(F.col("o_custkey"))
    updated = (
        F.when(cp == 1, _ts(SNAPSHOT_CHANGED_AT[2]))
        .when((k >= 3) & (m % 10 == 9), _ts(SNAPSHOT_CHANGED_AT[3]))
        .when((k >= 2) & ((st == "O") | (m % 31 == 0)), _ts(SNAPSHOT_CHANGED_AT[2]))
        .otherwise(_ts(SNAPSHOT_CHANGED_AT[1]))
    )
    return g.where(present).select(
        k.alias("_snapshot_id"),
        (m + cp * NEW_ORDER_OFFSET).alias("order_id"),
        F.when(m % 37 == 0, F.lit(None).cast("bigint")).otherwise(cust).alias("customer_id"),
        date_text.alias("order_date"),
        amount.alias("amount"),
        status.alias("status"),
        ((k >= 2) & (m % 31 == 0)).alias("is_deleted"),
        updated.alias("updated_at"),
        _case(k, SNAPSHOT_LOADED_AT).alias("_ingested_at"),
    )


def products_changes(spark: SparkSession, sf_dir: str, files=(1, 2, 3, 4)) -> DataFrame:
    """Rows of the product CSV files as Bronze holds them (all text plus lineage columns).

    Columns: product_code, product_name, category, price, valid_from, _file_path,
    _file_modification_time, _ingested_at.  File 1: every part, exact duplicates for id%7=0,
    no price for id%11=0, padded codes for id%6=0.  File 2: price +10 (id%5=0), new
    valid_from only (id%3=0), the same padded codes written clean (id%6=0).  File 3: price
    back (id%10=0).  File 4 arrives last but is older than file 2: category change (id%13=0).
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    pairs = [(f, d) for f in files for d in ((0, 1) if f == 1 else (0,))]
    g = p.select("*", _gen(pairs, "f", "dup")).select("*", "_g.*")
    m, f, dup = F.col("p_partkey"), F.col("f"), F.col("dup")
    present = (
        ((f == 1) & ((dup == 0) | (m % 7 == 0)))
        | ((f == 2) & ((m % 5 == 0) | (m % 3 == 0) | (m % 6 == 0)))
        | ((f == 3) & (m % 10 == 0))
        | ((f == 4) & (m % 13 == 0))
    )
    code = F.when((m % 6 == 0) & (f != 2), F.concat(F.lit(" P-"), _s(m), F.lit(" "))).otherwise(F.concat(F.lit("P-"), _s(m)))
    name = F.when(m % 4 == 1, F.replace(F.col("p_name"), F.lit(" "), F.lit("   "))).otherwise(F.col("p_name"))
    category = (
        F.when(f == 4, F.lit("Refurbished"))
        .when(m % 9 == 0, F.concat(F.lit(" "), F.lower(F.col("p_type")), F.lit(" ")))
        .otherwise(F.col("p_type"))
    )
    base = F.col("p_retailprice").cast("decimal(12,2)")
    price = (
        F.when((f == 1) & (m % 11 == 0), F.lit(None).cast("string"))
        .when((f == 2) & (m % 5 == 0), _s((base + F.lit(10)).cast("decimal(12,2)")))
        .otherwise(_s(base))
    )
    day = (m % 28).cast("int")
    vdate = (
        F.when(f == 1, F.date_add(F.lit("2026-01-01").cast("date"), day))
        .when(f == 2, F.date_add(F.lit("2026-03-01").cast("date"), day))
        .when(f == 3, F.date_add(F.lit("2026-05-01").cast("date"), day))
        .otherwise(F.date_add(F.lit("2026-02-15").cast("date"), day))
    )
    vtext = (
        F.when(m % 4 == 0, F.date_format(vdate, DATE_TEXT_FORMATS[0]))
        .when(m % 4 == 1, F.date_format(vdate, DATE_TEXT_FORMATS[1]))
        .when(m % 4 == 2, F.date_format(vdate, DATE_TEXT_FORMATS[2]))
        .otherwise(F.date_format(vdate, DATE_TEXT_FORMATS[3]))
    )
    return g.where(present).select(
        code.alias("product_code"),
        name.alias("product_name"),
        category.alias("category"),
        price.alias("price"),
        vtext.alias("valid_from"),
        F.concat(F.lit("products_f"), _s(f), F.lit(".csv")).alias("_file_path"),
        _case(f, FILE_MODIFIED_AT).alias("_file_modification_time"),
        _case(f, FILE_ARRIVED_AT).alias("_ingested_at"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing usage from ``events``: one usage record per event.

    Columns: usage_date, billing_origin_product, custom_tags map, usage_quantity decimal(12,2),
    sku_name, usage_start_time.
    """
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    u = F.col("user_id")
    env = F.when(u % 3 == 0, F.lit("dev")).when(u % 3 == 1, F.lit("tst")).otherwise(F.lit("prd"))
    project = F.when(u % 10 == 0, F.lit("other")).otherwise(F.lit(PROJECT))
    return e.select(
        F.to_date("ts").alias("usage_date"),
        F.when(u % 2 == 0, F.lit("JOBS")).otherwise(F.lit("SQL")).alias("billing_origin_product"),
        F.create_map(F.lit("project"), project, F.lit("env"), env).alias("custom_tags"),
        F.col("value").cast("decimal(12,2)").alias("usage_quantity"),
        F.upper("event_type").alias("sku_name"),
        F.col("ts").alias("usage_start_time"),
    )


def list_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price list: three validity ranges per SKU seen in ``events`` (the last one open).

    Columns: sku_name, price_start_time, price_end_time (NULL = open), pricing struct<default>.
    """
    skus = table(spark, sf_dir, "events").select(F.upper("event_type").alias("sku_name")).distinct()
    idx = F.explode(F.array(*[F.lit(i) for i in range(len(PRICE_FROM))])).alias("i")
    g = skus.select("sku_name", idx)
    i = F.col("i")
    start = F.when(i == 0, _ts(PRICE_FROM[0])).when(i == 1, _ts(PRICE_FROM[1])).otherwise(_ts(PRICE_FROM[2]))
    end = F.when(i == 0, _ts(PRICE_FROM[1])).when(i == 1, _ts(PRICE_FROM[2]))
    price = ((F.length("sku_name") * F.lit(10) + i * F.lit(5)).cast("decimal(10,4)") / F.lit(100)).cast("decimal(10,4)")
    return g.select(
        "sku_name",
        start.alias("price_start_time"),
        end.alias("price_end_time"),
        F.struct(price.alias("default")).alias("pricing"),
    )


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job run timeline from ``events``: one run per event.

    Columns: workspace_id, job_id, run_id, period_start_time, period_end_time, result_state.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    secs = F.floor(F.col("value") * 60).cast("int")
    state = (
        F.when(F.col("event_type") == "error", F.lit("FAILED"))
        .when(F.col("event_type") == "signup", F.lit("CANCELED"))
        .otherwise(F.lit("SUCCEEDED"))
    )
    return e.select(
        (F.col("user_id") % 4).alias("workspace_id"),
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("run_id"),
        F.col("ts").alias("period_start_time"),
        F.timestamp_add("SECOND", secs, F.col("ts")).alias("period_end_time"),
        state.alias("result_state"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job catalogue: one row per (workspace_id, job_id) seen in ``events``."""
    e = table(spark, sf_dir, "events").select("user_id")
    return (
        e.select((F.col("user_id") % 4).alias("workspace_id"), F.col("user_id").alias("job_id"))
        .distinct()
        .select("workspace_id", "job_id", F.concat(F.lit("job_"), _s(F.col("job_id"))).alias("name"))
    )
