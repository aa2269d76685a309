"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code from the same rules: the derivation of the
reference's data model (``strata.sources.model``) and the operator semantics.  Oracle
traps handled here: DuckDB's ``\\s`` lacks \\x0B (explicit class instead), DuckDB's
``strptime`` is laxer than Spark's patterns (guarded by a full-match regex), sums of
decimals are cast to Spark's result types, months are cast to DATE.
"""

from __future__ import annotations

from strata.sources import model

_WS = r"[\t\n\x0B\f\r ]+"


def CLEAN(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '{_WS}', ' ', 'g')), '')"


def EMAIL(x: str) -> str:
    sq = f"lower(replace({CLEAN(x)}, ' ', ''))"
    return f"(CASE WHEN regexp_full_match({sq}, '[^@]+@[^@]+') THEN {sq} END)"


def PARSE(x: str) -> str:
    c = CLEAN(x)
    parts = [
        (r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"),
        (r"\d{2}\.\d{2}\.\d{4}", "%d.%m.%Y"),
        (r"\d{2}/\d{2}/\d{4}", "%m/%d/%Y"),
        (r"\d{8}", "%Y%m%d"),
    ]
    alts = ", ".join(f"CASE WHEN regexp_full_match({c}, '{rx}') THEN try_strptime({c}, '{fmt}') END" for rx, fmt in parts)
    return f"CAST(coalesce({alts}) AS DATE)"


def MASK(x: str) -> str:
    return f"regexp_replace({x}, '^(.).*(@.*)$', '\\1***\\2')"


def TS(s: str) -> str:
    return f"TIMESTAMP '{s}'"


def _case_ts(col: str, mapping: dict[int, str]) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN {k} THEN {TS(v)}" for k, v in mapping.items()) + " END"


CH = model.SNAPSHOT_CHANGED_AT
LD = model.SNAPSHOT_LOADED_AT

CUSTOMERS_RAW = f"""
SELECT g.k AS _snapshot_id,
  c.c_custkey + g.cp * {model.NEW_CUSTOMER_OFFSET} AS customer_id,
  CASE WHEN g.k >= 2 AND c.c_custkey % 10 = 4 THEN nb || '  Jr.' ELSE nb END AS name,
  CASE WHEN g.k >= 2 AND c.c_custkey % 10 = 7 THEN 'new.address' || CAST(c.c_custkey AS VARCHAR) || '@example.com'
       ELSE CASE c.c_custkey % 13 % 4
              WHEN 0 THEN 'customer' || CAST(c.c_custkey AS VARCHAR) || '@example.com'
              WHEN 1 THEN ' CUSTOMER' || CAST(c.c_custkey AS VARCHAR) || '@Example.COM '
              WHEN 2 THEN 'customer' || CAST(c.c_custkey AS VARCHAR) || 'example.com' END END AS email,
  CASE WHEN g.k >= 2 AND c.c_custkey % 10 = 2 THEN ' Dresden'
       WHEN g.k >= 3 AND c.c_custkey % 10 = 3 THEN 'Bonn'
       WHEN c.c_custkey % 7 = 0 THEN ' ' || lower(n.n_name) || '  '
       WHEN c.c_custkey % 11 = 0 THEN NULL
       ELSE n.n_name END AS city,
  CASE WHEN g.k >= 2 AND c.c_custkey % 10 = 7 THEN 'ENTERPRISE'
       WHEN c.c_custkey % 9 = 0 THEN ' ' || lower(c.c_mktsegment)
       ELSE c.c_mktsegment END AS segment,
  CASE WHEN g.k >= 3 AND c.c_custkey % 10 = 3 THEN {TS(CH[3])}
       WHEN (g.k >= 2 AND c.c_custkey % 10 IN (2, 4, 7)) OR g.cp = 1 THEN {TS(CH[2])}
       ELSE {TS(CH[1])} END AS updated_at,
  {_case_ts('g.k', LD)} AS _ingested_at
FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '  ' || c_name
                 WHEN 2 THEN replace(c_name, '#', '   ') ELSE upper(c_name) END AS nb FROM customer) c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
CROSS JOIN (VALUES (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1)) g(k, cp)
WHERE (g.cp = 0 AND (g.k = 1 OR c.c_custkey % 20 <> 0 OR (g.k = 3 AND c.c_custkey % 40 = 0)))
   OR (g.cp = 1 AND g.k >= 2 AND c.c_custkey % 50 = 1)
"""


def _fmt(m: str, d: str) -> str:
    return (
        f"CASE {m} % 4 WHEN 0 THEN strftime({d}, '%Y-%m-%d') WHEN 1 THEN strftime({d}, '%d.%m.%Y') "
        f"WHEN 2 THEN strftime({d}, '%m/%d/%Y') ELSE strftime({d}, '%Y%m%d') END"
    )


ORDERS_RAW = f"""
SELECT g.k AS _snapshot_id,
  o.o_orderkey + g.cp * {model.NEW_ORDER_OFFSET} AS order_id,
  CASE WHEN o.o_orderkey % 37 = 0 THEN NULL
       WHEN g.cp = 1 THEN o.o_custkey - o.o_custkey % 50 + 1 + {model.NEW_CUSTOMER_OFFSET}
       ELSE o.o_custkey END AS customer_id,
  CASE WHEN o.o_orderkey % 97 = 0 THEN 'n/a'
       WHEN o.o_orderkey % 89 = 0 THEN '31/12/1995'
       WHEN o.o_orderkey % 8 = 5 THEN ' ' || {_fmt('o.o_orderkey', 'o.o_orderdate')} || ' '
       ELSE {_fmt('o.o_orderkey', 'o.o_orderdate')} END AS order_date,
  CAST(CASE WHEN g.k >= 3 AND o.o_orderkey % 10 = 9 THEN a + 1 ELSE a END AS DECIMAL(12,2)) AS amount,
  CASE o.o_orderstatus WHEN 'O' THEN (CASE WHEN g.k >= 2 THEN 'shipped' ELSE ' open' END)
       WHEN 'F' THEN (CASE WHEN o.o_orderkey % 2 = 0 THEN 'SHIPPED' ELSE 'shipped' END)
       ELSE (CASE WHEN o.o_orderkey % 3 = 0 THEN 'cancelled ' ELSE 'Cancelled' END) END AS status,
  (g.k >= 2 AND o.o_orderkey % 31 = 0) AS is_deleted,
  CASE WHEN g.cp = 1 THEN {TS(CH[2])}
       WHEN g.k >= 3 AND o.o_orderkey % 10 = 9 THEN {TS(CH[3])}
       WHEN g.k >= 2 AND (o.o_orderstatus = 'O' OR o.o_orderkey % 31 = 0) THEN {TS(CH[2])}
       ELSE {TS(CH[1])} END AS updated_at,
  {_case_ts('g.k', LD)} AS _ingested_at
FROM (SELECT *, CASE WHEN o_orderkey % 101 = 0 THEN -CAST(o_totalprice AS DECIMAL(12,2))
                     ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS a FROM orders) o
CROSS JOIN (VALUES (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1)) g(k, cp)
WHERE (g.cp = 0 AND NOT (g.k = 3 AND o.o_orderkey % 53 = 0)) OR (g.cp = 1 AND g.k >= 2 AND o.o_orderkey % 50 = 3)
"""

_VDATE = (
    "(CASE g.f WHEN 1 THEN DATE '2026-01-01' WHEN 2 THEN DATE '2026-03-01' WHEN 3 THEN DATE '2026-05-01' "
    "ELSE DATE '2026-02-15' END + CAST(p.p_partkey % 28 AS INTEGER))"
)

PRODUCTS_RAW = f"""
SELECT
  CASE WHEN p.p_partkey % 6 = 0 AND g.f <> 2 THEN ' P-' || CAST(p.p_partkey AS VARCHAR) || ' '
       ELSE 'P-' || CAST(p.p_partkey AS VARCHAR) END AS product_code,
  CASE WHEN p.p_partkey % 4 = 1 THEN replace(p.p_name, ' ', '   ') ELSE p.p_name END AS product_name,
  CASE WHEN g.f = 4 THEN 'Refurbished' WHEN p.p_partkey % 9 = 0 THEN ' ' || lower(p.p_type) || ' ' ELSE p.p_type END AS category,
  CASE WHEN g.f = 1 AND p.p_partkey % 11 = 0 THEN NULL
       WHEN g.f = 2 AND p.p_partkey % 5 = 0 THEN CAST(CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) + 10 AS DECIMAL(12,2)) AS VARCHAR)
       ELSE CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS price,
  {_fmt('p.p_partkey', _VDATE)} AS valid_from,
  'products_f' || CAST(g.f AS VARCHAR) || '.csv' AS _file_path,
  {_case_ts('g.f', model.FILE_MODIFIED_AT)} AS _file_modification_time,
  {_case_ts('g.f', model.FILE_ARRIVED_AT)} AS _ingested_at
FROM part p CROSS JOIN (VALUES (1, 0), (1, 1), (2, 0), (3, 0), (4, 0)) g(f, dup)
WHERE (g.f = 1 AND (g.dup = 0 OR p.p_partkey % 7 = 0))
   OR (g.f = 2 AND (p.p_partkey % 5 = 0 OR p.p_partkey % 3 = 0 OR p.p_partkey % 6 = 0))
   OR (g.f = 3 AND p.p_partkey % 10 = 0)
   OR (g.f = 4 AND p.p_partkey % 13 = 0)
"""

USAGE = f"""
SELECT CAST(ts AS DATE) AS usage_date,
  CASE WHEN user_id % 2 = 0 THEN 'JOBS' ELSE 'SQL' END AS billing_origin_product,
  CASE WHEN user_id % 10 = 0 THEN 'other' ELSE '{model.PROJECT}' END AS tag_project,
  CASE user_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'tst' ELSE 'prd' END AS tag_env,
  CAST(value AS DECIMAL(12,2)) AS usage_quantity, upper(event_type) AS sku_name, ts AS usage_start_time
FROM events
"""

P = model.PRICE_FROM
LIST_PRICES = f"""
SELECT s.sku_name,
  CASE t.i WHEN 0 THEN {TS(P[0])} WHEN 1 THEN {TS(P[1])} ELSE {TS(P[2])} END AS price_start_time,
  CASE t.i WHEN 0 THEN {TS(P[1])} WHEN 1 THEN {TS(P[2])} END AS price_end_time,
  CAST(CAST(length(s.sku_name) * 10 + t.i * 5 AS DECIMAL(10,4)) / 100 AS DECIMAL(10,4)) AS price_default
FROM (SELECT DISTINCT upper(event_type) AS sku_name FROM events) s CROSS JOIN (VALUES (0), (1), (2)) t(i)
"""

RUNS = """
SELECT user_id % 4 AS workspace_id, user_id AS job_id, event_id AS run_id, ts AS period_start_time,
  ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS period_end_time,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'CANCELED' ELSE 'SUCCEEDED' END AS result_state
FROM events
"""

JOBS = "SELECT DISTINCT user_id % 4 AS workspace_id, user_id AS job_id, 'job_' || CAST(user_id AS VARCHAR) AS name FROM events"

CUST_COLS = "customer_id, name, email, city, segment, updated_at"
ORDER_COLS = "order_id, customer_id, order_date, amount, status, is_deleted, updated_at"


def customers_clean(where: str = "TRUE", drop: bool = True) -> str:
    cond = f"({where})" + (" AND coalesce(customer_id IS NOT NULL, false)" if drop else "")
    return (
        f"SELECT * REPLACE ({CLEAN('name')} AS name, {EMAIL('email')} AS email, "
        f"{CLEAN('city')} AS city, {CLEAN('segment')} AS segment) FROM customers_raw WHERE {cond}"
    )


def orders_clean(where: str = "TRUE", drop: bool = True) -> str:
    cond = f"({where})" + (" AND coalesce(amount >= 0, false)" if drop else "")
    return (
        f"SELECT _snapshot_id, _ingested_at, order_id, customer_id, {PARSE('order_date')} AS order_date, amount, "
        f"{CLEAN('status')} AS status, is_deleted, updated_at FROM orders_raw WHERE {cond}"
    )


def with_(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n"


CR = ("customers_raw", CUSTOMERS_RAW)
OR = ("orders_raw", ORDERS_RAW)
PR = ("products_raw", PRODUCTS_RAW)


def scd2_snapshots_sql(tracked: list[str], raw: tuple[str, str] = CR, cols: str = CUST_COLS) -> str:
    """Set form of SCD2 over the three cleaned customer snapshots."""
    diff = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in tracked)
    ends = " ".join(f"WHEN {k - 1} THEN {TS(LD[k])}" for k in (2, 3))
    return with_(
        raw,
        ("cs", customers_clean()),
        (
            "f",
            "SELECT *, CASE WHEN lag(_snapshot_id) OVER w IS NULL OR _snapshot_id - lag(_snapshot_id) OVER w > 1 THEN 1 "
            f"WHEN {diff} THEN 1 ELSE 0 END AS chg FROM cs WINDOW w AS (PARTITION BY customer_id ORDER BY _snapshot_id)",
        ),
        (
            "v",
            "SELECT *, sum(chg) OVER (PARTITION BY customer_id ORDER BY _snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ver FROM f",
        ),
        (
            "r",
            "SELECT *, min(_ingested_at) OVER (PARTITION BY customer_id, ver) AS start_at, "
            "max(_snapshot_id) OVER (PARTITION BY customer_id, ver) AS last_id, "
            "row_number() OVER (PARTITION BY customer_id, ver ORDER BY _snapshot_id DESC) AS rn FROM v",
        ),
        (
            "scd",
            f"SELECT {cols}, start_at AS __START_AT, CASE last_id {ends} END AS __END_AT FROM r WHERE rn = 1",
        ),
    )


def products_clean_sql() -> list[tuple[str, str]]:
    others = "product_name, category, price, valid_from, _file_path, _ingested_at"
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in others.split(", "))
    return [
        PR,
        (
            "pd",
            f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY product_code, _file_modification_time "
            f"ORDER BY {order}) AS rn FROM products_raw) WHERE rn = 1",
        ),
        (
            "pc",
            f"SELECT {CLEAN('product_code')} AS product_code, {CLEAN('product_name')} AS product_name, "
            f"{CLEAN('category')} AS category, price, {PARSE('valid_from')} AS valid_from, _file_path, "
            f"_file_modification_time, _ingested_at FROM pd WHERE coalesce({CLEAN('product_code')} IS NOT NULL, false)",
        ),
    ]


def products_scd2_sql() -> str:
    tracked = ["product_name", "category", "price"]
    diff = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in tracked)
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in ["product_name", "category", "price", "valid_from"])
    return with_(
        *products_clean_sql(),
        (
            "p2",
            "SELECT * EXCLUDE (rn) FROM (SELECT product_code, product_name, category, price, valid_from, _file_modification_time, "
            f"row_number() OVER (PARTITION BY product_code, _file_modification_time ORDER BY {order}) AS rn FROM pc) WHERE rn = 1",
        ),
        (
            "f",
            f"SELECT *, CASE WHEN lag(_file_modification_time) OVER w IS NULL THEN 1 WHEN {diff} THEN 1 ELSE 0 END AS chg "
            "FROM p2 WINDOW w AS (PARTITION BY product_code ORDER BY _file_modification_time)",
        ),
        (
            "v",
            "SELECT *, sum(chg) OVER (PARTITION BY product_code ORDER BY _file_modification_time "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ver FROM f",
        ),
        (
            "r",
            "SELECT *, min(_file_modification_time) OVER (PARTITION BY product_code, ver) AS start_at, "
            "row_number() OVER (PARTITION BY product_code, ver ORDER BY _file_modification_time DESC) AS rn FROM v",
        ),
        (
            "scd",
            "SELECT product_code, product_name, category, price, valid_from, _file_modification_time, start_at AS __START_AT, "
            "lead(start_at) OVER (PARTITION BY product_code ORDER BY ver) AS __END_AT FROM r WHERE rn = 1",
        ),
    )


def _report(fn_name: str, src: str, col: str, out: str) -> str:
    same = f"(CAST({out} AS VARCHAR) IS NOT DISTINCT FROM {col})"
    return (
        f"SELECT '{fn_name}' AS function, count(*) AS rows, count(*) FILTER (WHERE {col} IS NULL) AS null_in, "
        f"count(*) FILTER (WHERE {col} IS NOT NULL AND {out} IS NULL) AS nulled, "
        f"count(*) FILTER (WHERE {out} IS NOT NULL AND NOT {same}) AS changed, "
        f"count(*) FILTER (WHERE {col} IS NOT NULL AND {same}) AS unchanged FROM {src}"
    )


def _metric(table: str, rule: str, action: str, expr: str, src: str) -> str:
    ok = f"coalesce({expr}, false)"
    return (
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{action}' AS action, "
        f"count(*) FILTER (WHERE {ok}) AS passed, count(*) FILTER (WHERE NOT {ok}) AS failed FROM {src}"
    )


def _feed(kind: str, src: str) -> str:
    return f"SELECT {', '.join(src + '.' + c for c in CUST_COLS.split(', '))}, '{kind}' AS _change_type, 3 AS _commit_version"


ORACLE: dict[str, str] = {}

ORACLE["clean_string"] = f"SELECT doc_id, {CLEAN('text')} AS text_clean FROM documents"
ORACLE["normalize_email"] = with_(CR) + f"SELECT customer_id, {EMAIL('email')} AS email FROM customers_raw"
ORACLE["parse_date_multi"] = with_(OR) + f"SELECT order_id, {PARSE('order_date')} AS order_date FROM orders_raw"
ORACLE["mask_email"] = with_(CR) + f"SELECT customer_id, {MASK(EMAIL('email'))} AS masked FROM customers_raw"
ORACLE["lower_clean"] = with_(OR) + f"SELECT order_id, lower({CLEAN('status')}) AS status FROM orders_raw"
ORACLE["normalize_report"] = with_(
    CR, OR, ("c1", "SELECT * FROM customers_raw"), ("o1", "SELECT * FROM orders_raw")
) + " UNION ALL ".join(
    [
        _report("clean_string:documents", "documents", "text", CLEAN("text")),
        _report("clean_string:conversations", "conversations", "text", CLEAN("text")),
        _report("normalize_email:customers", "c1", "email", EMAIL("email")),
        _report("parse_date_multi:orders", "o1", "order_date", PARSE("order_date")),
    ]
)
ORACLE["apply_transforms"] = with_(CR, ("c", customers_clean(drop=False))) + f"SELECT {CUST_COLS} FROM c"
ORACLE["udf_sql_surface"] = with_(CR) + (
    f"SELECT customer_id, {CLEAN('name')} AS name, {EMAIL('email')} AS email, {MASK(EMAIL('email'))} AS masked, "
    f"lower({CLEAN('segment')}) AS segment FROM customers_raw"
)
ORACLE["udf_sql_dates"] = with_(OR) + (
    f"SELECT order_id, {PARSE('order_date')} AS order_date, {CLEAN('status')} AS status FROM orders_raw"
)
ORACLE["param_sql"] = with_(OR, ("o", orders_clean("_snapshot_id = 3"))) + "SELECT status, count(*) AS orders FROM o GROUP BY status"
ORACLE["dq_drop"] = with_(OR, ("o", orders_clean())) + f"SELECT {ORDER_COLS} FROM o"
ORACLE["dq_metrics"] = with_(
    CR, OR, ("o", orders_clean(drop=False)), ("c", customers_clean(drop=False))
) + " UNION ALL ".join(
    [
        _metric("orders", "positive_amount", "drop", "amount >= 0", "o"),
        _metric("orders", "known_customer", "warn", "customer_id IS NOT NULL", "o"),
        _metric("customers", "valid_id", "drop", "customer_id IS NOT NULL", "c"),
        _metric("customers", "valid_email", "warn", "email IS NOT NULL", "c"),
    ]
)
ORACLE["bronze_snapshot_load"] = with_(CR) + "SELECT * FROM customers_raw"
ORACLE["bronze_current_snapshot"] = with_(CR) + (
    "SELECT * FROM customers_raw WHERE _snapshot_id = (SELECT max(_snapshot_id) FROM customers_raw)"
)
ORACLE["snapshot_as_of"] = with_(CR) + (
    "SELECT * FROM customers_raw WHERE _snapshot_id = (SELECT max(_snapshot_id) FROM customers_raw "
    f"WHERE _ingested_at <= TIMESTAMP '2026-01-02 12:00:00')"
)
ORACLE["load_audit"] = with_(CR, OR) + (
    "SELECT 'customers' AS table_name, _snapshot_id, count(*) AS rows FROM customers_raw GROUP BY _snapshot_id "
    "UNION ALL SELECT 'orders' AS table_name, _snapshot_id, count(*) AS rows FROM orders_raw GROUP BY _snapshot_id"
)
_DIFF_COLS = ["name", "email", "city", "segment", "updated_at"]
ORACLE["snapshot_diff"] = with_(CR, ("a", customers_clean("_snapshot_id = 1")), ("b", customers_clean("_snapshot_id = 2"))) + (
    "SELECT coalesce(b.customer_id, a.customer_id) AS customer_id, "
    "CASE WHEN a.customer_id IS NULL THEN 'insert' WHEN b.customer_id IS NULL THEN 'delete' ELSE 'update' END AS change "
    "FROM a FULL OUTER JOIN b ON a.customer_id = b.customer_id WHERE a.customer_id IS NULL OR b.customer_id IS NULL OR "
    + " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in _DIFF_COLS)
)
_UPD = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in _DIFF_COLS)
ORACLE["change_feed"] = with_(CR, ("a", customers_clean("_snapshot_id = 2")), ("b", customers_clean("_snapshot_id = 3"))) + " UNION ALL ".join(
    [
        _feed("delete", "a") + " FROM a ANTI JOIN b ON a.customer_id = b.customer_id",
        _feed("insert", "b") + " FROM b ANTI JOIN a ON a.customer_id = b.customer_id",
        _feed("update_preimage", "a") + f" FROM a JOIN b ON a.customer_id = b.customer_id WHERE {_UPD}",
        _feed("update_postimage", "b") + f" FROM a JOIN b ON a.customer_id = b.customer_id WHERE {_UPD}",
    ]
)
ORACLE["scd1_from_snapshots"] = with_(OR, ("o", orders_clean("_snapshot_id = 3"))) + f"SELECT {ORDER_COLS} FROM o"
ORACLE["scd2_from_snapshots"] = scd2_snapshots_sql(_DIFF_COLS) + "SELECT * FROM scd"
ORACLE["scd2_tracked_columns"] = scd2_snapshots_sql(["email", "city", "segment"]) + "SELECT * FROM scd"
ORACLE["scd2_current"] = scd2_snapshots_sql(["email", "city", "segment"]) + "SELECT * FROM scd WHERE __END_AT IS NULL"
_P_OTHERS = "product_name, category, price, valid_from, _file_path, _ingested_at"
ORACLE["dedupe_key_seq"] = with_(
    PR,
    (
        "d",
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY product_code, _file_modification_time ORDER BY "
        + ", ".join(f"{c} ASC NULLS FIRST" for c in _P_OTHERS.split(", "))
        + ") AS rn FROM products_raw) WHERE rn = 1",
    ),
) + "SELECT * EXCLUDE (_ingested_at) FROM d"
ORACLE["unique_key_check"] = with_(PR) + (
    "SELECT product_code, _file_modification_time, count(*) AS n FROM products_raw GROUP BY 1, 2 HAVING count(*) > 1"
)
ORACLE["key_collision_report"] = with_(PR) + (
    f"SELECT {CLEAN('product_code')} AS key_clean, count(DISTINCT product_code) AS raw_variants, count(*) AS rows "
    "FROM products_raw GROUP BY 1 HAVING count(DISTINCT product_code) > 1"
)
ORACLE["scd1_from_changes"] = with_(*products_clean_sql()) + (
    "SELECT product_code, product_name, category, price, valid_from, _file_modification_time FROM ("
    "SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY _file_modification_time DESC, product_name DESC NULLS LAST, "
    "category DESC NULLS LAST, price DESC NULLS LAST, valid_from DESC NULLS LAST) AS rn FROM pc) WHERE rn = 1"
)
_O_OTHERS = "customer_id, order_date, amount, status, is_deleted"
_ORDER_CHANGES = (
    OR,
    (
        "d",
        "SELECT * EXCLUDE (rn) FROM (SELECT order_id, customer_id, order_date, amount, status, is_deleted, updated_at, "
        "row_number() OVER (PARTITION BY order_id, updated_at ORDER BY "
        + ", ".join(f"{c} ASC NULLS FIRST" for c in _O_OTHERS.split(", "))
        + ") AS rn FROM orders_raw) WHERE rn = 1",
    ),
    (
        "c",
        f"SELECT order_id, customer_id, {PARSE('order_date')} AS order_date, amount, {CLEAN('status')} AS status, is_deleted, updated_at FROM d",
    ),
)
ORACLE["scd1_soft_delete"] = with_(*_ORDER_CHANGES) + (
    f"SELECT {ORDER_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, "
    "coalesce(is_deleted, false) DESC, customer_id DESC NULLS LAST, order_date DESC NULLS LAST, amount DESC NULLS LAST, "
    "status DESC NULLS LAST) AS rn FROM c) WHERE rn = 1 AND NOT coalesce(is_deleted, false)"
)
_O_TRACKED = "customer_id, order_date, amount, status, is_deleted"
ORACLE["scd2_soft_delete"] = with_(
    *_ORDER_CHANGES,
    (
        "f",
        "SELECT *, CASE WHEN row_number() OVER w = 1 OR "
        + " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in _O_TRACKED.split(", "))
        + " THEN 1 ELSE 0 END AS chg FROM c WINDOW w AS (PARTITION BY order_id ORDER BY updated_at)",
    ),
    ("v", "SELECT *, sum(chg) OVER (PARTITION BY order_id ORDER BY updated_at) AS ver FROM f"),
    (
        "g",
        "SELECT order_id, ver, min(updated_at) AS __START_AT, max(updated_at) AS updated_at, "
        + ", ".join(f"any_value({c}) AS {c}" for c in _O_TRACKED.split(", "))
        + " FROM v GROUP BY order_id, ver",
    ),
    ("e", "SELECT *, lead(__START_AT) OVER (PARTITION BY order_id ORDER BY ver) AS __END_AT FROM g"),
) + f"SELECT {ORDER_COLS}, __START_AT, __END_AT FROM e WHERE NOT is_deleted"
ORACLE["scd2_from_changes"] = products_scd2_sql() + "SELECT * FROM scd"
ORACLE["scd2_late_arrival"] = ORACLE["scd2_from_changes"]
ORACLE["incremental_cursor_load"] = with_(
    OR,
    ("l1", "SELECT * FROM orders_raw WHERE _snapshot_id = 1"),
    (
        "l2",
        "SELECT * EXCLUDE (_snapshot_id, _ingested_at) FROM l1 UNION ALL (SELECT * EXCLUDE (_snapshot_id, _ingested_at) FROM orders_raw "
        "WHERE _snapshot_id = 2 AND (updated_at IS NULL OR updated_at >= (SELECT max(updated_at) FROM l1)) "
        "EXCEPT SELECT * EXCLUDE (_snapshot_id, _ingested_at) FROM l1)",
    ),
    (
        "l",
        "SELECT * FROM l2 UNION ALL (SELECT * EXCLUDE (_snapshot_id, _ingested_at) FROM orders_raw "
        "WHERE _snapshot_id = 3 AND (updated_at IS NULL OR updated_at >= (SELECT max(updated_at) FROM l2)) EXCEPT SELECT * FROM l2)",
    ),
    (
        "c",
        f"SELECT order_id, customer_id, {PARSE('order_date')} AS order_date, amount, {CLEAN('status')} AS status, "
        "is_deleted, updated_at FROM l WHERE coalesce(amount >= 0, false)",
    ),
) + (
    f"SELECT {ORDER_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, "
    "customer_id DESC NULLS LAST, order_date DESC NULLS LAST, amount DESC NULLS LAST, status DESC NULLS LAST, "
    "is_deleted DESC NULLS LAST) AS rn FROM c) WHERE rn = 1"
)
ORACLE["revenue_by_customer_month"] = with_(
    CR, OR, ("o", orders_clean("_snapshot_id = 3")), ("c", customers_clean("_snapshot_id = 3"))
) + (
    "SELECT c.customer_id, c.name AS customer_name, c.segment, CAST(date_trunc('month', o.order_date) AS DATE) AS month, "
    "count(*) AS orders, CAST(SUM(o.amount) AS DECIMAL(22,2)) AS revenue "
    "FROM o JOIN c ON o.customer_id = c.customer_id "
    "WHERE NOT o.is_deleted AND lower(o.status) <> 'cancelled' AND o.order_date IS NOT NULL GROUP BY ALL"
)
ORACLE["price_history"] = products_scd2_sql() + (
    "SELECT product_code, product_name, category, TRY_CAST(price AS DECIMAL(12,2)) AS price, __START_AT AS valid_since, "
    "__END_AT AS valid_until, __END_AT IS NULL AS is_current FROM scd"
)
ORACLE["cost_by_day"] = with_(("u", USAGE), ("p", LIST_PRICES)) + (
    "SELECT u.usage_date, u.billing_origin_product, u.tag_env AS env, CAST(SUM(u.usage_quantity) AS DECIMAL(22,2)) AS dbus, "
    "CAST(SUM(u.usage_quantity * p.price_default) AS DECIMAL(38,6)) AS list_cost FROM u JOIN p ON u.sku_name = p.sku_name "
    "AND u.usage_start_time >= p.price_start_time AND (p.price_end_time IS NULL OR u.usage_start_time < p.price_end_time) "
    f"WHERE u.tag_project = '{model.PROJECT}' AND u.tag_env = 'dev' GROUP BY ALL"
)
ORACLE["job_runs_recent"] = with_(("r", RUNS), ("j", JOBS)) + (
    "SELECT j.name AS job_name, r.run_id, r.period_start_time, r.period_end_time, r.result_state, "
    "CAST((epoch_us(r.period_end_time) - epoch_us(r.period_start_time)) // 1000000 AS BIGINT) AS duration_s "
    "FROM r JOIN j USING (workspace_id, job_id) WHERE r.period_start_time >= DATE '2024-01-31' - INTERVAL 7 DAYS"
)
ORACLE["top_products"] = (
    "WITH rev AS (SELECT l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue, "
    "count(*) AS lines FROM lineitem GROUP BY l_partkey), top AS (SELECT * FROM rev ORDER BY revenue DESC, l_partkey LIMIT 10) "
    "SELECT p.p_partkey, p.p_name, CAST(t.revenue AS DECIMAL(38,4)) AS revenue, t.lines FROM top t JOIN part p ON p.p_partkey = t.l_partkey"
)
ORACLE["masked_view"] = with_(CR, ("c", customers_clean("_snapshot_id = 3"))) + (
    f"SELECT customer_id, name, {MASK('email')} AS email, segment FROM c WHERE lower(segment) = 'building'"
)
ORACLE["ops_failures_by_day"] = with_(
    ("r", RUNS),
    ("u", USAGE),
    (
        "rd",
        "SELECT CAST(period_start_time AS DATE) AS day, count(*) AS runs, count(*) FILTER (WHERE result_state = 'FAILED') AS failed_runs FROM r GROUP BY 1",
    ),
    (
        "vd",
        "SELECT usage_date AS day, CAST(SUM(CASE WHEN NOT coalesce(usage_quantity >= 1, false) THEN 1 ELSE 0 END + "
        "CASE WHEN NOT coalesce(tag_env IS NOT NULL, false) THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM u GROUP BY 1",
    ),
) + (
    "SELECT coalesce(rd.day, vd.day) AS day, coalesce(rd.runs, 0) AS runs, coalesce(rd.failed_runs, 0) AS failed_runs, "
    "coalesce(vd.violations, 0) AS violations FROM rd FULL OUTER JOIN vd ON rd.day = vd.day"
)
_PROF = ["name", "email", "city", "segment"]
ORACLE["table_profile"] = with_(
    CR,
    (
        "s",
        "SELECT count(*) AS rows, max(updated_at) AS max_ts, "
        + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS n{i}" for i, c in enumerate(_PROF))
        + " FROM customers_raw",
    ),
) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, rows, n{i} AS nulls, CAST(n{i} AS DOUBLE) / rows AS null_rate, max_ts FROM s"
    for i, c in enumerate(_PROF)
)

# The pipelines publish exactly what the set forms describe
ORACLE["silver_customers"] = ORACLE["scd2_tracked_columns"]
ORACLE["silver_orders"] = ORACLE["scd1_from_snapshots"]
ORACLE["change_feed_stored"] = ORACLE["change_feed"]
ORACLE["profile_from_log"] = ORACLE["table_profile"]
ORACLE["rebucketed_load"] = ORACLE["silver_customers"]
_WITH_POINTS = (
    "SELECT * REPLACE (CASE WHEN _snapshot_id = 2 THEN updated_at END AS updated_at), CASE _snapshot_id WHEN 2 THEN customer_id % 1000 "
    f"WHEN 3 THEN customer_id % 1000 + 3000000000 END AS points FROM ({CUSTOMERS_RAW})"
)
ORACLE["schema_added_column"] = (
    scd2_snapshots_sql(["email", "city", "segment"], ("customers_raw", _WITH_POINTS), f"{CUST_COLS}, points") + " SELECT * FROM scd"
)
ORACLE["schema_widened_json"] = (
    products_scd2_sql() + f" SELECT *, CASE WHEN _file_modification_time = {TS(model.FILE_MODIFIED_AT[3])} THEN 'true' END AS badge FROM scd"
)
ORACLE["silver_products"] = ORACLE["scd2_from_changes"]
ORACLE["dq_fail"] = with_(OR, ("o", orders_clean("_snapshot_id = 1", drop=False))) + " UNION ALL ".join(
    [
        _metric("orders", "positive_amount", "drop", "amount >= 0", "o"),
        _metric("orders", "known_customer", "warn", "customer_id IS NOT NULL", "o"),
        _metric("orders", "has_date", "fail", "order_date IS NOT NULL", "o"),
    ]
).replace("SELECT 'orders' AS table_name, ", "SELECT ").replace(" FROM o", ", true AS update_failed, false AS published FROM o")

# files through the stream: the exports carry the model's modification times, so the
# stream's Silver is the change-log SCD2
ORACLE["file_stream_ingest"] = ORACLE["scd2_from_changes"]
ORACLE["file_formats_read"] = with_(PR) + (
    "SELECT f.format, product_code, product_name, category, price, valid_from FROM products_raw "
    "CROSS JOIN (VALUES ('csv'), ('json'), ('parquet')) f(format)"
)
ORACLE["multi_table_full_load"] = with_(CR, OR) + (
    "SELECT 'customers' AS table_name, 1 AS _snapshot_id, count(*) AS rows FROM customers_raw WHERE _snapshot_id = 1 "
    "UNION ALL SELECT 'orders' AS table_name, 1 AS _snapshot_id, count(*) AS rows FROM orders_raw WHERE _snapshot_id = 1"
)
ORACLE["metadata_health"] = with_(CR, OR, PR) + (
    "SELECT 'salesdb' AS source, 'customers' AS \"table\", 'full' AS load_type, CAST(2 AS BIGINT) AS scd_type, ['customer_id'] AS keys, "
    "(SELECT count(*) FROM customers_raw WHERE _snapshot_id = 3) AS latest_rows, CAST(3 AS BIGINT) AS loads "
    "UNION ALL SELECT 'salesdb', 'orders', 'full', CAST(1 AS BIGINT), ['order_id'], "
    "(SELECT count(*) FROM orders_raw WHERE _snapshot_id = 3), CAST(3 AS BIGINT) "
    "UNION ALL SELECT 'crm_files', 'products', 'files', CAST(2 AS BIGINT), ['product_code'], "
    "(SELECT count(*) FROM products_raw), CAST(1 AS BIGINT)"
)
ORACLE["incremental_cursor_pipeline"] = ORACLE["incremental_cursor_load"]
ORACLE["file_lineage_columns"] = with_(PR) + (
    "SELECT product_code, CAST(regexp_extract(_file_path, 'products_f(\\d+)\\.csv', 1) AS INTEGER) AS export_no, "
    "_file_modification_time, true AS has_load_time FROM products_raw"
)
_EMPTY_AT = f"TIMESTAMP '{LD[2]}'"
ORACLE["empty_snapshot_scd1"] = with_(OR, ("a", orders_clean("_snapshot_id = 1")), ("b", orders_clean("_snapshot_id = 3"))) + (
    "SELECT 1 AS version, count(*) AS rows FROM a UNION ALL SELECT 2, 0 UNION ALL SELECT 3, count(*) FROM b"
)
ORACLE["empty_snapshot_scd2"] = with_(CR, ("a", customers_clean("_snapshot_id = 1")), ("b", customers_clean("_snapshot_id = 3"))) + (
    f"SELECT {CUST_COLS}, TIMESTAMP '{LD[1]}' AS __START_AT, {_EMPTY_AT} AS __END_AT FROM a "
    f"UNION ALL SELECT {CUST_COLS}, TIMESTAMP '{LD[3]}', NULL FROM b"
)
ORACLE["duplicate_key_snapshot"] = with_(CR, ("a", customers_clean("_snapshot_id <= 2"))) + (
    "SELECT customer_id, count(*) AS n, true AS refused, false AS published FROM a GROUP BY 1 HAVING count(*) > 1"
)
ORACLE["gold_materialized"] = ORACLE["revenue_by_customer_month"]
ORACLE["gold_persistent_view"] = ORACLE["price_history"]
ORACLE["table_properties"] = with_(CR) + (
    "SELECT _snapshot_id, count(*) AS rows, 'raw customers' AS comment, 'change_feed=true, load_type=full' AS properties "
    "FROM customers_raw GROUP BY 1"
)
ORACLE["udf_versions"] = with_(CR) + f"SELECT lower({CLEAN('segment')}) AS segment, count(*) AS rows, true AS versioned FROM customers_raw GROUP BY 1"
