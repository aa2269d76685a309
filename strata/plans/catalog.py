"""Source and table metadata for the sales domain (what the YAML metadata would hold).

The pipelines are generic; these dicts are the configuration they run with.
"""

from __future__ import annotations

from strata.config import SourceConfig, read_source

# --- fixed values: table configuration of the sales domain ----------------------------------
SALESDB = {
    "source": {"name": "salesdb", "type": "sqlserver", "ingestion_mode": "full_load"},
    "tables": [
        {
            "name": "customers",
            "load": {"type": "full"},
            "keys": ["customer_id"],
            "silver": {
                "scd_type": 2,
                "track_history_columns": ["email", "city", "segment"],
                "transforms": [
                    {"column": "name", "fn": "clean_string"},
                    {"column": "email", "fn": "normalize_email"},
                    {"column": "city", "fn": "clean_string"},
                    {"column": "segment", "fn": "clean_string"},
                ],
                "expectations": {
                    "valid_id": {"expr": "customer_id IS NOT NULL", "action": "drop"},
                    "valid_email": {"expr": "email IS NOT NULL", "action": "warn"},
                },
            },
        },
        {
            "name": "orders",
            "load": {"type": "full"},
            "keys": ["order_id"],
            "silver": {
                "scd_type": 1,
                "transforms": [
                    {"column": "order_date", "fn": "parse_date_multi"},
                    {"column": "status", "fn": "clean_string"},
                ],
                "expectations": {
                    "positive_amount": {"expr": "amount >= 0", "action": "drop"},
                    "known_customer": {"expr": "customer_id IS NOT NULL", "action": "warn"},
                },
            },
        },
    ],
}

CRM_FILES = {
    "source": {
        "name": "crm_files",
        "type": "files",
        "ingestion_mode": "file_stream",
        "format": "csv",
        "location": "products/",
        "options": {"header": "true", "delimiter": ";"},
    },
    "tables": [
        {
            "name": "products",
            "pattern": "products_*.csv",
            "keys": ["product_code"],
            "silver": {
                "scd_type": 2,
                "sequence_by": "_file_modification_time",
                "track_history_columns": ["product_name", "category", "price"],
                "transforms": [
                    {"column": "product_code", "fn": "clean_string"},
                    {"column": "product_name", "fn": "clean_string"},
                    {"column": "category", "fn": "clean_string"},
                    {"column": "valid_from", "fn": "parse_date_multi"},
                ],
                "expectations": {
                    "code_present": {"expr": "product_code IS NOT NULL", "action": "drop"},
                    "price_present": {"expr": "price IS NOT NULL", "action": "warn"},
                },
            },
        }
    ],
}
# ---------------------------------------------------------------------------------------------


def sources() -> list[SourceConfig]:
    return [read_source(SALESDB), read_source(CRM_FILES)]


def table_config(source: str, table: str):
    for s in sources():
        if s.name == source:
            return s.table(table)
    raise KeyError(source)
