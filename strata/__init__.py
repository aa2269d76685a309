"""strata: metadata-driven layered tables (Bronze -> Silver -> Gold) on plain PySpark.

Everything is expressed with DataFrame / SQL / Structured Streaming operators so that
Catalyst plans it; data is stored as plain Parquet.
"""

from strata.config import SourceConfig, TableConfig

__all__ = ["SourceConfig", "TableConfig"]
__version__ = "0.1.0"
