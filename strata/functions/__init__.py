from strata.functions.cleaning import (
    REGISTRY,
    clean_string,
    lower_clean,
    mask_email,
    normalize_email,
    parse_date_multi,
    transform,
    with_function,
)
from strata.functions.report import normalize_report
from strata.functions.sql import register_functions

__all__ = [
    "REGISTRY",
    "clean_string",
    "lower_clean",
    "mask_email",
    "normalize_email",
    "normalize_report",
    "parse_date_multi",
    "register_functions",
    "transform",
    "with_function",
]
