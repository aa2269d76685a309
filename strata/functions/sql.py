"""The cleaning functions as SQL functions, callable by name from ``spark.sql``.

They are SQL-bodied functions, so the analyser inlines them into the plan: no Python worker,
no per-row serialisation.  Bodies mirror :mod:`strata.functions.cleaning` exactly.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from strata.functions.cleaning import DATE_PATTERNS, DATE_SHAPES, EMAIL_SHAPE, MASK_PATTERN, MASK_REPLACEMENT

_CLEAN = r"nullif(trim(regexp_replace(s, '\\s+', ' ')), '')"

def _sql_regex(rx: str) -> str:
    return rx.replace("\\", "\\\\")


_DATES = ", ".join(
    f"CASE WHEN t RLIKE '{_sql_regex(shape)}' THEN to_date(try_to_timestamp(t, '{p}')) END" for p, shape in zip(DATE_PATTERNS, DATE_SHAPES, strict=True)
)

#: name: (parameters, return type, body, comment); a body names other functions in braces.  What comes
#: after cleaning is a function of its own, so a text is cleaned once, as the argument, however
#: often the body needs it.
FUNCTIONS: dict[str, tuple[str, str, str, str]] = {
    "clean_string": ("s STRING", "STRING", _CLEAN, "collapse whitespace, trim, empty -> NULL"),
    "email_shaped": ("t STRING", "STRING", f"CASE WHEN t RLIKE '{EMAIL_SHAPE}' THEN t END", "text of the shape x@y, else NULL"),
    "normalize_email": ("s STRING", "STRING", "{email_shaped}(lower(replace({clean_string}(s), ' ', '')))", "lower-case e-mail, invalid -> NULL"),
    "date_of_clean": ("t STRING", "DATE", f"coalesce({_DATES})", "date from clean ISO, German, US or compact text"),
    "parse_date_multi": ("s STRING", "DATE", "{date_of_clean}({clean_string}(s))", "date from ISO, German, US or compact text"),
    "mask_email": ("s STRING", "STRING", f"regexp_replace(s, '{MASK_PATTERN}', '{MASK_REPLACEMENT}')", "mask the local part of an e-mail"),
    "lower_clean": ("s STRING", "STRING", "lower({clean_string}(s))", "lower-case clean_string"),
}


def _body(body: str, prefix: str) -> str:
    for name in FUNCTIONS:
        body = body.replace("{" + name + "}", prefix + name)
    return body


def register_functions(spark: SparkSession, schema: str | None = None, version: str | None = None) -> list[str]:
    """Create the functions; temporary when ``schema`` is None, else permanent in ``schema``.

    Permanent functions carry the library version in their comment.
    """
    from strata import __version__

    made = []
    for name, (params, returns, body, comment) in FUNCTIONS.items():
        if schema is None:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {_body(body, '')}")
            made.append(name)
        else:
            note = f"{comment} (strata {version or __version__})".replace("'", "")
            spark.sql(
                f"CREATE OR REPLACE FUNCTION {schema}.{name}({params}) RETURNS {returns} "
                f"COMMENT '{note}' RETURN {_body(body, schema + '.')}"
            )
            made.append(f"{schema}.{name}")
    return made
