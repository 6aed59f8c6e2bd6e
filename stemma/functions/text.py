"""Text clean-up and table-name normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a whitespace strip removes at both ends.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column, chars: str = BLANKS) -> Column:
    return F.btrim(c, F.lit(chars))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty text."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def with_schema(name: Column, default_schema: str) -> Column:
    """Lower-cased ``schema.table``; an unqualified name gets the default schema."""
    low = F.lower(name)
    return (
        F.when(name == "", F.lit(""))
        .when(F.contains(name, F.lit(".")), low)
        .otherwise(F.concat(F.lit(f"{default_schema}."), low))
    )


def sql_table_ref(name: Column, default_schema: str = "public") -> Column:
    cleaned = strip(strip(strip(strip(name), '"'), "'"), "`")
    return with_schema(F.when(cleaned == "*", F.lit("")).otherwise(cleaned), default_schema)


def etl_table_ref(name: Column, default_schema: str = "public") -> Column:
    return with_schema(strip(strip(strip(name), '"'), "'"), default_schema)


def change_table_ref(name: Column, default_schema: str = "public") -> Column:
    return with_schema(strip(F.lower(strip(name)), "`\"'"), default_schema)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root`` with '/' separators; outside the root the full path stays."""
    bare = F.regexp_replace(slashes(path), r"^file:/+", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(bare, F.lit(base)), F.substr(bare, F.lit(len(base) + 1))).otherwise(bare)
