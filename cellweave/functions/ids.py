"""Identifier and text-parsing expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that source tables use for "no value".
MISSING_TEXTS = ("", "nan", "na", "null", "none")
# Fixed value: largest integer a double holds exactly.
MAX_EXACT_COUNT = 2**53 - 1
UNANNOTATED = "Unannotated"


def percent_encode(value: Column) -> Column:
    """Percent-encode everything but letters, digits and ``_.-~`` (url_encode differs on three characters)."""
    encoded = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def qualified_observation_id(sample: Column, cell: Column) -> Column:
    return F.concat(F.lit("sample:"), percent_encode(sample), F.lit("::cell:"), percent_encode(cell))


def fov_cell_id(fov: Column, cell: Column) -> Column:
    return F.concat(F.lit("fov="), percent_encode(fov), F.lit(";cell="), percent_encode(cell))


def missing_text_to_null(value: Column) -> Column:
    return F.when(~F.lower(F.trim(value)).isin(*MISSING_TEXTS), value)


def exact_count(text: Column) -> Column:
    """Parse count text through decimal: an exact non-negative integer below 2**53, otherwise NULL."""
    number = F.trim(text.cast("string")).try_cast("decimal(38,10)")
    return F.when((number >= 0) & (number == F.floor(number)) & (number <= F.lit(MAX_EXACT_COUNT)), number.cast("double"))


def row_digest(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the named columns in sorted order (nulls written out)."""
    fields = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def table_digest(df, *columns: str):
    """Order-free content digest of a table: row count plus the folded sum of 60-bit row-digest prefixes."""
    names = columns or tuple(df.columns)
    prefix = F.conv(F.substring(row_digest(*names), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(prefix.alias("p")).agg(
        F.count("*").alias("row_count"),
        F.sha2(F.coalesce(F.sum("p"), F.lit(0)).cast("string"), 256).alias("content_sha256"))
