"""SQL functions that Spark lacks, as SQL expressions (they inline into the plan)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"
_MICROS = "(extract(DAY FROM width) * 86400000000 + extract(HOUR FROM width) * 3600000000 + extract(MINUTE FROM width) * 60000000 + CAST(extract(SECOND FROM width) * 1000000 AS BIGINT))"
_ORIGIN = f"origin TIMESTAMP_NTZ DEFAULT TIMESTAMP_NTZ '{EPOCH}'"
_MONTHS = "CAST(floor((extract(YEAR FROM ts) * 12 + extract(MONTH FROM ts) - extract(YEAR FROM origin) * 12 - extract(MONTH FROM origin) - CASE WHEN timestampadd(MONTH, CAST(extract(YEAR FROM ts) * 12 + extract(MONTH FROM ts) - extract(YEAR FROM origin) * 12 - extract(MONTH FROM origin) AS INT), origin) > ts THEN 1 ELSE 0 END) / months) * months AS INT)"

_SQL = {
    "date_bin": f"(width INTERVAL DAY TO SECOND, ts TIMESTAMP_NTZ, {_ORIGIN}) RETURNS TIMESTAMP_NTZ RETURN timestampadd(MICROSECOND, timestampdiff(MICROSECOND, origin, ts) - pmod(timestampdiff(MICROSECOND, origin, ts), {_MICROS}), origin)",
    "date_bin_months": f"(months INT, ts TIMESTAMP_NTZ, {_ORIGIN}) RETURNS TIMESTAMP_NTZ RETURN timestampadd(MONTH, {_MONTHS}, origin)",
    "to_timestamp_seconds": f"(seconds BIGINT) RETURNS TIMESTAMP_NTZ RETURN timestampadd(SECOND, seconds, TIMESTAMP_NTZ '{EPOCH}')",
    "concat_lenient": "(a STRING, b STRING) RETURNS STRING RETURN concat_ws('', a, b)",
}


NAMES = frozenset(_SQL)


def register(spark: SparkSession) -> None:
    for name, rest in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")


def date_bin(width: timedelta | int, ts: Column, origin: str = EPOCH) -> Column:
    """Start of the bin that a timestamp lies in: bins of a time, or of so many months, counted from
    the origin.  The session must have the SQL functions of this library."""
    start = F.lit(origin).cast("timestamp_ntz")
    if isinstance(width, timedelta):
        seconds, micros = width.days * 86400 + width.seconds, width.microseconds
        return F.call_function("date_bin", F.expr(f"INTERVAL '{seconds}.{micros:06d}' SECOND"), ts, start)
    return F.call_function("date_bin_months", F.lit(width), ts, start)


def to_timestamp_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def concat_lenient(*parts: Column) -> Column:
    """concat that skips nulls."""
    return F.concat_ws("", *parts)


def integer_division(a: Column, b: Column) -> Column:
    """Truncating division of integers (null for a zero divisor)."""
    return F.try_divide(a - F.try_mod(a, b), b).cast("long")


def asc(column: str) -> Column:
    """Ascending, nulls last."""
    return F.col(column).asc_nulls_last()


def desc(column: str) -> Column:
    """Descending, nulls first."""
    return F.col(column).desc_nulls_first()
