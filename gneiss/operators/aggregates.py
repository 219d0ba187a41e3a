"""Aggregation in more than two steps, for keys with very many rows, and sorted-out small helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FINAL = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def two_level(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]], salts: int = 16) -> DataFrame:
    """Groups by keys with the work of one key spread over `salts` tasks first.

    aggregates: name -> (function, column); functions count, sum, min, max and avg (kept as sum and
    count between the steps).
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("_salt")
    first: list[Column] = []
    last: list[Column] = []
    for name, (function, column) in aggregates.items():
        if function == "avg":
            first += [F.sum(column).alias(f"_{name}_sum"), F.count(column).alias(f"_{name}_n")]
            last.append((F.sum(f"_{name}_sum") / F.sum(f"_{name}_n")).alias(name))
        else:
            first.append(getattr(F, function)(column).alias(f"_{name}"))
            last.append(_FINAL[function](f"_{name}").alias(name))
    return df.select("*", salt).groupBy(*keys, "_salt").agg(*first).groupBy(*keys).agg(*last)


def reduction_tree(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]], fan_in: list[int]) -> DataFrame:
    """Counts, sums, minima and maxima merged in steps, each with so many partitions (the last: 1 or more)."""
    if any(f not in _FINAL for f, _ in aggregates.values()):
        raise ValueError("only count, sum, min and max can be merged in steps")
    out = df.groupBy(*keys, F.spark_partition_id().alias("_part")).agg(*[getattr(F, f)(c).alias(n) for n, (f, c) in aggregates.items()])
    for parts in fan_in:
        step = out.withColumn("_part", F.pmod("_part", F.lit(parts)))
        out = step.groupBy(*keys, "_part").agg(*[_FINAL[f](n).alias(n) for n, (f, _) in aggregates.items()])
    return out.groupBy(*keys).agg(*[_FINAL[f](n).alias(n) for n, (f, _) in aggregates.items()])


def first_by(column: str, order: str) -> Column:
    """first_value with a defined order."""
    return F.min_by(column, order)
