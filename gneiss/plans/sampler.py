"""What the heads of a table's partitions tell about it: rows, bytes, distinct and null shares."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = 8192  # rows of each partition that are looked at


def heads(df: DataFrame, rows: int = HEAD) -> DataFrame:
    """A row for each partition and column: rows and bytes looked at, distinct values and nulls among
    them, and whether the partition ended within its head.  The rest of a partition is not read."""

    def run(batches):
        held, n, ended = [], 0, True
        for batch in batches:
            take = min(rows - n, batch.num_rows)
            held.append(batch.slice(0, take))
            n += take
            if take < batch.num_rows or n == rows:
                ended = take == batch.num_rows and next(batches, None) is None
                break
        if not held:
            return
        table = pa.Table.from_batches(held)
        out = []
        for name, column in zip(table.column_names, table.columns, strict=True):
            plain = not pa.types.is_nested(column.type)
            out.append((name, n, int(pc.sum(pc.binary_length(column)).as_py() or 0) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else column.get_total_buffer_size() if not plain else n * (column.type.bit_width // 8 or 1), pc.count_distinct(column, mode="only_valid").as_py() if plain else None, column.null_count, ended))
        names = ("name", "rows", "bytes", "distinct_values", "nulls", "ended")
        yield pa.RecordBatch.from_arrays([pa.array(c) if any(v is not None for v in c) else pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return df.mapInArrow(run, "name string, rows long, bytes long, distinct_values long, nulls long, ended boolean")


def profile(df: DataFrame, rows: int = HEAD) -> DataFrame:
    """A row for each column: partitions and rows looked at, share of nulls, mean share of distinct
    values within a partition's head, mean bytes of a value, and whether that was all of the table."""
    seen = heads(df, rows).groupBy("name")
    return seen.agg(
        F.count("*").alias("partitions"),
        F.sum("rows").alias("rows"),
        (F.sum("nulls") / F.sum("rows")).alias("null_share"),
        (F.sum("distinct_values") / F.sum("rows")).alias("distinct_share"),
        (F.sum("bytes") / F.sum("rows")).alias("mean_bytes"),
        F.bool_and("ended").alias("complete"),
    )
