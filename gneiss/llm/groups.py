"""Work on groups of bounded size: a group of any size is cut into blocks, and each pair of blocks is a
task of its own, so no task holds more than two blocks however large the group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(df: DataFrame, key: str, member: str, size: Column, block: int) -> DataFrame:
    """df with `first` and `second` block numbers, each row once for every pair of blocks its own
    block is in (just once where size is at most `block`), and `own`, its block."""
    n = F.ceil(size / F.lit(block)).cast("int")
    rows = df.withColumn("_n", n).withColumn("own", F.pmod(F.xxhash64(member, F.lit(17)), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    rows = rows.withColumn("_other", other)
    return rows.withColumn("first", F.least("own", "_other")).withColumn("second", F.greatest("own", "_other")).drop("_n", "_other")


def gathered(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """The rows of each (key, first, second) next to each other in one of `parts` partitions."""
    parts = parts or max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 32)
    return df.repartition(parts, key, "first", "second").sortWithinPartitions(key, "first", "second")


def each_group(batches: Iterator[pa.RecordBatch], key: str, handle: Callable[[list[pa.Table]], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Calls handle with tables of whole groups: all groups that end within a batch at once."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in (key, "first", "second")]
        final = tuple(k[-1].as_py() for k in keys)
        same = None
        for k, v in zip(keys, final, strict=True):
            e = pc.equal(k, pa.scalar(v, k.type))
            same = e if same is None else pc.and_(same, e)
        cut = pc.index(same, True).as_py()  # where the last group begins
        if cut == 0 and last in (None, final):
            held.append(batch)
        else:
            whole = [*held, batch.slice(0, cut)] if last is None or cut or last != final else held
            out = handle(pa.Table.from_batches([b for b in whole if b.num_rows]))
            if out is not None:
                yield out
            held = [batch.slice(cut)]
        last = final
    if held and (out := handle(pa.Table.from_batches(held))) is not None:
        yield out
