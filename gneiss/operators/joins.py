"""Join strategies.  Catalyst chooses by size; these helpers ask for one or keep data co-located."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRATEGIES = {"broadcast": "broadcast", "merge": "merge", "shuffle_hash": "shuffle_hash", "nested_loop": "shuffle_replicate_nl"}


def join(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner", strategy: str | None = None) -> DataFrame:
    """A join with an optional strategy hint on its right side."""
    return left.join(right.hint(STRATEGIES[strategy]) if strategy else right, on, how)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Asks to broadcast df only if it is counted to have at most so many rows (the count stops there)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def null_aware_anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left WHERE left_key NOT IN (right_key): nothing if the right side holds a null; a null key stays
    only if the right side is empty.  The global facts are two flags; the join itself is an ordinary
    anti join on the key that Spark may shuffle, so no side has to fit in memory."""
    facts = right.agg(F.count("*").alias("n"), F.count(F.when(F.col(right_key).isNull(), 1)).alias("nulls"))
    kept = left.join(right.select(F.col(right_key).alias("_right")), left[left_key] == F.col("_right"), "left_anti")
    allowed = kept.crossJoin(F.broadcast(facts))  # one row
    return allowed.filter((F.col("nulls") == 0) & (F.col(left_key).isNotNull() | (F.col("n") == 0))).drop("n", "nulls")


def salted(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join with every key of the left side dealt over `salts` partitions; the right side is
    repeated so often.  For inner, left and semi or anti joins from the left."""
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"a salted join cannot be {how}")
    a = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "_salt"], how).drop("_salt")


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table dealt and sorted by a key, one file a bucket: joins and aggregates on it need no shuffle,
    and, with the setting declared_order, no sort."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def bucketed_join(spark: SparkSession, left: str, right: str, key: str, how: str = "inner") -> DataFrame:
    return spark.table(left).join(spark.table(right), key, how)


def folder_values(spark: SparkSession, path: str, key: str) -> list[str]:
    """The values of a hive-style folder key, from the folders' names; nothing is read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = (s.getPath().getName() for s in listed if s.isDirectory())
    return sorted(unquote(n[len(key) + 1 :]) for n in names if n.startswith(f"{key}="))


def folder_join(spark: SparkSession, left: str, right: str, key: str, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """A join of two tables in hive-style folders on the folder key (and further columns), folder by
    folder and without a shuffle: a task for each value holds both sides' rows of it, which must fit a
    sort on disk.  Inner, left, semi and anti joins from the left; null keys match nothing."""
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"a join of folders cannot be {how}")
    sides = [spark.read.option("basePath", p).parquet(p) for p in (left, right)]
    values = folder_values(spark, left, key)
    shared = set(values) & set(folder_values(spark, right, key))
    out = None
    for v in values:
        if v == _NULL_FOLDER or (v not in shared and how in {"inner", "left_semi"}):
            same = [s.filter(F.lit(False)) for s in sides] if how in {"inner", "left_semi"} else [sides[0].filter(F.col(key).isNull()), sides[1].filter(F.lit(False))]
        else:
            same = [s.filter(F.col(key).cast("string") == v) for s in sides]
        a, b, columns = same[0].coalesce(1), same[1].coalesce(1), [key, *(on or [])]
        if how in {"inner", "left"}:
            part = a.join(b.hint("merge"), columns, how)
        else:  # Catalyst would push a semi or anti join below the coalesce
            there = b.select(*columns).dropDuplicates().withColumn("__there", F.lit(True))
            met = a.join(there.hint("merge"), columns, "left")
            part = met.filter(F.col("__there").isNotNull() if how == "left_semi" else F.col("__there").isNull()).drop("__there")
        part = apart(part)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = sides[0].join(sides[1], [key, *(on or [])], how)
    return out


_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def apart(df: DataFrame) -> DataFrame:
    """df, one that a union keeps in tasks of its own: Spark puts children of one partition each into
    one task, and an Expand hides that there is only one."""
    return df.withColumn("__one", F.lit(1)).unpivot(df.columns, ["__one"], "__name", "__value").select(*df.columns)
