"""Tables: registration, hive-style folders, views, introspection."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gneiss.functions import dialect, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Relations that queries use again and again and that are made from other tables.
DERIVED = {
    "partsupp": "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost, CAST(sum(l_quantity) AS BIGINT) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey",
}
_kept: dict[tuple[str, str, str], DataFrame] = {}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation, made once for a session and a folder and kept with the executors (in memory,
    on disk beyond it); a lost part is made again.  forget() drops what is kept."""
    key = (spark._jsparkSession.sessionUUID(), sf_dir, name)
    if key not in _kept:
        register_tables(spark, sf_dir, tables_in(DERIVED[name]))
        _kept[key] = spark.sql(DERIVED[name]).persist(StorageLevel.MEMORY_AND_DISK)
    return _kept[key]


def forget(spark: SparkSession) -> None:
    for key in [k for k in _kept if k[0] == spark._jsparkSession.sessionUUID()]:
        _kept.pop(key).unpersist()


def register_tables(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def tables_in(sql: str) -> list[str]:
    """The known tables that a statement names."""
    words = set(re.findall(r"\w+", sql.lower()))
    return [t for t in TABLES if t in words]


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a statement, in this library's dialect, over the tables of a folder."""
    names = tables_in(sql)
    register_tables(spark, sf_dir, names)
    for name in DERIVED:
        if re.search(rf"(?i)\b{name}\b", sql):
            derived(spark, sf_dir, name).createOrReplaceTempView(name)
    return run(spark, sql, names)


def run(spark: SparkSession, sql: str, tables: Iterable[str] | None = None) -> DataFrame:
    """Runs a statement in this library's dialect.  Whole-number columns of the tables (all temporary
    views that the statement names, where none are given) divide without a fraction; a name that is
    another kind of number in any of them does not."""
    if tables is None:
        words = {t.lower().strip("`") for t in dialect.tokens(sql)}
        tables = [t.name for t in spark.catalog.listTables() if t.isTemporary and t.name.lower() in words] if "/" in sql else []
    if any(t.lower() in registry.NAMES for t in dialect.tokens(sql)):
        registry.register(spark)
    whole, other = set(), set()
    for name in tables if "/" in sql else ():
        for f in spark.table(name).schema:
            (whole if isinstance(f.dataType, IntegralType) else other).add(f.name.lower())
    text, plain = dialect.translate(sql, whole - other), dialect.translate(sql, whole - other, not_in=False)
    try:
        return spark.sql(text)
    except AnalysisException:
        if text == plain:
            raise
    return spark.sql(plain)  # a key of a query two levels out, or what is an error anyhow


def register_parquet(spark: SparkSession, name: str, path: str, partition_types: dict[str, str] | None = None) -> DataFrame:
    """A view over a file or folder; folder keys (k=v) become columns of the given types."""
    df = spark.read.parquet(path)
    for column, kind in (partition_types or {}).items():
        df = df.withColumn(column, F.col(column).cast(kind))
    df.createOrReplaceTempView(name)
    return df


def register_csv(spark: SparkSession, name: str, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df.createOrReplaceTempView(name)
    return df


def register_json(spark: SparkSession, name: str, path: str, schema: str | None = None) -> DataFrame:
    df = (spark.read.schema(schema) if schema else spark.read).json(path)
    df.createOrReplaceTempView(name)
    return df


def register_avro(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Needs Spark's avro module on the class path; Spark's error says so where it is missing."""
    df = spark.read.format("avro").load(path)
    df.createOrReplaceTempView(name)
    return df


def from_path(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """SELECT * FROM a path."""
    return spark.sql(f"SELECT * FROM {kind}.`{path}`")


def create_view(spark: SparkSession, name: str, sql: str, columns: list[str] | None = None) -> None:
    listed = f"({', '.join(columns)})" if columns else ""
    spark.sql(f"CREATE OR REPLACE TEMP VIEW {name}{listed} AS {sql}")


def drop_view(spark: SparkSession, name: str) -> None:
    spark.catalog.dropTempView(name)


def show_columns(spark: SparkSession, name: str) -> DataFrame:
    """table_name, column_name, data_type, is_nullable of a table or view."""
    rows = [(name, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for f in spark.table(name).schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, is_nullable string")


def copy_to(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> None:
    """COPY ... TO path STORED AS kind."""
    writer = df.write.format(kind).options(**(options or {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str], sort_by: list[str] | None = None) -> None:
    """Hive-style folders, one set of files a key, rows in the declared order within files."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *(sort_by or []))
    rows.write.partitionBy(*keys).parquet(path)


def cached(spark: SparkSession, name: str) -> DataFrame:
    """Keeps a table's column batches with the executors that read them."""
    spark.catalog.cacheTable(name)
    return spark.table(name)
