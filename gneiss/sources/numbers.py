"""Number ranges (in SQL: FROM numbers(start, end), see the dialect) and a data source fed by work units."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def numbers(spark: SparkSession, start: int, end: int, per_task: int | None = None) -> DataFrame:
    """Integers start to end - 1, `per_task` of them in each partition."""
    parts = max(1, -(-(end - start) // per_task)) if per_task else None
    return spark.range(start, end, 1, parts).withColumnRenamed("id", "number")


class Unit(InputPartition):
    def __init__(self, task: int, partition: int, operations: list[str]):
        super().__init__((task, partition))
        self.task, self.partition, self.operations = task, partition, operations


class WorkUnits(DataSource):
    """Rows made from descriptors: option tasks, and option units, one list of operations a partition
    ("rows(2) wait(5)|rows(1)"): rows(n) makes n rows, wait(ms) pauses, err(message) fails."""

    @classmethod
    def name(cls) -> str:
        return "work_units"

    def schema(self) -> str:
        return "tag string, task bigint, partition bigint, letter string"

    def reader(self, schema) -> DataSourceReader:
        return _UnitReader(self.options)


class _UnitReader(DataSourceReader):
    def __init__(self, options):
        self.tag = options.get("tag", "")
        self.tasks = int(options.get("tasks", "1"))
        self.units = [u.split() for u in options.get("units", "").split("|")]

    def partitions(self) -> list[InputPartition]:
        return [Unit(i % self.tasks, i // self.tasks, u) for i, u in enumerate(self.units)]

    def read(self, partition: Unit) -> Iterator[tuple]:
        made = 0
        for operation in partition.operations:
            name, _, argument = operation.partition("(")
            argument = argument.rstrip(")")
            if name == "rows":
                for _ in range(int(argument)):
                    yield (self.tag, partition.task, partition.partition, chr(ord("a") + made % 26))
                    made += 1
            elif name == "wait":
                time.sleep(int(argument) / 1000)
            elif name == "err":
                raise RuntimeError(argument)
            else:
                raise ValueError(f"unknown operation {operation}")


def work_units(spark: SparkSession, tag: str, tasks: int, units: list[str]) -> DataFrame:
    spark.dataSource.register(WorkUnits)
    return spark.read.format("work_units").option("tag", tag).option("tasks", tasks).option("units", "|".join(units)).load()
