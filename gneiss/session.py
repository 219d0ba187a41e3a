"""Sessions: one typed configuration translated to Spark settings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession


@dataclass
class EngineConfig:
    """Distribution settings, by what they do; `confs` gives the Spark settings they stand for."""

    scan_bytes_per_partition: int = 128 << 20
    shuffle_bytes_per_partition: int = 64 << 20
    max_tasks_per_stage: int = 0  # 0: the cluster's default parallelism, coalesced at run time
    adaptive: bool = True
    broadcast_joins: bool = True
    broadcast_bytes: int = 10 << 20
    compression: str = "lz4"  # lz4, zstd or none
    fetch_buffer_bytes: int = 64 << 20
    arrow_batch_rows: int = 10_000
    prefer_hash_joins: bool = False
    quoted_identifiers: bool = True  # "x" is a column, not a text
    time_zone: str = "UTC"
    declared_order: bool = True  # bucketed tables of one file a bucket are taken as sorted
    lenient: bool = False  # overflow wraps and bad casts give null instead of an error
    extra: dict[str, str] = field(default_factory=dict)

    def confs(self) -> dict[str, str]:
        flag = lambda x: str(x).lower()
        out = {
            "spark.sql.files.maxPartitionBytes": str(self.scan_bytes_per_partition),
            "spark.sql.adaptive.enabled": flag(self.adaptive),
            "spark.sql.adaptive.coalescePartitions.enabled": flag(self.adaptive),
            "spark.sql.adaptive.skewJoin.enabled": flag(self.adaptive),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(self.shuffle_bytes_per_partition),
            "spark.sql.autoBroadcastJoinThreshold": str(self.broadcast_bytes if self.broadcast_joins else -1),
            "spark.sql.adaptive.autoBroadcastJoinThreshold": str(self.broadcast_bytes if self.broadcast_joins else -1),
            "spark.sql.join.preferSortMergeJoin": flag(not self.prefer_hash_joins),
            "spark.shuffle.compress": flag(self.compression != "none"),
            "spark.reducer.maxSizeInFlight": str(self.fetch_buffer_bytes),
            "spark.sql.execution.arrow.maxRecordsPerBatch": str(self.arrow_batch_rows),
            "spark.sql.ansi.doubleQuotedIdentifiers": flag(self.quoted_identifiers),
            "spark.sql.session.timeZone": self.time_zone,
            "spark.sql.legacy.bucketedTableScan.outputOrdering": flag(self.declared_order),
            "spark.sql.ansi.enabled": flag(not self.lenient),
        }
        if self.compression != "none":
            out["spark.io.compression.codec"] = self.compression
        if self.max_tasks_per_stage:
            out["spark.sql.shuffle.partitions"] = str(self.max_tasks_per_stage)
        return out | self.extra

    def apply(self, spark: SparkSession) -> SparkSession:
        """Sets what a running session can still change."""
        for key, value in self.confs().items():
            if spark.conf.isModifiable(key):
                spark.conf.set(key, value)
        return spark


def session(name: str = "gneiss", master: str | None = None, config: EngineConfig | None = None, prepare: Iterable[Callable[[SparkSession], SparkSession | None]] = ()) -> SparkSession:
    """A session with the configuration and the SQL functions of this library.  prepare: steps that
    add to the session in order (functions, views, settings), each given what the one before returned."""
    from gneiss.functions.registry import register

    config = config or EngineConfig()
    builder = SparkSession.builder.appName(name).config(map=config.confs())
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    register(spark)
    _CONFIGS[_key(spark)] = config
    for step in prepare:
        spark = step(spark) or spark
    return spark


_CONFIGS: dict[str, EngineConfig] = {}  # by session


def _key(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def set_option(spark: SparkSession, statement: str) -> None:
    """Runs SET statements, also with the engine's own names: SET gneiss.<field> = value.  All settings
    that the field stands for are set, whatever they were; a field that a running session cannot
    change is an error."""
    text = statement.strip().rstrip(";")
    if not text.lower().startswith("set gneiss."):
        spark.sql(text)
        return
    name, _, value = text[len("set gneiss.") :].partition("=")
    name, raw = name.strip(), value.strip().strip("'")
    now = _CONFIGS.get(_key(spark)) or EngineConfig()
    kinds = {f.name: type(getattr(now, f.name)) for f in fields(now) if f.name != "extra"}
    if name not in kinds:
        raise ValueError(f"no setting gneiss.{name}; there are {', '.join(sorted(kinds))}")
    if kinds[name] is bool and raw.lower() not in {"true", "false"}:
        raise ValueError(f"gneiss.{name} is true or false")
    parsed = raw.lower() == "true" if kinds[name] is bool else kinds[name](raw)
    other = not parsed if kinds[name] is bool else parsed + 1 if kinds[name] is int else parsed + "-"
    then, with_other = replace(now, **{name: parsed}), replace(now, **{name: other})
    wanted, against = then.confs(), with_other.confs()
    for key in [k for k in wanted if wanted[k] != against.get(k) and k not in now.extra]:
        if spark.conf.isModifiable(key):
            spark.conf.set(key, wanted[key])
        elif spark.conf.get(key, None) != wanted[key]:
            raise ValueError(f"gneiss.{name} cannot be changed while the session runs")
    _CONFIGS[_key(spark)] = then
