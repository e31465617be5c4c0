"""Shared scratch tables: cut a plan's lineage without tying it to one executor's disk.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a plain ``local[...]`` session that names
none gets a temporary folder; a cluster without that setting is refused, because a folder on one machine would be
invisible to the others.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scope:
    """Tables written inside `with Scope() as s:` go when it ends, but for those handed to `s.keep()`.

    What leaves the scope must be read from kept tables only. Kept tables belong to the scope around, if there is one.
    """

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, object]] = []
        self.kept: list[DataFrame] = []

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.append(table)
        return table

    def drop(self, *gone: DataFrame) -> None:
        """Remove tables that are not needed any more."""
        for table, path in self.tables:
            if any(table is g for g in gone):
                _remove(table.sparkSession, path)
        self.tables = [(t, p) for t, p in self.tables if not any(t is g for g in gone)]

    def __enter__(self) -> Scope:
        _scopes.append(self)
        return self

    def __exit__(self, *error) -> None:
        _scopes.remove(self)
        left = [(t, p) for t, p in self.tables if any(t is k for k in self.kept)]
        self.drop(*[t for t, p in self.tables if not any(t is k for k in self.kept)])
        if _scopes:
            _scopes[-1].tables += left


def _remove(spark: SparkSession, path) -> None:
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SETTING = "spark.checkpoint.dir"
_scopes: list[Scope] = []
_local: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="inkwell-"))


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` as Parquet in the shared folder and return it read back; it goes with its Scope, else when the JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/inkwell/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _scopes:
        _scopes[-1].tables.append((table, target))
    return table
