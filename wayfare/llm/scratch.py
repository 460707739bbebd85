"""Written intermediate tables: they cut lineage and survive the loss of an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfare.session import file_system, shared_folder

_folders: dict[str, str] = {}
# what an application has written and not deleted, in order
_tables: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder below the shared one; deleted when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_folder(spark)}/wayfare-llm-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders[app])
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _folders[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.setdefault(folder(spark), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """The place in the order of tables from which on ``keep_last`` deletes."""
    return len(_tables.setdefault(folder(spark), []))


def keep_last(spark: SparkSession, since: int) -> None:
    """Delete the tables written since, but for the last, which no longer needs them."""
    tables = _tables[folder(spark)]
    for name in tables[since:-1]:
        files, path = file_system(spark, name)
        files.delete(path, True)
    tables[since:-1] = []
