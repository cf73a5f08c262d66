"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside spark.checkpoint.dir. Where that is unset, a local run gets a temporary one; on a cluster it must be set, as executors see no folder of the driver's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written as Parquet, in a new shared folder unless one is named, and read again: the plan restarts there, and a lost executor costs no earlier step."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a folder that saved wrote, once what was made of it is written too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's own setting by which the shuffle files of a query go as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """The intermediate tables of one job: with Workspace(spark) as work, work.keep(df) writes one, and all of them are deleted at the end, when the result is written.

    tidy: also the shuffle files of each step are deleted as it ends. Such a job's steps must restart from written tables; a DataFrame that is run twice shuffles again."""

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.folders, self.tidy, self.before = spark, [], tidy, None
        self.tables: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.folders.append(shared_folder(self.spark))
        table = saved(df, self.folders[-1])
        self.tables[id(table)] = table, self.folders[-1]
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of keep that no later step reads."""
        for table in tables:
            _, folder = self.tables.pop(id(table))
            self.folders.remove(folder)
            forget(self.spark, folder)

    def __enter__(self) -> Workspace:
        if self.tidy:
            self.before = self.spark.conf.get(CLEANUP, None)
            self.spark.conf.set(CLEANUP, "true")
        return self

    def __exit__(self, *error) -> None:
        if self.tidy:
            if self.before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, self.before)
        for folder in self.folders:
            forget(self.spark, folder)
        self.folders, self.tables = [], {}
