"""Tables in the folder that all executors share: intermediate results that cut a plan's lineage, and numbered writes that count only when
they are whole."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a temporary one, but only if driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"pathspark-{os.getpid()}")
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, system = _file_system(spark, path)
    system.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _file_system(spark, path)
    return system.exists(at)


def whole(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of folders path/name=n whose write has ended, ascending."""
    at, system = _file_system(spark, f"{path}/{name}=*/_SUCCESS")
    found = system.globStatus(at)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


class Scratch:
    """Tables of one owner: `with Scratch(spark) as keep: t = keep(df)` writes df and reads it back; all go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/pathspark-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read from there from now on, until the session's process ends."""
    scratch = Scratch(df.sparkSession)
    at, system = _file_system(scratch.spark, scratch.path)
    system.mkdirs(at)
    system.deleteOnExit(at)
    return scratch(df)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from now on. Spark removes such a checkpoint when nothing refers to it, if
    spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
