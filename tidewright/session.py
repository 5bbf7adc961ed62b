"""Session factory and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidewright", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A UTC session with adaptive execution on; anything already configured wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset on a local master (tests, local use), a local folder is chosen and set; on a
    cluster a folder of one machine would lose what other machines write, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"tidewright-{uuid.uuid4().hex[:12]}")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of what finished steps hold: Spark removes their broadcasts and shuffle files only when the driver collects its garbage, which a driver
    that does nothing but plan many small steps hardly ever does."""
    gc.collect()
    spark._jvm.System.gc()


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, if it is there."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, tasks: int = 1) -> DataFrame:
    """Deals the rows of a table that comes in fewer partitions than there are cores (times `tasks`), so that costly work on each row uses them all.
    A table of enough partitions, which is every large one, stays as it is."""
    wanted = df.sparkSession.sparkContext.defaultParallelism * tasks
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
