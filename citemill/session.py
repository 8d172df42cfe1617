"""Session defaults and the few physical-plan decisions shared by operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Up to this number of rows a small result is kept on the driver, and staged beyond.
HELD_ROWS = 20_000


def build_session(app: str = "citemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect. A cluster's own
    spark-submit settings win over nothing here but the listed keys."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows. Reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan at least one partition per core before per-row text work.

    A file with one row group is one task however large its texts are. Tables
    of many files already fill the cluster and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Where it
    is unset and all runs in one process, as in local tests, a temporary one that
    ends with the process. Executors elsewhere could not read that, so there the
    setting is required."""
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {key} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="citemill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(key, folder)
    return folder


def spread_by_key(df: DataFrame, key: str) -> DataFrame:
    """Partition by ``key`` for costly work per row. The fixed number of
    partitions keeps adaptive execution from merging them because they are few
    bytes; later steps on the same key need no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    For a result that several later steps read: it is computed once, survives
    the loss of executors, and its columns and row groups can still be skipped.
    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame, name: str, limit: int = HELD_ROWS) -> tuple[DataFrame, pa.Table | None]:
    """``df`` computed once: up to ``limit`` rows as a local table, which is given too, more of them staged."""
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows <= limit:
        return df.sparkSession.createDataFrame(rows, df.schema), rows
    return stage(df, name), None


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a path when the application ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
