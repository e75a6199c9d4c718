"""Session creation and lineage cutting that survives lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine, in tests or on a laptop, is a folder of our own made
    where it is unset; on a cluster that is an error, as executors would not see
    each other's files.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


_written: list[str] = []


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    ``Dataset.checkpoint`` computes its input twice; a written table costs one
    pass, cuts the lineage in the same way and outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
    except BaseException:
        delete_path(spark, path)
        raise
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed Parquet tables in a folder; none if it doesn't exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = lambda d: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS"))
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory() and done(x.getPath()))


def forget(df: DataFrame) -> None:
    """Delete the one materialized table ``df`` was read from."""
    for f in df.inputFiles()[:1]:
        for path in list(_written):
            if path.split("://")[-1] in f:
                _delete(df.sparkSession, path)


def written() -> set[str]:
    """Paths of the materialized tables that are still there."""
    return set(_written)


def release(spark: SparkSession, paths: set[str] | None = None) -> None:
    """Delete the materialized tables at ``paths``, or all of this process.

    Call it only when no DataFrame built on them will be read again.
    """
    for path in list(_written):
        if paths is None or path in paths:
            _delete(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _delete(spark: SparkSession, path: str) -> None:
    delete_path(spark, path)
    _written.remove(path)
