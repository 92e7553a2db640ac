"""Session settings the operators rely on, and staging through the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results (time zone) or that the plans are designed
# around (adaptive execution: runtime broadcast, skew splitting, coalescing).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts are long: a Python worker holds a few megabytes of them at a time.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # The Parquet reader holds a batch of rows in one array a column.
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    # Of a repeated JSON key the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marketsense")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only where the cluster names none, a folder beside the tables is used: the
    warehouse is shared as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return folder or join_path(spark.conf.get("spark.sql.warehouse.dir"), "_stages")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from the files.

    For results that a plan reads more than once and that are dear to compute
    (scored text) or small (series).  Unlike a cache it survives the loss of
    executors: a lost task re-reads its files.
    """
    spark, path = df.sparkSession, staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[str] = []


def staged_path(spark: SparkSession, name: str) -> str:
    """A new folder for a staged table; ``staged_since`` knows it."""
    path = join_path(shared_folder(spark), "marketsense", f"{name}-{uuid.uuid4().hex}")
    _STAGED.append(path)
    return path


def staged_since(mark: int = 0) -> list[str]:
    """Folders of the staged tables of this process, from the ``mark``-th on; their number is the next mark."""
    return _STAGED[mark:]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Give back the space of staged tables that nobody reads any more.

    A table is overwritten with an empty one: Spark itself then removes the files,
    wherever they are.  Frames that still read them fail; release only what is done with.
    """
    for path in paths:
        spark.range(0).write.mode("overwrite").parquet(path)
        if path in _STAGED:
            _STAGED[_STAGED.index(path)] = ""


def join_path(folder: str, *parts: str) -> str:
    return "/".join([folder.rstrip("/"), *parts]) if ":/" in folder else os.path.join(folder, *parts)
