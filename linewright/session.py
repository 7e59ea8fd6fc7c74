"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN_FOLDERS: dict[str, str] = {}
#: The most rows and bytes that go to Python at once where rows hold whole texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("linewright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """This run's folder for checkpoints and intermediate tables.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a
    plain local master may do without, because there every task sees the
    driver's disk. The run's folder is removed when the driver ends.
    """
    run = spark.sparkContext.applicationId
    if run not in _RUN_FOLDERS:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
            shared = tempfile.mkdtemp(prefix="linewright-")
        folder = f"{shared.rstrip('/')}/linewright-{run}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _RUN_FOLDERS[run] = folder
    return _RUN_FOLDERS[run]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` gave, once nothing that is still to run reads them.

    Spark drops the shuffle files of finished jobs when the driver's JVM collects
    its garbage, which may be long after; it is asked to do so here.
    """
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` over all shuffle partitions.

    A fixed number, for rows that are few bytes but much work: sized by bytes
    they would end up in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now sends few rows and bytes at once to Python; smaller settings stay.

    Rows of texts differ much in length, so a number of rows alone bounds nothing.
    """
    spark, prefix = df.sparkSession, "spark.sql.execution.arrow."
    if not 0 < int(spark.conf.get(prefix + "maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set(prefix + "maxRecordsPerBatch", BATCH_ROWS)
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if in_bytes(spark.conf.get(prefix + "maxBytesPerBatch")) > BATCH_BYTES:
        spark.conf.set(prefix + "maxBytesPerBatch", BATCH_BYTES)
    return df
