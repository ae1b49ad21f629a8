"""Session, table access and materialisation helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("threadloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only in local mode, where every task
    runs on this machine, a folder below the warehouse directory takes its place.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all machines share")
    return spark.conf.get("spark.sql.warehouse.dir", os.path.abspath("spark-warehouse")).rstrip("/") + "/_shared"


#: Tables written by cut_lineage that are still there, with their sessions.
_TABLES: dict[str, SparkSession] = {}


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives the loss of any executor and starts a fresh plan, so loops
    neither grow their lineage nor recompute earlier rounds. The table goes with
    :func:`forget`, with :func:`release`, or at the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadloom/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _TABLES[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table of a result of :func:`cut_lineage` that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path in _TABLES:
        drop_path(_TABLES.pop(path), path)


@atexit.register
def release() -> None:
    """Delete all tables that :func:`cut_lineage` has left; results that read them are void then."""
    while _TABLES:
        path, spark = _TABLES.popitem()
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone, and its folder is the cluster's to clear
            pass


def held(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` that is not pushed below the columns computed so far.

    Pushing a filter below a projection writes the projection's expressions into it a
    second time. Where these are long chains over arrays, that costs more than the
    rows it saves; a non-deterministic column in between keeps the optimiser off.
    """
    return df.withColumn("_held", F.monotonically_increasing_id() >= 0).where(F.when(F.col("_held"), condition)).drop("_held")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop's file system API; missing paths are fine."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    Needed where the package is not installed and the session was started from
    another folder; the path must exist on the executors, as in local mode.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    return spark
