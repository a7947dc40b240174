"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "riskfold",
                  shuffle_partitions: int = 8, driver_memory: str = "16g") -> SparkSession:
    """Local/test session.  On a cluster, the launcher's session is used as is."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset (tests,
    local runs) fall back to a fresh scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="riskfold-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return local


def materialize(df: DataFrame, keep_cached: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder
    (survives executor loss, unlike local checkpoints).  The input is
    persisted while the checkpoint is written so the plan runs once, not
    twice; the result is kept cached (memory, spilling to disk) when it is
    re-read by several statistics jobs, and its lineage is the checkpoint."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = df.checkpoint(eager=True)
    finally:
        df.unpersist()
    if not keep_cached:
        return out
    # a table re-read by many jobs should use every core; the checkpoint's own
    # partition count is known without running anything
    slots = df.sparkSession.sparkContext.defaultParallelism
    if out.rdd.getNumPartitions() < slots:
        out = out.repartition(slots)
    return out.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors
    share; Spark's writers create it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries run inside delete their shuffle files when they end; else these
    stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_rows(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append ``df`` to a folder of intermediate rows as compressed Parquet, one
    folder per value of ``by``: a table as long as the input neither stays in
    the executors' memory nor on their disks as plain rows."""
    with shuffles_removed(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").partitionBy(*(by or [])).parquet(path)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists: a part without rows is never written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def settle(df: DataFrame) -> DataFrame:
    """Evaluate a small statistics table (bounded by groups x columns x
    categories, never by rows) and re-create it as a local relation: cuts
    the lineage so later plans neither recompute it nor grow with it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data that this package wrote and no
    later plan reads; any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``riskfold`` importable in Python workers (Arrow UDFs pickle
    functions by module reference): zip the package once per context and add
    it with ``addPyFile`` so every executor receives it."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = tempfile.mkdtemp(prefix="riskfold-pkg-", dir="/tmp")
    path = os.path.join(out, "riskfold.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
