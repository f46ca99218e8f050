"""Session helpers: the local session of tests and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the command line; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, in local mode one that ends with the process, on a
    cluster one beside its tables, if these aren't on a machine's own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            tables = spark.conf.get("spark.sql.warehouse.dir")
            if "://" not in tables or tables.startswith("file:"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            return f"{tables.rstrip('/')}/_seriesloom"
        where = tempfile.mkdtemp(prefix="seriesloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


#: What this process has put into the shared folder.
_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there goes with `release`, at the latest when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def release() -> None:
    """Remove all tables that `cut` wrote. Results that were computed from them and not yet written can't be read any
    more, so a long session calls this between its jobs."""
    while _made:
        _drop(*_made.pop())


atexit.register(release)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps neither recompute it nor depend
    on any one executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores if it is read in fewer partitions than there are cores, as a small file is; else as
    it is, without a shuffle. Select the columns that are needed first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
