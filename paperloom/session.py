"""Sessions, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: str = "*", app: str = "paperloom") -> SparkSession:
    """A local session with the settings the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PAPERLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where
    that is unset (tests, a laptop) a temporary one is made, and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/paperloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage is cut, a lost executor costs no recomputation, and readers
    get column pruning, which ``checkpoint()`` would not give them.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_partitions(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Give a CPU-heavy stage at least one partition per core.

    Large inputs arrive with more splits than cores and pass through
    untouched; only an input of few splits is redistributed.
    """
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if n_partitions(df) < least else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="paperloom-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        name = shutil.make_archive(f"{folder}/paperloom", "zip", os.path.dirname(root), os.path.basename(root))
        spark.sparkContext.addPyFile(name)
        _SHIPPED.add(app)
