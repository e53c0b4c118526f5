"""Session helpers: a configured SparkSession and the shared checkpoint folder."""
from __future__ import annotations

import os
import tempfile

from pyspark import SparkContext
from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "moneta") -> SparkSession:
    """Session for tests, bench and local runs.

    The submitter's configuration wins: an active session is returned as it is, and
    settings that a running context or the submit arguments name are left alone.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        cpus = os.environ.get("BENCH_CPUS", "8")
        ours = {
            "spark.master": master or f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus),
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            # AQE may merge small shuffle partitions down to this size; at 256 KB a
            # CPU-heavy grouped Python stage over a few MB still gets several tasks
            # (no effect once partitions are large, as at scale)
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.driver.memory": os.environ.get("MONETA_DRIVER_MEMORY", "16g"),
        }
        given = os.environ.get("PYSPARK_SUBMIT_ARGS", "")  # --master and --conf of the submitter, before a JVM runs
        if "--master" in given or "spark.master=" in given:
            del ours["spark.master"]
        ours = {k: v for k, v in ours.items() if f"{k}=" not in given}
        builder = SparkSession.builder.appName(app_name)
        have = SparkContext._active_spark_context
        if have is not None:
            ours = {k: v for k, v in ours.items() if not have.getConf().contains(k)}
        spark = builder.config(map=ours).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Read from the session; only when it is unset and the master is local (tests,
    local runs) a fresh local folder is created and registered.  On a cluster an
    unset folder is an error: executors do not share a local one.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="moneta-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``moneta`` importable in the Python workers (pandas UDFs, grouped
    maps, streaming state functions): zip the package once per SparkContext and
    add it with ``addPyFile``, Spark's own code-distribution path."""
    import shutil

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="moneta-pkg-")
    archive = shutil.make_archive(os.path.join(out, "moneta"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="moneta")
    sc.addPyFile(archive)
    _SHIPPED.add(id(sc))
