"""SparkSession construction shared by tests, bench and applications."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: UTC, AQE and skew-join handling.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset so that spark-submit's values hold.
    """
    builder = SparkSession.builder.appName("tessella")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(**conf: str) -> SparkSession:
    """A small local session for tests and benchmarks."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    return build_session(f"local[{cpus}]", 8, **({"spark.driver.memory": "8g"} | conf))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one, kept in the session, on a single machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessella.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("tessella.shared.dir", at)
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each SparkContext, for the operators that run Python there."""
    context = spark.sparkContext
    if getattr(context, "_tessella_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-code-"), "tessella_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    context._tessella_shipped = True
