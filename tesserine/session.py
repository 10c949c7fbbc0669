"""One place for the session settings that the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: AQE re-plans joins and splits skewed ones at run time; UTC keeps timestamp text stable.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass the cluster's own session to the operators."""
    folder = tempfile.mkdtemp(prefix="tesserine-")
    atexit.register(shutil.rmtree, folder, True)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tesserine").config("spark.checkpoint.dir", folder)
    conf = SETTINGS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, wherever they run and whatever their path is.

    The package is a few dozen source files; they are zipped once per application and sent by Spark itself."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tesserine-package-")  # read by the driver's own file server only
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
