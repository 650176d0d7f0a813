"""Session helpers.

The library never creates a cluster session on its own; ``get_session`` is
for tests, the bench and local runs.  ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from the running session and only falls back to a
fresh local folder when the setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app: str = "tardy", extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "8g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster.

    Only a local session (one machine) without the setting gets a folder of
    its own; on a cluster the folder must be named, since executors would not
    see each other's files in a machine's temporary folder.
    """
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="tardy-ckpt-")
    spark.sparkContext.setCheckpointDir(conf)
    return spark.sparkContext.getCheckpointDir() or conf


def materialize(df):
    """Cut lineage: write the table into the cluster's checkpoint folder and
    read it back.

    Used where a derived table is read by several jobs (counting, sampling
    block bounds, ranking), so the upstream plan runs once.  A Parquet write
    is one job (``checkpoint()`` computes the plan twice, once to count and
    once to write) and the re-reads keep column pruning.  The files survive
    executor loss (shared storage) and are removed when the session ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "tables")
    df.write.parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark, kind: str) -> str:
    """A fresh folder under the checkpoint folder, removed when the session ends."""
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


_SHIPPED = "TARDY_SHIPPED"


def ship_package(spark) -> None:
    """Send this package's modules to the executors, once per application, so
    that Python tasks can import them wherever the driver was started."""
    sc = spark.sparkContext
    if sc.environment.get(_SHIPPED):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tardy-code-"), "tardy_modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tardy", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc.environment[_SHIPPED] = "1"
