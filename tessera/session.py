"""Session defaults and the shared work folder.

A cluster brings its own session; :func:`local_session` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tessera", memory: str = "6g", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, few shuffle partitions)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder.

    Where the session names none, a local session (one machine, as in tests) gets a temporary one;
    a cluster gets an error, as rows written to the disk of one machine would be lost to the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    own = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "shared")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder; Hadoop removes it when the driver's JVM ends."""
    sc = spark.sparkContext
    base = f"{shared_folder(spark)}/tessera-{sc.applicationId}"
    known: set[str] = sc.__dict__.setdefault("_tessera_folders", set())
    if base not in known:
        path = sc._jvm.org.apache.hadoop.fs.Path(base)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        known.add(base)
    return base


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    ``by`` is a column with few values, each of which gets a folder that readers can leave out.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._tessera_shipped = True
