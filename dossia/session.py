"""Session helpers: loading tables and cutting lineage."""

from __future__ import annotations

import atexit
import os
import py_compile
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "dossia", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect; values already set by the cluster stay."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process, so that a folder of this machine is shared by all of them."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; only where all is one process one is made here."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="dossia-")
        spark.conf.set("spark.checkpoint.dir", d)
        atexit.register(shutil.rmtree, d.removeprefix("file://"), ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_TABLES: dict[str, list[str]] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage is cut and the rows survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/dossia-{uuid.uuid4().hex}.parquet"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables this application has written to the shared folder, once no result that reads them is wanted; their number."""
    sc = spark.sparkContext
    paths = _TABLES.pop(sc.applicationId, [])
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Give the tasks the package although it is not installed: by path where all is one machine's process, else as a zip file."""
    sc = spark.sparkContext
    if is_local(spark):
        path = sc.environment.get("PYTHONPATH", "")
        if root not in path.split(":"):
            sc.environment["PYTHONPATH"] = ":".join(x for x in (root, path) if x)
        return
    if sc.applicationId in _SHIPPED:
        return
    d = tempfile.mkdtemp(prefix="dossia-")  # of the driver, which serves the file to executors that start later, too
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    name = os.path.join(d, "dossia_code.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(os.path.join(root, "dossia")):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    inside = os.path.relpath(full, root)
                    z.write(full, inside)
                    py_compile.compile(full, os.path.join(d, "c.pyc"), dfile=inside, invalidation_mode=py_compile.PycInvalidationMode.UNCHECKED_HASH)
                    z.write(os.path.join(d, "c.pyc"), inside + "c")
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def parallelism(spark: SparkSession) -> int:
    """Number of partitions a shuffle of this session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
