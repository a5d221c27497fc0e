"""What operators take from the session: tables, and a shared folder that outlives an executor."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where that is unset and the master is local
    (tests, a laptop) one is made on this machine; on a cluster an unset folder is an error,
    since a local one would be lost with its executor."""
    conf = spark.sparkContext.getConf()
    if at := conf.get("spark.checkpoint.dir"):
        return at.rstrip("/")
    if at := spark.conf.get("tidewords.shared.dir", None):
        return at
    master = conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="tidewords-")
    spark.conf.set("tidewords.shared.dir", at)
    return at


#: Tables that this process has settled.
_SETTLED: list[str] = []


def _leave(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped context can't reach the folder
        with contextlib.suppress(Exception):  # nor can one whose JVM has left first
            swept(spark)


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors. Results are lazy and may read
    it at any time, so it stays until :func:`swept` or the end of this process."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tidewords-{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    if not _SETTLED:
        atexit.register(_leave, spark)
    _SETTLED.append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file, over what is there, to any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def swept(spark: SparkSession, names: tuple[str, ...] = ()) -> int:
    """Deletes what this process settled (of the given names, else all) and gives the number of tables: to be called when no result
    that was built on them is read any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for at in list(_SETTLED):
        if not names or any(f"/tidewords-{n}-" in at for n in names):
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
            _SETTLED.remove(at)
            gone += 1
    return gone


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, if ``PYTHONPATH`` doesn't already: on this machine by its path,
    on other machines as a zip in the shared folder. Once per context."""
    root = str(Path(__file__).resolve().parents[1])
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or root in sc.environment.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, sc.environment.get("PYTHONPATH", "")) if p)
    if sc.master.startswith("local"):
        return
    folder = shared_dir(spark).removeprefix("file://")
    if "://" in folder:
        return  # not a file system of this machine: pass the package with --py-files
    os.makedirs(folder, exist_ok=True)
    at = os.path.join(folder, f"tidewords-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(Path(root, "tidewords").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(at)
