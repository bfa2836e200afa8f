"""Session services that every subpackage may use: code shipping and shared storage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Make ``cellweave`` importable in Python workers.

    Nothing happens where the workers already inherit the repository on
    ``PYTHONPATH``; otherwise a small zip of the package is added to the session
    once, which Spark's file server hands to every executor.
    """
    root = str(PACKAGE_ROOT.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_cellweave_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="cellweave-")) / "cellweave.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(PACKAGE_ROOT.rglob("*.py")):
            out.write(path, str(Path("cellweave") / path.relative_to(PACKAGE_ROOT)))
    sc.addPyFile(str(target))
    sc._cellweave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where the setting is absent, only a session whose executors are threads of the
    driver (tests, notebooks on one machine) gets a private temporary folder; a cluster
    is told to name one, as its machines do not see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = getattr(sc, "_cellweave_shared", None)
        if not found:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="cellweave-shared-")
            sc._cellweave_shared = found
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cellweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a ``materialize``d frame that nothing reads any more; other frames are left alone."""
    path = getattr(df, "_cellweave_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    df._cellweave_path = None
