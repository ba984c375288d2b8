"""Tables that outlive a stage, and this package's code for Python workers."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def path_of(spark: SparkSession, uri: str):
    """The Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which goes when the session's JVM ends.

    Only a local session may have no such folder: then it is a temporary one, set here for all that follows.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = found.get() if found.isDefined() else None
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        top = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", top)
    out = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path, system = path_of(spark, out)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what follows starts from there, whatever executors are lost."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: as an archive in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    uri = f"{shared_dir(spark, 'code')}/tessera-code.zip"
    path, system = path_of(spark, uri)
    out = system.create(path)
    try:
        out.write(bytearray(held.getvalue()))
    finally:
        out.close()
    sc.addPyFile(uri)
    sc._tessera_shipped = True
