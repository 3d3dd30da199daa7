"""Tables that cut lineage, in the folder that the session names for it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a session whose driver and executors are one process gets a folder of its own; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tersa-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once under the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/tersa-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tersa_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a ``materialize``d table that no later plan reads."""
    path = getattr(df, "_tersa_path", None)
    if path:
        target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that sorts both. Spark takes what scanners, templates and explosions make for as small as the files below them, and would broadcast it."""
    return df.hint("merge")
