"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one of a local master (tests), else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/leafmill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, path: str, **options: str) -> None:
    """Write a table as Parquet under path, whole or not at all, and never over something that is there.

    The files are staged beside the target, and one rename that refuses an existing target makes them visible.  A failed
    write leaves neither the target nor the stage behind.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs_path, context = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.FileContext
    target = fs_path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    if fs.exists(target):
        raise FileExistsError(path)
    stage = fs_path(target.getParent(), f".{target.getName()}.stage-{uuid.uuid4().hex}")
    try:
        df.write.options(**options).parquet(stage.toString())
        flags = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.getFileContext(target.toUri(), conf).rename(stage, target, flags)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise FileExistsError(path) from e
        raise
    finally:
        fs.delete(stage, True)
