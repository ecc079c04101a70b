"""Sessions, what executors need, and tables between stages."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its scan has fewer splits than that; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package once per application, for Python operators."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        at = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(at)
        _SHIPPED.add(app)
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder shared by driver and executors that the session names; a temporary one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/checkpoints/matchloom"


def folder(spark: SparkSession, path: str):
    """A path and its file system, as the JVM knows them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back, and say where; it goes at the end of the driver unless it is discarded before."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = folder(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """A table between stages: cuts lineage and survives lost executors."""
    return stored_at(df, label)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that stored_at wrote and no plan reads any more."""
    p, fs = folder(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)
