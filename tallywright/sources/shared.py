"""The folder that driver and executors share, and tables in it that cut a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str = "streams") -> str:
    """A fresh folder that driver and executors share; only in local mode may ``spark.checkpoint.dir`` be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{base or spark.conf.get('spark.sql.warehouse.dir')}/{kind}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there: what is read several times is worked out once, and lost executors cost no more than a read."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, wherever the cluster's file systems have it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
