"""Readers for the Parquet tables of one data directory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the directory `sf_dir`, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many tasks as there are cores, if its scan has fewer: one small file is one task, and what is costly
    for each row would run in it alone. A table of many files stays as it is and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt by `key`, whose values hardly repeat, over as many tasks as its scan has, one a core at least. For narrow
    rows that are costly each: of a file's splits only those with a row group in them hold rows, however many there are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), key)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df`, written as Parquet below spark.checkpoint.dir and read again, so that what several parts of a plan need is
    made once. Where that folder is unset a temporary one is used, if the master is local."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyscope-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
