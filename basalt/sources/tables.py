"""Parquet and CSV tables in and out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _local(spark: SparkSession) -> str:
    """A temporary folder, where driver and tasks share one machine."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary folder where the session names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _local(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says; only where nothing is set, to a temporary folder."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_local(spark))


def read_one_source(spark: SparkSession, file: str | None = None, folder: str | None = None) -> DataFrame:
    """A Parquet file or all of a folder's; exactly one must be named."""
    if (file is None) == (folder is None):
        raise ValueError("name either a file or a folder")
    return spark.read.parquet(file or folder)


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files of a folder with the ``split`` that the beginning of a file's name tells."""
    name = F.col("_metadata.file_name")
    split = F.when(name.startswith("train"), "train").when(name.startswith("val"), "validation").when(name.startswith("test"), "test")
    return spark.read.parquet(folder).withColumn("split", split).filter("split is not null")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A wide label table; all columns stay text until their target is known."""
    return spark.read.csv(path, header=True, inferSchema=False)


def trait_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("group string, phenotype string").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, rows_a_file: int | None = None) -> None:
    """A Parquet table; with ``rows_a_file`` a new file after so many rows."""
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", rows_a_file) if rows_a_file else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def fixed_size(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Vectors as floats, all of length ``size``; another length raises."""
    checked = F.when(F.size(vector) == size, F.col(vector).cast("array<float>")).otherwise(F.raise_error(F.lit(f"{vector} must have {size} elements")).cast("array<float>"))
    return df.withColumn(vector, F.when(F.col(vector).isNotNull(), checked))


def pending(files: DataFrame, done: DataFrame, name: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Files of the slice [start, end) by name that ``done`` doesn't hold yet."""
    ordered = files.orderBy(name).offset(start)
    return (ordered if end is None else ordered.limit(end - start)).join(done.select(name), name, "left_anti")


def union_splits(**splits: DataFrame) -> DataFrame:
    """Frames of splits in one, with a ``split`` column."""
    out = None
    for name, df in splits.items():
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
