"""What the operators share: reading a table, and tables written to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CREATED: list[tuple[SparkSession, str]] = []

#: Rows in one Arrow batch. Texts may be long, so batches are kept short.
BATCH_ROWS = 1000
#: What counts as a large class in a join: more than this part of all rows, and so many rows.
HOT_PART = 1024
HOT_LEAST = 100


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Short Arrow batches, so that a worker's memory does not follow the length of texts. Plans are made when a
    result is asked for, so the setting stays with the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one. Where it is unset, as in tests, a temporary folder, if
    driver and tasks share one machine; otherwise it raises, as tasks would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _CREATED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with ``classes``, unique in ``keys``, whose ``size`` is their number of rows.

    Classes of more than a ``HOT_PART`` of all rows, of which there are fewer than ``HOT_PART``, are broadcast: no
    task gets all rows of a large class. All others are joined in a shuffle.
    """
    total = classes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.broadcast(classes.filter(F.col(size) > max(HOT_LEAST, total // HOT_PART)))
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(classes, keys))


@atexit.register
def _remove() -> None:
    for spark, path in _CREATED:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended; its owner clears the folder
            continue
