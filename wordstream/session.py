"""Session helpers: checkpoint folder and settings every plan relies on."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession, rows: int, rows_per_partition: int = 250_000) -> int:
    """Partitions for a stage that must hold one whole partition in a Python worker: at least the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_partition))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir of the session; where it is unset, as in tests, set a folder of our own in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def _folder(spark: SparkSession) -> str:
    """Folder of this application's tables in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df as a table to the shared checkpoint folder and read it from there, which cuts its lineage.

    Unlike an RDD checkpoint this computes df once, keeps columns apart and tells Spark the size of the result.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_checkpoints(spark: SparkSession) -> None:
    """Delete the tables that this application has written, once no result is needed that reads them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that Python tasks can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_wordstream_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    shutil.copytree(here, folder / "tree" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(folder / here.name), "zip", folder / "tree"))
    sc._wordstream_shipped = True
