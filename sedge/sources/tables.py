"""Table access and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where the session names none, a folder of this machine if the driver is
    all there is, as in tests; on a cluster that is an error, as executors couldn't read it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="sedge-checkpoint-")


#: Rows of a side that is broadcast.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A side of a join to be broadcast where it has few rows, which are counted first, and to be merged beyond.

    For what is already cut: the size that Spark takes for it is an estimate from what it was made of.
    """
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, made if there is none yet."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint.

    Set spark.cleaner.referenceTracking.cleanCheckpoints where files should go when their DataFrame does.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_packed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large table through a compressed file in the checkpoint folder, read again by columns.

    A checkpoint isn't compressed. The file goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4()}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(file)
    return spark.read.schema(df.schema).parquet(path)
