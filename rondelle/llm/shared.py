"""What the operators of this subpackage share: durable scratch tables and row checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regex class of ASCII white space, the only white space the contracts name.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Where it is unset and the master is local (tests), a temporary folder is
    set. On a cluster an unset folder is an error: a machine-local one would be
    invisible to the other executors.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rondelle-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def stash_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stash``, and the folder, for a caller that drops it once nothing reads it any more."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and several readers see the same rows.
    """
    return stash_at(df, name)[0]


def file_system(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, path: str) -> None:
    at, fs = file_system(spark, path)
    fs.delete(at, True)


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers n of the folders ``prefix``n under ``path``, ascending."""
    at, fs = file_system(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


#: Rows of a table of the most frequent keys at most.
HOT_KEYS = 1000


def join_sized(rows: DataFrame, sized: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined to the one row of ``sized`` for their key, hot keys apart.

    ``size`` says how many of ``total`` rows have the key. Keys of more than a
    thousandth of the rows are fewer than a thousand, so they are broadcast and
    their rows stay where they are; any other key is a thousandth at most of a
    shuffled join. ``rows`` is scanned twice.
    """
    hot = F.col(size) * HOT_KEYS > total
    few = stash(sized.where(hot), "hot")  # under HOT_KEYS rows
    cold = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(sized.where(~hot), key)
    return rows.join(F.broadcast(few), key).unionByName(cold)


def text_or_empty(column: str = "text"):
    """Null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
