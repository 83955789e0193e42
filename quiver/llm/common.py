"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of a word, as Java and Python read it.
WORD = r"[^\x20\x09-\x0D]+"
MAX_LONG = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = os.path.join(tempfile.gettempdir(), "quiver-checkpoints")
    return conf


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Spark's setting to delete the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of intermediate tables that the results of this session still read.
_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; the folder goes when the process ends or by discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quiver/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(discard)
    _written.append((spark, path))
    # What the write has shuffled is not read again, so its files go with the write.
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    except BaseException:
        discard(path)
        raise
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


def discard(*paths: str) -> None:
    """Delete folders that written() made (all of them, if none is named)."""
    for spark, path in [x for x in _written if not paths or x[1] in paths]:
        _written.remove((spark, path))
        try:
            jvm = spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001 - the session has ended: its folder is left to the cluster's clean-up
            continue


def written_paths() -> list[str]:
    """Folders that written() has made and that are still there, oldest first."""
    return [path for _, path in _written]


def order_key(column: str):
    """doc_id as a key that is never null: null sorts after every id."""
    return F.coalesce(F.col(column).cast("long"), F.lit(MAX_LONG))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def release_memory() -> None:
    """Give memory that a fit has freed back to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
