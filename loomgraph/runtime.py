"""Session helpers that every operator shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, lazily read; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in ``spark.checkpoint.dir``.

    A folder of this machine is taken only in local mode (tests), where driver and
    executors are one process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame, fresh: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The copy survives the loss of executors, unlike a local checkpoint.  A checkpoint keeps
    what the optimiser had proved about its columns; in long loops that grows from round to
    round until planning takes longer than the work, so they ask for a ``fresh`` copy that
    knows its schema only.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    if not fresh:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False), spark)


def complete_versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete versions ``v...`` of the table at ``path``, oldest first, on whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(n for n in names if n.startswith("v") and done(n))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
