"""Session defaults, reliable checkpoints, scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # call sites of every expression are costly to record
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "12g", app: str = "tripwise") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder or name a ``file:`` one:
    on a cluster a machine-local path would be lost with its machine.  The fallback is
    remembered per application, as the setting itself can't be changed at run time.
    """
    sc = spark.sparkContext
    local = sc.master.startswith("local")
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        if not local and folder.startswith("file:"):
            raise RuntimeError("spark.checkpoint.dir must be a shared folder, not a local one")
        return folder
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if sc.applicationId not in _FALLBACK:
        _FALLBACK[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _FALLBACK[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables a job writes and reads back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, for loops over DataFrames."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)



def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """Written once to the shared folder and read again: cuts the lineage like ``cut``, which
    works its rows out twice, and tells the optimizer its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
