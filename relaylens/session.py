"""Session settings and the shared scratch location."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan relies on.  Broadcasts stay under Spark's own size check
# (autoBroadcastJoinThreshold, re-checked by AQE on real sizes); the few joins that force one name
# the bound of the side that they send.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Raw messages can be large, so Arrow batches are bounded by bytes as well as by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}


_STAGED: list[str] = []
_LOCAL: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """Build a session.  Leave ``master`` unset on a cluster, where spark-submit names it."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Only a session without executors of its own may do without that setting; it gets a folder of
    its own.  A cluster without it is refused, because a machine-local folder is lost with its
    executor.  Whether the named folder is really shared is the cluster's promise.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.applicationId not in _LOCAL:
        _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="relaylens-")
    return _LOCAL[spark.sparkContext.applicationId]


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly to tasks, for work that costs far more a row than moving the row does.

    Else a task gets what a file split holds, which compresses to any number of rows: a table of one
    row group is one task.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                4 * spark.sparkContext.defaultParallelism))


def staged_tables() -> int:
    """How many tables this process has staged and not removed."""
    return len(_STAGED)


def remove_staged(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the staged tables but the first ``since`` and the last ``keep`` ones; for when nothing
    reads them any more."""
    last = len(_STAGED) - keep
    for path in _STAGED[since:last]:
        remove_folder(spark, path)
    del _STAGED[since:max(since, last)]


def move_folder(spark: SparkSession, path: str, target: str) -> None:
    """Put a finished folder in place by one rename."""
    jvm = spark.sparkContext._jvm
    source, goal = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, target))
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(goal.getParent())
    if not fs.rename(source, goal):
        raise OSError(f"cannot rename {path} to {target}")


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(top) if f.isDirectory())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that this process wrote."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def last_changed(spark: SparkSession, folder: str) -> int:
    """Latest modification time of the tables (files or folders of files) in a folder."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tables = list(fs.listStatus(top))
    files = [f for t in tables if t.isDirectory() for f in fs.listStatus(t.getPath())]
    return max((f.getModificationTime() for f in tables + files), default=0)
