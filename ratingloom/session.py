"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str, app: str = "ratingloom", shuffle_partitions: int = 8,
                  driver_memory: str = "16g") -> SparkSession:
    """A session with the settings the jobs are written for (UTC, AQE, skew handling)."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or a temporary one in local mode."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ratingloom-"))
    return spark.sparkContext.getCheckpointDir()


_run: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; everything that is written goes there."""
    app = spark.sparkContext.applicationId
    if app not in _run:
        _run[app] = f"{shared_folder(spark)}/ratingloom-{app}-{uuid.uuid4().hex[:8]}"
    return _run[app]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Spark's switch for deleting the shuffle files of a statement at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet in the shared folder and read it back.

    A lost executor then costs a file read instead of the whole plan, later uses read only
    their columns, and Spark knows the size when it picks joins. The shuffle files of the step are deleted at its end,
    so that the steps of a job do not add up on the disks.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``durable`` that an iteration has replaced; nothing may read them any more."""
    for df in frames:
        path = getattr(df, "durable_path", None)
        if path:
            _delete(df.sparkSession, path)


def close_run(spark: SparkSession) -> None:
    """Delete all that this application wrote for itself; call it when the results are stored."""
    path = _run.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)
