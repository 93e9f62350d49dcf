"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every botlens job relies on.  Time windows are evaluated in UTC
# (the reference's database session zone); AQE coalesces the small per-bot
# aggregates and splits skewed join partitions at run time.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM does not compile methods beyond 8,000 bytes of bytecode: a fused stage of many
    # columns (validation) would run interpreted, so such a stage is not fused
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # JSON bodies may repeat a key; the last one wins like JSON.parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


# Settings that only a new session can take.
STATIC_CONF = {
    # plans here are built from thousands of column expressions; recording the call site of each takes seconds
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = None, app: str = "botlens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the botlens settings applied.

    On a cluster ``master`` stays ``None`` so spark-submit decides.  Local
    runs and tests pass ``local[N]`` and a small partition count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SESSION_CONF, **STATIC_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    (tests, bench) without that setting gets a fresh temporary folder; on a
    cluster a machine-local folder would be invisible to other executors, so
    the missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="botlens-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for this application's written tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/botlens-{spark.sparkContext.applicationId}/{name}"


def drop_staged(spark: SparkSession) -> None:
    """Remove every table that this application has staged (when no result is read any more)."""
    drop_path(spark, scratch_path(spark, ""))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a written table through Hadoop's file system (any store)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df, name: str = "stage", paths: list[str] | None = None):
    """Cut the lineage of an intermediate result by writing it as a Parquet
    table in the shared checkpoint folder and reading it back.

    Unlike ``checkpoint(eager=True)`` (which evaluates the plan once for the
    count and again to write the files) the plan runs once; the table
    survives executor loss and keeps later plans small.  The written folder
    is appended to ``paths`` so that a caller that knows when the rows are
    no longer needed can remove it with ``drop_path``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
