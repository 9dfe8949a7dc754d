"""Session settings the library is designed for, and the checkpoint folder.

Operators never create a session; they work with whatever session built
their input DataFrames. ``build_session`` is for tests, benchmarks and
scripts. On a cluster, set the same options in the job configuration and
point ``spark.checkpoint.dir`` at a shared folder (HDFS, S3, ...).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE re-plans joins at runtime from real sizes (sort-merge -> broadcast for
# a small side, split of skewed partitions, coalescing of small partitions).
# Skewed-join splitting is allowed even where it costs one extra shuffle:
# one hot order, seller or product may hold a large share of all rows.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "souk",
    driver_memory: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, as the cluster names it in
    ``spark.checkpoint.dir``. There is no local fallback: on a cluster a
    folder of one machine would lose rows without an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
