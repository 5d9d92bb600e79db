"""Session helper with the settings the library is designed around."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "margin-engine",
                driver_memory: str | None = None) -> SparkSession:
    """Build or get a session: AQE with partition coalescing and skew-join
    splitting, UTC session time, no UI.  A checkpoint directory is set only
    when the cluster has not named one (local runs and tests).

    In local mode the driver JVM is the only executor, so its heap is sized
    (``driver_memory``, default 16g) when this call launches it."""
    b = (SparkSession.builder.appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC"))
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", driver_memory or "16g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without one gets a scratch folder (tests, local
    runs); on a cluster a machine-local folder would not be shared, so a
    missing setting is an error there.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    d = sc.getCheckpointDir()
    if d:
        return d
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    d = tempfile.mkdtemp(prefix="margin-engine-ckpt-")
    sc.setCheckpointDir(d)
    try:
        spark.conf.set("spark.checkpoint.dir", d)
    except Exception:  # noqa: BLE001 - some deployments forbid setting core confs
        pass
    return sc.getCheckpointDir() or d
