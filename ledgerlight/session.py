"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where an aggregate on the join key then needs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.ui.enabled": "false",
}


PARTITION_MB = 128


def sized_for(shuffle_gb: int) -> dict[str, str]:
    """Settings for the largest shuffle a job expects: about 128 MB per partition, joined up by AQE when smaller."""
    return {"spark.sql.shuffle.partitions": str(max(200, shuffle_gb * 1024 // PARTITION_MB)),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{PARTITION_MB}m",
            "spark.sql.files.maxPartitionBytes": f"{2 * PARTITION_MB}m"}


def build(app: str = "ledgerlight", master: str | None = None, shuffle_gb: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; on a cluster the master comes from spark-submit."""
    if shuffle_gb:
        extra = {**sized_for(shuffle_gb), **extra}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """The cluster's shared checkpoint folder; `fallback` is only used where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = configured or fallback
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder
