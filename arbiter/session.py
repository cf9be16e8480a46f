"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "arbiter", extra_conf: dict[str, str] | None = None
) -> SparkSession:
    """A local session tuned for small data: few shuffle partitions, AQE on, no UI."""
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; a scratch one only in a local session.

    On a cluster ``spark.checkpoint.dir`` must name a folder that the driver and
    all executors share; without it this raises.  Only a ``local`` session
    (tests, bench), which has no other machines, gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="arbiter-ckpt-")
    sc.setCheckpointDir(path)
    return path


def stable(df: DataFrame) -> DataFrame:
    """Written once as Parquet under the cluster's checkpoint folder, and reread.

    For a derived table that several branches of one plan read: the work
    behind it runs once, a lost executor re-reads the files, and each reader's
    columns and filters reach the scan.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
