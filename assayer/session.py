"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Time-zone-less source text is UTC, so dates are taken in UTC as well. Failed plain casts must raise.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Rows are mostly JSON text and hexadecimal hashes: entropy coding halves what is stored and written.
STORAGE_CONF = {
    "spark.sql.parquet.compression.codec": "zstd",
}

# Left to AQE at run time: partition coalescing, skewed-partition splitting, broadcast by measured size. The JVM
# never compiles a method of more than 8000 bytes, so a wider fused stage is better cut into its operators.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# For tables of many terabytes: plenty of small shuffle partitions that AQE joins to even sizes at run time.
CLUSTER_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build(app_name: str = "assayer", master: str | None = None, cluster: bool = False, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    sizes = CLUSTER_CONF if cluster else {}
    settings = {**SEMANTIC_CONF, **STORAGE_CONF, **RUNTIME_CONF, **sizes, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_semantics(spark: SparkSession) -> SparkSession:
    """Set the settings that decide results on a session created elsewhere, and the codec of its tables unless it was started with one."""
    for key, value in SEMANTIC_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    started_with = spark.sparkContext.getConf()
    for key, value in STORAGE_CONF.items():
        if not started_with.contains(key):
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the cluster.

    Only a local session that names no such folder (a test) gets a machine-local one; elsewhere executors would not
    see each other's files, so a missing folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="assayer-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
