"""Bronze tables and exports on shared storage."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import JSON_OPTIONS
from ..session import scratch_dir

# Bronze folders by day let an incremental read skip whole folders, not only row groups.
INGEST_DAY = "ingest_date"


def _hadoop_path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _hadoop_path(spark, path)
    return fs.exists(hadoop)


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern; only folders along the pattern are listed."""
    hadoop, fs = _hadoop_path(spark, pattern)
    return [s.getPath().toString() for s in fs.globStatus(hadoop) or []]


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct children of a folder; empty when it does not exist."""
    hadoop, fs = _hadoop_path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def folder_bytes(spark: SparkSession, path: str) -> int:
    hadoop, fs = _hadoop_path(spark, path)
    return fs.getContentSummary(hadoop).getLength()


def remove_folder(spark: SparkSession, path: str) -> None:
    hadoop, fs = _hadoop_path(spark, path)
    fs.delete(hadoop, True)


def scan_source(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All columns of a bronze table. With a schema, columns an old file lacks read as NULL."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in the schema's order, cast to its types; absent ones are NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def with_ingest_day(df: DataFrame) -> DataFrame:
    """Add the partition column of bronze tables: the day of ``ingested_at``."""
    return df.withColumn(INGEST_DAY, F.to_date("ingested_at"))


def create_if_missing(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty typed table; an existing one is left alone."""
    if not path_exists(spark, path):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def append_bronze(df: DataFrame, path: str, schema: T.StructType | None = None, by_day: bool = False) -> None:
    """Append rows to a bronze table, created on first use; ``by_day`` makes a folder per day of ingestion."""
    rows = conform(df, schema) if schema is not None else df
    if by_day:
        with_ingest_day(rows).write.mode("append").partitionBy(INGEST_DAY).parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def add_column_if_missing(df: DataFrame, name: str, data_type: T.DataType | str) -> DataFrame:
    """The column as typed NULLs when absent; otherwise the table as it is."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(data_type))


def overwrite_table(df: DataFrame, path: str) -> None:
    """Full refresh: rebuild the table whole."""
    df.write.mode("overwrite").parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared scratch folder and read back, for results that several branches build on.

    Unlike a cached block the files outlive an executor, and each branch prunes its own columns.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_all(frames: Mapping[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """Materialize several independent frames at the same time."""
    with ThreadPoolExecutor(len(frames)) as pool:
        stored = pool.map(lambda item: materialize(item[1], f"{name}-{item[0]}"), frames.items())
        return dict(zip(frames, stored))


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, NULL fields and microseconds kept."""
    return df.select(F.to_json(F.struct("*"), JSON_OPTIONS).alias("record"))


def export_json_records(df: DataFrame, path: str) -> None:
    """The records as a folder of JSON-lines files, written by the executors."""
    json_records(df).write.mode("overwrite").text(path)
