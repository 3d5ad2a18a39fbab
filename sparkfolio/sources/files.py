"""Files, tables and event logs."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENTS
from .log import file_system


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table. Timestamps without a zone become UTC ones, so that they can be watermarked."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write Parquet; with ``by``, only the partitions that appear are replaced."""
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def _listed(spark: SparkSession, path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The files under ``path`` as Spark reads them, and rows (path, modificationTime) of those without a byte, which it leaves out.

    The names are those that the reader has listed for its own plan; what of them has no row is asked for in tasks.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column("path").to_pylist():
                store, at = file_system(name)
                info = store.get_file_info(at)
                found.append(info.mtime if info.is_file and not info.size else None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.timestamp("us", "UTC"))], ["path", "modificationTime"])

    names = spark.createDataFrame([(unquote(f).replace("file:///", "file:/"),) for f in raw.inputFiles()], "path string")
    empty = names.join(raw.select("path"), "path", "left_anti").mapInArrow(times, "path string, modificationTime timestamp")
    return raw, empty.filter("modificationTime is not null")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Rows (file_uid, name, content, version, is_dir) of the files under ``path``; the version is the time of change."""
    raw, empty = _listed(spark, path, pattern)
    both = raw.select("path", "modificationTime", "content").union(empty.select("path", "modificationTime", F.lit(b"")))
    return both.select(
        F.col("path").alias("file_uid"), F.element_at(F.split("path", "/"), -1).alias("name"), "content",
        F.date_format("modificationTime", "yyyyMMdd_HHmmss.SSS").alias("version"), F.lit(False).alias("is_dir"),
    )


def read_metadata(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Rows (file_uid, name, length, version) of the files under ``path``; their content is not read."""
    raw, empty = _listed(spark, path, pattern)
    both = raw.select("path", "modificationTime", "length").union(empty.select("path", "modificationTime", F.lit(0).cast("long")))
    return both.select(F.col("path").alias("file_uid"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.date_format("modificationTime", "yyyyMMdd_HHmmss.SSS").alias("version"))


def events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events of JSON lines. Unknown fields are ignored, a broken line is an event of nulls, a missing tenant the default."""
    fields = F.from_json(F.decode(F.col(value).cast("binary"), "UTF-8") if dict(lines.dtypes)[value] == "binary" else F.col(value), EVENTS, {"mode": "PERMISSIVE"})
    rows = lines.select(F.coalesce(fields, F.from_json(F.lit("{}"), EVENTS)).alias("e")).select("e.*")
    return rows.withColumn("tenant", F.coalesce(F.nullif("tenant", F.lit("")), F.lit("default")))


def event_stream(spark: SparkSession, path: str, most_files: int = 32) -> DataFrame:
    """Events of a folder of JSON-lines files, a bounded number of files a batch; the checkpoint keeps what is done."""
    return events(spark.readStream.option("maxFilesPerTrigger", most_files).text(path))


def append_events(df: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def latest_events(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The last ``most`` events by time stamp, then id: what a log keeps when it is written anew."""
    return df.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
