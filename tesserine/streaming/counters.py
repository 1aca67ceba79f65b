"""Counters over streams of files: the same results as in batch, once all files are read (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.session import shared_path


def drained(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a streaming query over all that is there; gives its last result (complete) or all that it put out (append), written in the shared folder.

    A batch that is run again overwrites its own folder.
    """
    spark = stream.sparkSession
    out, seen = shared_path(spark, label), {}

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{out}/{number}"
        batch.write.mode("overwrite").parquet(path)
        seen[number] = path

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", shared_path(spark, label)).foreachBatch(keep).start()
    query.awaitTermination()
    paths = [seen[k] for k in sorted(seen)]
    return spark.read.schema(stream.schema).parquet(*(paths if mode == "append" else paths[-1:])) if paths else spark.createDataFrame([], stream.schema)


def files(spark: SparkSession, path: str, at_once: int = 1000) -> DataFrame:
    """A stream of parquet files, so many in a batch: of a folder, or one file by its name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    alone = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", at_once)
    if alone:
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def counted(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """Counts by key of the rows of parquet files, read as a stream."""
    return drained(files(spark, path).groupBy(*by).agg(F.count("*").alias("n")), "complete", "counter")


def windowed(spark: SparkSession, path: str, time: str, width: str, late: str, *by: str, at_once: int = 1000) -> DataFrame:
    """Counts by event-time window of the windows that the watermark has passed.

    The watermark trails the greatest time seen by `late`; a window leaves the
    state when it passes and is final then, rows that come for it later are not
    counted, and windows that it has not passed by the end are not put out.
    """
    rows = files(spark, path, at_once).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return drained(rows.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")), "append", "windows")
