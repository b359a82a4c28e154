"""Conversion of files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.plans import convert
from quire.plans.config import ConvertConfig


def arriving(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """A stream of path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most).load(path)


def converting(spark: SparkSession, path: str, out: str, checkpoint: str, cfg: ConvertConfig = ConvertConfig()) -> StreamingQuery:
    """Converts new files to Parquet under out, one folder a batch, so that a batch run twice is written once."""

    def each(files: DataFrame, epoch: int) -> None:
        convert.convert(files, cfg).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return arriving(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
