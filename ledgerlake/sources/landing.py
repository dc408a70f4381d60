"""Reading the landed log: batch, bounded by a watermark, as a stream; and the log of injected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import RAW


def batch(spark: SparkSession, *paths: str, schema: T.StructType = RAW) -> DataFrame:
    """Complete files of several folders, with the file each row came from."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(*paths).withColumn("_source_file", F.col("_metadata.file_path"))


def stream(spark: SparkSession, path: str, schema: T.StructType = RAW, files_per_trigger: int | None = None, files: str = "*.parquet") -> DataFrame:
    """New complete files, each once; the folders' dates don't become a column."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", files).option("recursiveFileLookup", "true")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path).withColumn("_source_file", F.col("_metadata.file_path"))


def kafka(spark: SparkSession, servers: str, pattern: str) -> DataFrame:
    """Messages of a change topic; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", pattern).option("startingOffsets", "earliest").load()


def after(rows: DataFrame, watermark: object | None, column: str = "_bronze_loaded_at") -> DataFrame:
    """Rows later than the watermark, strictly; all rows without one."""
    return rows if watermark is None else rows.filter(F.col(column) > F.lit(watermark).cast(rows.schema[column].dataType))


def ground_truth(spark: SparkSession, *paths: str) -> DataFrame:
    """Injected rows, one JSON object a line: injected_at, table, pk, kind."""
    raw = spark.read.schema("injected_at STRING, table STRING, pk STRING, kind STRING").json(list(paths))
    return raw.withColumnRenamed("table", "table_name")


def jdbc(spark: SparkSession, url: str, table: str, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table, or a select in brackets with a name, of a database; needs the database's driver on the class path.
    split: a whole-numbered column, its bounds and in how many parts it is read at once."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split:
        column, low, high, parts = split
        r = r.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return r.load()


def bound(spark: SparkSession, text: str, /, **values: object) -> DataFrame:
    """A select with :name for each value; values are literals, never text of the statement."""
    return spark.sql(text, args=values)
