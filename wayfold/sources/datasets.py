"""Datasets as JSON: rows in a fixed order over any number of files, read back with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def write_dataset(df: DataFrame, path: str, order: str = "id") -> None:
    """One row a line; files follow each other in the order of a column, so that equal tables give equal lines. Rows
    name the version of the schema; null fields are left out. An existing folder is an error."""
    df.withColumn("schemaVersion", F.lit(VERSION)).repartitionByRange(order).sortWithinPartitions(order).write.json(path)


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of this version; broken lines and those of another version stop the job that reads them."""
    d = spark.read.schema(f"{schema}, schemaVersion int").option("mode", "FAILFAST").json(path)
    known = F.when(F.col("schemaVersion").eqNullSafe(F.lit(VERSION)), F.lit(True)).otherwise(F.raise_error(F.lit("unsupported schemaVersion")).cast("boolean"))
    return d.where(known).drop("schemaVersion")


def read_document(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """The rows that whole JSON documents hold in an array field: one task a document."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode(rows).alias("row")).select("row.*")
