"""What file names and authoring documents say about their data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from .datasets import read_document


def portable_path(path: Column) -> Column:
    """Slashes of one kind, no ./ in front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def same_lines(text: Column) -> Column:
    """Line ends of one kind."""
    return F.regexp_replace(text, "\r\n?", "\n")


def path_parts(path: Column) -> Column:
    """struct(facility, floor, layer) of <facility>_<floor>_<Layer>.<ending>; fields are null where a name has no such
    part. The floor is a normal one (-1: B1)."""
    name = F.regexp_extract(portable_path(path), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    part = lambda i: F.nullif(F.regexp_extract(name, r"^(.*?)_(-?[A-Za-z]?\d+(?:\.\d+)?(?i:out)?)_([A-Za-z]+)$", i), F.lit(""))
    return F.struct(part(1).alias("facility"), scalars.normalize_floor(part(2)).alias("floor"), part(3).alias("layer"))


def discover(spark: SparkSession, folder: str, ending: str = "*.shp") -> DataFrame:
    """path, facility, floor, layer of the files below a folder; their content isn't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", ending).option("recursiveFileLookup", "true").load(folder)
    return f.select("path").withColumn("p", path_parts(F.col("path"))).select("path", "p.*")


def read_authored(spark: SparkSession, path: str, schema: str, rows: str, expected: dict[str, object]) -> DataFrame:
    """The rows of authoring documents whose metadata fields are as expected; others stop the job that reads them.
    schema: of a whole document, with the expected fields and an array field ``rows``."""
    head = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    fits = reduce(lambda a, b: a & b, [F.col(field).eqNullSafe(F.lit(value)) for field, value in expected.items()])
    if head.where(~fits).limit(1).count():
        raise ValueError(f"{path} isn't a document with {expected}")
    return read_document(spark, path, schema, rows)
