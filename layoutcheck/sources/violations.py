"""Violations as text: eight integers a line, two edges by their end points."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutcheck.errors import OpenFileError

EDGES = ("e1x1", "e1y1", "e1x2", "e1y2", "e2x1", "e2y1", "e2x2", "e2y2")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """file and the eight integers; a line that isn't eight integers is an error."""
    schema = ", ".join(f"{c} BIGINT" for c in EDGES)
    try:
        df = spark.read.csv(path, sep=" ", schema=schema, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    except Exception as e:
        raise OpenFileError(path, str(e).splitlines()[0]) from e
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(\.[^./]*)?$", 1).alias("file"), *EDGES)


def lines(violations: DataFrame) -> DataFrame:
    return violations.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in EDGES)).alias("value"))


def write_text(violations: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Violations with edges, one a line; those of areas have none and are left out."""
    lines(violations.where("e1x1 IS NOT NULL")).write.mode(mode).text(path)


def result_files(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Files of two directories paired by base name: file, in_first, in_second."""

    def names(path: str) -> DataFrame:
        try:
            found = spark.read.format("binaryFile").load(path)
        except Exception as e:
            raise OpenFileError(path, str(e).splitlines()[0]) from e
        return found.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("file")).distinct()

    a, b = names(first).withColumn("in_first", F.lit(True)), names(second).withColumn("in_second", F.lit(True))
    return a.join(b, "file", "full").select("file", F.coalesce("in_first", F.lit(False)).alias("in_first"), F.coalesce("in_second", F.lit(False)).alias("in_second"))
