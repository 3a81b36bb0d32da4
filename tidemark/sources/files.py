"""Readers of logs, the ragged table of speeds and dimensions; sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEO_SCHEMA = "ip_lo long, ip_hi long, continent string, country string, region string, city string, isp string"
UA_SCHEMA = "pattern string, platform string, browser_name string, browser_version string, major int, minor int, is_mobile boolean"
MAX_DURATION = 65535


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines, one column `value`; a missing file is an error at this point."""
    return spark.read.text(path)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def speeds(lines: DataFrame) -> DataFrame:
    """name, lo (exclusive), hi (inclusive), speed from lines `name,(speed,max)*,speed`."""
    cells = lines.select(F.transform(F.split(F.trim("value"), ","), lambda x: F.trim(x)).alias("c")).where(F.size("c") >= 2)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("c") - 1, F.lit(1)), F.lit(2)), lambda i: F.struct(F.get("c", i).alias("speed"), F.coalesce(F.get("c", i + 1).cast("int"), F.lit(MAX_DURATION)).alias("hi")))
    return cells.select(F.get("c", F.lit(0)).alias("name"), steps.alias("s")).select("name", F.posexplode("s").alias("i", "x"), "s").select("name", F.when(F.col("i") == 0, -1).otherwise(F.try_element_at("s", F.col("i").cast("int"))["hi"]).alias("lo"), "x.hi", "x.speed")


def read_speeds(spark: SparkSession, path: str) -> DataFrame:
    return speeds(spark.read.text(path))


def read_geo(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GEO_SCHEMA).csv(path, header=True)


def read_ua(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UA_SCHEMA).csv(path, header=True)


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rules, comparisons or statistics as Parquet."""
    df.write.mode(mode).parquet(path)


def dump(df: DataFrame, rows: int = 50) -> str:
    """The first rows and the plan as text, for debugging."""
    return df._show_string(rows, False) + df._jdf.queryExecution().simpleString()
