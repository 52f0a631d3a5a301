"""Per-second request counts and wait histograms of logs that are still growing.

State is one row a class and second (or class, minute and millisecond value), and the watermark lets go of old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.dialects import parse
from tidegauge.dialects.event import latency_ns
from tidegauge.operators.classes import DEFAULT, ClassSet
from tidegauge.sources.reader import NAME, LineSource
from tidegauge.streaming.counts import observed
from tidegauge.streaming.heads import with_heads_stream


def tail_lines(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """file, line_block, line_no, value of the files of a folder, those that appear and those that grow."""
    spark.dataSource.register(LineSource)
    lines = spark.readStream.format(NAME).option("folder", folder.removeprefix("file://")).option("pattern", pattern).load()
    return lines.withColumn("value", F.regexp_replace("value", "\r$", ""))


def parsed_stream(spark: SparkSession, folder: str, dialect: str, tz: str = "UTC", xff_capture: int = 0, tail: bool = False, **options) -> DataFrame:
    """All lines with their outcome, counted on their way (see ``counts``).

    Spark's file source reads whole files as they appear. ``tail``, and CloudFront always, follows growing files instead,
    in a folder that driver and tasks see; CloudFront's headers are kept by file.
    """
    if tail or dialect.lower() == "cloudfront":
        lines = tail_lines(spark, folder, options.pop("pattern", "*"))
        if dialect.lower() == "cloudfront":
            lines = with_heads_stream(lines, **options)
    else:
        lines = spark.readStream.format("text").option("lineSep", "\n").options(**options).load(folder).select(F.lit(0).alias("file_idx"), F.lit(0).cast("long").alias("line_block"), F.lit(0).cast("long").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))
    return observed(parse(lines, dialect, tz, xff_capture))


def read_stream(spark: SparkSession, folder: str, dialect: str, tz: str = "UTC", xff_capture: int = 0, **options) -> DataFrame:
    """The events of ``parsed_stream``."""
    return parsed_stream(spark, folder, dialect, tz, xff_capture, **options).where("parse_status = 'parsed'")


def per_second_stream(events: DataFrame, classes: ClassSet = DEFAULT, late: str = "1 minute") -> DataFrame:
    """cls, second, n in append mode: a second is given once the watermark has passed it."""
    return events.withColumn("cls", classes.column()).withWatermark("ts", late).groupBy(F.window("ts", "1 second"), "cls").agg(F.count(F.lit(1)).alias("n")).select("cls", F.col("window.start").alias("second"), "n")


def wait_histogram_stream(events: DataFrame, classes: ClassSet = DEFAULT, span: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """cls, span_start, ms, n: exact percentiles of any longer time follow from these."""
    timed = events.withColumn("cls", classes.column()).withColumn("ms", F.floor(latency_ns() / 1_000_000)).where("ms is not null")
    return timed.withWatermark("ts", late).groupBy(F.window("ts", span), "cls", "ms").agg(F.count(F.lit(1)).alias("n")).select("cls", F.col("window.start").alias("span_start"), "ms", "n")
