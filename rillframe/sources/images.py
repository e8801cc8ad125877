"""Picture folders, keyed by file stem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.functions import text


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, file, bytes) of png, jpg, jpeg and webp files; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,webp}").load(folder).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(text.image_stem(name).alias("stem"), name.alias("file"), F.col("length").alias("bytes"))


def register(images: DataFrame, dams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, unknown): one picture per registered dam, the first by file name; files whose stem is no dam."""
    known = images.join(dams.select(F.col("dam_id").alias("stem")), "stem", "left_semi").groupBy(F.col("stem").alias("dam_id")).agg(F.min("file").alias("file"))
    return known, images.join(dams.select(F.col("dam_id").alias("stem")), "stem", "left_anti").select("file")
