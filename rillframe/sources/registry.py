"""Registry files: CSV with a header, schema-tagged JSON lists, optional inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, by name; a byte-order mark before the header is tolerated; absent columns are null."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string")).alias(c) for c in columns])


def optional(spark: SparkSession, schema: T.StructType | str, read) -> DataFrame:
    """The input, or an empty table of the schema where the path doesn't exist; other errors stay errors."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def registered(spark: SparkSession, registry: DataFrame, root: str, file: str, columns: list[str]) -> DataFrame:
    """Files of the registered folders only, in registry order; a folder that isn't registered is never opened.

    ``registry`` has key and ord; it is a control table of a few rows.
    """
    out = None
    for r in registry.where("key is not null and key <> ''").orderBy("ord").collect():
        one = optional(spark, ", ".join(f"`{c}` string" for c in columns), lambda r=r: read_csv(spark, f"{root}/{r['key']}/{file}", columns))
        one = one.withColumn("pref", F.lit(r["key"])).withColumn("pref_ord", F.lit(r["ord"]))
        out = one if out is None else out.unionByName(one)
    return out


def read_tagged(spark: SparkSession, path: str, tag: str, list_field: str, value_type: str) -> DataFrame:
    """(dam_id, ...) entries of a JSON document {schema, <list_field>: {dam_id: {...}}}; another tag is an error."""
    doc = spark.read.schema(f"schema string, `{list_field}` map<string, {value_type}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    found = [r["schema"] for r in doc.select("schema").collect()]  # one document
    if found != [tag]:
        raise ValueError(f"{path}: expected schema {tag}, found {found}")
    return doc.select(F.explode(F.col(list_field)).alias("dam_id", "entry")).select("dam_id", "entry.*")
