"""Raw inputs: policies, claims, the feature blacklist and the reference categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column layout of the raw tables.
POLICY_SCHEMA = T.StructType([
    T.StructField("IDpol", T.LongType()),
    T.StructField("ClaimNb", T.LongType()),
    T.StructField("Exposure", T.DoubleType()),
    T.StructField("Area", T.StringType()),
    T.StructField("VehPower", T.LongType()),
    T.StructField("VehAge", T.LongType()),
    T.StructField("DrivAge", T.LongType()),
    T.StructField("BonusMalus", T.LongType()),
    T.StructField("VehBrand", T.StringType()),
    T.StructField("VehGas", T.StringType()),
    T.StructField("Density", T.DoubleType()),
    T.StructField("Region", T.StringType()),
])
CLAIM_SCHEMA = T.StructType([
    T.StructField("IDpol", T.LongType()),
    T.StructField("ClaimAmount", T.DoubleType()),
])


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).option(
            "enforceSchema", False).csv(path)
    return spark.read.format(fmt).load(path)


def read_policies(spark: SparkSession, path: str, schema: T.StructType = POLICY_SCHEMA,
                  fmt: str = "csv") -> DataFrame:
    return _read(spark, path, schema, fmt)


def read_claims(spark: SparkSession, path: str, schema: T.StructType = CLAIM_SCHEMA,
                fmt: str = "csv") -> DataFrame:
    return _read(spark, path, schema, fmt)


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """Feature names of a text file, without ``#`` comments and blank lines."""
    name = F.trim(F.split("value", "#")[0])
    return spark.read.text(path).select(name.alias("feature")).where("feature <> ''")


def read_reference_categories(spark: SparkSession, path: str) -> dict[str, str]:
    """Reference level per column from a flat ``column: "level"`` file."""
    rows = (spark.read.text(path)
            .select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line"))
            .where("line <> ''")
            .select(F.trim(F.substring_index("line", ":", 1)).alias("column"),
                    F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("level"))
            .select("column", F.regexp_replace("level", "^[\"']|[\"']$", "").alias("level")))
    return {r["column"]: r["level"] for r in rows.collect()}
