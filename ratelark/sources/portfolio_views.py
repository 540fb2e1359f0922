"""Policies, claims and predictions derived from the order and line-item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TARGET_COLUMN, Target, Weighting
from ..operators.prep import join_claims, modelling_task, weight_column, with_targets


# The columns read from each table; a given schema saves a look at the files.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long",
    "lineitem": "l_orderkey long, l_extendedprice double, l_discount double, l_returnflag string",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def claims_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines are claims."""
    return (read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
            .select(F.col("l_orderkey").cast("long").alias("IDpol"),
                    (F.col("l_extendedprice").cast("double") * F.col("l_discount").cast("double"))
                    .alias("ClaimAmount")))


def _policy_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, cust = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    region = (read_table(spark, sf_dir, "nation").join(
        read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("r_name").alias("Region")))
    return (read_table(spark, sf_dir, "orders")
            .join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(region, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                order.alias("IDpol"),
                F.substring(F.lit("ABCDEF"), (cust % 6 + 1).cast("int"), F.lit(1)).alias("Area"),
                (16 + cust % 75).alias("DrivAge"),
                (order % 20).alias("VehAge"),
                (4 + order % 12).alias("VehPower"),
                (50 + (cust * 7) % 180).alias("BonusMalus"),
                (1 + (cust * 13) % 27000).cast("double").alias("Density"),
                F.col("c_mktsegment").alias("Brand"), "Region",
                ((order % 25).cast("double") / 20).alias("Exposure"),
                (order % 5).cast("string").alias("part")))


def _declared(count):
    """The declared claim number: sometimes one too high."""
    extra = F.when(F.col("IDpol") % 97 == 0, F.lit(1)).otherwise(F.lit(0))
    return (F.coalesce(count, F.lit(0)) + extra).cast("long")


def policies_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy per order, with its declared claim number."""
    returned = claims_view(spark, sf_dir).groupBy("IDpol").agg(F.count(F.lit(1)).alias("_nb"))
    return (_policy_facts(spark, sf_dir).join(returned, "IDpol", "left")
            .withColumn("ClaimNb", _declared(F.col("_nb"))).drop("_nb"))


def prepared_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared portfolio; claim sums are settled to the four decimals the amounts carry.

    The declared number follows from the same claim counts, so claims are read once.
    """
    joined = join_claims(_policy_facts(spark, sf_dir), claims_view(spark, sf_dir))
    settled = joined.withColumns({"claim_sum": F.round("claim_sum", 4),
                                  "ClaimNb": _declared(F.col("claim_count"))})
    return with_targets(settled).withColumn("cust6", F.ascii("Area") - 65)


def prediction_columns() -> dict:
    """Three deterministic predictors: tied, with signal, and tied-free."""
    tied = F.round(F.lit(0.2) + F.lit(0.05) * F.col("cust6").cast("double")
                   + F.lit(0.01) * F.col("VehAge").cast("double"), 6)
    return {
        "pred_tied": tied,
        "pred_signal": tied * (1 + F.lit(0.3) * F.col("ClaimNb_TRG").cast("double")),
        "pred_unique": tied + F.col("IDpol").cast("double") * 1e-9,
    }


def prediction_view(spark: SparkSession, sf_dir: str, pred: str = "pred_tied",
                    target: Target = Target.FREQUENCY,
                    weighting: Weighting = Weighting.EXPOSURE) -> DataFrame:
    """``(part, IDpol, y, pred, w)`` of one target."""
    rows = modelling_task(prepared_view(spark, sf_dir), target)
    return rows.select("part", "IDpol", F.col(TARGET_COLUMN[target]).cast("double").alias("y"),
                       prediction_columns()[pred].alias("pred"),
                       weight_column(weighting).alias("w"))
