"""Trials from the star-schema tables.

One trial is a (customer, supplier nation) pair with at least one line item;
its count is the number of returned items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING_BLOCK = "FURNITURE"

# The columns this analysis reads; a declared schema saves a look at the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey long, s_nationkey int",
    "orders": "o_orderkey long, o_custkey long",
    "lineitem": "l_orderkey long, l_suppkey long, l_returnflag string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_trials(spark: SparkSession, sf_dir: str, sources: tuple[str, ...] | None = None) -> DataFrame:
    """Uncleaned trials; one market segment plays the missing block.

    ``sources`` keeps the items of some supplier regions only. Suppliers join
    first, so that a choice of regions drops items before the large shuffle by
    order; a supplier with very many items is left to adaptive skew handling.
    Items are then counted per (customer, nation), with partial sums before the
    shuffle, so the customer table meets at most one row per customer and nation
    however many items a customer has.
    """
    items = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", (F.col("l_returnflag") == "R").cast("long").alias("returned")
    )
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nation = load(spark, sf_dir, "nation")
    region = load(spark, sf_dir, "region")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name"
    )
    chosen = places if sources is None else places.where(F.col("r_name").isin(*sources))
    origins = chosen.select("n_nationkey", F.col("n_name").alias("family"), F.col("r_name").alias("source_site"))
    suppliers = (
        load(spark, sf_dir, "supplier")
        .join(origins, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    )
    per_nation = (
        items.join(suppliers, "l_suppkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "n_nationkey")
        .agg(F.sum("returned").alias("cnt"))
        .join(origins, "n_nationkey")
    )
    hosts = places.select(
        F.col("n_nationkey").alias("host_nation"), F.col("r_name").alias("host_site")
    )
    buyers = customer.join(hosts, F.col("c_nationkey") == F.col("host_nation"))
    return per_nation.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("c_custkey") * 100 + F.col("n_nationkey")).alias("trial_id"),
        "host_site",
        "family",
        "source_site",
        F.nullif(F.col("c_mktsegment"), F.lit(MISSING_BLOCK)).alias("block"),
        "cnt",
        F.when(F.col("cnt") > 0, "y").otherwise("n").alias("infected_flag"),
    )


def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site codes with a display name and an order, from the region table."""
    return load(spark, sf_dir, "region").select(
        F.col("r_name").alias("code"),
        F.initcap(F.col("r_name")).alias("label"),
        F.col("r_regionkey").cast("long").alias("ordinal"),
    )
