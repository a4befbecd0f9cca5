"""Trial preparation, design cells and observed summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twofold.rules import NULL_BLOCK, SITE_LABELS, Design

CELL_KEYS = ("host_site", "family", "source_site", "block", "genus", "native")
TRIAL_COLUMNS = ("trial_id", "host_site", "family", "source_site", "block", "cnt")


def fill_block(df: DataFrame, label: str = NULL_BLOCK) -> DataFrame:
    """Missing block becomes a level of its own."""
    return df.fillna({"block": label})


def with_native_and_genus(df: DataFrame, design: Design = Design()) -> DataFrame:
    in_a = F.col("host_site").isin(*design.genus_a_hosts)
    other = "M" if design.genus == "A" else design.genus
    return df.withColumn("native", F.col("host_site") == F.col("source_site")).withColumn(
        "genus", F.when(in_a, "A").otherwise(other)
    )


def clean(raw: DataFrame, design: Design = Design()) -> DataFrame:
    """Cleaned trials: named columns, filled block, native flag, genus."""
    return with_native_and_genus(fill_block(raw.select(*TRIAL_COLUMNS)), design)


def flag_to_int(flag: Column, yes: str = "y") -> Column:
    return (flag == yes).cast("int")


def site_labels(spark: SparkSession) -> DataFrame:
    """Display names and order of the site codes, as a label table."""
    return spark.createDataFrame(list(SITE_LABELS), "code string, label string, ordinal long")


def recode(df: DataFrame, col: str, labels: DataFrame) -> DataFrame:
    """Replace the codes of ``col`` by labels and add the level order.

    ``labels`` has one row per code: ``code, label, ordinal``.
    """
    found = df.join(labels, df[col] == labels["code"], "left")
    return found.drop(col, "code").withColumnRenamed("label", col).withColumnRenamed(
        "ordinal", f"{col}_ordinal"
    )


def uncode(df: DataFrame, col: str, labels: DataFrame) -> DataFrame:
    """Turn labels back into codes."""
    found = df.join(labels.select("code", "label"), df[col] == F.col("label"), "left")
    return found.drop(col, "label").withColumnRenamed("code", col)


def design_cells(trials: DataFrame) -> DataFrame:
    """First trial of every distinct design cell, with ``native`` derived anew."""
    keys = [k for k in CELL_KEYS if k != "native"]
    first = trials.groupBy(*keys).agg(F.min("trial_id").alias("cell_id"))
    return first.withColumn("native", F.col("host_site") == F.col("source_site"))


def count_classes(trials: DataFrame, keys: tuple[str, ...] = CELL_KEYS) -> DataFrame:
    """Trials that no candidate can tell apart: same cell, same count.

    Every score depends on a trial only through its class, so all later work
    runs on classes with a multiplicity. This one aggregate is the only pass
    over the trials; partial sums run before its shuffle.
    """
    seen = trials.groupBy(*keys, "cnt").agg(
        F.count(F.lit(1)).alias("copies"), F.min("trial_id").alias("first_trial")
    )
    cell = Window.partitionBy(*keys)
    return seen.withColumn("cell_id", F.min("first_trial").over(cell)).drop("first_trial")


def cells_from_classes(classes: DataFrame, keys: tuple[str, ...] = CELL_KEYS) -> DataFrame:
    """Hurdle sufficient statistics per design cell."""
    n, y = F.col("copies"), F.col("cnt")
    return classes.groupBy("cell_id", *keys).agg(
        F.sum(n).alias("n"),
        F.sum(F.when(y == 0, n).otherwise(0)).alias("n_zero"),
        F.sum(F.when(y > 0, n).otherwise(0)).alias("n_pos"),
        F.sum(n * y).alias("sum_y"),
    )


def positive_trials(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("cnt") > 0)


def observed_summary(trials: DataFrame) -> DataFrame:
    """Prevalence and mean positive count by site pair, each with its standard error."""
    hit = (F.col("cnt") > 0).cast("double")
    positive = F.when(F.col("cnt") > 0, F.col("cnt").cast("double"))
    return trials.groupBy("host_site", "source_site").agg(
        F.avg(hit).alias("prevalence"),
        (F.stddev_samp(hit) / F.sqrt(F.count(F.lit(1)))).alias("prevalence_se"),
        F.avg(positive).alias("incidence"),
        (F.stddev_samp(positive) / F.sqrt(F.count(positive))).alias("incidence_se"),
    )


def observed_long(summary: DataFrame) -> DataFrame:
    return summary.select(
        "host_site",
        "source_site",
        F.col("prevalence").alias("Prevalence"),
        F.col("incidence").alias("Incidence"),
    ).unpivot(["host_site", "source_site"], ["Prevalence", "Incidence"], "variable", "mean")


def observed_prevalence(trials: DataFrame, keys: list[str], hit: Column | None = None) -> DataFrame:
    hit = (F.col("cnt") > 0).cast("int") if hit is None else hit
    return trials.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("prevalence"))
