"""Density and interval layers behind the figures."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twofold.operators.effects import partition_by_presence
from twofold.operators.quantiles import grouped_quantiles

SQRT_2PI = math.sqrt(2.0 * math.pi)


def _spread(sd: Column, q25: Column, q75: Column) -> Column:
    """Smaller of sd and scaled interquartile range; sd alone where the quartiles agree."""
    iqr = (q75 - q25) / F.lit(1.34)
    return F.when(iqr > 0, F.least(sd, iqr)).otherwise(sd)


def paired_effects(effects: DataFrame, child: str, parent: str) -> DataFrame:
    """Child effect of each draw beside the parent effect, if the draw has it."""
    keys = ["component", "draw_id"]
    there = effects.where(~F.col("absent"))
    a = there.where(F.col("factor") == child).select(*keys, F.col("effect_size").alias("child"))
    b = there.where(F.col("factor") == parent).select(*keys, F.col("effect_size").alias("parent"))
    return a.join(b, keys, "left")


def class_labels(effects: DataFrame, parent: str, child: str) -> DataFrame:
    """Child effects, and parent effects with or without the child in the same
    draw and component."""
    there = effects.where(~F.col("absent"))
    own = there.where(F.col("factor") == child).withColumn("class", F.lit(child))
    split = partition_by_presence(
        effects, parent, child, f"{parent} with {child}", f"{parent} without {child}"
    ).withColumnRenamed("partition", "class")
    return own.unionByName(split).select("component", "draw_id", "class", "effect_size")


def joint_points(effects: DataFrame, parent: str, child: str, most: float = 1.5) -> DataFrame:
    """Points (x = parent, y = child) per component; draws without the child get
    a zero, and points beyond ``most`` are outside the figure."""
    pairs = paired_effects(effects, child, parent)
    alone = partition_by_presence(effects, parent, child, "with", "without").where(
        F.col("partition") == "without"
    )
    zeros = alone.select(
        "component", "draw_id", F.lit(0.0).alias("child"), F.col("effect_size").alias("parent")
    )
    both = pairs.unionByName(zeros).where((F.col("child") < most) & (F.col("parent") < most))
    return both.select("component", "draw_id", F.col("parent").alias("x"), F.col("child").alias("y"))


def grid_frame(points: DataFrame) -> DataFrame:
    """Range, bandwidths and size per component, for a rule-of-thumb kernel.

    A bandwidth is 0 if all values are equal and null for a single point.
    """

    def axis(c: str) -> DataFrame:
        return grouped_quantiles(
            points,
            ["component"],
            c,
            (0.25, 0.75),
            (f"{c}_q25", f"{c}_q75"),
            extra=(
                F.min(c).alias(f"{c}_min"),
                F.max(c).alias(f"{c}_max"),
                F.stddev_samp(c).alias(f"{c}_sd"),
                F.count(F.lit(1)).alias(f"{c}_n"),
            ),
        )

    stats = axis("x").join(axis("y"), "component")

    def h(c: str) -> Column:
        size = F.pow(F.col(f"{c}_n").cast("double"), F.lit(-0.2))
        return F.lit(1.06) * _spread(F.col(f"{c}_sd"), F.col(f"{c}_q25"), F.col(f"{c}_q75")) * size

    return stats.select(
        "component",
        "x_min",
        "x_max",
        "y_min",
        "y_max",
        h("x").alias("hx"),
        h("y").alias("hy"),
        F.col("x_n").alias("n_points"),
    )


def density_2d(points: DataFrame, n: int = 400) -> DataFrame:
    """Gaussian kernel density on an n x n grid per component.

    The kernel is separable, so a batch of points adds the product of two
    n-column matrices. Each task sums its batches into one grid and emits it
    once; Spark adds the grids. Exact: no binning and no kernel cut. A component
    without a spread in x or y has no density: its grid points have a null z.
    """
    frame = grid_frame(points)
    spread = frame.where((F.col("hx") > 0) & (F.col("hy") > 0))
    placed = points.join(spread, "component").select(
        "component", "x", "y", "x_min", "x_max", "y_min", "y_max", "hx", "hy"
    )

    def accumulate(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        grids: dict[str, np.ndarray] = {}

        def kernel(v, lo, hi, h):
            at = lo + (hi - lo) * np.arange(n) / (n - 1)
            return np.exp(-0.5 * ((at[None, :] - v[:, None]) / h) ** 2) / SQRT_2PI

        for batch in batches:
            for name, rows in batch.groupby("component"):
                lo = rows.iloc[0]
                kx = kernel(rows["x"].to_numpy(), lo["x_min"], lo["x_max"], lo["hx"])
                ky = kernel(rows["y"].to_numpy(), lo["y_min"], lo["y_max"], lo["hy"])
                grids[name] = grids.get(name, 0.0) + kx.T @ ky
        for name, grid in grids.items():
            i, j = np.indices(grid.shape)
            yield pd.DataFrame({"component": name, "i": i.ravel(), "j": j.ravel(), "part": grid.ravel()})

    sums = (
        placed.mapInPandas(accumulate, "component string, i int, j int, part double")
        .groupBy("component", "i", "j")
        .agg(F.sum("part").alias("total"))
    )

    def at(lo: str, hi: str, k: str) -> Column:
        return F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(k) / F.lit(float(n - 1))

    steps = F.sequence(F.lit(0), F.lit(n - 1))
    grid = frame.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return grid.join(sums, ["component", "i", "j"], "left").select(
        "component",
        "i",
        "j",
        at("x_min", "x_max", "i").alias("x"),
        at("y_min", "y_max", "j").alias("y"),
        (F.col("total") / (F.col("n_points") * F.col("hx") * F.col("hy"))).alias("z"),
    )


def with_alpha(density: DataFrame) -> DataFrame:
    """Transparency by density: faint cells fade out, quadratically for counts; null without a density."""
    z = F.col("z")
    faint = F.when(F.col("component") == "count", z * z).otherwise(z)
    return density.withColumn("alpha", F.when(z < 1, faint).when(z >= 1, F.lit(1.0))).withColumn(
        "plot_alpha", F.when(z.isNotNull(), F.least(z, F.lit(1.0)))
    )


def normalised(density: DataFrame) -> DataFrame:
    """Density relative to the component's peak."""
    peak = density.groupBy("component").agg(F.max("z").alias("peak"))
    return density.join(peak, "component").select(
        "component", "i", "j", "x", "y", (F.col("z") / F.col("peak")).alias("ndensity")
    )


def density_1d(
    rows: DataFrame, keys: list[str], value: str, n: int = 101
) -> DataFrame:
    """Gaussian kernel density on n points per group.

    Every value adds to all grid points by an explode; partial sums run before
    the shuffle, which carries n rows per group and task. A group whose values are
    all equal, or that has one value, has no density: its points have a null one.
    """
    seen = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"))
    stats = grouped_quantiles(
        seen,
        keys,
        "_value",
        (0.25, 0.75),
        ("q25", "q75"),
        extra=(
            F.min("_value").alias("least"),
            F.max("_value").alias("most"),
            F.stddev_samp("_value").alias("sd"),
            F.count(F.lit(1)).alias("n_points"),
        ),
    )
    h = F.lit(0.9) * _spread(F.col("sd"), F.col("q25"), F.col("q75")) * F.pow(
        F.col("n_points").cast("double"), F.lit(-0.2)
    )
    frame = stats.select(*keys, "least", "most", "n_points", h.alias("h"))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    x = F.col("least") + (F.col("most") - F.col("least")) * F.col("i") / F.lit(float(n - 1))
    t = (F.col("x") - F.col("_value")) / F.col("h")
    spread = (
        seen.join(frame.where(F.col("h") > 0), keys)
        .withColumn("i", F.explode(steps))
        .withColumn("x", x)
        .withColumn("k", F.exp(F.lit(-0.5) * t * t) / F.lit(SQRT_2PI))
    )
    sums = spread.groupBy(*keys, "i").agg(F.sum("k").alias("total"))
    points = frame.withColumn("i", F.explode(steps)).withColumn("x", x)
    return points.join(sums, [*keys, "i"], "left").select(*keys, "i", "x", (F.col("total") / (F.col("n_points") * F.col("h"))).alias("density"))


def parent_child(effects: DataFrame, parent: str, child: str, most: float = 1.5) -> DataFrame:
    """One row per draw with both effects, and whether the child is missing."""
    rows = effects.where(F.col("factor").isin(parent, child)).where(F.col("effect_size") <= most)
    wide = (
        rows.where(~F.col("absent"))
        .groupBy("component", "draw_id")
        .pivot("factor", [parent, child])
        .agg(F.first("effect_size"))
    )
    return wide.select(
        "component",
        "draw_id",
        F.col(f"`{parent}`").alias("parent"),
        F.col(f"`{child}`").alias("child"),
        F.col(f"`{child}`").isNull().alias("child_missing"),
    )


def axis_limits(effects: DataFrame, parent: str, child: str, most: float = 1.5) -> DataFrame:
    """Largest effect per component, and where the side panel starts."""
    rows = effects.where(F.col("factor").isin(parent, child)).where(F.col("effect_size") <= most)
    top = rows.groupBy("component").agg(F.max("effect_size").alias("largest"))
    return top.withColumn("panel_start", -F.col("largest") / F.lit(5.0))


def measures(table: DataFrame, left_out: list[str]) -> DataFrame:
    """Frequencies and effect sizes stacked in one table with explicit orders."""
    order = Window.partitionBy(F.lit(1)).orderBy(
        F.desc("component"), "frequency", F.desc("q_5"), "factor"
    )
    kept = table.where(~F.col("factor").isin(*left_out)).select(
        F.when(F.col("component") == "count", "Count").otherwise("Frequency").alias("component"),
        F.when(F.col("factor") == "Genus", "Host Genus").otherwise(F.col("factor")).alias("factor"),
        F.row_number().over(order).alias("factor_ordinal"),
        "frequency",
        "q_5",
        "q_025",
        "q_975",
    )
    first = kept.select(
        "component",
        "factor",
        "factor_ordinal",
        F.col("frequency").alias("x"),
        F.lit("Model Inclusion Frequency").alias("measure"),
        F.lit(1).alias("measure_ordinal"),
    )
    second = kept.select(
        "component",
        "factor",
        "factor_ordinal",
        F.col("q_5").alias("x"),
        F.col("q_025").alias("lower"),
        F.col("q_975").alias("upper"),
        F.lit("Effect size [with 95% CI]").alias("measure"),
        F.lit(2).alias("measure_ordinal"),
    )
    return first.unionByName(second, allowMissingColumns=True)
