"""Expected counts and prevalences per design cell and draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twofold.functions.links import prevalence, truncated_mean
from twofold.operators.joins import block_product
from twofold.operators.modelspace import cell_levels, term_level
from twofold.operators.quantiles import grouped_quantiles
from twofold.rules import EV_NAMES, EV_PROBS, TERMS

INTERACTIONS = ("source:host", "genus:source")


def _terms(interactions: bool) -> list[str]:
    return [t for t in TERMS if interactions or t not in INTERACTIONS]


def cell_parameters(cells: DataFrame, draws: DataFrame, interactions: bool = True) -> DataFrame:
    """Which parameters apply to each cell, per component; only those that exist
    in some draw."""
    rows = cell_levels(cells).where(F.col("term").isin(*_terms(interactions)))
    start = cells.select("cell_id", F.lit("intercept").alias("term"), F.lit("").alias("level"))
    existing = draws.select("component", "term", "level").distinct()
    return rows.unionByName(start).join(existing, ["term", "level"])


def _key(term: Column, level: Column) -> Column:
    return F.concat_ws("|", term, level)


def draw_vectors(draws: DataFrame) -> DataFrame:
    """One row per draw with a map of parameter values for each part.

    A map holds the parameters of one model, so its size does not grow with
    trials or draws.
    """
    entry = F.struct(_key(F.col("term"), F.col("level")).alias("k"), F.col("value").alias("v"))

    def part(name: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("component") == name, entry))).alias(name)

    return draws.groupBy("draw_id", "model_name").agg(part("count"), part("prop"))


def cell_keys(cells: DataFrame, terms: list[str], reference: dict[str, str] | None = None) -> DataFrame:
    """Cells with one column per term: the key of the parameter it calls for.

    With ``reference``, levels that need no parameter have a null key.
    """
    keys = []
    for i, term in enumerate(terms):
        key = _key(F.lit(term), term_level(term))
        for factor in term.split(":") if reference else ():
            if factor in reference:
                key = F.when(term_level(factor) != reference[factor], key)
        keys.append(key.alias(f"key_{i}"))
    return cells.select("cell_id", *keys)


def linear_predictors(
    cells: DataFrame,
    draws: DataFrame,
    interactions: bool = True,
    draw_blocks: int | None = None,
    cell_blocks: int = 4,
) -> DataFrame:
    """Linear predictor of both parts for every cell under every draw.

    The result has one row per (cell, draw) by definition. The sum of a cell's
    parameters is looked up in the draw's own map, so pairs are built and
    summed in place and never shuffled.
    """
    terms = _terms(interactions)
    pairs = block_product(
        draw_vectors(draws), cell_keys(cells, terms), "draw_id", "cell_id", draw_blocks, cell_blocks
    )

    def total(part: str) -> Column:
        eta = F.try_element_at(part, F.lit("intercept|"))
        for i in range(len(terms)):
            eta = eta + F.coalesce(F.try_element_at(part, F.col(f"key_{i}")), F.lit(0.0))
        return eta

    return pairs.select(
        "draw_id", "model_name", "cell_id", total("count").alias("eta_count"), total("prop").alias("eta_prop")
    )


def expected_values(predictors: DataFrame) -> DataFrame:
    return predictors.select(
        "draw_id",
        "model_name",
        "cell_id",
        truncated_mean(F.col("eta_count")).alias("count_ev"),
        prevalence(F.col("eta_prop")).alias("prev_ev"),
    )


def with_cells(values: DataFrame, cells: DataFrame) -> DataFrame:
    return values.join(
        cells.select("cell_id", "host_site", "family", "source_site", "block", "genus", "native"), "cell_id"
    )


def long_values(values: DataFrame, keys: list[str], names=("Incidence", "Prevalence")) -> DataFrame:
    """Expected values as (variable, pred) rows."""
    return values.select(
        *keys, F.col("count_ev").alias(names[0]), F.col("prev_ev").alias(names[1])
    ).unpivot(keys, list(names), "variable", "pred")


def cell_summary(values: DataFrame) -> DataFrame:
    """Quantiles, mean and median per cell and response."""
    rows = long_values(values, ["cell_id"], ("count", "hu"))
    return grouped_quantiles(
        rows,
        ["cell_id", "variable"],
        "pred",
        (*EV_PROBS, 0.5),
        (*EV_NAMES, "median"),
        extra=(F.avg("pred").alias("mean"),),
    )


def site_summary(values: DataFrame) -> DataFrame:
    """Mean, median, sd and the 50% and 95% limits by variable and site pair."""
    keys = ["variable", "host_site", "source_site"]
    rows = long_values(values, ["host_site", "source_site"])
    return grouped_quantiles(
        rows,
        keys,
        "pred",
        (0.5, 0.25, 0.75, 0.025, 0.975),
        ("median", "lower_50", "upper_50", "lower_95", "upper_95"),
        extra=(F.avg("pred").alias("mean"), F.stddev_samp("pred").alias("sd")),
    )


def wide_intervals(summary: DataFrame) -> DataFrame:
    """One row per interval with its lower and upper limit."""
    rows = F.array(
        *[
            F.struct(
                F.lit(w).alias("interval"),
                F.col(f"lower_{n}").alias("lower"),
                F.col(f"upper_{n}").alias("upper"),
            )
            for w, n in ((0.5, "50"), (0.95, "95"))
        ]
    )
    keep = ["variable", "host_site", "source_site", "mean", "median", "sd"]
    return summary.select(*keep, F.inline(rows))


def complete_share(
    cells: DataFrame, draws: DataFrame, by: str, terms: list[str], reference: dict[str, str]
) -> DataFrame:
    """Share of predictions for which the model holds every parameter asked for.

    Reference levels, and interactions with one, need no parameter. ``by`` is ``cell_id`` or ``draw_id``.
    """
    pairs = block_product(
        draw_vectors(draws), cell_keys(cells, terms, reference), "draw_id", "cell_id"
    )

    def share(part: str, name: str) -> Column:
        complete = F.lit(True)
        for i in range(len(terms)):
            key = F.col(f"key_{i}")
            complete = complete & (key.isNull() | F.try_element_at(part, key).isNotNull())
        return F.avg(complete.cast("int").cast("double")).alias(name)

    return pairs.groupBy(by).agg(share("count", "prop_count"), share("prop", "prop_hu"))


def common_terms(candidates: DataFrame, column: str) -> DataFrame:
    """Terms found in every model: those whose count equals the number of models."""
    size = candidates.agg(F.count(F.lit(1)).alias("n_models"))
    counts = candidates.select(F.explode(column).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.join(size, F.col("n") == F.col("n_models")).select("term")
