"""Marginal effects, pooled factors, effect sizes and inclusion frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twofold.functions.links import inv_logit
from twofold.operators.quantiles import grouped_quantiles
from twofold.rules import (
    EFFECT_NAMES,
    EFFECT_PROBS,
    FACTOR_LABELS,
    JOINT_HOST,
    JOINT_SOURCE,
    POOLED_HOST,
    POOLED_SOURCE,
)

MARGINAL = ("draw_id", "component", "factor", "level", "intercept", "linear_value", "absent")


def factor_label(term: Column) -> Column:
    """Factor of a term; the first match wins, other terms have none."""
    label = F.lit(None).cast("string")
    for name, text in reversed(FACTOR_LABELS.items()):
        label = F.when(term == name, F.lit(text)).otherwise(label)
    return label


def factor_table(draws: DataFrame) -> DataFrame:
    """Distinct parameters with their factor label."""
    table = draws.select("kind", "term", "level").distinct()
    return table.withColumn("factor", factor_label(F.col("term"))).where(F.col("factor").isNotNull())


def relevant(draws: DataFrame, kinds=("fixed", "interaction"), component: str | None = None) -> DataFrame:
    kept = draws.where(F.col("kind").isin(*kinds))
    return kept if component is None else kept.where(F.col("component") == component)


def inverse_link(component: Column, eta: Column) -> Column:
    return F.when(component == "count", F.exp(eta)).otherwise(inv_logit(eta))


def with_intercept(draws: DataFrame) -> DataFrame:
    """Put each draw's intercept next to its parameters; a window over one draw's
    parameters replaces a join of the draws with themselves."""
    one = Window.partitionBy("draw_id", "component")
    start = F.max(F.when(F.col("kind") == "intercept", F.col("value"))).over(one)
    return draws.withColumn("intercept", start).where(F.col("kind") != "intercept")


def present_marginals(draws: DataFrame) -> DataFrame:
    """g^-1(intercept + value) of every parameter in a draw's model."""
    return with_intercept(draws).select(
        "draw_id",
        "component",
        factor_label(F.col("term")).alias("factor"),
        "level",
        "intercept",
        inverse_link(F.col("component"), F.col("intercept") + F.col("value")).alias("linear_value"),
        F.lit(False).alias("absent"),
        "kind",
    )


def reference_marginals(present: DataFrame) -> DataFrame:
    """The reference class of each fixed factor of a draw; random factors have none."""
    return (
        present.where(F.col("kind") != "random")
        .groupBy("draw_id", "component", "factor")
        .agg(F.first("intercept").alias("intercept"))
        .select(
            "draw_id",
            "component",
            "factor",
            F.lit(None).cast("string").alias("level"),
            "intercept",
            inverse_link(F.col("component"), F.col("intercept")).alias("linear_value"),
            F.lit(False).alias("absent"),
        )
    )


def absent_rows(index: DataFrame, present: DataFrame) -> DataFrame:
    """One row per draw and factor that its model lacks.

    Factors are those seen in any draw of the component. Each draw's own factors
    are gathered once (eight at most) and taken from the full list.
    """
    own = present.select("draw_id", "component", "factor").unionByName(
        _both_parts(index).withColumn("factor", F.lit(None).cast("string"))
    )
    names = F.array(*[F.lit(v) for v in FACTOR_LABELS.values()])
    lacking = own.groupBy("draw_id", "component").agg(F.collect_set("factor").alias("own"))
    rows = lacking.select(
        "draw_id", "component", F.explode(F.array_except(names, "own")).alias("factor")
    )
    seen = present.select("component", "factor").distinct()
    return rows.join(seen, ["component", "factor"], "left_semi").select(
        "draw_id",
        "component",
        "factor",
        F.lit(None).cast("string").alias("level"),
        F.lit(None).cast("double").alias("intercept"),
        F.lit(None).cast("double").alias("linear_value"),
        F.lit(True).alias("absent"),
    )


def _both_parts(index: DataFrame) -> DataFrame:
    sides = F.explode(F.array(F.lit("count"), F.lit("prop")))
    return index.select("draw_id", sides.alias("component"))


def marginals(draws: DataFrame, index: DataFrame) -> DataFrame:
    """All marginals: present levels, reference classes and absent factors."""
    present = present_marginals(draws)
    return (
        present.drop("kind")
        .unionByName(reference_marginals(present))
        .unionByName(absent_rows(index, present))
    )


# Nested factors ------------------------------------------------------------


def draws_with_both(details: DataFrame, parent_term: str, child_term: str) -> DataFrame:
    """Draws whose model holds both terms, per component."""
    parts = F.array(
        F.struct(F.lit("count").alias("component"), F.col("count_terms").alias("terms")),
        F.struct(F.lit("prop").alias("component"), F.col("hurdle_terms").alias("terms")),
    )
    rows = details.select("draw_id", F.inline(parts))
    return rows.where(
        F.array_contains("terms", parent_term) & F.array_contains("terms", child_term)
    ).select("draw_id", "component")


def level_parent(levels: DataFrame, dimension: DataFrame) -> DataFrame:
    """Parent of each child level, from a (level, parent) table."""
    return levels.join(dimension, "level", "left")


def nested_vectors(
    draws: DataFrame,
    index: DataFrame,
    parent_term: str,
    child_term: str,
    dimension: DataFrame,
    parent_ref: str,
    child_ref: str | None,
) -> DataFrame:
    """One row per draw and component with the levels of both terms.

    ``parents`` maps each parent level to its value; ``children`` lists child
    levels with their parent level and value. A fixed term that is in the model
    also has its reference level, with value 0. Both are null for a term that
    is not in the model. A draw's lists hold the levels of one model.
    """
    rows = draws.where(
        (F.col("kind") == "intercept") | F.col("term").isin(parent_term, child_term)
    )
    # The intercept row looks up the parent of the child's reference level.
    if child_ref is None:
        placed = level_parent(rows, dimension)
    else:
        at_ref = F.col("kind") == "intercept"
        placed = level_parent(
            rows.withColumn("level", F.when(at_ref, F.lit(child_ref)).otherwise(F.col("level"))), dimension
        )
    term, level, value = F.col("term"), F.col("level"), F.col("value")
    slots = _both_parts(index).unionByName(
        placed.select("draw_id", "component", "term", "level", "parent", "value"), allowMissingColumns=True
    )
    parents = F.collect_list(F.when(term == parent_term, F.struct(level.alias("level"), value.alias("value"))))
    children = F.collect_list(
        F.when(
            term == child_term,
            F.struct(level.alias("level"), F.col("parent").alias("parent"), value.alias("value")),
        )
    )
    gathered = slots.groupBy("draw_id", "component").agg(
        F.max(F.when(term == "intercept", value)).alias("intercept"),
        F.max(F.when(term == "intercept", F.col("parent"))).alias("ref_parent"),
        parents.alias("parents"),
        children.alias("children"),
    )
    zero_parent = F.array(F.struct(F.lit(parent_ref).alias("level"), F.lit(0.0).alias("value")))
    full_parents = F.when(F.size("parents") > 0, F.concat("parents", zero_parent))
    full_children = F.when(F.size("children") > 0, F.col("children"))
    if child_ref is not None:
        zero_child = F.struct(
            F.lit(child_ref).alias("level"), F.col("ref_parent").alias("parent"), F.lit(0.0).alias("value")
        )
        full_children = F.when(F.size("children") > 0, F.concat("children", F.array(zero_child)))
    return gathered.select(
        "draw_id",
        "component",
        "intercept",
        full_parents.alias("parents"),
        full_children.alias("children"),
    )


def pool_nested(
    draws: DataFrame,
    index: DataFrame,
    parent_term: str,
    child_term: str,
    dimension: DataFrame,
    parent_ref: str,
    child_ref: str | None,
    joint_label: str,
    pooled_label: str,
) -> DataFrame:
    """Joint and pooled factor of a nested pair.

    Joint: child levels combined with their parent, for draws whose model has
    both. Pooled: the joint rows where there are any, else the rows of whichever
    of the two is in the model. Every other draw gets one absent row, so both
    frequencies are over all draws. ``child_ref`` is None for a random child,
    which has no reference level. One grouping by draw does all of it.
    """
    vectors = nested_vectors(draws, index, parent_term, child_term, dimension, parent_ref, child_ref)
    intercept, part = F.col("intercept"), F.col("component")

    def row(level: Column, eta: Column) -> Column:
        return F.struct(
            level.alias("level"), inverse_link(part, intercept + eta).alias("linear_value")
        )

    values = F.map_from_entries("parents")
    placed = F.filter(
        "children", lambda c: F.exists("parents", lambda p: p["level"] == c["parent"])
    )
    joint = F.transform(placed, lambda c: row(c["level"], F.element_at(values, c["parent"]) + c["value"]))
    # Alone, a reference level keeps the null level it has among the marginals.
    alone = F.coalesce(
        F.transform("parents", lambda p: row(F.nullif(p["level"], F.lit(parent_ref)), p["value"])),
        F.transform(
            "children",
            lambda c: row(
                F.nullif(c["level"], F.lit(child_ref)) if child_ref else c["level"], c["value"]
            ),
        ),
    )
    both = F.col("parents").isNotNull() & F.col("children").isNotNull()
    rows = vectors.select(
        "draw_id",
        "component",
        "intercept",
        F.when(both, joint).alias("joint"),
        F.when(both, joint).otherwise(alone).alias("pooled"),
    )
    factors = F.array(
        F.struct(F.lit(joint_label).alias("factor"), F.col("joint").alias("rows")),
        F.struct(F.lit(pooled_label).alias("factor"), F.col("pooled").alias("rows")),
    )
    absent = F.col("level").isNull() & F.col("linear_value").isNull()
    return (
        rows.select("draw_id", "component", "intercept", F.inline(factors))
        .select("draw_id", "component", "factor", "intercept", F.inline_outer("rows"))
        .select(
            "draw_id",
            "component",
            "factor",
            "level",
            F.when(~absent, intercept).alias("intercept"),
            "linear_value",
            absent.alias("absent"),
        )
    )


def family_dimension(cells: DataFrame) -> DataFrame:
    """Source site of each family."""
    return cells.select(F.col("family").alias("level"), F.col("source_site").alias("parent")).distinct()


def genus_dimension(cells: DataFrame) -> DataFrame:
    """Genus of each host site, from the trials and not from a typed list."""
    return cells.select(F.col("host_site").alias("level"), F.col("genus").alias("parent")).distinct()


def pool_source(draws, index, cells, source_ref: str) -> DataFrame:
    return pool_nested(
        draws, index, "source", "(1|family)", family_dimension(cells), source_ref, None, JOINT_SOURCE, POOLED_SOURCE
    )


def pool_host(draws, index, cells, genus_ref: str, host_ref: str) -> DataFrame:
    return pool_nested(
        draws, index, "genus", "host", genus_dimension(cells), genus_ref, host_ref, JOINT_HOST, POOLED_HOST
    )


# Effect sizes --------------------------------------------------------------


def effect_sizes(rows: DataFrame) -> DataFrame:
    """Spread of a factor's marginals within each draw. One level gives null."""
    return rows.groupBy("component", "factor", "draw_id").agg(
        F.stddev_samp("linear_value").alias("effect_size"),
        F.bool_or(F.col("linear_value").isNull()).alias("absent"),
    )


def inclusion(effects: DataFrame) -> DataFrame:
    return effects.groupBy("component", "factor").agg(_frequency().alias("frequency"))


def _frequency() -> Column:
    return F.lit(1.0) - F.avg(F.col("absent").cast("int").cast("double"))


def credible_intervals(effects: DataFrame, keys: list[str]) -> DataFrame:
    return grouped_quantiles(effects, keys, "effect_size", EFFECT_PROBS, EFFECT_NAMES)


def summary(effects: DataFrame) -> DataFrame:
    """Inclusion frequency and credible interval per component and factor."""
    return grouped_quantiles(
        effects,
        ["component", "factor"],
        "effect_size",
        EFFECT_PROBS,
        EFFECT_NAMES,
        extra=(_frequency().alias("frequency"),),
    ).orderBy("component", F.desc("frequency"), "factor")


def n_draws(effects: DataFrame) -> DataFrame:
    return effects.agg(F.countDistinct("draw_id").alias("n_draws"))


def manuscript(table: DataFrame) -> DataFrame:
    """Text table: three decimals, interval in brackets, joint factors left out."""

    def text(c: str) -> Column:
        return F.format_string("%.3f", F.round(F.col(c), 3))

    return (
        table.where(~F.col("factor").isin(JOINT_SOURCE, JOINT_HOST))
        .where(F.col("q_5").isNotNull())
        .select(
            "component",
            F.when(F.col("factor") == "Genus", "Host Genus").otherwise(F.col("factor")).alias("factor"),
            text("frequency").alias("frequency"),
            text("q_5").alias("median"),
            F.concat(F.lit("["), text("q_025"), F.lit(", "), text("q_975"), F.lit("]")).alias("ci"),
        )
    )


def partition_by_presence(
    effects: DataFrame, factor: str, other: str, with_label: str, without_label: str
) -> DataFrame:
    """A factor's effects, split by whether another is in the same draw."""
    keys = ["component", "draw_id"]
    there = effects.where(~F.col("absent"))
    mine = there.where(F.col("factor") == factor)
    theirs = there.where(F.col("factor") == other).select(*keys)
    inside = mine.join(theirs, keys, "left_semi").withColumn("partition", F.lit(with_label))
    outside = mine.join(theirs, keys, "left_anti").withColumn("partition", F.lit(without_label))
    return inside.unionByName(outside)


def split_effects(effects: DataFrame, factor: str, other: str) -> DataFrame:
    parts = partition_by_presence(effects, factor, other, "With", "Without")
    return credible_intervals(parts, ["component", "partition"])


def joint_inclusion(effects: DataFrame, component: str) -> DataFrame:
    """How often each combination of factors occurs together."""
    rows = effects.where(F.col("component") == component)
    per_draw = rows.groupBy("draw_id").agg(
        F.array_join(
            F.sort_array(F.collect_set(F.when(~F.col("absent"), F.col("factor")))), " + "
        ).alias("factors")
    )
    combos = per_draw.groupBy("factors").agg(F.count(F.lit(1)).alias("n_draws"))
    total = F.sum("n_draws").over(Window.partitionBy(F.lit(1)))
    return combos.withColumn("frequency", F.col("n_draws") / total)
