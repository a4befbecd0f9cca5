"""Draw allocation, generation and pooling in a long layout.

``draws``: draw_id, model_name, component, kind, term, level, value. A parameter
that is not in the model has no row; neither has a reference level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twofold.functions import rand
from twofold.rules import Design

DRAW_BASE = 1 << 32  # draws per model stay below


def allocate(weights: DataFrame, per_model: int = 4000) -> DataFrame:
    """Draws per model in proportion to weight, the best model getting all of its
    draws. Halves round to even."""
    top = F.max("weight").over(Window.partitionBy(F.lit(1)))
    return weights.withColumn(
        "n_draws", F.bround(F.col("weight") / top * F.lit(float(per_model))).cast("long")
    )


def allocate_total(weights: DataFrame, per_model: int = 4000, total: float | None = None) -> DataFrame:
    """Draws per model for a total budget; by default the largest total that
    leaves no model asked for more draws than it has."""
    top = F.max("weight").over(Window.partitionBy(F.lit(1)))
    budget = F.lit(float(total)) if total is not None else F.lit(float(per_model)) / top
    return weights.withColumn("n_draws", F.bround(budget * F.col("weight")).cast("long"))


def draw_index(allocated: DataFrame, per_model: int = 4000, seed: int = 52399832) -> DataFrame:
    """Sample of draw numbers per model, without replacement.

    Numbers are ordered by a hash within the model. The identifier is fixed by
    model and number, so it never depends on row order. Asking a model for more
    draws than it has is an error.
    """
    if per_model >= DRAW_BASE:
        raise ValueError("draws per model must be below 2^32")
    short = F.when(F.col("n_draws") > per_model, F.raise_error(F.lit("a model is asked for more draws than it has")).cast("long"))
    allocated = allocated.withColumn("n_draws", F.coalesce(short, F.col("n_draws")))
    pool = allocated.where(F.col("n_draws") > 0).select(
        "model_name", "id", "n_draws", F.explode(F.sequence(F.lit(1), F.lit(per_model))).alias("draw_in_model")
    )
    u = rand.uniform(rand.key("pick", seed, F.col("model_name"), F.col("draw_in_model")))
    order = Window.partitionBy("model_name").orderBy(u, "draw_in_model")
    return (
        pool.withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= F.col("n_draws"))
        .select(
            (F.col("id") * F.lit(DRAW_BASE).cast("long") + F.col("draw_in_model")).alias("draw_id"),
            "model_name",
            "draw_in_model",
        )
    )


# Parameters as contrasts of group estimates --------------------------------


def _part(form: str, kind: str, term: str, level: str, role: str, group: str, coef, when: str = "") -> str:
    """SQL text of one contrast row; null where ``when`` does not hold."""
    row = (
        f"struct('{form}' AS form, '{kind}' AS kind, '{term}' AS term, {level} AS level, "
        f"'{role}' AS role, {group} AS group_level, CAST({coef} AS DOUBLE) AS coef)"
    )
    return f"CASE WHEN {when} THEN {row} END" if when else row


def _one_factor(form: str, term: str, level: str, ref: str, role: str = "fixed") -> list[str]:
    """Intercept at the reference level, offsets elsewhere."""
    here, away = f"{level} = '{ref}'", f"{level} <> '{ref}'"
    return [
        _part(form, "intercept", "intercept", "''", role, f"'{ref}'", 1, here),
        _part(form, "fixed", term, level, role, level, 1, away),
        _part(form, "fixed", term, level, role, f"'{ref}'", -1, away),
    ]


def _crossed(form: str, term: str, first: str, ref: str, name: str, base: str) -> list[str]:
    """Source offsets at the first factor's reference, and interactions."""
    source = f"{first} = '{ref}' AND source_site <> '{base}'"
    both = f"{first} <> '{ref}' AND source_site <> '{base}'"
    pair, at_source = f"{first} || '|' || source_site", f"'{ref}|' || source_site"
    at_first, corner = f"{first} || '|{base}'", f"'{ref}|{base}'"
    return [
        _part(form, "fixed", "source", "source_site", "fixed", at_source, 1, source),
        _part(form, "fixed", "source", "source_site", "fixed", corner, -1, source),
        _part(form, "interaction", term, name, "fixed", pair, 1, both),
        _part(form, "interaction", term, name, "fixed", at_first, -1, both),
        _part(form, "interaction", term, name, "fixed", at_source, -1, both),
        _part(form, "interaction", term, name, "fixed", corner, 1, both),
    ]


def _rows(df: DataFrame, parts: list[str]) -> DataFrame:
    return df.selectExpr(f"inline(filter(array({', '.join(parts)}), x -> x IS NOT NULL))")


def contrasts(cells: DataFrame, design: Design = Design()) -> DataFrame:
    """Each parameter as a sum of group estimates.

    Treatment coding with the design's reference levels. Where hosts nest in
    genus, a genus stands for its reference host, or for the mean of its hosts
    if it has none; host offsets are taken from there. The table is bounded by
    the number of factor levels.
    """
    genus, source = design.genus, design.source
    at_base = f"source_site = '{source}' AND genus = '{genus}'"
    off_base = f"source_site = '{source}' AND genus <> '{genus}'"
    corner = f"'{genus}|{source}'"
    parts = (
        _one_factor("source", "source", "source_site", source)
        + _one_factor("genus", "genus", "genus", genus)
        + _one_factor("native", "native", "CAST(native AS STRING)", "false")
        + _one_factor("source_family", "source", "source_site", source, role="parent")
        + _crossed("genus_source", "genus:source", "genus", genus, "genus || ':' || source_site", source)
        + _crossed(
            "host_source", "source:host", "host_site", design.host, "source_site || ':' || host_site", source
        )
        + [
            _part("genus_source", "intercept", "intercept", "''", "fixed", corner, 1, at_base),
            _part("genus_source", "fixed", "genus", "genus", "fixed", f"genus || '|{source}'", 1, off_base),
            _part("genus_source", "fixed", "genus", "genus", "fixed", corner, -1, off_base),
            _part("source_family", "random", "(1|family)", "family", "random", "family", 1),
            _part("block", "intercept", "intercept", "''", "parent", "'all'", 1),
            _part("block", "random", "(1|block)", "block", "random", "block", 1),
        ]
    )
    plain = _rows(cells, parts).distinct()

    # Hosts nested in genus.
    hosts = cells.select("host_site", "genus").distinct()
    base = hosts.selectExpr(
        "genus",
        "host_site AS base_host",
        f"max(host_site = '{design.host}') OVER (PARTITION BY genus) AS has_ref",
    )
    base = base.where(f"NOT has_ref OR base_host = '{design.host}'").selectExpr(
        "genus", "base_host", "1.0D / count(1) OVER (PARTITION BY genus) AS w"
    )
    # Base hosts of the reference genus, once for every other genus.
    against_ref = (
        base.selectExpr("*", "collect_set(genus) OVER () AS genera")
        .where(f"genus = '{genus}'")
        .selectExpr("base_host", "w", f"explode(array_remove(genera, '{genus}')) AS genus")
    )
    moved = hosts.where(f"host_site <> '{design.host}'")

    def both_forms(rows_of) -> list[str]:
        """Rows of the host form, and of the host by source form at the reference source."""
        return rows_of("host", "") + rows_of("host_source", f" || '|{source}'")

    own = both_forms(
        lambda form, at: [
            _part(form, "intercept", "intercept", "''", "fixed", f"base_host{at}", "w", f"genus = '{genus}'"),
            _part(form, "fixed", "genus", "genus", "fixed", f"base_host{at}", "w", f"genus <> '{genus}'"),
        ]
    )
    against = both_forms(
        lambda form, at: [_part(form, "fixed", "genus", "genus", "fixed", f"base_host{at}", "-w")]
    )
    offset = both_forms(
        lambda form, at: [_part(form, "fixed", "host", "host_site", "fixed", f"host_site{at}", 1)]
    )
    from_base = both_forms(
        lambda form, at: [_part(form, "fixed", "host", "host_site", "fixed", f"base_host{at}", "-w")]
    )
    tables = [
        plain,
        _rows(base, own),
        _rows(against_ref, against),
        _rows(moved, offset),
        _rows(moved.join(base, "genus"), from_base),
    ]
    return reduce(DataFrame.unionByName, tables)


def parameters(contrast: DataFrame, fits: DataFrame) -> DataFrame:
    """One row per parameter with the estimates it is made of."""
    parts = contrast.join(
        fits.withColumnRenamed("level", "group_level"), ["form", "role", "group_level"]
    )
    return parts.groupBy("form", "component", "kind", "term", "level").agg(
        F.sort_array(F.collect_list(F.struct("role", "group_level", "coef", "loc", "scale"))).alias("parts")
    )


def make_draws(index: DataFrame, candidates: DataFrame, params: DataFrame, seed: int = 1) -> DataFrame:
    """Draws of every parameter of every chosen draw.

    Value = sum of coef * (loc + z * scale) with z hashed from model, draw and
    group, so a group's draw is the same in all parameters it enters. No shuffle
    of draws: parameters (bounded by factor levels) join the index by form.
    """
    parts = F.array(
        F.struct(F.lit("count").alias("component"), F.col("count_form").alias("form")),
        F.struct(F.lit("prop").alias("component"), F.col("hurdle_form").alias("form")),
    )
    models = candidates.select("model_name", F.inline(parts))
    per_model = models.join(params, ["component", "form"]).drop("form")

    def add(total, part):
        k = rand.key(
            "draw",
            seed,
            F.col("model_name"),
            F.col("component"),
            part["role"],
            part["group_level"],
            F.col("draw_in_model"),
        )
        return total + part["coef"] * (part["loc"] + rand.normal(k) * part["scale"])

    return index.join(per_model, "model_name").select(
        "draw_id",
        "model_name",
        "component",
        "kind",
        "term",
        "level",
        F.aggregate("parts", F.lit(0.0), add).alias("value"),
    )


def subset_draws(draws: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of the chosen draws only; for draw tables loaded from elsewhere."""
    return draws.join(index.select("draw_id"), "draw_id", "left_semi")


def parameter_name() -> Column:
    """Column name of a parameter in the wide layout."""
    tail = F.regexp_replace(F.concat_ws("_", "term", F.nullif(F.col("level"), F.lit(""))), r"[^A-Za-z0-9]+", "_")
    return F.concat_ws("_", "component", F.regexp_replace(tail, "^_|_$", ""))


def parameter_names(draws: DataFrame) -> list[str]:
    """Names of all parameters of the draws, in order; bounded by the factor levels."""
    found = draws.select("component", "term", "level").distinct().select(parameter_name().alias("name"))
    return sorted({r["name"] for r in found.collect()})


def wide_draws(draws: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per draw, one column per parameter, null where the model lacks it.

    Given names spare the pass that finds them; without any, all parameters of
    the draws have a column.
    """
    names = parameter_names(draws) if names is None else names
    return (
        draws.withColumn("parameter", parameter_name())
        .groupBy("draw_id", "model_name")
        .pivot("parameter", names)
        .agg(F.first("value"))
    )


def zero_filled(wide: DataFrame) -> DataFrame:
    """Missing parameters count as zero in a sum."""
    doubles = [f.name for f in wide.schema if f.dataType.simpleString() == "double"]
    return wide.fillna(0.0, doubles)


def draw_details(index: DataFrame, candidates: DataFrame) -> DataFrame:
    """Model and formulas behind every draw."""
    return index.join(
        candidates.select("model_name", "count_formula", "hurdle_formula", "count_terms", "hurdle_terms"),
        "model_name",
    )
