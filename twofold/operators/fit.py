"""Closed-form fits of grouped hurdle models from sufficient statistics.

The likelihood depends on the data only through (n, n_zero, n_pos, sum_y) per
group, so every candidate is fitted from the cell table, whose size is set by
the number of factor levels and not by the number of trials. Estimates are
normal approximations on the link scale, not a sampled posterior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twofold.functions.links import logit, positive_mean, truncated_rate
from twofold.operators.modelspace import cell_levels
from twofold.rules import FIXED_SD, FORMS, INTERCEPT_SD, RANDOM_SD, RANDOM_TERMS, Form

STATS = ("n", "n_zero", "n_pos", "sum_y")
GROUP = ("form", "role", "parent", "level")
OVERALL = "all"


def _level(keys: tuple[str, ...]) -> str:
    if not keys:
        return f"'{OVERALL}'"
    return "concat_ws('|', " + ", ".join(f"CAST({k} AS STRING)" for k in keys) + ")"


def form_groups(forms: tuple[Form, ...] = FORMS, roles=("fixed", "parent", "random")) -> Column:
    """Array of (form, role, parent, level) that a cell belongs to."""
    groups = []
    for f in forms:
        if f.random:
            groups.append((f.name, "parent", "''", _level(f.parent)))
            groups.append((f.name, "random", _level(f.parent), _level(f.keys)))
        else:
            groups.append((f.name, "fixed", "''", _level(f.keys)))
    rows = [
        f"struct('{form}' AS form, '{role}' AS role, {parent} AS parent, {level} AS level)"
        for form, role, parent, level in groups
        if role in roles
    ]
    return F.expr(f"array({', '.join(rows)})")


def form_stats(cells: DataFrame, forms: tuple[Form, ...] = FORMS) -> DataFrame:
    """Sufficient statistics of every group of every form, in one aggregate."""
    return (
        cells.select(F.inline(form_groups(forms)), *STATS)
        .groupBy(*GROUP)
        .agg(*[F.sum(s).alias(s) for s in STATS])
    )


def zero_chance(n: Column, n_zero: Column) -> Column:
    return (n_zero + F.lit(0.5)) / (n + F.lit(1.0))


def estimates(stats: DataFrame) -> DataFrame:
    """Link-scale estimate and information of each group, one row per component.

    ``prop`` is the log odds of a zero, ``count`` the log rate of the truncated
    Poisson. ``boundary`` marks groups without a finite rate: no positive
    counts, or all of them equal to one.
    """
    n, n_zero, n_pos, sum_y = (F.col(s) for s in STATS)
    wide = (
        stats.withColumn("p0", zero_chance(n, n_zero))
        .withColumn("mu", positive_mean(n_pos, sum_y))
        .withColumn("rate", truncated_rate(F.col("mu")))
        .withColumn("boundary", (n_pos == 0) | (n_pos == sum_y))
    )
    p0, mu, rate = F.col("p0"), F.col("mu"), F.col("rate")
    prop = F.struct(
        F.lit("prop").alias("component"),
        logit(p0).alias("est"),
        (n * p0 * (F.lit(1.0) - p0)).alias("info"),
        F.lit(False).alias("boundary"),
    )
    count = F.struct(
        F.lit("count").alias("component"),
        F.ln(rate).alias("est"),
        (F.greatest(n_pos.cast("double"), F.lit(0.5)) * mu * (F.lit(1.0) + rate - mu)).alias("info"),
        F.col("boundary").alias("boundary"),
    )
    return wide.select(*GROUP, *STATS, F.inline(F.array(prop, count))).withColumn(
        "se", F.lit(1.0) / F.sqrt("info")
    )


def pooling(est: DataFrame) -> DataFrame:
    """Deviations of random groups from their parent, and the moment estimate of
    their variance per form and component."""
    parents = est.where(F.col("role") == "parent").select(
        "form", "component", F.col("level").alias("parent"), F.col("est").alias("center")
    )
    groups = (
        est.where(F.col("role") == "random")
        .join(parents, ["form", "component", "parent"])
        .withColumn("dev", F.col("est") - F.col("center"))
    )
    w, d = F.col("info"), F.col("dev")
    spread = groups.groupBy("form", "component").agg(
        (F.sum(w * d * d) - F.sum(w * d) * F.sum(w * d) / F.sum(w)).alias("q"),
        F.count(F.lit(1)).alias("groups"),
        (F.sum(w) - F.sum(w * w) / F.sum(w)).alias("scale"),
    )
    tau2 = F.greatest(
        F.lit(0.0),
        F.when(F.col("scale") > 0, (F.col("q") - (F.col("groups") - 1)) / F.col("scale")).otherwise(0.0),
    )
    return groups.join(
        spread.select("form", "component", tau2.alias("tau2")), ["form", "component"]
    )


def shrunk(est: DataFrame) -> DataFrame:
    """Random groups with their deviation shrunk towards the parent."""
    t, w = F.col("tau2"), F.col("info")
    return (
        pooling(est)
        .withColumn("shrinkage", t * w / (F.lit(1.0) + t * w))
        .withColumn("shrunk_dev", F.col("shrinkage") * F.col("dev"))
        .withColumn("shrunk_se", F.sqrt(t / (F.lit(1.0) + t * w)))
    )


def fits(stats: DataFrame) -> DataFrame:
    """Location and scale of every estimated quantity: group estimates for fixed
    and parent groups, shrunk deviations for random groups."""
    est = estimates(stats)
    plain = est.where(F.col("role") != "random").select(
        "form", "role", "level", "component", F.col("est").alias("loc"), F.col("se").alias("scale")
    )
    pooled = shrunk(est).select(
        "form",
        "role",
        "level",
        "component",
        F.col("shrunk_dev").alias("loc"),
        F.col("shrunk_se").alias("scale"),
    )
    return plain.unionByName(pooled)


# Additive candidates -------------------------------------------------------


def design_rows(cells: DataFrame, sides: DataFrame, reference: dict[str, str]) -> DataFrame:
    """Active parameters of every cell under every right-hand side.

    ``sides`` has ``side`` (name) and ``terms``. Reference levels of fixed terms
    have no parameter. One intercept row per (side, cell).
    """
    ref = F.lit(None).cast("string")
    for term, level in reference.items():
        ref = F.when(F.col("term") == term, F.lit(level)).otherwise(ref)
    active = (
        cell_levels(cells)
        .join(sides.select("side", F.explode("terms").alias("term")), "term")
        .withColumn("ref", ref)
        .where(F.col("ref").isNull() | (F.col("level") != F.col("ref")))
    )
    rows = active.select("side", "cell_id", "term", "level")
    start = cells.select("cell_id", F.lit("intercept").alias("term"), F.lit("").alias("level"))
    firsts = start.join(sides.select("side", F.lit("intercept").alias("term")), "term")
    return rows.unionByName(firsts.select("side", "cell_id", "term", "level"))


def prior_precision(component: Column, term: Column) -> Column:
    def inv(table):
        return F.when(component == "count", 1.0 / table["count"] ** 2).otherwise(1.0 / table["prop"] ** 2)

    return (
        F.when(term == "intercept", 1.0 / INTERCEPT_SD**2)
        .when(term.isin(*RANDOM_TERMS), inv(RANDOM_SD))
        .otherwise(inv(FIXED_SD))
    )


def cell_scores(predicted: DataFrame) -> DataFrame:
    """Score and information of each cell's linear predictor ``eta``."""
    eta = F.col("eta")
    p0 = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    rate = F.exp(eta)
    mu = rate / -F.expm1(-rate)
    is_prop = F.col("component") == "prop"
    score = F.when(is_prop, F.col("n_zero") - F.col("n") * p0).otherwise(
        F.col("sum_y") - F.col("n_pos") * mu
    )
    info = F.when(is_prop, F.col("n") * p0 * (F.lit(1.0) - p0)).otherwise(
        F.col("n_pos") * mu * (F.lit(1.0) + rate - mu)
    )
    return predicted.withColumn("score", score).withColumn("weight", info)


def predictors(design: DataFrame, cells: DataFrame, state: DataFrame) -> DataFrame:
    """Linear predictor of every (side, component, cell) under ``state``.

    ``state`` has ``side, component, term, level, value``.
    """
    eta = (
        design.join(state, ["side", "term", "level"])
        .groupBy("side", "component", "cell_id")
        .agg(F.sum("value").alias("eta"))
    )
    return eta.join(cells.select("cell_id", *STATS), "cell_id")


def score_sweep(design: DataFrame, cells: DataFrame, state: DataFrame) -> DataFrame:
    """Penalised gradient and diagonal information of every parameter."""
    scored = cell_scores(predictors(design, cells, state))
    sums = (
        design.join(scored, ["side", "cell_id"])
        .groupBy("side", "component", "term", "level")
        .agg(F.sum("score").alias("score"), F.sum("weight").alias("weight"))
    )
    prec = F.col("precision")
    return state.join(sums, ["side", "component", "term", "level"]).select(
        "side",
        "component",
        "term",
        "level",
        "value",
        "precision",
        (F.col("score") - prec * F.col("value")).alias("gradient"),
        (F.col("weight") + prec).alias("information"),
    )


def initial_state(design: DataFrame, precision=prior_precision) -> DataFrame:
    """All parameters zero, for both components, with their prior precision."""
    both = F.explode(F.array(F.lit("count"), F.lit("prop")))
    return (
        design.select("side", "term", "level")
        .distinct()
        .withColumn("component", both)
        .withColumn("value", F.lit(0.0))
        .withColumn("precision", precision(F.col("component"), F.col("term")).cast("double"))
    )


def diagonal_step(swept: DataFrame, damping: float = 0.5) -> DataFrame:
    """One damped step of every parameter along its own gradient."""
    return swept.select(
        "side",
        "component",
        "term",
        "level",
        "precision",
        (F.col("value") + F.lit(damping) * F.col("gradient") / F.col("information")).alias("value"),
    )


def patterns(design: DataFrame, cells: DataFrame, mark: str = "|") -> DataFrame:
    """Sufficient statistics per side and distinct set of active parameters.

    Cells that a candidate cannot tell apart are summed, so a candidate without
    block and family effects works on a handful of rows.
    """
    name = F.concat_ws(mark, "term", "level")
    active = design.groupBy("side", "cell_id").agg(F.sort_array(F.collect_list(name)).alias("params"))
    return (
        active.join(cells.select("cell_id", *STATS), "cell_id")
        .groupBy("side", "params")
        .agg(*[F.sum(c).alias(c) for c in STATS])
    )


def newton_step(table: DataFrame, state: DataFrame) -> DataFrame:
    """One full Newton step of every candidate.

    Spark sums the normal equations over the patterns: a pattern has at most
    nine active parameters, so it adds a small block, pre-summed on the map
    side. What reaches one task per candidate is its P x P system, P being its
    number of parameters. Steps are scaled so that no parameter moves by more
    than 2, which keeps the rates of the first steps finite.
    """
    values = state.withColumn("row", F.concat_ws("|", "term", "level"))
    # The parameter vector of a candidate travels with it: P numbers per side.
    vectors = values.groupBy("side", "component").agg(
        F.map_from_entries(F.collect_list(F.struct("row", "value"))).alias("values")
    )
    eta = F.aggregate("params", F.lit(0.0), lambda a, p: a + F.element_at("values", p))
    scored = cell_scores(table.join(vectors, "side").withColumn("eta", eta))
    order = F.sequence(F.lit(1), F.size("params"))
    pairs = F.transform(
        order,
        lambda i: F.struct(
            F.element_at("params", i).alias("row"),
            F.concat(F.slice("params", i, F.size("params")), F.array(F.lit(""))).alias("cols"),
        ),
    )
    blocks = (
        scored.select("side", "component", "score", "weight", F.inline(pairs))
        .select("side", "component", "row", "score", "weight", F.explode("cols").alias("col"))
        .groupBy("side", "component", "row", "col")
        .agg(
            F.sum(F.when(F.col("col") == "", F.col("score")).otherwise(F.col("weight"))).alias("total")
        )
    )
    return (
        blocks.join(values, ["side", "component", "row"])
        .groupBy("side", "component")
        .applyInPandas(
            _solve,
            "side string, component string, term string, level string, value double, "
            "precision double, change double",
        )
    )


def _solve(key, block):
    import numpy as np
    import pandas as pd

    own = block.drop_duplicates("row").sort_values("row")
    names = own["row"].to_numpy()
    at = {n: i for i, n in enumerate(names)}
    value, prec = own["value"].to_numpy(), own["precision"].to_numpy()
    h, g = np.diag(prec).astype(float), -prec * value
    rows = block["row"].map(at).to_numpy()
    is_score = (block["col"] == "").to_numpy()
    g[rows[is_score]] += block["total"].to_numpy()[is_score]
    cols = block.loc[~is_score, "col"].map(at).to_numpy()
    total = block["total"].to_numpy()[~is_score]
    h[rows[~is_score], cols] += total
    off = rows[~is_score] != cols
    h[cols[off], rows[~is_score][off]] += total[off]
    move = np.linalg.solve(h, g)
    size = float(np.abs(move).max())
    move *= min(1.0, 2.0 / size) if size > 0 else 1.0
    return pd.DataFrame(
        {
            "side": key[0],
            "component": key[1],
            "term": own["term"].to_numpy(),
            "level": own["level"].to_numpy(),
            "value": value + move,
            "precision": prec,
            "change": size,
        }
    )


def newton_fit(
    design: DataFrame,
    cells: DataFrame,
    tol: float = 1e-6,
    max_steps: int = 25,
    precision=prior_precision,
) -> DataFrame:
    """Penalised fit of every additive candidate, with a ``converged`` flag.

    All candidates advance in one job per step; the state, one row per
    parameter, is staged after each step.
    """
    from twofold.sources.tables import stage

    table = stage(patterns(design, cells), "patterns")
    state = stage(initial_state(design, precision), "newton")
    for _ in range(max_steps):
        moved = stage(newton_step(table, state), "newton")
        state = moved.drop("change")
        if moved.agg(F.max("change")).first()[0] < tol:
            break
    return moved.withColumn("converged", F.col("change") < F.lit(tol)).drop("change")
