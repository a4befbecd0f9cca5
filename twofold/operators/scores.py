"""Pointwise leave-one-out predictive scores on classes of equal trials."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twofold.functions.links import (
    count_log_density,
    hurdle_log_density,
    logit,
    positive_mean,
    truncated_rate,
)
from twofold.operators.fit import estimates, form_groups, pooling, zero_chance
from twofold.operators.joins import salted_join
from twofold.operators.trials import CELL_KEYS
from twofold.rules import FORMS, Form

CLASS = ("cell_id", "cnt")


def class_groups(classes: DataFrame, forms: tuple[Form, ...] = FORMS) -> DataFrame:
    """The group each class belongs to, under each form."""
    return classes.select(*CLASS, "copies", F.inline(form_groups(forms, roles=("fixed", "random"))))


def loo_scores(groups: DataFrame, stats: DataFrame) -> DataFrame:
    """Score of one trial when its group is refitted without it, in closed form.

    Evaluated once per distinct (group, count). Random groups are refitted
    around the parent estimate and with the variance of the full fit.
    """
    pooled = pooling(estimates(stats))
    hyper = pooled.groupBy("form", "parent").agg(
        F.max(F.when(F.col("component") == "prop", F.col("center"))).alias("center_prop"),
        F.max(F.when(F.col("component") == "count", F.col("center"))).alias("center_count"),
        F.max(F.when(F.col("component") == "prop", F.col("tau2"))).alias("tau2_prop"),
        F.max(F.when(F.col("component") == "count", F.col("tau2"))).alias("tau2_count"),
    )
    y = F.col("cnt")
    hit = F.when(y > 0, F.lit(1)).otherwise(F.lit(0))
    left = (
        groups.select("form", "role", "parent", "level", "cnt")
        .distinct()
        .join(stats.where(F.col("role") != "parent"), ["form", "role", "parent", "level"])
        .withColumn("n", F.col("n") - 1)
        .withColumn("n_zero", F.col("n_zero") - (F.lit(1) - hit))
        .withColumn("n_pos", F.col("n_pos") - hit)
        .withColumn("sum_y", F.col("sum_y") - y)
        .join(hyper, ["form", "parent"], "left")
        .withColumn("p0", zero_chance(F.col("n"), F.col("n_zero")))
        .withColumn("mu", positive_mean(F.col("n_pos"), F.col("sum_y")))
        .withColumn("rate", truncated_rate(F.col("mu")))
    )

    def shrink(est: Column, info: Column, name: str) -> Column:
        t, c = F.col(f"tau2_{name}"), F.col(f"center_{name}")
        return F.when(c.isNull(), est).otherwise(c + t * info / (F.lit(1.0) + t * info) * (est - c))

    p0, mu, rate = F.col("p0"), F.col("mu"), F.col("rate")
    zero = shrink(logit(p0), F.col("n") * p0 * (F.lit(1.0) - p0), "prop")
    log_rate = shrink(
        F.ln(rate),
        F.greatest(F.col("n_pos").cast("double"), F.lit(0.5)) * mu * (F.lit(1.0) + rate - mu),
        "count",
    )
    scored = left.withColumn("eta_zero", zero).withColumn("eta_count", log_rate)
    return scored.select(
        "form",
        "role",
        "parent",
        "level",
        "cnt",
        F.when(y == 0, -F.log1p(F.exp(-F.col("eta_zero"))))
        .otherwise(-F.log1p(F.exp(F.col("eta_zero"))))
        .alias("elpd_zero"),
        F.when(y == 0, F.lit(0.0)).otherwise(count_log_density(y, F.col("eta_count"))).alias("elpd_count"),
    )


def half_scores(classes: DataFrame, stats: DataFrame, forms: tuple[Form, ...] = FORMS) -> DataFrame:
    """Zero-part and count-part score of every class under every form."""
    groups = class_groups(classes, forms)
    return groups.join(
        loo_scores(groups, stats), ["form", "role", "parent", "level", "cnt"]
    ).select(*CLASS, "copies", "form", "elpd_zero", "elpd_count")


def pointwise(candidates: DataFrame, halves: DataFrame) -> DataFrame:
    """Score of every class under every two-part candidate.

    The two parts factorise, so the score is the sum of two half scores.
    """
    count = halves.select(F.col("form").alias("count_form"), *CLASS, "copies", "elpd_count")
    zero = halves.select(F.col("form").alias("hurdle_form"), *CLASS, "elpd_zero")
    return (
        candidates.select("model_name", "count_form", "hurdle_form")
        .join(count, "count_form")
        .join(zero, ["hurdle_form", *CLASS])
        .select("model_name", *CLASS, "copies", (F.col("elpd_count") + F.col("elpd_zero")).alias("elpd"))
    )


def trial_scores(trials: DataFrame, cells: DataFrame, points: DataFrame) -> DataFrame:
    """Model-by-trial table in long form: each trial takes its class's score.

    One class (say, the zeros of a large cell) may hold a third of the trials,
    so both joins cut their keys into parts.
    """
    homes = cells.select(*CELL_KEYS, "cell_id")
    located = salted_join(trials, homes, list(CELL_KEYS), spread="trial_id").select("trial_id", *CLASS)
    scored = points.select("model_name", *CLASS, "elpd")
    return salted_join(located, scored, list(CLASS), spread="trial_id").select(
        "model_name", "trial_id", "elpd"
    )


# Scores from draws ---------------------------------------------------------


def draw_log_density(classes: DataFrame, predictors: DataFrame) -> DataFrame:
    """Log density of each class under each draw.

    ``classes`` has ``model_name, group, cnt, copies`` (classes that the model
    cannot tell apart); ``predictors`` has ``model_name, group, draw, zero_logit,
    log_rate``.
    """
    return classes.join(predictors, ["model_name", "group"]).select(
        "model_name",
        "group",
        "cnt",
        "copies",
        "draw",
        hurdle_log_density(F.col("cnt"), F.col("zero_logit"), F.col("log_rate")).alias("log_lik"),
    )


def importance_loo(log_lik: DataFrame, keys: tuple[str, ...] = ("model_name", "group", "cnt")) -> DataFrame:
    """Leave-one-out score -ln mean exp(-log_lik), with the largest ratio factored out.

    A class has one row per draw, so the window holds a model's draws at most.
    """
    w = Window.partitionBy(*keys)
    ratio = -F.col("log_lik")
    shifted = log_lik.withColumn("top", F.max(ratio).over(w))
    return shifted.groupBy(*keys, "copies", "top").agg(
        F.avg(F.exp(ratio - F.col("top"))).alias("mean_ratio")
    ).select(*keys, "copies", (-(F.col("top") + F.ln("mean_ratio"))).alias("elpd"))


def smoothed_loo(log_lik: DataFrame, keys: tuple[str, ...] = ("model_name", "group", "cnt")) -> DataFrame:
    """Leave-one-out score with the largest ratios replaced by quantiles of a
    fitted generalised Pareto tail, and the tail's shape ``pareto_k``.

    Each row carries the ratios of one class: one number per draw of one model.
    """
    @F.pandas_udf("elpd double, pareto_k double")
    def smooth(lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_smooth_ratios(v) for v in lists], columns=["elpd", "pareto_k"])

    packed = log_lik.groupBy(*keys, "copies").agg(F.collect_list(-F.col("log_lik")).alias("ratios"))
    return packed.withColumn("fit", smooth("ratios")).select(*keys, "copies", "fit.elpd", "fit.pareto_k")


def _smooth_ratios(ratios):
    import numpy as np

    r = np.sort(np.asarray(ratios, dtype=float))
    s = len(r)
    top = r[-1]
    w = np.exp(r - top)
    tail = int(np.ceil(min(0.2 * s, 3.0 * np.sqrt(s))))
    shape = float("nan")
    if tail >= 5 and w[-1] > w[-tail] * (1 + 1e-12):
        cut = w[-tail - 1] if s > tail else 0.0
        shape, scale = _fit_tail(w[-tail:] - cut)
        if np.isfinite(shape):
            p = (np.arange(1, tail + 1) - 0.5) / tail
            grown = -np.log1p(-p) if abs(shape) < 1e-12 else np.expm1(-shape * np.log1p(-p)) / shape
            w[-tail:] = np.minimum(cut + scale * grown, 1.0)
    # The ratios weight the densities, which are the inverse of the raw ratios.
    elpd = np.log((w * np.exp(top - r)).sum()) - np.log(w.sum()) - top
    return elpd, (shape if np.isfinite(shape) else None)


def _fit_tail(x):
    """Shape and scale of a generalised Pareto tail by the profile-posterior
    estimate of Zhang and Stephens (2009)."""
    import numpy as np

    x = np.sort(x)
    n = len(x)
    if x[-1] <= 0 or x[0] < 0:
        return float("nan"), float("nan")
    m = 30 + int(np.sqrt(n))
    quarter = x[max(int(n / 4 + 0.5) - 1, 0)]
    if quarter <= 0:
        return float("nan"), float("nan")
    b = 1.0 / x[-1] + (1.0 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3.0 * quarter)
    k = np.log1p(-b[:, None] * x[None, :]).mean(axis=1)
    profile = n * (np.log(-b / k) - k - 1.0)
    with np.errstate(over="ignore"):  # a hopeless value gets weight 1 / inf = 0
        weight = 1.0 / np.exp(profile[None, :] - profile[:, None]).sum(axis=1)
    best = float((b * weight).sum())
    shape = float(np.log1p(-best * x).mean())
    scale = -shape / best
    # Weak prior towards 1/2, worth ten tail values.
    return (n * shape + 10 * 0.5) / (n + 10.0), scale


def diagnostics(smoothed: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Trials per model whose score rests on too few draws."""
    bad = F.col("pareto_k") > threshold
    return smoothed.groupBy("model_name").agg(
        F.sum("copies").alias("n_trials"),
        F.sum(F.when(bad, F.col("copies")).otherwise(0)).alias("n_high_k"),
        F.max("pareto_k").alias("max_k"),
    )
