"""Additive candidates of the ensemble: fits, leave-one-out half scores, correlated draws.

A side is a right-hand side; a two-part model is a pair of sides. Everything is
done per side and component, of which there are few (67 sides make 4,489 models),
and from sufficient statistics: what one fit sees is one row per distinct set of
active parameters, bounded by the design's factor levels, not by the trials.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twofold.functions import rand
from twofold.functions.links import count_log_density
from twofold.operators.fit import STATS, patterns
from twofold.operators.modelspace import bad_combo, term_subsets
from twofold.operators.scores import CLASS
from twofold.rules import FIXED_SD, INTERACTION_RULES, INTERCEPT_SD, NESTING_RULES, RANDOM_SD, RANDOM_TERMS
from twofold.sources.tables import stage

MARK = "\u001f"
T_FREEDOM = 7.0
FITTED = (
    "side string, component string, term string, level string, place int, value double, precision double, "
    "factor array<double>, converged boolean"
)

Prior = Callable[[str, str, str], tuple[str, float]]


def study_prior(side: str, component: str, term: str) -> tuple[str, float]:
    """Kind and scale of a term's prior: normal on coefficients, half-t on the sd of random groups."""
    if term == "intercept":
        return "normal", INTERCEPT_SD
    return ("sd_t", RANDOM_SD[component]) if term in RANDOM_TERMS else ("normal", FIXED_SD[component])


def valid_sides(usable: DataFrame) -> DataFrame:
    """(side, terms, mask) of every right-hand side that obeys the structural rules."""
    valid = term_subsets(usable)
    for higher, required in NESTING_RULES + INTERACTION_RULES:
        valid = valid.where(~bad_combo(F.col("terms"), [higher], list(required)))
    return valid.select(F.col("mask").cast("string").alias("side"), "terms", "mask")


def group_variance(kind: str, scale: float, levels: int, squares: float) -> float:
    """Variance of a random term that raises its posterior most, given the expected sum of squared deviations.

    The mode is taken for the logarithm of the sd, so that no term collapses to zero.
    """
    q, s2 = levels - 1.0, scale * scale
    if kind == "sd_normal":
        return s2 / 2 * (np.sqrt(q * q + 4 * squares / s2) - q)
    a, b, c = q + T_FREEDOM + 1, T_FREEDOM * s2 * q - squares, -T_FREEDOM * s2 * squares
    return (np.sqrt(b * b - 4 * a * c) - b) / (2 * a)


def _slopes(component: str, eta: np.ndarray, stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Score and information of each pattern's linear predictor."""
    eta = np.clip(eta, -30, 30)
    if component == "prop":
        p0 = 1 / (1 + np.exp(-eta))
        return stats["n_zero"] - stats["n"] * p0, stats["n"] * p0 * (1 - p0)
    rate = np.exp(eta)
    mu = rate / -np.expm1(-rate)
    return stats["sum_y"] - stats["n_pos"] * mu, stats["n_pos"] * mu * (1 + rate - mu)


class SideFit:
    """Penalised fit of one side and component, with the variances of its random terms."""

    def __init__(self, names: list[str], active: np.ndarray, component: str, stats: dict, priors: list[tuple[str, float]], terms: list[str]):
        self.names, self.x, self.component, self.stats = names, active, component, stats
        self.value = np.zeros(len(names))
        self.precision = np.array([1 / s**2 for _, s in priors])
        self.random = {}
        for t in dict.fromkeys(t for t, (kind, _) in zip(terms, priors) if kind != "normal"):
            at = np.flatnonzero([u == t for u in terms])
            self.random[t] = (at, *priors[at[0]])

    def information(self) -> tuple[np.ndarray, np.ndarray]:
        score, weight = _slopes(self.component, self.x @ self.value, self.stats)
        h = (self.x * weight[:, None]).T @ self.x + np.diag(self.precision)
        return self.x.T @ score - self.precision * self.value, h

    def newton(self) -> float:
        """One step; no parameter moves by more than 2."""
        g, h = self.information()
        move = np.linalg.solve(h, g)
        size = float(np.abs(move).max(initial=0.0))
        self.value += move * min(1.0, 2.0 / size if size else 1.0)
        return size

    def at_mode(self, tol: float) -> None:
        for _ in range(100):
            if self.newton() < tol:
                return

    def update(self, logs: np.ndarray, tol: float) -> np.ndarray:
        """Log variances after fitting with the given ones and updating each term's."""
        for (at, *_), v in zip(self.random.values(), logs):
            self.precision[at] = np.exp(-v)
        self.at_mode(tol)
        spread = np.diag(np.linalg.inv(self.information()[1]))
        return np.array(
            [np.log(group_variance(kind, s, len(at), float((self.value[at] ** 2 + spread[at]).sum()))) for at, kind, s in self.random.values()]
        )

    def run(self, tol: float, max_steps: int) -> bool:
        """Alternate fits and variances, with extrapolated variances; true if both have settled."""
        logs = np.array([np.log(s * s) for _, _, s in self.random.values()])
        for _ in range(max_steps):
            one = self.update(logs, tol)
            two = self.update(one, tol)
            r, v = one - logs, (two - one) - (one - logs)
            if np.abs(two - one).max(initial=0.0) < tol * 10:
                # Values belong to the last variances that were set, ``one``.
                return self.newton() < tol * 10
            length = -np.sqrt((r @ r) / max(v @ v, 1e-300))
            length = min(max(length, -50.0), -1.0)
            logs = np.clip(logs - 2 * length * r + length * length * v, two - 3, two + 3)
        return False


def fit_sides(design: DataFrame, cells: DataFrame, prior: Prior = study_prior, tol: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """Fit of every side and component, all in one job.

    ``design`` has (side, cell_id, term, level), ``cells`` the sufficient
    statistics. One row per parameter: its place in the fit, value, prior precision
    (of a random term: one over its estimated variance), its row of the lower
    Cholesky factor of the inverse information, and whether the fit has settled.
    """

    def run(key, pdf):
        side, component = key
        names = sorted(set().union(*pdf["params"]))
        at = {n: i for i, n in enumerate(names)}
        x = np.zeros((len(pdf), len(names)))
        for row, params in enumerate(pdf["params"]):
            x[row, [at[p] for p in params]] = 1.0
        parts = [n.split(MARK, 1) for n in names]
        terms = [t for t, _ in parts]
        stats = {s: pdf[s].to_numpy(float) for s in STATS}
        one = SideFit(names, x, component, stats, [prior(side, component, t) for t in terms], terms)
        done = one.run(tol, max_steps)
        factor = np.linalg.cholesky(np.linalg.inv(one.information()[1]))
        return pd.DataFrame(
            {
                "side": side, "component": component, "term": terms, "level": [v for _, v in parts], "place": np.arange(len(names), dtype=np.int32),
                "value": one.value, "precision": one.precision, "factor": [f.tolist() for f in factor], "converged": done,
            }
        )

    table = patterns(design, cells, MARK)
    both = F.explode(F.array(F.lit("count"), F.lit("prop")))
    return table.withColumn("component", both).groupBy("side", "component").applyInPandas(run, FITTED)


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + of(v))


def cell_fits(design: DataFrame, fitted: DataFrame) -> DataFrame:
    """(side, component, cell_id, eta, spread): linear predictor of every cell and the variance of its estimate."""
    name = F.concat("term", F.lit(MARK), "level")
    entry = F.struct(name.alias("k"), F.struct("value", "factor").alias("v"))
    vectors = fitted.groupBy("side", "component").agg(
        F.map_from_entries(F.collect_list(entry)).alias("at"), F.max(F.size("factor")).alias("size")
    )
    active = design.groupBy("side", "cell_id").agg(F.collect_list(name).alias("params"))
    found = active.join(vectors, "side").withColumn("rows", F.transform("params", lambda p: F.element_at("at", p)))
    total = F.aggregate(
        "rows", F.array_repeat(F.lit(0.0), F.col("size")), lambda a, r: F.zip_with(a, r["factor"], lambda x, y: x + y)
    )
    return found.select(
        "side", "component", "cell_id", _sum(F.col("rows"), lambda r: r["value"]).alias("eta"), _sum(total, lambda x: x * x).alias("spread")
    )


def additive_half_scores(classes: DataFrame, fits: DataFrame) -> DataFrame:
    """(side, cell_id, cnt, copies, elpd_count, elpd_zero): leave-one-out score of each class's trials under each side.

    Leaving one trial out moves its linear predictor, to first order, by minus
    spread * score / (1 - spread * information), with the trial's own score and
    information; ``fits`` are the rows of ``cell_fits``.
    """
    wide = fits.groupBy("side", "cell_id").agg(
        *[F.max(F.when(F.col("component") == c, F.col(v))).alias(f"{v}_{c}") for c in ("prop", "count") for v in ("eta", "spread")]
    )
    y, zero = F.col("cnt"), F.col("cnt") == 0
    p0 = 1 / (1 + F.exp(-F.col("eta_prop")))
    rate = F.exp("eta_count")
    mu = rate / -F.expm1(-rate)

    def without(name: str, score: Column, info: Column) -> Column:
        spread = F.col(f"spread_{name}")
        return F.col(f"eta_{name}") - spread * score / (1 - spread * info)

    hit = F.when(zero, 1.0).otherwise(0.0)
    moved = classes.select(*CLASS, "copies").join(wide, "cell_id").select(
        "side",
        *CLASS,
        "copies",
        without("prop", hit - p0, p0 * (1 - p0)).alias("z"),
        without("count", y - mu, mu * (1 + rate - mu)).alias("c"),
    )
    z = F.col("z")
    return moved.select(
        "side",
        *CLASS,
        "copies",
        F.when(zero, 0.0).otherwise(count_log_density(y, F.col("c"))).alias("elpd_count"),
        F.when(zero, -F.log1p(F.exp(-z))).otherwise(-F.log1p(F.exp(z))).alias("elpd_zero"),
    )


def pair_optimality(halves: DataFrame, pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(model_name, weight, gradient) of every pair, computed anew from the weights by joins.

    At the best weights no gradient exceeds 1. Only pairs with a noticeable weight
    enter the mixture; sums over classes are partial before the shuffle.
    """
    count = halves.select(F.col("side").alias("count_side"), *CLASS, "copies", "elpd_count")
    zero = halves.select(F.col("side").alias("hurdle_side"), *CLASS, "elpd_zero")
    held = pairs.join(weights.where("weight > 1e-9").select("model_name", "weight"), "model_name")
    mixed = (
        held.join(count, "count_side")
        .join(zero, ["hurdle_side", *CLASS])
        .groupBy(*CLASS)
        .agg(F.max("copies").alias("copies"), F.sum(F.col("weight") * F.exp(F.col("elpd_count") + F.col("elpd_zero"))).alias("mix"))
    )
    total = mixed.agg(F.sum("copies").alias("n"))
    share = F.col("copies") / F.col("mix") * F.exp(F.col("elpd_count") + F.col("elpd_zero"))
    sums = (
        mixed.join(count.drop("copies"), list(CLASS))
        .join(zero, list(CLASS))
        .groupBy("count_side", "hurdle_side")
        .agg(F.sum(share).alias("total"))
        .join(total)
        .select("count_side", "hurdle_side", (F.col("total") / F.col("n")).alias("gradient"))
    )
    return pairs.join(sums, ["count_side", "hurdle_side"]).join(weights.select("model_name", "weight"), "model_name").select(
        "model_name", "weight", "gradient"
    )


def additive_draws(index: DataFrame, candidates: DataFrame, fitted: DataFrame, seed: int = 7) -> DataFrame:
    """Draws of every parameter of every chosen draw, correlated as the fit's information says.

    ``index`` has (draw_id, model_name, draw_in_model), ``candidates`` (model_name,
    count_side, hurdle_side). A draw and component has one standard normal per
    parameter, hashed from model, component, draw and place; a parameter's value is
    its estimate plus its row of the Cholesky factor times these.
    """
    parts = F.array(
        F.struct(F.lit("count").alias("component"), F.col("count_side").alias("side")),
        F.struct(F.lit("prop").alias("component"), F.col("hurdle_side").alias("side")),
    )
    sides = index.join(candidates.select("model_name", F.inline(parts)), "model_name")
    size = fitted.groupBy("side", "component").agg(F.max(F.size("factor")).alias("size"))
    places = F.sequence(F.lit(0), F.col("size") - 1)
    z = F.transform(
        places, lambda i: rand.normal(rand.key("additive", seed, F.col("model_name"), F.col("component"), F.col("draw_in_model"), i))
    )
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    normals = sides.join(size, ["side", "component"]).repartition(tasks, "model_name", "draw_in_model").withColumn("z", z)
    used = fitted.join(sides.select("side", "component").distinct(), ["side", "component"], "left_semi")
    rows = used.select("side", "component", "place", "value", "factor").collect()  # sides of drawn models, whatever the draws
    fits: dict = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        fits.setdefault((r["side"], r["component"]), []).append((r["value"], np.array(r["factor"])))
    arrays = {k: (np.array([v for v, _ in f]), np.stack([a for _, a in f])) for k, f in fits.items()}

    def move(batches):
        for pdf in batches:
            for key, part in pdf.groupby(["side", "component"]):
                at, factor = arrays[key]
                values = np.stack(part["z"].to_numpy()) @ factor.T + at
                yield part.drop(columns="z").assign(values=values.tolist())

    moved = normals.select("draw_id", "model_name", "component", "side", "z").mapInPandas(
        move, "draw_id long, model_name string, component string, side string, values array<double>"
    )
    kind = (
        F.when(F.col("term") == "intercept", "intercept")
        .when(F.col("term").isin(*RANDOM_TERMS), "random")
        .when(F.contains("term", F.lit(":")), "interaction")
        .otherwise("fixed")
    )
    named = fitted.select("side", "component", "place", "term", "level")
    each = moved.select("draw_id", "model_name", "component", "side", F.posexplode("values").alias("place", "value"))
    return each.join(named, ["side", "component", "place"]).select("draw_id", "model_name", "component", kind.alias("kind"), "term", "level", "value")
