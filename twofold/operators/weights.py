"""Model weights: pseudo-BMA, its Bayesian-bootstrap version, and stacking.

Input everywhere is a long score table ``points``: one row per (model, class)
with ``elpd`` and the number of trials ``copies`` in the class. Trial-level
scores are the case ``copies = 1``.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twofold.functions import rand
from twofold.operators.scores import CLASS
from twofold.sources.tables import stage

# Weight that no model falls below, models of a Newton step, and tasks whose vectors the driver adds by itself.
LEAST_WEIGHT = 1e-12
MOST_ACTIVE = 64
POWERS = (1, 64)
FEW_PARTS = 32
# Replicates of a bootstrap block.
BLOCK = 96


def pseudo_bma(points: DataFrame) -> DataFrame:
    """Softmax over models of the total score."""
    totals = points.groupBy("model_name").agg(F.sum(F.col("copies") * F.col("elpd")).alias("elpd_total"))
    everything = Window.partitionBy(F.lit(1))
    totals = totals.withColumn("top", F.max("elpd_total").over(everything))
    z = F.col("elpd_total") - F.col("top")
    ln_total = F.ln(F.sum(F.exp(z)).over(everything))
    return totals.withColumn("log_weight", z - ln_total).select(
        "model_name", "elpd_total", "log_weight", F.exp("log_weight").alias("weight")
    )


def bootstrap_masses(points: DataFrame, replicates: int, seed: int, first: int = 1) -> DataFrame:
    """Unnormalised Dirichlet weight of every class in every replicate.

    A class of m trials gets a Gamma(m) variate, which is the sum of the m unit
    exponentials its trials would get one by one.
    """
    classes = points.select(*CLASS, "copies").distinct()
    numbers = F.explode(F.sequence(F.lit(first), F.lit(first + replicates - 1)))
    k = rand.key("dirichlet", seed, *[F.col(c) for c in CLASS], F.col("replicate"))
    return rand.with_gamma(classes.withColumn("replicate", numbers), "mass", k, F.col("copies"))


def bootstrap_scores(points: DataFrame, masses: DataFrame) -> DataFrame:
    """Score of each model in each replicate: N times the weighted mean.

    The product of scores and replicates is summed on the map side, so the
    shuffle carries one row per (replicate, model) and task.
    """
    size = masses.groupBy("replicate").agg(
        F.sum("mass").alias("total_mass"), F.sum("copies").alias("n_trials")
    )
    sums = (
        points.select("model_name", *CLASS, "elpd")
        .join(masses.select(*CLASS, "replicate", "mass"), list(CLASS))
        .groupBy("replicate", "model_name")
        .agg(F.sum(F.col("mass") * F.col("elpd")).alias("weighted"))
    )
    return sums.join(size, "replicate").select(
        "replicate",
        "model_name",
        (F.col("n_trials") * F.col("weighted") / F.col("total_mass")).alias("z"),
    )


def replicate_weights(scores: DataFrame) -> DataFrame:
    by_rep = Window.partitionBy("replicate")
    with_top = scores.withColumn("top", F.max("z").over(by_rep))
    part = F.exp(F.col("z") - F.col("top"))
    return with_top.withColumn("weight", part / F.sum(part).over(by_rep)).drop("top")


def class_masses(cell_id: int, cnt: int, copies: float, first: int, last: int, seed: int, attempts: int = 12) -> np.ndarray:
    """Masses of one class in replicates first to last, those of ``bootstrap_masses``."""
    d = copies - 1 / 3
    out = np.full(last - first + 1, d)
    left = np.arange(len(out))
    for attempt in range(1, attempts + 1):
        keys = (f"dirichlet|{seed}|{cell_id}|{cnt}|{first + r}|{attempt}" for r in left.tolist())
        raw = np.frombuffer(b"".join(hashlib.md5(k.encode()).digest() for k in keys), ">u4").reshape(-1, 4)
        u = (raw[:, :3].astype(float) + 0.5) / 2.0**32
        x = np.sqrt(-2 * np.log(u[:, 0])) * np.cos(2 * np.pi * u[:, 1])
        v = (1 + x / np.sqrt(9 * d)) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (v > 0) & (np.log(u[:, 2]) < 0.5 * x * x + d - d * v + d * np.log(v))
        out[left[good]] = d * v[good]
        left = left[~good]
        if not len(left):
            break
    return out


def bootstrap_weights(points: DataFrame, replicates: int = 2880, seed: int = 1234) -> DataFrame:
    """(replicate, model_name, z, weight) of every replicate, as a product of matrices.

    A class is one row with all models' scores. The task that holds it makes its
    masses for a block of replicates and adds masses times scores, so no row is
    made per class, model and replicate; a task returns one matrix per block, and
    a block's matrices are added and turned into weights by one task each.
    """
    names = sorted(r[0] for r in points.select("model_name").distinct().collect())
    rows = points.groupBy(*CLASS).agg(
        F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("model_name", "elpd"))).alias("models")
    )
    packed = stage(rows.select(*CLASS, "copies", F.col("models.elpd").alias("scores")), "scores")
    blocks = [(i, min(i + BLOCK, replicates + 1) - 1) for i in range(1, replicates + 1, BLOCK)]
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), packed.rdd.getNumPartitions())

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            scores, copies = np.stack(pdf["scores"].to_numpy()), pdf["copies"].to_numpy(float)
            table = np.c_[scores, np.ones(len(pdf))]
            for k, (first, last) in enumerate(blocks):
                mass = np.stack([class_masses(c, n, m, first, last, seed) for c, n, m in zip(pdf["cell_id"], pdf["cnt"], copies)])
                sums[k] = sums.get(k, 0.0) + np.c_[mass.T @ table, np.full(last - first + 1, copies.sum())]
        yield pd.DataFrame({"block": list(sums), "part": [v.tobytes() for v in sums.values()]})

    def finish(key, pdf):
        first, last = blocks[int(key[0])]
        total = sum(map(np.frombuffer, pdf["part"])).reshape(last - first + 1, -1)
        z = total[:, :-2] / total[:, -2:-1] * total[:, -1:]
        w = np.exp(z - z.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        who = np.arange(first, last + 1)
        return pd.DataFrame({"replicate": np.repeat(who, len(names)), "model_name": names * len(who), "z": z.ravel(), "weight": w.ravel()})

    parts = packed.repartition(tasks, *CLASS).mapInPandas(run, "block int, part binary")
    return parts.groupBy("block").applyInPandas(finish, "replicate int, model_name string, z double, weight double")


def pseudo_bma_bootstrap(points: DataFrame, replicates: int = 2880, seed: int = 1234) -> DataFrame:
    """Pseudo-BMA+ weights: mean over Bayesian-bootstrap replicates of the softmax."""
    return bootstrap_weights(points, replicates, seed).groupBy("model_name").agg(F.avg("weight").alias("weight"))


def worker_averages(per_replicate: DataFrame, workers: int) -> DataFrame:
    """Mean weight within each worker's share of the replicates, and the mean of
    those means. Shares of equal size give the plain average."""
    share = per_replicate.withColumn("worker", F.pmod(F.col("replicate"), F.lit(workers)))
    means = share.groupBy("worker", "model_name").agg(F.avg("weight").alias("weight"))
    return means.groupBy("model_name").agg(
        F.avg("weight").alias("weight"), F.count(F.lit(1)).alias("n_workers")
    )


def cutoff(weights: DataFrame, log10_min: float = -100.0) -> DataFrame:
    """Keep models above a log10 weight; uses the log weight where there is one,
    as the weight itself may underflow."""
    if "log_weight" in weights.columns:
        return weights.where(F.col("log_weight") / F.lit(math.log(10.0)) > F.lit(log10_min))
    return weights.where(F.log10("weight") > F.lit(log10_min))


def balanced_chunks(weights: DataFrame, chunks: int = 4) -> DataFrame:
    """Deal models to chunks in order of weight, so each gets good and bad ones.

    Weights are compared by their logs to six digits, equal ones go by name: the
    order does not hang on rounding, nor on weights too small to tell from zero.
    """
    log_weight = F.col("log_weight") if "log_weight" in weights.columns else F.ln("weight")
    order = Window.partitionBy(F.lit(1)).orderBy(F.round(log_weight, 6).desc_nulls_last(), "model_name")
    return weights.withColumn(
        "chunk", F.pmod(F.row_number().over(order), F.lit(chunks)) + F.lit(1)
    )


def chunk_lists(chunked: DataFrame, seed: int = 1234) -> DataFrame:
    """Model list and random seed of each chunk."""
    return (
        chunked.groupBy("chunk")
        .agg(F.sort_array(F.collect_list("model_name")).alias("models"))
        .withColumn("seed", rand.seed32(rand.key("chunk", seed, F.col("chunk")), 65536))
    )


# Stacking ------------------------------------------------------------------


def densities(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Predictive densities scaled by each class's best model.

    The scale cancels in the gradient and is added back in the objective, and
    it keeps very small densities from underflowing. Rows stay partitioned by
    class, which later passes reuse. ``keys`` adds grouping columns (chunk).
    """
    per_class = Window.partitionBy(*CLASS, *keys)
    return points.withColumn("best", F.max("elpd").over(per_class)).withColumn(
        "density", F.exp(F.col("elpd") - F.col("best"))
    )


def uniform_weights(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    models = points.select("model_name", *keys).distinct()
    size = F.count(F.lit(1)).over(Window.partitionBy(*(keys or (F.lit(1),))))
    return models.withColumn("weight", F.lit(1.0) / size)


def mixture(dens: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean density of each class, next to every model's own density."""
    per_class = Window.partitionBy(*CLASS, *keys)
    joined = dens.join(weights.select("model_name", *keys, "weight"), ["model_name", *keys])
    return joined.withColumn("mix", F.sum(F.col("weight") * F.col("density")).over(per_class))


def objective(dens: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Negative log score of a weighting; one row (per chunk)."""
    per_class = (
        dens.join(weights.select("model_name", *keys, "weight"), ["model_name", *keys])
        .groupBy(*CLASS, *keys, "copies", "best")
        .agg(F.sum(F.col("weight") * F.col("density")).alias("mix"))
    )
    return per_class.groupBy(*keys).agg(
        F.sum(-F.col("copies") * (F.ln("mix") + F.col("best"))).alias("neg_log_score"),
        F.sum("copies").alias("n_trials"),
    )


def gradient(dens: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean over trials of a model's density relative to the mixture.

    At the optimum it is 1 for models with weight and at most 1 for the rest.
    """
    mixed = mixture(dens, weights, keys)
    return mixed.groupBy("model_name", *keys, "weight").agg(
        (F.sum(F.col("copies") * F.col("density") / F.col("mix")) / F.sum("copies")).alias("gradient")
    )


def em_step(dens: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One multiplicative step towards the stacking optimum; weights stay on the
    simplex and the log score never falls."""
    return gradient(dens, weights, keys).select(
        "model_name", *keys, (F.col("weight") * F.col("gradient")).alias("weight")
    )


def em_steps(points: DataFrame, steps: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """A fixed number of steps from equal weights, as one lazy plan."""
    dens = densities(points, keys)
    weights = uniform_weights(points, keys)
    for _ in range(steps):
        weights = em_step(dens, weights, keys)
    return weights


def _packed(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per class (and group): copies and the scaled densities of all models, in order of name.

    An array is as long as there are models, whatever the number of trials.
    """
    group = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    rows = points.withColumn("group", group).groupBy(*CLASS, "group").agg(
        F.max("copies").alias("copies"),
        F.max("elpd").alias("best"),
        F.sort_array(F.collect_list(F.struct("model_name", "elpd"))).alias("models"),
    )
    density = F.transform("models", lambda m: F.exp(m["elpd"] - F.col("best")))
    one = F.array(F.lit(1.0))
    return stage(rows.select("group", "copies", density.alias("first"), one.alias("second")), "packed")


def _class_sums(first, second, copies, models, trials, active) -> np.ndarray:
    """What one batch of classes adds to a pass, as one vector.

    A model is a pair of places in ``first`` and ``second``, its density their
    product. For each weighting in ``trials``: log score, slope of every model,
    and the product matrix of the active ones.
    """
    i, j = models
    some = first[:, i[active]] * second[:, j[active]]
    out = []
    for w in trials:
        spread = np.zeros((first.shape[1], second.shape[1]))
        np.add.at(spread, (i, j), w)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            mix = ((first @ spread) * second).sum(1)
            r = copies / mix
            slopes = ((first * r[:, None]).T @ second)[i, j]
            product = (some * (r / mix)[:, None]).T @ some
            out += [[copies @ np.log(mix)], slopes, product.ravel()]
    return np.concatenate(out)


@dataclass
class _Pass:
    """Mean log score, slopes and product matrix of one weighting of one group."""

    weights: np.ndarray
    score: float
    slopes: np.ndarray
    active: np.ndarray
    product: np.ndarray


def _passes(packed: DataFrame, models: dict, trials: dict, active: dict, size: dict) -> dict[str, list[_Pass]]:
    """One job: every trial weighting of every group, over all classes."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for g, rows in pdf.groupby("group"):
                if g in trials:
                    first, second = np.stack(rows["first"].to_numpy()), np.stack(rows["second"].to_numpy())
                    part = _class_sums(first, second, rows["copies"].to_numpy(float), models[g], trials[g], active[g])
                    sums[g] = sums[g] + part if g in sums else part
        yield pd.DataFrame({"group": list(sums), "part": [v.tobytes() for v in sums.values()]})

    def add(pdf):
        return pd.DataFrame({"group": pdf["group"][:1], "part": [sum(map(np.frombuffer, pdf["part"])).tobytes()]})

    schema = "group string, part binary"
    parts = packed.mapInPandas(run, schema)
    if packed.rdd.getNumPartitions() > FEW_PARTS:  # then tasks' vectors meet in parts first
        part = F.pmod(F.spark_partition_id(), F.lit(FEW_PARTS))
        parts = parts.withColumn("at", part).groupBy("group", "at").applyInPandas(add, schema)
    total: dict[str, np.ndarray] = {}
    for r in parts.collect():
        total[r["group"]] = total.get(r["group"], 0.0) + np.frombuffer(r["part"])
    out = {}
    for g, v in total.items():
        k, a = len(models[g][0]), len(active[g])
        rows = v.reshape(len(trials[g]), -1) / size[g]
        out[g] = [_Pass(w, float(r[0]), r[1 : 1 + k], active[g], r[1 + k :].reshape(a, a)) for w, r in zip(trials[g], rows)]
    return out


def _active(weights: np.ndarray, slopes: np.ndarray | None) -> np.ndarray:
    """Models that a Newton step moves: those of most weight, or that most raise the score; at most ``MOST_ACTIVE``."""
    if slopes is None:
        return np.arange(len(weights))[:MOST_ACTIVE]
    gain = np.where(weights > 1e-9, weights, 0.0) + np.maximum(slopes - 1, 0)
    order = np.argsort(-gain, kind="stable")[:MOST_ACTIVE]
    return np.sort(order[gain[order] > 0])


def _newton_weights(at: _Pass) -> np.ndarray:
    """Weights of best second-order score over the simplex, those that are not active kept.

    Active-set steps: the best move along the free weights, cut where the first
    one reaches zero; weights at zero that would still raise the score are freed.
    """
    x, g, h = at.weights[at.active], at.slopes[at.active], at.product
    if not len(x) or x.sum() <= 0:
        return at.weights
    h = h + np.eye(len(x)) * 1e-12 * max(np.trace(h) / len(x), 1e-300)
    v, free = x.copy(), (x > 0) | (g > 1)
    for _ in range(6 * len(x) + 20):
        f = np.flatnonzero(free)
        slope = g - h @ (v - x)
        system = np.block([[h[np.ix_(f, f)], np.ones((len(f), 1))], [np.ones((1, len(f))), np.zeros((1, 1))]])
        try:
            move = np.linalg.solve(system, np.r_[slope[f], 0.0])
        except np.linalg.LinAlgError:
            move = np.linalg.lstsq(system, np.r_[slope[f], 0.0], rcond=None)[0]
        d, level = move[:-1], move[-1]
        falls = d < -1e-15
        room = np.where(falls, v[f] / np.where(falls, -d, 1.0), np.inf)
        if room.min(initial=np.inf) < 1:
            k = int(room.argmin())
            v[f] += room[k] * d
            v[f[k]], free[f[k]] = 0.0, False
            continue
        v[f] += d
        slope = g - h @ (v - x)
        rising = ~free & (slope > level + 1e-12)
        if not rising.any():
            break
        free[np.where(rising, slope, -np.inf).argmax()] = True
    out = at.weights.copy()
    out[at.active] = np.maximum(v, 0.0)
    return out


def _next_trials(at: _Pass) -> list[np.ndarray]:
    """Weightings to try from here: the same, whose product matrix then covers the models that matter now, the
    multiplicative step, which never lowers the score, a longer one, and Newton steps."""
    newton = _newton_weights(at)
    out = [at.weights] + [at.weights * (at.slopes / at.slopes.max()) ** p for p in POWERS]
    alone = np.zeros(len(newton))
    alone[at.active] = newton[at.active]  # without the weight of models that are not active
    out += [newton, alone, at.weights + 0.25 * (newton - at.weights)]
    kept = [np.maximum(w / w.sum(), LEAST_WEIGHT) for w in out if np.isfinite(w).all() and w.sum() > 0]
    return [w / w.sum() for w in kept]


def _better(found: list[_Pass]) -> _Pass:
    """The trial of best score, and of those that equal it but for rounding the one of least slope."""
    pool = [p for p in found if np.isfinite(p.score) and np.isfinite(p.slopes).all()]
    best = max(p.score for p in pool)
    return min((p for p in pool if p.score >= best - 1e-10 * (1 + abs(best))), key=lambda p: p.slopes.max())


def _stack_packed(packed: DataFrame, models: dict[str, tuple[np.ndarray, np.ndarray]], tol: float, max_steps: int) -> dict[str, _Pass]:
    """Best weighting found for every group."""
    size = {r["group"]: r["n"] for r in packed.groupBy("group").agg(F.sum("copies").alias("n")).collect()}
    start = {g: [np.full(len(i), 1.0 / len(i))] for g, (i, _) in models.items()}
    active = {g: _active(w[0], None) for g, w in start.items()}
    state = {g: _better(p) for g, p in _passes(packed, models, start, active, size).items()}
    for _ in range(max_steps):
        moving = [g for g, p in state.items() if p.slopes.max() > 1 + tol]
        if not moving:
            break
        trials = {g: _next_trials(state[g]) for g in moving}
        active = {g: _active(state[g].weights, state[g].slopes) for g in moving}
        for g, found in _passes(packed, models, trials, active, size).items():
            state[g] = _better(found)
    return state


def stack(
    points: DataFrame,
    keys: tuple[str, ...] = (),
    tol: float = 1e-4,
    max_steps: int = 200,
) -> DataFrame:
    """Stacking weights: the simplex point with the best log score.

    Columns: model_name, keys, weight, gradient, converged. A step tries several
    weightings in one pass over the classes (the multiplicative step, which never
    lowers the score, longer ones, and Newton steps on the models that matter) and
    keeps the best, so the score never falls. A group is done when no model's
    gradient exceeds 1 + tol, which bounds the loss of score per trial by tol; a
    group that is not done after ``max_steps`` is marked as not converged. Weights
    are kept above ``LEAST_WEIGHT``, so that a model can come back.

    Classes are packed once, a row each with all models' densities; a pass returns
    one vector per group and task. With ``keys`` (chunk) every group is stacked in
    the same passes.
    """
    spark = points.sparkSession
    named = points.select("model_name", *keys).distinct()
    members: dict[str, list[tuple]] = {}
    for r in sorted(tuple(r) for r in named.collect()):
        members.setdefault("|".join(map(str, r[1:])), []).append(r)
    if not members:
        raise ValueError("stacking needs a model")
    models = {g: (np.arange(len(m)), np.zeros(len(m), int)) for g, m in members.items()}
    state = _stack_packed(_packed(points, keys), models, tol, max_steps)
    rows = [
        (*m, float(w), float(d), bool(state[g].slopes.max() <= 1 + tol))
        for g, ms in members.items()
        for m, w, d in zip(ms, state[g].weights, state[g].slopes)
    ]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    return spark.createDataFrame(rows, f"{schema}, weight double, gradient double, converged boolean")


def stack_pairs(halves: DataFrame, pairs: DataFrame, tol: float = 1e-4, max_steps: int = 200) -> DataFrame:
    """Stacking weights of two-part models from the scores of their halves.

    ``halves`` has (side, cell_id, cnt, copies, elpd_count, elpd_zero), ``pairs``
    (model_name, count_side, hurdle_side). A pair's density is the product of two
    halves, so a class holds one number per half, not per pair: 134 for 4,489
    pairs. Columns and steps are those of ``stack``.
    """
    spark = halves.sparkSession
    sides = sorted(r[0] for r in halves.select("side").distinct().collect())
    place = {s: k for k, s in enumerate(sides)}
    named = sorted(tuple(r) for r in pairs.select("model_name", "count_side", "hurdle_side").distinct().collect())
    if not named:
        raise ValueError("stacking needs a model")
    models = {"": tuple(np.array([place[r[c]] for r in named]) for c in (1, 2))}
    both = F.sort_array(F.collect_list(F.struct("side", "elpd_count", "elpd_zero")))
    rows = halves.groupBy(*CLASS).agg(
        F.max("copies").alias("copies"), both.alias("sides"), F.max("elpd_count").alias("top"), F.max("elpd_zero").alias("top_zero")
    )
    first = F.transform("sides", lambda s: F.exp(s["elpd_count"] - F.col("top")))
    second = F.transform("sides", lambda s: F.exp(s["elpd_zero"] - F.col("top_zero")))
    packed = stage(rows.select(F.lit("").alias("group"), "copies", first.alias("first"), second.alias("second")), "packed")
    found = _stack_packed(packed, models, tol, max_steps)[""]
    done = bool(found.slopes.max() <= 1 + tol)
    out = [(n, float(w), float(d), done) for (n, *_), w, d in zip(named, found.weights, found.slopes)]
    return spark.createDataFrame(out, "model_name string, weight double, gradient double, converged boolean")


def first_pass(points: DataFrame, chunked: DataFrame, **options) -> DataFrame:
    """Stacking inside every chunk of models, all chunks in the same jobs."""
    inside = points.join(chunked.select("model_name", "chunk"), "model_name")
    return stack(inside, ("chunk",), **options)


def survivors(settings: DataFrame, chunk_weights: DataFrame, min_weight: float = 1e-6) -> DataFrame:
    """Settings of the models that got weight in their chunk; less than ``min_weight`` counts as none."""
    joined = settings.join(chunk_weights.select("model_name", "weight"), "model_name", "left")
    return joined.where(F.col("weight") > F.lit(min_weight))


def ranked(weights: DataFrame, settings: DataFrame) -> DataFrame:
    """Weight table with settings, best first."""
    return weights.join(settings, "model_name", "left").orderBy(F.desc("weight"), "model_name")


def final_stacking(points: DataFrame, settings: DataFrame, **options) -> DataFrame:
    """Stacking over the surviving models, joined to their settings and ranked."""
    kept = points.join(settings.select("model_name"), "model_name", "left_semi")
    return ranked(stack(kept, **options), settings)


def readable(weights: DataFrame) -> DataFrame:
    """One column per part: formulas cut at `` ~ `` and spread by response."""
    parts = weights.select(
        "model_name", "weight", F.explode(F.array("count_formula", "hurdle_formula")).alias("formula")
    )
    cut = parts.select(
        "model_name",
        "weight",
        F.split_part("formula", F.lit(" ~ "), F.lit(1)).alias("response"),
        F.split_part("formula", F.lit(" ~ "), F.lit(2)).alias("terms"),
    )
    return cut.groupBy("model_name", "weight").pivot("response", ["cnt", "hu"]).agg(F.first("terms"))


def term_weights(weights: DataFrame) -> DataFrame:
    """Summed weight of the models that hold each term, per part."""

    def one(terms: str, name: str) -> DataFrame:
        return (
            weights.select("weight", F.explode(terms).alias("term"))
            .groupBy("term")
            .agg(F.sum("weight").alias(name))
        )

    return one("count_terms", "count_weight").join(one("hurdle_terms", "hurdle_weight"), "term", "full")


def scaled(weights: DataFrame) -> DataFrame:
    """Weights relative to the best model."""
    top = F.max("weight").over(Window.partitionBy(F.lit(1)))
    return weights.withColumn("scaled", F.col("weight") / top)
