import numpy as np
import pytest
from pyspark.sql import functions as F

from twofold.operators import additive, fit, weights
from twofold.operators.additive import SideFit, group_variance
from twofold.plans.ensemble import AdditiveStudy
from twofold.sources.tables import stage


@pytest.fixture(scope="module")
def study(spark, sf_dir):
    return AdditiveStudy(spark, sf_dir)


def test_variance_is_the_mode_of_its_log_sd():
    for kind in ("sd_t", "sd_normal"):
        for scale, levels, squares in ((1.0, 5, 0.3), (1.5, 25, 40.0), (0.25, 2, 1e-4)):
            sd = np.exp(np.linspace(-9, 4, 400_001))
            prior = -4 * np.log1p(sd**2 / (7 * scale**2)) if kind == "sd_t" else -(sd**2) / (2 * scale**2)
            extra = np.log(sd) if kind == "sd_t" else np.log(sd)
            best = sd[np.argmax(-levels * np.log(sd) - squares / (2 * sd**2) + prior + extra)]
            assert group_variance(kind, scale, levels, squares) == pytest.approx(best**2, rel=1e-3)


def test_one_factor_meets_both_conditions():
    """One random factor: a zero gradient, and the variance that its own deviations ask for."""
    rng = np.random.default_rng(4)
    n = rng.integers(20, 200, 8).astype(float)
    zero = rng.binomial(n.astype(int), 1 / (1 + np.exp(-rng.normal(0, 0.8, 8)))).astype(float)
    x = np.c_[np.ones(8), np.eye(8)]
    terms = ["intercept"] + ["(1|block)"] * 8
    one = SideFit(terms, x, "prop", {"n": n, "n_zero": zero}, [additive.study_prior("s", "prop", t) for t in terms], terms)
    assert one.run(1e-9, 60)
    g, h = one.information()
    assert np.abs(g).max() < 1e-6
    at, spread = np.arange(1, 9), np.diag(np.linalg.inv(h))
    assert 1 / one.precision[1] == pytest.approx(group_variance("sd_t", 1.0, 8, float((one.value[at] ** 2 + spread[at]).sum())), rel=1e-6)
    assert 0.05 < 1 / one.precision[1] < 3


def test_all_sides_settle_at_a_zero_gradient(study):
    assert study.fitted.where("not converged").count() == 0
    swept = fit.score_sweep(study.design_rows, study.cells, study.fitted.select("side", "component", "term", "level", "value", "precision"))
    assert swept.count() == study.fitted.count() > 0
    assert swept.agg(F.max(F.abs("gradient"))).first()[0] < 1e-5


def test_left_out_scores_are_close_to_refits(spark, study):
    """Leave a trial of a class out, fit again with the same variances, and score it."""
    sides = study.design_rows.where(F.col("side").isin("2", "10", "66"))
    fitted = stage(study.fitted.where(F.col("side").isin("2", "10", "66")), "some")
    got = {(r.side, r.cell_id, r.cnt): r for r in additive.additive_half_scores(study.classes, additive.cell_fits(sides, fitted)).collect()}
    cells = {r.cell_id: r for r in study.cells.collect()}
    active: dict = {}
    for r in sides.collect():
        active.setdefault((r.side, r.cell_id), []).append((r.term, r.level))
    classes = sorted((r.cell_id, r.cnt) for r in study.classes.collect())
    for side in ("2", "10", "66"):
        precision = {(r.component, r.term, r.level): r.precision for r in fitted.where(F.col("side") == side).collect()}
        names = sorted({k[1:] for k in precision})
        ids = sorted(c for s, c in active if s == side)
        x = np.array([[float(n in active[side, c]) for n in names] for c in ids])
        for cell, y in classes[:: len(classes) // 6]:
            for component in ("prop", "count"):
                if component == "count" and y == 0:
                    assert got[side, cell, y].elpd_count == 0
                    continue
                stats = {s: np.array([float(cells[c][s]) for c in ids]) for s in ("n", "n_zero", "n_pos", "sum_y")}
                at = ids.index(cell)
                for s, less in (("n", 1), ("n_zero", y == 0), ("n_pos", y > 0), ("sum_y", y)):
                    stats[s][at] -= less
                one = SideFit([str(n) for n in names], x, component, stats, [("normal", precision[component, *n] ** -0.5) for n in names], [n[0] for n in names])
                one.at_mode(1e-10)
                eta = float(x[at] @ one.value)
                if component == "prop":
                    want = -np.log1p(np.exp(-eta if y == 0 else eta))
                    assert got[side, cell, y].elpd_zero == pytest.approx(want, abs=0.02)
                else:
                    rate = np.exp(eta)
                    want = y * eta - rate - np.log(-np.expm1(-rate)) - sum(np.log(np.arange(1, y + 1)))
                    assert got[side, cell, y].elpd_count == pytest.approx(want, abs=0.05)


def test_weights_of_all_pairs_are_optimal(study):
    assert study.stacked.where("not converged").count() == 0
    assert study.stacked.count() == study.candidates.count() == study.sides.count() ** 2
    pairs = study.candidates.select("model_name", "count_side", "hurdle_side")
    found = additive.pair_optimality(study.side_scores, pairs, study.weights)
    assert found.count() == pairs.count() and found.agg(F.max("gradient")).first()[0] <= 1 + 1e-6
    total = weights.stack_pairs(study.side_scores, pairs.where(F.col("count_side").isin("2", "8") & F.col("hurdle_side").isin("2", "64")))
    assert total.agg(F.sum("weight")).first()[0] == pytest.approx(1) and total.count() == 4


def test_draws_have_the_fits_covariance(spark, study):
    side = "66"
    pairs = spark.createDataFrame([("m", side, side)], "model_name string, count_side string, hurdle_side string")
    index = spark.range(1, 6001).select(F.col("id").alias("draw_id"), F.lit("m").alias("model_name"), F.col("id").alias("draw_in_model"))
    drawn = additive.additive_draws(index, pairs, study.fitted).toPandas()
    drawn["name"] = drawn["term"] + "|" + drawn["level"]
    fitted = study.fitted.where(F.col("side") == side).toPandas().sort_values("place")
    for component in ("count", "prop"):
        f = fitted[fitted["component"] == component]
        names = (f["term"] + "|" + f["level"]).tolist()
        wide = drawn[drawn["component"] == component].pivot(index="draw_id", columns="name", values="value")[names].to_numpy()
        a = np.stack(f["factor"].to_numpy())
        cov, sd = a @ a.T, np.sqrt((a**2).sum(1))
        assert wide.mean(0) == pytest.approx(f["value"].to_numpy(), abs=float(5 * sd.max() / np.sqrt(6000)))
        assert np.abs(np.cov(wide.T) / np.outer(sd, sd) - cov / np.outer(sd, sd)).max() < 0.08
        assert np.abs(cov / np.outer(sd, sd) - np.eye(len(sd))).max() > 0.3
    assert set(drawn["kind"]) == {"intercept", "fixed", "random"}
