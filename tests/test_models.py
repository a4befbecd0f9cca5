import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twofold.functions import rand
from twofold.operators import draws, expected, fit, modelspace, scores, trials
from twofold.plans.queries import _additive, _loo_inputs, fixed_study
from twofold.plans.ensemble import Study
from twofold.rules import FORMS, INTERACTION_RULES, NESTING_RULES, TERMS, Form


@pytest.fixture(scope="module")
def usable(spark):
    return spark.createDataFrame([(t, 3, i) for i, t in enumerate(TERMS)], "term string, n_levels long, bit int")


def test_model_space_sizes(usable):
    every = modelspace.term_subsets(usable).cache()
    assert every.count() == 255
    loose = modelspace.drop_broken_interactions(every, strict=False)
    strict = modelspace.drop_broken_interactions(every)
    assert (loose.count(), strict.count()) == (159, 103)

    def obey(df, rules):
        for higher, required in rules:
            df = df.where(~modelspace.bad_combo(F.col("terms"), [higher], list(required)))
        return df

    nested = obey(loose, NESTING_RULES)
    assert (nested.count(), obey(nested, INTERACTION_RULES).count()) == (87, 67)
    assert modelspace.two_part(loose).count() == 159**2
    final = modelspace.candidates(usable)
    assert final.count() == 67**2 and final.select("id").distinct().count() == 67**2
    r = final.agg(F.min("rng_seed"), F.max("rng_seed")).first()
    assert 1 <= r[0] and r[1] <= 2**31 - 1


def test_work_list_splits_the_space(usable):
    settings = modelspace.candidates(usable)
    done = settings.where("id % 3 = 0")
    left = modelspace.still_to_run(settings, done)
    kept = modelspace.keep_named(settings, done)
    assert left.count() + kept.count() == settings.count()
    assert modelspace.part_rows(settings).count() == 2 * settings.count()


def test_one_level_terms_leave_the_space(spark):
    rows = [("AFRICA", "N1", "AFRICA", "p", "M", True), ("ASIA", "N1", "AFRICA", "p", "A", False)]
    df = spark.createDataFrame(rows, "host_site string, family string, source_site string, block string, genus string, native boolean")
    names = {r.term for r in modelspace.usable_terms(df).collect()}
    assert names == {"host", "source:host", "genus", "genus:source", "native"}


TINY = [
    (1, "AFRICA", "F1", "AFRICA", None, 0),
    (2, "AFRICA", "F1", "AFRICA", None, 2),
    (3, "AFRICA", "F1", "AFRICA", "b1", 1),
    (4, "ASIA", "F2", "AMERICA", "b1", 3),
    (5, "ASIA", "F2", "AMERICA", "b1", 1),
    (6, "ASIA", "F2", "AMERICA", "b2", 0),
    (7, "EUROPE", "F1", "AFRICA", "b2", 0),
    (8, "EUROPE", "F1", "AFRICA", "b2", 0),
    (9, "AMERICA", "F2", "AMERICA", "b1", 1),
    (10, "AMERICA", "F2", "AMERICA", "b1", 4),
    (11, "AMERICA", "F1", "AFRICA", "b2", 0),
    (12, "AMERICA", "F1", "AFRICA", "b2", 2),
]


@pytest.fixture(scope="module")
def tiny(spark):
    schema = "trial_id long, host_site string, family string, source_site string, block string, cnt long"
    return trials.clean(spark.createDataFrame(TINY, schema))


def test_cleaning(tiny):
    rows = {r.trial_id: r for r in tiny.collect()}
    assert rows[1].block == "p100" and rows[1].native and rows[1].genus == "M"
    assert rows[4].genus == "A" and not rows[4].native
    obs = {(r.host_site, r.source_site): r for r in trials.observed_summary(tiny).collect()}
    assert obs[("EUROPE", "AFRICA")].incidence is None and obs[("EUROPE", "AFRICA")].prevalence == 0


def test_boundary_flags(tiny):
    classes = trials.count_classes(tiny)
    cells = trials.cells_from_classes(classes)
    assert cells.agg(F.sum("n")).first()[0] == 12
    form = (Form("host", ("host",), ("host_site",)),)
    est = fit.estimates(fit.form_stats(cells, form)).where("component = 'count'")
    flags = {r.level: (r.boundary, r.est) for r in est.collect()}
    assert flags["EUROPE"][0] and all(math.isfinite(e) for _, e in flags.values())
    assert not flags["AMERICA"][0]


def test_closed_form_loo_equals_refitting(tiny):
    """Drop each trial, refit its host by hand, and score it."""
    classes = trials.count_classes(tiny).cache()
    cells = trials.cells_from_classes(classes)
    form = (Form("host", ("host",), ("host_site",)),)
    half = scores.half_scores(classes, fit.form_stats(cells, form), form)
    got = {(r.cell_id, r.cnt): (r.elpd_zero, r.elpd_count) for r in half.collect()}
    home = {(r.cell_id, r.cnt): r.host_site for r in classes.collect()}
    for (cell, y), (zero, count) in got.items():
        rest = [r[5] for r in TINY if r[1] == home[(cell, y)]]
        rest.remove(y)
        p0 = (rest.count(0) + 0.5) / (len(rest) + 1)
        assert zero == pytest.approx(math.log(p0 if y == 0 else 1 - p0))
        if y > 0:
            pos = [v for v in rest if v > 0]
            mean = max(sum(pos) / len(pos) if pos else 1.0, 1 + 0.5 / (len(pos) + 1))
            lo, hi = 1e-9, 50.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if mid / -math.expm1(-mid) < mean else (lo, mid)
            want = y * math.log(lo) - lo - math.lgamma(y + 1) - math.log(-math.expm1(-lo))
            assert count == pytest.approx(want, rel=1e-6)


def test_recovers_known_parameters(spark):
    """Counts simulated from known p0 and rate by hashed uniforms."""
    p0, rate, n = 0.4, 1.7, 40000
    u = rand.uniform(rand.key("sim", 1, F.col("id")))
    v = rand.uniform(rand.key("sim", 2, F.col("id")))
    total, cdf = 1 - math.exp(-rate), []
    mass, acc = math.exp(-rate), 0.0
    for y in range(1, 15):
        mass *= rate / y
        acc += mass / total
        cdf.append(acc)
    y = F.lit(15)
    for k in range(14, 0, -1):
        y = F.when(v < cdf[k - 1], k).otherwise(y)
    sim = spark.range(n).select(F.when(u < p0, 0).otherwise(y).cast("long").alias("cnt"))
    stats = sim.agg(
        F.count("*").alias("n"),
        F.sum((F.col("cnt") == 0).cast("long")).alias("n_zero"),
        F.sum((F.col("cnt") > 0).cast("long")).alias("n_pos"),
        F.sum("cnt").alias("sum_y"),
    ).select(F.lit("x").alias("form"), F.lit("fixed").alias("role"), F.lit("").alias("parent"), F.lit("").alias("level"), "*")
    for r in fit.estimates(stats).collect():
        truth = math.log(p0 / (1 - p0)) if r.component == "prop" else math.log(rate)
        assert abs(r.est - truth) < 4 * r.se


def test_parameters_rebuild_the_group_estimates(spark, sf_dir):
    """With no noise, the sum of a cell's parameters is its group's estimate."""
    study = Study(spark, sf_dir)
    flat = study.fits.withColumn("scale", F.lit(0.0))
    params = draws.parameters(draws.contrasts(study.cells), flat)
    same = study.same_form.select("model_name", "id", "count_form", "hurdle_form")
    index = same.select((F.col("id") * 1000000 + 1).alias("draw_id"), "model_name", F.lit(1).alias("draw_in_model"))
    made = draws.make_draws(index, same, params)
    eta = expected.linear_predictors(study.cells, made)
    groups = study.cells.select("cell_id", F.inline(fit.form_groups(FORMS)))
    want = (
        groups.join(flat, ["form", "role", "level"])
        .groupBy("form", "component", "cell_id")
        .agg(F.sum("loc").alias("want"))
    )
    long = eta.join(same, "model_name").select(
        F.col("count_form").alias("form"),
        "cell_id",
        F.inline(
            F.array(
                F.struct(F.lit("count").alias("component"), F.col("eta_count").alias("eta")),
                F.struct(F.lit("prop").alias("component"), F.col("eta_prop").alias("eta")),
            )
        ),
    )
    both = long.join(want, ["form", "component", "cell_id"])
    assert both.count() == want.count() > 0
    assert both.where(~(F.abs(F.col("eta") - F.col("want")) < 1e-9)).count() == 0


def test_newton_reaches_a_zero_gradient(spark, sf_dir):
    study = Study(spark, sf_dir)
    design = _additive(study).where(F.col("side").isin("9", "15", "130", "255"))
    found = fit.newton_fit(design, study.cells)
    assert found.where(~F.col("converged")).count() == 0
    swept = fit.score_sweep(design, study.cells, found.drop("converged"))
    assert swept.count() == found.count()
    assert swept.agg(F.max(F.abs("gradient"))).first()[0] < 1e-4


def test_smoothed_scores(spark, sf_dir):
    log_lik = scores.draw_log_density(*_loo_inputs(fixed_study(spark, sf_dir))).cache()
    keys = ["model_name", "group", "cnt"]
    plain = scores.importance_loo(log_lik)
    smooth = scores.smoothed_loo(log_lik).withColumnRenamed("elpd", "smooth")
    rows = plain.join(smooth, keys).collect()
    assert len(rows) == plain.count()
    calm = [r for r in rows if r.pareto_k is not None and r.pareto_k < 0.3]
    assert calm and all(abs(r.elpd - r.smooth) < 0.05 for r in calm)
    bad = scores.diagnostics(scores.smoothed_loo(log_lik)).collect()
    assert len(bad) == 6 and all(0 <= r.n_high_k <= r.n_trials for r in bad)


def test_pareto_tail_fit():
    rng = np.random.default_rng(1)
    for shape in (-0.2, 0.3, 0.9):
        x = (np.power(1 - rng.random(20000), -shape) - 1) / shape
        k, sigma = scores._fit_tail(x)
        assert k == pytest.approx(shape, abs=0.05) and sigma == pytest.approx(1.0, abs=0.06)


def test_constant_ratios_need_no_smoothing():
    elpd, k = scores._smooth_ratios([1.5] * 100)
    assert elpd == pytest.approx(-1.5) and k is None


def test_site_codes_round_trip_with_an_order(spark):
    labels = trials.site_labels(spark)
    df = spark.createDataFrame([(1, "gos"), (2, "lau"), (3, "ech")], "trial_id long, host_site string")
    named = trials.recode(df, "host_site", labels)
    assert [r.host_site for r in named.orderBy("host_site_ordinal").collect()] == ["Lawier", "Echo", "Gossling"]
    back = trials.uncode(named.drop("host_site_ordinal"), "host_site", labels)
    assert sorted((r.trial_id, r.host_site) for r in back.collect()) == [(1, "gos"), (2, "lau"), (3, "ech")]
