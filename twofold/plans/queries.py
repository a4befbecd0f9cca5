"""Named queries: one per operator of the analysis, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twofold.functions.links import prevalence, truncated_mean
from twofold.operators import (
    additive,
    contrast,
    density,
    draws,
    effects,
    expected,
    fit,
    modelspace,
    quantiles,
    scores,
    trials,
    weights,
)
from twofold.plans.ensemble import AdditiveStudy, Study, grouped_estimates
from twofold.rules import (
    EFFECT_NAMES,
    EFFECT_PROBS,
    FIXED_FORMS,
    INTERACTION_RULES,
    JOINT_HOST,
    JOINT_SOURCE,
    NESTING_RULES,
)
from twofold.sources import star, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Sizes of the registered queries; the operators take them as arguments.
REPLICATES = 2880
PATH_REPLICATES = 50
LOO_DRAWS = 200
EV_DRAWS = 400
EFFECT_DRAWS = 4000
EM_STEPS = 5
CHUNKS = 4
GRID = 25
WHOLE_GRID = 400
CURVE = 41


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, so that results compare across engines; no negative zero."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "double":
            r = F.round(c, digits)
            c = F.when(r == 0, F.lit(0.0)).otherwise(r).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def query(name: str, digits: int = 6):
    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        return f

    return register


def fixed_study(spark, sf_dir) -> Study:
    return Study(spark, sf_dir, forms=FIXED_FORMS)


def pooled_study(spark, sf_dir) -> Study:
    """All closed-form candidates."""
    return Study(spark, sf_dir)


def ev_study(spark, sf_dir) -> Study:
    return Study(spark, sf_dir, per_model=EV_DRAWS)


def effect_study(spark, sf_dir) -> Study:
    return Study(spark, sf_dir, per_model=EFFECT_DRAWS)


# Sources and sinks ---------------------------------------------------------


@query("io1_read_delimited")
def io1(spark, sf_dir):
    path = tables.stage_path(spark, "trials-csv")
    tables.write_delimited(star.raw_trials(spark, sf_dir), path)
    return tables.read_delimited(spark, path)


@query("io2_write_delimited")
def io2(spark, sf_dir):
    clean = Study(spark, sf_dir).trials
    path = tables.stage_path(spark, "clean-csv")
    tables.write_delimited(clean, path)
    return tables.read_delimited(spark, path, clean.schema)


@query("io3_stage_table")
def io3(spark, sf_dir):
    return Study(spark, sf_dir).cells


def _model_totals(points: DataFrame, name) -> DataFrame:
    return points.groupBy(name.alias("model_name")).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.sum("copies").alias("n_trials"),
        F.sum(F.col("copies") * F.col("elpd")).alias("elpd_total"),
    )


@query("io4_read_folder", digits=4)
def io4(spark, sf_dir):
    path = tables.stage_path(spark, "by-model")
    tables.write_by_model(pooled_study(spark, sf_dir).staged_points, path)
    found = tables.read_folder(spark, path)
    return _model_totals(found, F.regexp_extract("file_path", r"model_name=([^/]+)/", 1))


@query("io5_load_scores", digits=4)
def io5(spark, sf_dir):
    path = tables.stage_path(spark, "by-model")
    study = pooled_study(spark, sf_dir)
    tables.write_by_model(study.staged_points, path)
    wanted = study.same_form.select("model_name")
    found = spark.read.parquet(path).join(wanted, "model_name", "left_semi")
    return _model_totals(found, F.col("model_name"))


@query("io6_name_from_path")
def io6(spark, sf_dir):
    study = pooled_study(spark, sf_dir)
    files = _model_totals(study.staged_points, F.col("model_name")).select(
        F.concat(F.lit("scores/"), "model_name", F.lit(".parquet")).alias("path"), "n_trials"
    )
    return files.select("path", tables.stem(F.col("path")).alias("model_name"), "n_trials")


@query("io7_write_chunks")
def io7(spark, sf_dir):
    path = tables.stage_path(spark, "chunks")
    chunked = weights.balanced_chunks(weights.pseudo_bma(pooled_study(spark, sf_dir).staged_points), CHUNKS)
    tables.write_chunks(chunked.select("chunk", "model_name", "log_weight"), path)
    return spark.read.parquet(path).select(F.col("chunk").cast("int"), "model_name", "log_weight")


# Trials --------------------------------------------------------------------


@query("t1_select_rename")
def t1(spark, sf_dir):
    return star.raw_trials(spark, sf_dir).select(
        "trial_id", "host_site", "family", "source_site", F.col("cnt").alias("n_items")
    )


@query("t2_fill_block")
def t2(spark, sf_dir):
    return trials.fill_block(star.raw_trials(spark, sf_dir).select("trial_id", "block"))


@query("t3_native_genus")
def t3(spark, sf_dir):
    return trials.with_native_and_genus(
        star.raw_trials(spark, sf_dir).select("trial_id", "host_site", "source_site")
    )


@query("t4_clean_trials")
def t4(spark, sf_dir):
    return Study(spark, sf_dir).trials


@query("t5_flag_to_int")
def t5(spark, sf_dir):
    return star.raw_trials(spark, sf_dir).select(
        "trial_id", trials.flag_to_int(F.col("infected_flag")).alias("infected")
    )


@query("t6_recode_sites")
def t6(spark, sf_dir):
    labels = star.region_labels(spark, sf_dir)
    rows = Study(spark, sf_dir).trials.select("trial_id", "host_site", "cnt")
    return trials.recode(rows, "host_site", labels).select(
        "trial_id", "host_site", "host_site_ordinal", "cnt"
    )


@query("t6b_uncode_sites")
def t6b(spark, sf_dir):
    labels = star.region_labels(spark, sf_dir)
    rows = Study(spark, sf_dir).trials.select("trial_id", "host_site", "cnt")
    there = trials.recode(rows, "host_site", labels).drop("host_site_ordinal")
    return trials.uncode(there, "host_site", labels).select("trial_id", "host_site", "cnt")


@query("t7_design_cells")
def t7(spark, sf_dir):
    return trials.design_cells(Study(spark, sf_dir).trials)


@query("t8_positive_trials")
def t8(spark, sf_dir):
    return trials.positive_trials(Study(spark, sf_dir).trials)


# Model space ---------------------------------------------------------------


def _usable(spark, sf_dir):
    return modelspace.usable_terms(Study(spark, sf_dir).trials)


def _subsets(spark, sf_dir, strict=False):
    return modelspace.drop_broken_interactions(
        modelspace.term_subsets(_usable(spark, sf_dir)), strict
    )


def _text(col: str):
    return F.array_join(col, "|").alias(col)


@query("m1_term_subsets")
def m1(spark, sf_dir):
    return modelspace.term_subsets(_usable(spark, sf_dir)).select("mask", _text("terms"), "n_coef")


@query("m2_interaction_repair")
def m2(spark, sf_dir):
    every = modelspace.term_subsets(_usable(spark, sf_dir))
    loose = modelspace.drop_broken_interactions(every, strict=False).withColumn("strict", F.lit(False))
    strict = modelspace.drop_broken_interactions(every, strict=True).withColumn("strict", F.lit(True))
    return loose.unionByName(strict).select("strict", "mask", _text("terms"), "n_coef")


@query("m3_formula_text")
def m3(spark, sf_dir):
    return _subsets(spark, sf_dir).select(
        "mask", modelspace.formula(F.col("terms"), "cnt").alias("formula"), "n_coef"
    )


@query("m4_two_part_product")
def m4(spark, sf_dir):
    return modelspace.two_part(_subsets(spark, sf_dir)).select(
        "count_mask",
        "hurdle_mask",
        "count_formula",
        "hurdle_formula",
        (F.col("count_coef") + F.col("hurdle_coef")).alias("n_coef"),
    )


@query("m5_effect_flags")
def m5(spark, sf_dir):
    flagged = modelspace.with_effect_flags(modelspace.two_part(_subsets(spark, sf_dir)))
    return flagged.select(
        "count_mask", "hurdle_mask", "count_random", "hurdle_random", "count_fixed", "hurdle_fixed"
    )


@query("m6_priors")
def m6(spark, sf_dir):
    flagged = modelspace.with_effect_flags(modelspace.two_part(_subsets(spark, sf_dir)))
    return flagged.withColumn("priors", modelspace.priors()).select(
        "count_mask", "hurdle_mask", modelspace.prior_text().alias("priors")
    )


@query("m7_run_settings")
def m7(spark, sf_dir):
    return modelspace.with_run_settings(modelspace.two_part(_subsets(spark, sf_dir))).select(
        "id", "model_name", "adapt_delta", "rng_seed"
    )


@query("m8_split_formula")
def m8(spark, sf_dir):
    text = _subsets(spark, sf_dir).select("mask", modelspace.formula(F.col("terms"), "hu").alias("formula"))
    return text.withColumn("terms", modelspace.split_formula(F.col("formula"))).select(
        "mask", "formula", _text("terms"), F.size("terms").alias("n_terms")
    )


@query("m9_bad_combo")
def m9(spark, sf_dir):
    every = modelspace.term_subsets(_usable(spark, sf_dir))
    return every.select(
        "mask",
        modelspace.bad_combo(F.col("terms"), ["host"], ["genus"]).alias("nest_host"),
        modelspace.bad_combo(F.col("terms"), ["(1|family)"], ["source"]).alias("nest_family"),
        modelspace.bad_combo(F.col("terms"), ["genus:source"], ["genus", "source"]).alias("inter_genus"),
        modelspace.bad_combo(F.col("terms"), ["source:host"], ["host", "source"]).alias("inter_host"),
    )


@query("m10_nesting_rules")
def m10(spark, sf_dir):
    named = modelspace.with_run_settings(modelspace.two_part(_subsets(spark, sf_dir)))
    return modelspace.prune(named, NESTING_RULES).select("model_name", "count_formula", "hurdle_formula")


@query("m11_interaction_rules")
def m11(spark, sf_dir):
    named = modelspace.with_run_settings(modelspace.two_part(_subsets(spark, sf_dir)))
    return modelspace.prune(named, INTERACTION_RULES).select("model_name", "count_formula", "hurdle_formula")


@query("m12_keep_valid")
def m12(spark, sf_dir):
    named = modelspace.with_run_settings(modelspace.two_part(_subsets(spark, sf_dir)))
    return modelspace.keep_named(named, modelspace.prune(named)).select(
        "id", "model_name", "count_formula", "hurdle_formula"
    )


@query("m13_still_to_run")
def m13(spark, sf_dir):
    study = Study(spark, sf_dir)
    done = study.staged_points.select("model_name").distinct()
    settings = modelspace.candidates(modelspace.usable_terms(study.cells))
    return modelspace.still_to_run(settings, done).select("id", "model_name")


@query("m14_part_rows")
def m14(spark, sf_dir):
    return modelspace.part_rows(modelspace.candidates(_usable(spark, sf_dir)))


# Fits ----------------------------------------------------------------------


@query("f1_cell_statistics")
def f1(spark, sf_dir):
    return Study(spark, sf_dir).cells


@query("f2_grouped_fit")
def f2(spark, sf_dir):
    study = fixed_study(spark, sf_dir)
    return fit.estimates(study.stats).drop("role", "parent")


@query("f2b_cell_expectations")
def f2b(spark, sf_dir):
    return grouped_estimates(Study(spark, sf_dir))


@query("f3_partial_pooling")
def f3(spark, sf_dir):
    return fit.shrunk(fit.estimates(Study(spark, sf_dir).stats)).select(
        "form", "component", "parent", "level", "center", "dev", "tau2", "shrunk_dev", "shrunk_se"
    )


def _additive(study: Study):
    valid = modelspace.term_subsets(modelspace.usable_terms(study.cells))
    for part in (NESTING_RULES, INTERACTION_RULES):
        for higher, required in part:
            valid = valid.where(~modelspace.bad_combo(F.col("terms"), [higher], list(required)))
    sides = valid.select(F.col("mask").cast("string").alias("side"), "terms")
    return fit.design_rows(study.cells, sides, study.reference)


@query("f4_score_sweep", digits=4)
def f4(spark, sf_dir):
    study = Study(spark, sf_dir)
    design = tables.stage(_additive(study), "design")
    start = tables.stage(fit.initial_state(design), "state")
    first = fit.score_sweep(design, study.cells, start)
    return fit.score_sweep(design, study.cells, fit.diagonal_step(first)).drop("precision")


@query("f4b_newton_fit")
def f4b(spark, sf_dir):
    study = Study(spark, sf_dir)
    return fit.newton_fit(_additive(study), study.cells).drop("precision")


@query("f4c_side_fits")
def f4c(spark, sf_dir):
    """All sides with estimated group variances; a term's variance is one over its precision."""
    return AdditiveStudy(spark, sf_dir).fitted.select("side", "component", "term", "level", "value", (1 / F.col("precision")).alias("variance"), "converged")


@query("f4d_fit_gradient", digits=4)
def f4d(spark, sf_dir):
    """Penalised gradient at the fits, summed anew over cells by joins; zero at the mode."""
    study = AdditiveStudy(spark, sf_dir)
    state = study.fitted.select("side", "component", "term", "level", "value", "precision")
    return fit.score_sweep(study.design_rows, study.cells, state).select("side", "component", "term", "level", "gradient")


@query("f6b_additive_loo")
def f6b(spark, sf_dir):
    return AdditiveStudy(spark, sf_dir).side_scores


@query("f5_draws")
def f5(spark, sf_dir):
    return effect_study(spark, sf_dir).draws.drop("model_name")


@query("f6_closed_form_loo")
def f6(spark, sf_dir):
    return Study(spark, sf_dir).halves


# Scores --------------------------------------------------------------------


def _loo_inputs(study: Study):
    """Classes and per-draw predictors of the same-form candidates, by group."""
    groups = scores.class_groups(study.classes, FIXED_FORMS).select(
        F.col("form").alias("count_form"), F.col("level").alias("group"), "cnt", "copies"
    )
    models = study.same_form.select("model_name", "count_form")
    classes = groups.join(models, "count_form").groupBy("model_name", "group", "cnt").agg(
        F.sum("copies").alias("copies")
    )
    from twofold.functions import rand

    numbers = F.explode(F.sequence(F.lit(1), F.lit(LOO_DRAWS)))
    k = rand.key(
        "draw", 1, F.col("model_name"), F.col("component"), F.col("role"), F.col("group"), F.col("draw")
    )
    values = (
        fit.fits(study.stats)
        .join(models.withColumnRenamed("count_form", "form"), "form")
        .withColumnRenamed("level", "group")
        .withColumn("draw", numbers)
        .withColumn("eta", F.col("loc") + rand.normal(k) * F.col("scale"))
    )
    predictors = values.groupBy("model_name", "group", "draw").agg(
        F.max(F.when(F.col("component") == "prop", F.col("eta"))).alias("zero_logit"),
        F.max(F.when(F.col("component") == "count", F.col("eta"))).alias("log_rate"),
    )
    return classes, predictors


@query("l1_draw_log_density")
def l1(spark, sf_dir):
    return scores.draw_log_density(*_loo_inputs(fixed_study(spark, sf_dir)))


@query("l2_importance_loo")
def l2(spark, sf_dir):
    return scores.importance_loo(scores.draw_log_density(*_loo_inputs(fixed_study(spark, sf_dir))))


@query("l3_smoothed_loo")
def l3(spark, sf_dir):
    return scores.smoothed_loo(scores.draw_log_density(*_loo_inputs(fixed_study(spark, sf_dir))))


@query("l4_trial_scores")
def l4(spark, sf_dir):
    study = Study(spark, sf_dir)
    points = scores.pointwise(study.same_form, study.halves)
    return scores.trial_scores(study.trials, study.cells, points)


@query("l5_diagnostics")
def l5(spark, sf_dir):
    smoothed = scores.smoothed_loo(scores.draw_log_density(*_loo_inputs(fixed_study(spark, sf_dir))))
    return scores.diagnostics(smoothed)


# Weights -------------------------------------------------------------------


@query("w1_pseudo_bma", digits=4)
def w1(spark, sf_dir):
    return weights.pseudo_bma(pooled_study(spark, sf_dir).staged_points)


@query("w2_pseudo_bma_bootstrap")
def w2(spark, sf_dir):
    return weights.pseudo_bma_bootstrap(pooled_study(spark, sf_dir).staged_points, REPLICATES)


@query("w3_worker_average")
def w3(spark, sf_dir):
    return weights.worker_averages(weights.bootstrap_weights(pooled_study(spark, sf_dir).staged_points, REPLICATES), 5)


@query("w4_cutoff", digits=4)
def w4(spark, sf_dir):
    return weights.cutoff(weights.pseudo_bma(pooled_study(spark, sf_dir).staged_points), -3.0)


@query("w5_balanced_chunks", digits=4)
def w5(spark, sf_dir):
    table = weights.pseudo_bma(pooled_study(spark, sf_dir).staged_points)
    return weights.balanced_chunks(table, CHUNKS).select("model_name", "chunk", "log_weight")


@query("w6_chunk_lists")
def w6(spark, sf_dir):
    table = weights.pseudo_bma(pooled_study(spark, sf_dir).staged_points)
    return weights.chunk_lists(weights.balanced_chunks(table, CHUNKS)).select("chunk", _text("models"), "seed")


@query("w7_stacking_objective", digits=4)
def w7(spark, sf_dir):
    points = pooled_study(spark, sf_dir).staged_points
    return weights.objective(weights.densities(points), weights.uniform_weights(points))


@query("w8_stacking_gradient")
def w8(spark, sf_dir):
    points = pooled_study(spark, sf_dir).staged_points
    return weights.gradient(weights.densities(points), weights.uniform_weights(points))


@query("w9_stacking_steps")
def w9(spark, sf_dir):
    return weights.em_steps(pooled_study(spark, sf_dir).staged_points, EM_STEPS)


@query("w9b_stacking_converged")
def w9b(spark, sf_dir):
    return Study(spark, sf_dir).stacked


def _chunked_points(study: Study):
    chunked = weights.balanced_chunks(weights.pseudo_bma(study.staged_points), CHUNKS)
    return study.staged_points.join(chunked.select("model_name", "chunk"), "model_name")


@query("w10_chunk_stacking")
def w10(spark, sf_dir):
    inside = tables.stage(_chunked_points(pooled_study(spark, sf_dir)), "chunked")
    return weights.em_steps(inside, EM_STEPS, ("chunk",))


@query("w10b_chunk_stacking_converged")
def w10b(spark, sf_dir):
    study = pooled_study(spark, sf_dir)
    chunked = weights.balanced_chunks(weights.pseudo_bma(study.staged_points), CHUNKS)
    return weights.first_pass(study.staged_points, chunked, tol=study.tol)


@query("w11_survivors")
def w11(spark, sf_dir):
    study = pooled_study(spark, sf_dir)
    inside = tables.stage(_chunked_points(study), "chunked")
    first = weights.stack(inside, ("chunk",), tol=study.tol)
    return weights.survivors(study.candidates.select("model_name", "count_formula", "hurdle_formula"), first)


def _weighting_path(study: Study, replicates: int) -> DataFrame:
    """The whole path: bootstrap weights, cutoff, chunks, stacking per chunk, stacking of what is left."""
    settings = study.candidates.select("model_name", "count_formula", "hurdle_formula")
    rough = weights.cutoff(weights.pseudo_bma_bootstrap(study.staged_points, replicates))
    chunked = tables.stage(weights.balanced_chunks(rough, CHUNKS), "chunked")
    first = weights.first_pass(study.staged_points, chunked, tol=study.tol)
    return weights.final_stacking(study.staged_points, weights.survivors(settings, first).drop("weight"), tol=study.tol)


@query("w12_final_stacking")
def w12(spark, sf_dir):
    return _weighting_path(pooled_study(spark, sf_dir), PATH_REPLICATES)


@query("w12b_final_stacking_whole")
def w12b(spark, sf_dir):
    """The path over all replicates; its statement would not end in time."""
    return _weighting_path(pooled_study(spark, sf_dir), REPLICATES)


def _weighted(study: Study) -> DataFrame:
    return study.weights.join(study.candidates, "model_name")


@query("w13_readable_weights")
def w13(spark, sf_dir):
    return weights.readable(_weighted(pooled_study(spark, sf_dir)))


@query("w14_term_weights")
def w14(spark, sf_dir):
    return weights.term_weights(_weighted(pooled_study(spark, sf_dir)))


@query("w16_additive_weights")
def w16(spark, sf_dir):
    """Stacking weights of all pairs of additive sides."""
    return AdditiveStudy(spark, sf_dir).stacked


@query("w16b_additive_optimality")
def w16b(spark, sf_dir):
    """Whether no pair would raise the score, from gradients summed anew by joins."""
    study = AdditiveStudy(spark, sf_dir)
    found = additive.pair_optimality(study.side_scores, study.candidates.select("model_name", "count_side", "hurdle_side"), study.weights)
    return found.select("model_name", (F.col("gradient") <= 1 + 1e-6).alias("at_most_one"))


class Question2(Study):
    """Second contrast question: one source, candidates about host kinship."""

    def __init__(self, spark, sf_dir, per_model=EFFECT_DRAWS):
        super().__init__(spark, sf_dir, forms=contrast.QUESTION2, per_model=per_model)

    @property
    def trials(self):
        return contrast.cohort2(self.raw)

    @property
    def classes(self):
        return self._stage("classes", lambda: trials.count_classes(self.trials, contrast.COHORT2_KEYS))

    @property
    def cells(self):
        return trials.cells_from_classes(self.classes, contrast.COHORT2_KEYS)

    @property
    def points(self):
        elpd = F.col("elpd_zero") + F.col("elpd_count")
        return self.halves.select(
            F.col("form").alias("model_name"), "cell_id", "cnt", "copies", elpd.alias("elpd")
        )


@query("w15_named_stacking")
def w15(spark, sf_dir):
    study = Question2(spark, sf_dir)
    return weights.scaled(study.weights)


# Draws ---------------------------------------------------------------------


@query("d1_allocate")
def d1(spark, sf_dir):
    return Study(spark, sf_dir).allocation


@query("d2_draw_index")
def d2(spark, sf_dir):
    return ev_study(spark, sf_dir).index


@query("d3_allocate_total")
def d3(spark, sf_dir):
    study = Study(spark, sf_dir)
    free = draws.allocate_total(study.weights, 4000).withColumnRenamed("n_draws", "n_free")
    fixed = draws.allocate_total(study.weights, 4000, 50000.0).select("model_name", "n_draws")
    return free.join(fixed, "model_name")


@query("d4_subset_draws")
def d4(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    some = draws.allocate_total(
        study.weights.join(study.candidates.select("model_name", "id"), "model_name"), EFFECT_DRAWS, 300.0
    )
    fewer = draws.draw_index(some, EFFECT_DRAWS, 52399832)
    return draws.subset_draws(study.draws, fewer).drop("model_name")


WIDE = [
    f"{c}_{p}"
    for c in ("count", "prop")
    for p in ("intercept", "genus_M", "source_AMERICA", "source_ASIA", "native_true")
]


@query("d5_wide_draws")
def d5(spark, sf_dir):
    return draws.wide_draws(effect_study(spark, sf_dir).draws, WIDE)


@query("d6_zero_filled")
def d6(spark, sf_dir):
    return draws.zero_filled(draws.wide_draws(effect_study(spark, sf_dir).draws, WIDE))


@query("d5b_wide_draws_all")
def d5b(spark, sf_dir):
    """All parameters of the draws; the statement of d5 has ten."""
    return draws.wide_draws(effect_study(spark, sf_dir).draws)


@query("d6b_zero_filled_all")
def d6b(spark, sf_dir):
    return draws.zero_filled(draws.wide_draws(effect_study(spark, sf_dir).draws))


@query("d7_draw_details")
def d7(spark, sf_dir):
    return effect_study(spark, sf_dir).details.drop("count_terms", "hurdle_terms")


# Expected values -----------------------------------------------------------


def _estimates(spark, sf_dir, component):
    est = fit.estimates(fixed_study(spark, sf_dir).stats)
    return est.where(F.col("component") == component)


@query("e1_prevalence")
def e1(spark, sf_dir):
    return _estimates(spark, sf_dir, "prop").select(
        "form", "level", prevalence(F.col("est")).alias("prevalence")
    )


@query("e2_truncated_mean")
def e2(spark, sf_dir):
    return _estimates(spark, sf_dir, "count").select(
        "form", "level", truncated_mean(F.col("est")).alias("mean_count")
    )


@query("e3_cell_parameters")
def e3(spark, sf_dir):
    study = ev_study(spark, sf_dir)
    return expected.cell_parameters(study.cells, study.draws)


@query("e4_expected_values")
def e4(spark, sf_dir):
    return ev_study(spark, sf_dir).values.drop("model_name")


@query("e4b_no_interactions")
def e4b(spark, sf_dir):
    study = ev_study(spark, sf_dir)
    flat = expected.linear_predictors(study.cells, study.draws, interactions=False)
    return expected.expected_values(flat).groupBy("cell_id").agg(
        F.avg("count_ev").alias("count_ev"), F.avg("prev_ev").alias("prev_ev")
    )


@query("e5_by_model")
def e5(spark, sf_dir):
    return ev_study(spark, sf_dir).staged_values.groupBy("model_name", "cell_id").agg(
        F.avg("count_ev").alias("count_ev"), F.avg("prev_ev").alias("prev_ev")
    )


@query("e6_values_with_cells")
def e6(spark, sf_dir):
    study = ev_study(spark, sf_dir)
    return expected.with_cells(study.staged_values.drop("model_name"), study.cells)


@query("e7_cell_summary")
def e7(spark, sf_dir):
    study = ev_study(spark, sf_dir)
    return expected.cell_summary(study.staged_values)


def _site_summary(spark, sf_dir):
    study = ev_study(spark, sf_dir)
    return expected.site_summary(expected.with_cells(study.staged_values, study.cells))


@query("e8_site_summary")
def e8(spark, sf_dir):
    return _site_summary(spark, sf_dir).select(
        "variable", "host_site", "source_site", "mean", "median", "sd"
    )


@query("e9_intervals")
def e9(spark, sf_dir):
    return expected.wide_intervals(_site_summary(spark, sf_dir))


@query("e10_observed_summary")
def e10(spark, sf_dir):
    return trials.observed_summary(Study(spark, sf_dir).trials)


@query("e11_observed_long")
def e11(spark, sf_dir):
    return trials.observed_long(trials.observed_summary(Study(spark, sf_dir).trials))


@query("e12_observed_prevalence")
def e12(spark, sf_dir):
    return trials.observed_prevalence(Study(spark, sf_dir).trials, ["host_site", "source_site"])


MAIN_TERMS = ["host", "source", "genus", "native"]


@query("e13_share_by_cell")
def e13(spark, sf_dir):
    study = ev_study(spark, sf_dir)
    return expected.complete_share(study.cells, study.draws, "cell_id", MAIN_TERMS, study.reference)


@query("e13b_share_by_draw")
def e13b(spark, sf_dir):
    study = ev_study(spark, sf_dir)
    return expected.complete_share(study.cells, study.draws, "draw_id", MAIN_TERMS, study.reference)


@query("e13c_common_terms")
def e13c(spark, sf_dir):
    study = ev_study(spark, sf_dir)
    share = expected.complete_share(study.cells, study.draws, "draw_id", MAIN_TERMS, study.reference)
    good = share.where((F.col("prop_count") > 0.5) & (F.col("prop_hu") > 0.5))
    models = study.details.join(good, "draw_id", "left_semi").select("model_name", "count_terms").distinct()
    return expected.common_terms(models, "count_terms")


def _share_of_all_terms(spark, sf_dir, by: str) -> DataFrame:
    """Share over every term that varies in the trials; e13 has four."""
    study = ev_study(spark, sf_dir)
    terms = [r["term"] for r in modelspace.usable_terms(study.cells).orderBy("bit").collect()]
    return expected.complete_share(study.cells, study.draws, by, terms, study.reference)


@query("e13d_share_by_cell_all_terms")
def e13d(spark, sf_dir):
    return _share_of_all_terms(spark, sf_dir, "cell_id")


@query("e13e_share_by_draw_all_terms")
def e13e(spark, sf_dir):
    return _share_of_all_terms(spark, sf_dir, "draw_id")


@query("e13f_common_terms_all_terms")
def e13f(spark, sf_dir):
    good = _share_of_all_terms(spark, sf_dir, "draw_id").where((F.col("prop_count") > 0.5) & (F.col("prop_hu") > 0.5))
    models = ev_study(spark, sf_dir).details.join(good, "draw_id", "left_semi").select("model_name", "count_terms").distinct()
    return expected.common_terms(models, "count_terms")


# Effects -------------------------------------------------------------------


@query("x1_factor_table")
def x1(spark, sf_dir):
    return effects.factor_table(effect_study(spark, sf_dir).draws)


@query("x2_relevant")
def x2(spark, sf_dir):
    return effects.relevant(effect_study(spark, sf_dir).draws).select(
        "draw_id", "component", "term", "level", "value"
    )


def _present(spark, sf_dir, component: str | None, random: bool):
    rows = effects.present_marginals(effect_study(spark, sf_dir).draws)
    rows = rows.where((F.col("kind") == "random") == F.lit(random))
    rows = rows if component is None else rows.where(F.col("component") == component)
    return rows.drop("kind", "absent")


@query("x3_count_marginals")
def x3(spark, sf_dir):
    return _present(spark, sf_dir, "count", False)


@query("x4_prop_marginals")
def x4(spark, sf_dir):
    return _present(spark, sf_dir, "prop", False)


@query("x5_random_marginals")
def x5(spark, sf_dir):
    return _present(spark, sf_dir, None, True)


@query("x6_reference_class")
def x6(spark, sf_dir):
    present = effects.present_marginals(effect_study(spark, sf_dir).draws)
    return effects.reference_marginals(present).drop("level", "absent")


@query("x7_absent_rows")
def x7(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    rows = effects.absent_rows(study.index, effects.present_marginals(study.draws))
    return rows.select("draw_id", "component", "factor", "absent")


@query("x8_joint_source_draws")
def x8(spark, sf_dir):
    return effects.draws_with_both(effect_study(spark, sf_dir).details, "source", "(1|family)")


def _levels(study: Study, term: str, dimension: DataFrame) -> DataFrame:
    rows = effects.relevant(study.draws, ("fixed", "random")).where(F.col("term") == term)
    per_level = rows.groupBy("component", "level").agg(F.count(F.lit(1)).alias("n_rows"))
    return effects.level_parent(per_level, dimension)


@query("x9_family_source")
def x9(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    return _levels(study, "(1|family)", effects.family_dimension(study.cells))


def _joint(study: Study, source: bool) -> DataFrame:
    rows = study.pooled_source if source else study.pooled_host
    label = JOINT_SOURCE if source else JOINT_HOST
    return rows.where(F.col("factor") == label)


@query("x10_joint_source")
def x10(spark, sf_dir):
    return _joint(effect_study(spark, sf_dir), True).drop("factor")


@query("x11_pooled_source")
def x11(spark, sf_dir):
    return effect_study(spark, sf_dir).pooled_source.where(F.col("factor") != JOINT_SOURCE).drop("factor")


@query("x12_joint_host_draws")
def x12(spark, sf_dir):
    return effects.draws_with_both(effect_study(spark, sf_dir).details, "genus", "host")


@query("x13_host_genus")
def x13(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    return _levels(study, "host", effects.genus_dimension(study.cells))


@query("x14_pooled_host")
def x14(spark, sf_dir):
    return effect_study(spark, sf_dir).pooled_host


@query("x15_effect_sizes")
def x15(spark, sf_dir):
    return effect_study(spark, sf_dir).effect_sizes


@query("x16_inclusion")
def x16(spark, sf_dir):
    return effects.inclusion(effect_study(spark, sf_dir).staged_effects)


@query("x17_credible_intervals")
def x17(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    return effects.credible_intervals(study.staged_effects, ["component", "factor"])


@query("x17b_located_quantiles")
def x17b(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    return effects.credible_intervals(study.staged_effects, ["component", "factor"])


@query("x18_summary")
def x18(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    return effects.summary(study.staged_effects)


@query("x18b_additive_summary")
def x18b(spark, sf_dir):
    """Inclusion and intervals over all pairs of additive sides."""
    return effects.summary(AdditiveStudy(spark, sf_dir).staged_effects)


@query("x19_n_draws")
def x19(spark, sf_dir):
    return effects.n_draws(effect_study(spark, sf_dir).staged_effects)


@query("x20_manuscript")
def x20(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    return effects.manuscript(effects.summary(study.staged_effects))


@query("x21_split_effects")
def x21(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    return effects.split_effects(study.staged_effects, "Genus", "Host Site")


@query("x22_joint_inclusion")
def x22(spark, sf_dir):
    return effects.joint_inclusion(effect_study(spark, sf_dir).staged_effects, "count")


# Densities -----------------------------------------------------------------


@query("k1_paired_effects")
def k1(spark, sf_dir):
    return density.paired_effects(effect_study(spark, sf_dir).staged_effects, "Host Site", "Genus")


@query("k2_class_labels")
def k2(spark, sf_dir):
    return density.class_labels(effect_study(spark, sf_dir).staged_effects, "Genus", "Host Site")


@query("k3_joint_points")
def k3(spark, sf_dir):
    return density.joint_points(effect_study(spark, sf_dir).staged_effects, "Genus", "Host Site")


def _density(study: Study, points: DataFrame, n: int = GRID) -> DataFrame:
    return density.density_2d(tables.stage(points, "points"), n)


HOST_PAIR = ("Genus", "Host Site")
SOURCE_PAIR = ("Source Site", "Family (RE)")


def _joint_density(spark, sf_dir, n: int = GRID, pair: tuple[str, str] = HOST_PAIR) -> DataFrame:
    study = effect_study(spark, sf_dir)
    return _density(study, density.joint_points(study.staged_effects, *pair), n)


# The statements of k4 to k7 leave out groups without a density; their second forms
# below hold all of them, on the full grid, their third those of source and family.


@query("k4_density_2d", digits=4)
def k4(spark, sf_dir):
    return _joint_density(spark, sf_dir).where(F.col("z").isNotNull())


@query("k4b_density_all_components", digits=4)
def k4b(spark, sf_dir):
    return _joint_density(spark, sf_dir, WHOLE_GRID)


@query("k4c_density_source_family", digits=4)
def k4c(spark, sf_dir):
    return _joint_density(spark, sf_dir, WHOLE_GRID, SOURCE_PAIR)


@query("k5_alpha", digits=4)
def k5(spark, sf_dir):
    grid = _joint_density(spark, sf_dir).where(F.col("z").isNotNull())
    return density.with_alpha(grid).select("component", "i", "j", "alpha", "plot_alpha")


@query("k5b_alpha_all_components", digits=4)
def k5b(spark, sf_dir):
    grid = _joint_density(spark, sf_dir, WHOLE_GRID)
    return density.with_alpha(grid).select("component", "i", "j", "alpha", "plot_alpha")


@query("k5c_alpha_source_family", digits=4)
def k5c(spark, sf_dir):
    grid = _joint_density(spark, sf_dir, WHOLE_GRID, SOURCE_PAIR)
    return density.with_alpha(grid).select("component", "i", "j", "alpha", "plot_alpha")


def _class_density(spark, sf_dir, pair: tuple[str, str] = HOST_PAIR) -> DataFrame:
    study = effect_study(spark, sf_dir)
    rows = tables.stage(density.class_labels(study.staged_effects, *pair), "classes")
    return density.density_1d(rows, ["component", "class"], "effect_size", CURVE)


@query("k6_density_1d", digits=4)
def k6(spark, sf_dir):
    return _class_density(spark, sf_dir).where(F.col("density").isNotNull())


@query("k6c_density_all_classes", digits=4)
def k6c(spark, sf_dir):
    return _class_density(spark, sf_dir)


@query("k6d_density_source_family", digits=4)
def k6d(spark, sf_dir):
    return _class_density(spark, sf_dir, SOURCE_PAIR)


@query("k6b_class_intervals")
def k6b(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    rows = density.class_labels(study.staged_effects, "Genus", "Host Site")
    return quantiles.grouped_quantiles(
        rows, ["component", "class"], "effect_size", EFFECT_PROBS, EFFECT_NAMES
    )


def _pair_density(spark, sf_dir, n: int = GRID, pair: tuple[str, str] = HOST_PAIR) -> DataFrame:
    study = effect_study(spark, sf_dir)
    wide = density.parent_child(study.staged_effects, *pair, 1.5)
    points = wide.where(~F.col("child_missing") & F.col("parent").isNotNull()).select(
        "component", "draw_id", F.col("child").alias("x"), F.col("parent").alias("y")
    )
    return density.normalised(_density(study, points, n))


@query("k7_normalised_density")
def k7(spark, sf_dir):
    return _pair_density(spark, sf_dir).where(F.col("ndensity").isNotNull())


@query("k7b_normalised_all_components")
def k7b(spark, sf_dir):
    return _pair_density(spark, sf_dir, WHOLE_GRID)


@query("k7c_normalised_source_family")
def k7c(spark, sf_dir):
    return _pair_density(spark, sf_dir, WHOLE_GRID, SOURCE_PAIR)


@query("k8_parent_child")
def k8(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    wide = density.parent_child(study.staged_effects, "Source Site", "Family (RE)", 1.5)
    limits = density.axis_limits(study.staged_effects, "Source Site", "Family (RE)", 1.5)
    return wide.join(limits, "component")


@query("k9_measures")
def k9(spark, sf_dir):
    study = effect_study(spark, sf_dir)
    # Order on rounded values, so that ties and last digits do not decide it.
    table = rounded(effects.summary(study.staged_effects))
    return density.measures(table, [JOINT_SOURCE, JOINT_HOST])


# Contrast study ------------------------------------------------------------


@query("c1_cohort_one")
def c1(spark, sf_dir):
    return contrast.cohort1(star.raw_trials(spark, sf_dir))


@query("c2_cohort_two")
def c2(spark, sf_dir):
    return contrast.cohort2(star.raw_trials(spark, sf_dir))


class Question1(Study):
    """First contrast question: one source on two hosts, named additive candidates."""

    @property
    def trials(self):
        return contrast.cohort1_cells(contrast.cohort1(self.raw))

    @property
    def design_rows(self):
        return self._stage("design", lambda: fit.design_rows(self.cells, contrast.question1_sides(self.spark), {"host": "AFRICA"}))

    @property
    def fitted(self):
        return self._stage("fits", lambda: additive.fit_sides(self.design_rows, self.cells, contrast.question1_prior))

    @property
    def side_scores(self):
        return self._stage("side-scores", lambda: additive.additive_half_scores(self.classes, additive.cell_fits(self.design_rows, self.fitted)))

    @property
    def candidates(self):
        """The same side in both parts."""
        names = [(n, n, n) for n in contrast.QUESTION1_STACKED]
        return self.spark.createDataFrame(names, "model_name string, count_side string, hurdle_side string")

    @property
    def stacked(self):
        return self._stage("weights", lambda: weights.stack_pairs(self.side_scores, self.candidates, tol=self.tol), self.tol)


@query("c3_question_one_fits")
def c3(spark, sf_dir):
    return Question1(spark, sf_dir).fitted.select("side", "component", "term", "level", "value", (1 / F.col("precision")).alias("variance"), "converged")


@query("c3c_question_one_gradient", digits=4)
def c3c(spark, sf_dir):
    """Penalised gradient at the fits, summed anew by joins; zero at the mode."""
    study = Question1(spark, sf_dir)
    state = study.fitted.select("side", "component", "term", "level", "value", "precision")
    return fit.score_sweep(study.design_rows, study.cells, state).select("side", "component", "term", "level", "gradient")


@query("c3d_question_one_weights")
def c3d(spark, sf_dir):
    return weights.scaled(Question1(spark, sf_dir).stacked)


@query("c3e_question_one_optimality")
def c3e(spark, sf_dir):
    study = Question1(spark, sf_dir)
    found = additive.pair_optimality(study.side_scores, study.candidates, study.weights)
    return found.select("model_name", (F.col("gradient") <= 1 + 1e-6).alias("at_most_one"))


@query("c3b_question_two_fits")
def c3b(spark, sf_dir):
    return fit.fits(Question2(spark, sf_dir).stats)


def _question2_draws(study: Question2) -> DataFrame:
    """Pooled expected values of the best candidate and of the random-effect one."""
    from twofold.functions import rand

    table = weights.scaled(study.weights)
    shares = table.where(F.col("model_name").isin("Full", "Random Effect")).select(
        "model_name", F.bround(F.col("scaled") * F.lit(float(study.per_model))).cast("long").alias("n_draws")
    )
    pool = shares.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(study.per_model)))).where(
        F.col("draw") <= F.col("n_draws")
    )
    k = rand.key(
        "contrast", 9842892, F.col("form"), F.col("component"), F.col("role"), F.col("level"), F.col("draw")
    )
    value = F.col("loc") + rand.normal(k) * F.col("scale")
    values = pool.join(
        study.fits.withColumnRenamed("form", "model_name").withColumn("form", F.col("model_name")), "model_name"
    ).select("model_name", "draw", "component", "role", "level", value.alias("value"))
    groups = study.cells.select(
        "host_site", "different_species", F.inline(fit.form_groups(study.forms))
    ).select("host_site", "different_species", F.col("form").alias("model_name"), "role", "level")
    eta = groups.join(values, ["model_name", "role", "level"]).groupBy(
        "host_site", "different_species", "model_name", "draw", "component"
    ).agg(F.sum("value").alias("eta"))
    return eta.select(
        "host_site",
        "different_species",
        F.when(F.col("component") == "count", "Intensity").otherwise("Prevalence").alias("component"),
        F.when(F.col("component") == "count", truncated_mean(F.col("eta")))
        .otherwise(prevalence(F.col("eta")))
        .alias("value"),
    )


@query("c4_stacked_values")
def c4(spark, sf_dir):
    study = Question2(spark, sf_dir)
    values = contrast.species_label(_question2_draws(study))
    return quantiles.grouped_quantiles(
        values,
        ["host_site", "species", "component"],
        "value",
        EFFECT_PROBS,
        EFFECT_NAMES,
    )


@query("c5_observed_prevalence")
def c5(spark, sf_dir):
    return contrast.observed(contrast.cohort2(star.raw_trials(spark, sf_dir)))
