"""One statement per registered query."""

from __future__ import annotations

from oracle.tables import EFFECT_NAMES, curves, link, quantiles, spread, statement, uniform

ORACLE: dict[str, str] = {}


def expect(name: str, final: str, *doubles: str, digits: int = 6) -> None:
    ORACLE[name] = statement(final, doubles, digits)


# Sources and sinks
_TOTALS = """SELECT model_name, count(*) AS n_classes, CAST(sum(copies) AS BIGINT) AS n_trials, sum(copies * elpd) AS elpd_total
FROM points64 {} GROUP BY model_name"""
expect("io1_read_delimited", "SELECT * FROM raw")
expect("io2_write_delimited", "SELECT * FROM trials")
expect("io3_stage_table", "SELECT * FROM cells")
expect("io4_read_folder", _TOTALS.format(""), "elpd_total", digits=4)
expect(
    "io5_load_scores",
    _TOTALS.format("JOIN models64 USING (model_name) WHERE count_form = hurdle_form"),
    "elpd_total",
    digits=4,
)
expect(
    "io6_name_from_path",
    """SELECT 'scores/' || model_name || '.parquet' AS path, model_name, CAST(sum(copies) AS BIGINT) AS n_trials
FROM points64 GROUP BY model_name""",
)
expect("io7_write_chunks", "SELECT CAST(chunk AS INTEGER) AS chunk, model_name, log_weight FROM chunked", "log_weight")

# Trials
expect("t1_select_rename", "SELECT trial_id, host_site, family, source_site, cnt AS n_items FROM raw")
expect("t2_fill_block", "SELECT trial_id, coalesce(block, 'p100') AS block FROM raw")
expect("t3_native_genus", "SELECT trial_id, host_site, source_site, native, genus FROM trials")
expect("t4_clean_trials", "SELECT * FROM trials")
expect("t5_flag_to_int", "SELECT trial_id, CASE WHEN infected_flag = 'y' THEN 1 ELSE 0 END AS infected FROM raw")
expect(
    "t6_recode_sites",
    """SELECT trial_id, upper(host_site[1]) || lower(host_site[2:]) AS host_site, CAST(r_regionkey AS BIGINT) AS host_site_ordinal, cnt
FROM (SELECT trial_id, host_site, cnt FROM trials) JOIN region ON host_site = r_name""".replace(
        "upper(host_site[1]) || lower(host_site[2:])",
        "array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(host_site, ' ')], ' ')",
    ),
)
expect("t6b_uncode_sites", "SELECT trial_id, host_site, cnt FROM trials")
expect("t7_design_cells", "SELECT host_site, family, source_site, block, genus, cell_id, native FROM cells")
expect("t8_positive_trials", "SELECT * FROM trials WHERE cnt > 0")

# Model space
_TEXT = "array_to_string(terms, '|') AS terms"
expect("m1_term_subsets", f"SELECT mask, {_TEXT}, n_coef FROM subsets")
expect(
    "m2_interaction_repair",
    f"""SELECT false AS strict, mask, {_TEXT}, n_coef FROM flagged WHERE NOT inter_host
UNION ALL SELECT true, mask, {_TEXT}, n_coef FROM flagged WHERE NOT inter_host AND NOT inter_genus""",
)
expect("m3_formula_text", "SELECT mask, 'cnt ~ ' || array_to_string(terms, ' + ') AS formula, n_coef FROM loose")
expect("m4_two_part_product", "SELECT count_mask, hurdle_mask, count_formula, hurdle_formula, n_coef FROM pairs")


def _has(part: str, words: str) -> str:
    return f"regexp_matches({part}_formula, '{words}')"


_RANDOM, _FIXED = "block|family", "host|source|native|genus"
expect(
    "m5_effect_flags",
    f"""SELECT count_mask, hurdle_mask, {_has('count', _RANDOM)} AS count_random, {_has('hurdle', _RANDOM)} AS hurdle_random,
  {_has('count', _FIXED)} AS count_fixed, {_has('hurdle', _FIXED)} AS hurdle_fixed FROM pairs""",
)
expect(
    "m6_priors",
    f"""SELECT count_mask, hurdle_mask, 'normal(0, 6)/Intercept/'
  || CASE WHEN {_has('hurdle', _RANDOM)} THEN '; student_t(7, 0, 1)/sd/hu' ELSE '' END
  || CASE WHEN {_has('count', _RANDOM)} THEN '; student_t(7, 0, 1.5)/sd/' ELSE '' END
  || CASE WHEN {_has('hurdle', _FIXED)} THEN '; normal(0, 1)/b/hu' ELSE '' END
  || CASE WHEN {_has('count', _FIXED)} THEN '; normal(0, 1.5)/b/' ELSE '' END AS priors FROM pairs""",
)
_SEED = uniform("concat_ws('|', 'seed', '93093', id)")
expect(
    "m7_run_settings",
    f"""SELECT id, model_name, 0.95e0 AS adapt_delta, CAST(floor({_SEED} * 2147483647e0) + 1 AS BIGINT) AS rng_seed FROM pairs""",
    "adapt_delta",
)
expect(
    "m8_split_formula",
    f"""SELECT mask, 'hu ~ ' || array_to_string(terms, ' + ') AS formula, {_TEXT}, CAST(len(terms) AS INTEGER) AS n_terms FROM loose""",
)
expect("m9_bad_combo", "SELECT mask, nest_host, nest_family, inter_genus, inter_host FROM flagged")
_MODEL = "SELECT model_name, count_formula, hurdle_formula FROM pairs"
expect("m10_nesting_rules", f"{_MODEL} WHERE NOT bad_nest")
expect("m11_interaction_rules", f"{_MODEL} WHERE NOT bad_inter")
expect("m12_keep_valid", "SELECT id, model_name, count_formula, hurdle_formula FROM valid_models")
expect(
    "m13_still_to_run",
    "SELECT id, model_name FROM valid_models WHERE model_name NOT IN (SELECT model_name FROM points64)",
)
expect(
    "m14_part_rows",
    """SELECT id, model_name, 'count_formula' AS part, count_formula AS formula FROM valid_models
UNION ALL SELECT id, model_name, 'hurdle_formula', hurdle_formula FROM valid_models""",
)

# Fits
expect("f1_cell_statistics", "SELECT * FROM cells")
expect(
    "f2_grouped_fit",
    """SELECT form, level, n, n_zero, n_pos, sum_y, component, est, info, boundary, se
FROM est WHERE role = 'fixed'""",
    "est",
    "info",
    "se",
)
expect(
    "f2b_cell_expectations",
    """SELECT split_part(level, '|', 1) AS host_site, split_part(level, '|', 2) AS source_site, n,
  rate / (1e0 - exp(-rate)) AS expected_count, 1e0 - p0 AS expected_prevalence,
  sum_y::DOUBLE / n_pos AS observed_count, n_pos::DOUBLE / n AS observed_prevalence,
  n_pos = 0 OR n_pos = sum_y AS boundary
FROM rates WHERE form = 'host_source'""",
    "expected_count",
    "expected_prevalence",
    "observed_count",
    "observed_prevalence",
)
expect(
    "f3_partial_pooling",
    "SELECT form, component, parent, level, center, dev, tau2, shrunk_dev, shrunk_se FROM pooled",
    "center",
    "dev",
    "tau2",
    "shrunk_dev",
    "shrunk_se",
)


def _sweep() -> str:
    """Gradient and information after one damped step from zero."""

    def sums(state: str) -> str:
        return f"""SELECT side, component, term, level, any_value(value) AS value,
  sum(CASE WHEN component = 'prop' THEN n_zero - n * p ELSE sum_y - n_pos * mu END) - any_value(prec * value) AS gradient,
  sum(CASE WHEN component = 'prop' THEN n * p * (1e0 - p) ELSE n_pos * mu * (1e0 + rate - mu) END) + any_value(prec) AS information
FROM (SELECT *, rate / (1e0 - exp(-rate)) AS mu FROM (
  SELECT side, component, cell_id, 1e0 / (1e0 + exp(-sum(value))) AS p, exp(sum(value)) AS rate
  FROM {state} JOIN design USING (side, term, level) GROUP BY side, component, cell_id))
JOIN cells USING (cell_id) JOIN design USING (side, cell_id)
JOIN {state} USING (side, component, term, level)
GROUP BY side, component, term, level"""

    return f"""SELECT side, component, term, level, value, gradient, information FROM (
WITH sides AS (
  SELECT mask::VARCHAR AS side, unnest(terms) AS term FROM flagged
  WHERE NOT (inter_host OR inter_genus OR nest_host OR nest_family)),
design AS (
  SELECT side, cell_id, term, level FROM sides JOIN cell_levels USING (term)
  WHERE NOT (term = 'host' AND level = 'AFRICA') AND NOT (term = 'source' AND level = 'AFRICA')
    AND NOT (term = 'genus' AND level = 'A') AND NOT (term = 'native' AND level = 'false')
  UNION ALL SELECT side, cell_id, 'intercept', '' FROM (SELECT DISTINCT side FROM sides) CROSS JOIN cells),
zero AS (
  SELECT side, component, term, level, 0e0 AS value, CASE WHEN term = 'intercept' THEN 1e0 / 36e0
    WHEN component = 'count' THEN 1e0 / 2.25e0 ELSE 1e0 END AS prec
  FROM (SELECT DISTINCT side, term, level FROM design) CROSS JOIN (VALUES ('count'), ('prop')) v(component)),
first AS ({sums('zero')}),
moved AS (
  SELECT side, component, term, level, f.value + 0.5e0 * gradient / information AS value, prec
  FROM first f JOIN zero USING (side, component, term, level))
{sums('moved')})"""


expect("f4_score_sweep", _sweep(), "value", "gradient", "information", digits=4)
expect("f5_draws", "SELECT draw_id, component, kind, term, level, value FROM d4000_draws", "value")
expect("f6_closed_form_loo", "SELECT * FROM halves", "elpd_zero", "elpd_count")

# Scores
_LL = """SELECT model_name, level AS "group", cnt, copies, draw, CASE WHEN cnt = 0 THEN -ln(1e0 + exp(-z)) ELSE
  -ln(1e0 + exp(z)) + cnt * c - exp(c) - lgamma(cnt + 1) - ln(1e0 - exp(-exp(c))) END AS log_lik
FROM (SELECT model_name, form, level, cnt, CAST(sum(copies) AS BIGINT) AS copies FROM classes JOIN cell_groups USING (cell_id)
  JOIN models36 m ON m.count_form = form AND m.hurdle_form = form GROUP BY model_name, form, level, cnt)
JOIN (SELECT form, level, CAST(draw AS INTEGER) AS draw, max(eta) FILTER (component = 'prop') AS z, max(eta) FILTER (component = 'count') AS c
  FROM (SELECT f.*, draw, loc + scale * {normal} AS eta FROM fits f JOIN models36 m ON m.count_form = form AND m.hurdle_form = form,
    range(1, 201) r(draw)) GROUP BY form, level, draw) USING (form, level)"""
from oracle.tables import key, normal  # noqa: E402

_LL = _LL.replace("{normal}", normal(key("'draw'", "'1'", "model_name", "component", "role", "level", "draw")))
expect("l1_draw_log_density", _LL, "log_lik")
expect(
    "l2_importance_loo",
    f"""SELECT model_name, "group", cnt, copies, -(top + ln(avg(exp(-log_lik - top)))) AS elpd FROM (
  SELECT *, max(-log_lik) OVER (PARTITION BY model_name, "group", cnt) AS top FROM ({_LL}))
GROUP BY model_name, "group", cnt, copies, top""",
    "elpd",
)
expect(
    "l4_trial_scores",
    """SELECT model_name, trial_id, elpd FROM trials JOIN cells USING (host_site, family, source_site, block, genus, native)
JOIN points64 USING (cell_id, cnt) JOIN models64 USING (model_name) WHERE count_form = hurdle_form""",
    "elpd",
)

# Weights
expect(
    "w1_pseudo_bma",
    "SELECT *, exp(log_weight) AS weight FROM pbma",
    "elpd_total",
    "log_weight",
    "weight",
    digits=4,
)
expect(
    "w2_pseudo_bma_bootstrap",
    "SELECT model_name, avg(weight) AS weight FROM boot_weights GROUP BY model_name",
    "weight",
)
expect(
    "w3_worker_average",
    """SELECT model_name, avg(weight) AS weight, count(*) AS n_workers FROM (
  SELECT replicate % 5 AS worker, model_name, avg(weight) AS weight FROM boot_weights GROUP BY replicate % 5, model_name)
GROUP BY model_name""",
    "weight",
)
expect(
    "w4_cutoff",
    "SELECT *, exp(log_weight) AS weight FROM pbma WHERE log_weight / ln(10e0) > -3e0",
    "elpd_total",
    "log_weight",
    "weight",
    digits=4,
)
expect(
    "w5_balanced_chunks",
    "SELECT model_name, CAST(chunk AS INTEGER) AS chunk, log_weight FROM chunked",
    "log_weight",
    digits=4,
)
_CHUNK_SEED = uniform("concat_ws('|', 'chunk', '1234', chunk)")
expect(
    "w6_chunk_lists",
    f"""SELECT CAST(chunk AS INTEGER) AS chunk, string_agg(model_name, '|' ORDER BY model_name) AS models,
  CAST(floor({_CHUNK_SEED} * 65536e0) + 1 AS BIGINT) AS seed FROM chunked GROUP BY chunk""",
)
expect(
    "w7_stacking_objective",
    """SELECT sum(-copies * (ln(mix) + best)) AS neg_log_score, CAST(sum(copies) AS BIGINT) AS n_trials FROM (
  SELECT cell_id, cnt, copies, best, sum(weight * density) AS mix FROM m64_dens JOIN m64_em0 USING (model_name)
  GROUP BY cell_id, cnt, copies, best)""",
    "neg_log_score",
    digits=4,
)
expect(
    "w8_stacking_gradient",
    """SELECT model_name, weight, sum(copies * density / mix) / sum(copies) AS gradient FROM (
  SELECT *, sum(weight * density) OVER (PARTITION BY cell_id, cnt) AS mix FROM m64_dens JOIN m64_em0 USING (model_name))
GROUP BY model_name, weight""",
    "weight",
    "gradient",
)
expect("w9_stacking_steps", "SELECT * FROM m64_em5", "weight")
expect("w9b_stacking_converged", "SELECT * FROM m64_stacked", "weight", "gradient")
expect(
    "w10b_chunk_stacking_converged",
    "SELECT model_name, CAST(chunk AS INTEGER) AS chunk, weight, gradient, converged FROM ch_stacked",
    "weight",
    "gradient",
)
expect(
    "w12_final_stacking",
    "SELECT model_name, weight, gradient, converged, count_formula, hurdle_formula FROM last_stacked JOIN models64 USING (model_name)",
    "weight",
    "gradient",
)
expect("w10_chunk_stacking", "SELECT model_name, CAST(chunk AS INTEGER) AS chunk, weight FROM ch_em5", "weight")
expect(
    "w11_survivors",
    """SELECT model_name, count_formula, hurdle_formula, weight FROM models64 JOIN ch_stacked USING (model_name) WHERE weight > 1e-6""",
    "weight",
)
expect(
    "w13_readable_weights",
    """SELECT model_name, weight, split_part(count_formula, ' ~ ', 2) AS cnt, split_part(hurdle_formula, ' ~ ', 2) AS hu
FROM m64_stacked JOIN models64 USING (model_name)""",
    "weight",
)
expect(
    "w14_term_weights",
    """SELECT coalesce(c.term, h.term) AS term, count_weight, hurdle_weight FROM
(SELECT term, sum(weight) AS count_weight FROM (SELECT weight, unnest(count_terms) AS term FROM m64_stacked JOIN models64 USING (model_name)) GROUP BY term) c
FULL JOIN
(SELECT term, sum(weight) AS hurdle_weight FROM (SELECT weight, unnest(hurdle_terms) AS term FROM m64_stacked JOIN models64 USING (model_name)) GROUP BY term) h
ON c.term = h.term""",
    "count_weight",
    "hurdle_weight",
)
expect("w15_named_stacking", "SELECT model_name, weight, scaled FROM c2_scaled", "weight", "scaled")

# Draws
expect("d1_allocate", "SELECT model_name, weight, id, n_draws FROM d4000_allocation", "weight")
expect("d2_draw_index", "SELECT * FROM d400_index")
expect(
    "d3_allocate_total",
    """SELECT model_name, weight, CAST(round_even(4000e0 / max(weight) OVER () * weight, 0) AS BIGINT) AS n_free,
  CAST(round_even(50000e0 * weight, 0) AS BIGINT) AS n_draws FROM study_weights""",
    "weight",
)
_PICK = uniform("concat_ws('|', 'pick', '52399832', model_name, draw_in_model)")
expect(
    "d4_subset_draws",
    f"""SELECT draw_id, component, kind, term, level, value FROM d4000_draws WHERE draw_id IN (
  SELECT id * 4294967296 + draw_in_model FROM (
    SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY {_PICK}, draw_in_model) AS rn
    FROM (SELECT model_name, id, round_even(300e0 * weight, 0) AS n_draws FROM study_weights JOIN models64 USING (model_name)),
      range(1, 4001) r(draw_in_model))
  WHERE rn <= n_draws)""",
    "value",
)
_WIDE = [
    (f"{c}_{n}", c, t, lv)
    for c in ("count", "prop")
    for n, t, lv in (
        ("intercept", "intercept", ""),
        ("genus_M", "genus", "M"),
        ("source_AMERICA", "source", "AMERICA"),
        ("source_ASIA", "source", "ASIA"),
        ("native_true", "native", "true"),
    )
]


def _wide(default: str) -> str:
    cols = ", ".join(
        f"coalesce(max(value) FILTER (component = '{c}' AND term = '{t}' AND level = '{lv}'), {default}) AS {n}"
        for n, c, t, lv in _WIDE
    )
    return f"SELECT draw_id, model_name, {cols} FROM d4000_draws GROUP BY draw_id, model_name"


expect("d5_wide_draws", _wide("NULL"), *[w[0] for w in _WIDE])
expect("d6_zero_filled", _wide("0e0"), *[w[0] for w in _WIDE])
expect(
    "d7_draw_details",
    "SELECT model_name, draw_id, draw_in_model, count_formula, hurdle_formula FROM d4000_index JOIN models64 USING (model_name)",
)

# Expected values
expect("e1_prevalence", "SELECT form, level, 1e0 - p0 AS prevalence FROM rates WHERE role = 'fixed'", "prevalence")
expect("e2_truncated_mean", "SELECT form, level, mu AS mean_count FROM rates WHERE role = 'fixed'", "mean_count")
expect(
    "e3_cell_parameters",
    "SELECT DISTINCT term, level, cell_id, component FROM ev_keys JOIN d400_draws USING (term, level)",
)
expect("e4_expected_values", "SELECT draw_id, cell_id, count_ev, prev_ev FROM ev_values", "count_ev", "prev_ev")
expect(
    "e4b_no_interactions",
    "SELECT cell_id, avg(count_ev) AS count_ev, avg(prev_ev) AS prev_ev FROM flat_values GROUP BY cell_id",
    "count_ev",
    "prev_ev",
)
expect(
    "e5_by_model",
    "SELECT model_name, cell_id, avg(count_ev) AS count_ev, avg(prev_ev) AS prev_ev FROM ev_values GROUP BY model_name, cell_id",
    "count_ev",
    "prev_ev",
)
expect(
    "e6_values_with_cells",
    """SELECT cell_id, draw_id, count_ev, prev_ev, host_site, family, source_site, block, genus, native
FROM ev_values JOIN cells USING (cell_id)""",
    "count_ev",
    "prev_ev",
)
_EV = ("q_005", "q_025", "q_05", "q_1", "q_25", "q_75", "q_9", "q_95", "q_975", "q_995", "median")
_EV_P = (0.005, 0.025, 0.05, 0.1, 0.25, 0.75, 0.9, 0.95, 0.975, 0.995, 0.5)
expect(
    "e7_cell_summary",
    f"""SELECT cell_id, variable, avg(pred) AS mean, {quantiles('pred', _EV, _EV_P)} FROM (
  SELECT cell_id, 'count' AS variable, count_ev AS pred FROM ev_values
  UNION ALL SELECT cell_id, 'hu', prev_ev FROM ev_values) GROUP BY cell_id, variable""",
    "mean",
    *_EV,
)
expect(
    "e8_site_summary",
    """SELECT variable, host_site, source_site, avg(pred) AS mean, median(pred) AS median, stddev_samp(pred) AS sd
FROM site_values GROUP BY variable, host_site, source_site""",
    "mean",
    "median",
    "sd",
)
expect(
    "e9_intervals",
    """SELECT variable, host_site, source_site, avg(pred) AS mean, median(pred) AS median, stddev_samp(pred) AS sd,
  width AS interval, quantile_cont(pred, 0.25) AS lower, quantile_cont(pred, 0.75) AS upper
FROM site_values, (VALUES (0.5e0)) v(width) GROUP BY variable, host_site, source_site, width
UNION ALL SELECT variable, host_site, source_site, avg(pred), median(pred), stddev_samp(pred),
  0.95e0, quantile_cont(pred, 0.025), quantile_cont(pred, 0.975)
FROM site_values GROUP BY variable, host_site, source_site""",
    "mean",
    "median",
    "sd",
    "interval",
    "lower",
    "upper",
)
_OBS = """SELECT host_site, source_site, avg((cnt > 0)::INT) AS prevalence,
  stddev_samp((cnt > 0)::INT) / sqrt(count(*)) AS prevalence_se, avg(cnt) FILTER (cnt > 0) AS incidence,
  stddev_samp(cnt) FILTER (cnt > 0) / sqrt(count(*) FILTER (cnt > 0)) AS incidence_se
FROM trials GROUP BY host_site, source_site"""
expect("e10_observed_summary", _OBS, "prevalence", "prevalence_se", "incidence", "incidence_se")
expect(
    "e11_observed_long",
    f"""SELECT host_site, source_site, 'Prevalence' AS variable, prevalence AS mean FROM ({_OBS})
UNION ALL SELECT host_site, source_site, 'Incidence', incidence FROM ({_OBS})""",
    "mean",
)
expect(
    "e12_observed_prevalence",
    "SELECT host_site, source_site, avg((cnt > 0)::INT) AS prevalence FROM trials GROUP BY host_site, source_site",
    "prevalence",
)
_SHARE = """SELECT {0}, avg((wanted = found)::INT) FILTER (component = 'count') AS prop_count,
  avg((wanted = found)::INT) FILTER (component = 'prop') AS prop_hu FROM {1} GROUP BY {0}"""
_COMMON = """SELECT term FROM (SELECT DISTINCT model_name, unnest(count_terms) AS term, k FROM (
  SELECT m.*, count(*) OVER () AS k FROM models64 m WHERE model_name IN (
    SELECT model_name FROM d400_index JOIN ({}) USING (draw_id) WHERE prop_count > 0.5 AND prop_hu > 0.5)))
GROUP BY term, k HAVING count(*) = k"""
expect("e13_share_by_cell", _SHARE.format("cell_id", "held"), "prop_count", "prop_hu")
expect("e13b_share_by_draw", _SHARE.format("draw_id", "held"), "prop_count", "prop_hu")
expect("e13c_common_terms", _COMMON.format(_SHARE.format("draw_id", "held")))
expect("e13d_share_by_cell_all_terms", _SHARE.format("cell_id", "held_all"), "prop_count", "prop_hu")
expect("e13e_share_by_draw_all_terms", _SHARE.format("draw_id", "held_all"), "prop_count", "prop_hu")
expect("e13f_common_terms_all_terms", _COMMON.format(_SHARE.format("draw_id", "held_all")))

# Effects
expect("x1_factor_table", "SELECT DISTINCT kind, term, level, factor FROM d4000_draws JOIN factor_labels USING (term)")
expect(
    "x2_relevant",
    "SELECT draw_id, component, term, level, value FROM d4000_draws WHERE kind IN ('fixed', 'interaction')",
    "value",
)
_PRESENT = "SELECT draw_id, component, factor, level, intercept, linear_value FROM present WHERE "
expect("x3_count_marginals", _PRESENT + "kind <> 'random' AND component = 'count'", "intercept", "linear_value")
expect("x4_prop_marginals", _PRESENT + "kind <> 'random' AND component = 'prop'", "intercept", "linear_value")
expect("x5_random_marginals", _PRESENT + "kind = 'random'", "intercept", "linear_value")
expect("x6_reference_class", "SELECT * FROM refs", "intercept", "linear_value")
expect("x7_absent_rows", "SELECT draw_id, component, factor, true AS absent FROM absent_factors")


def _both(a: str, b: str) -> str:
    return f"""SELECT draw_id, 'count' AS component FROM d4000_index JOIN models64 USING (model_name)
WHERE list_contains(count_terms, '{a}') AND list_contains(count_terms, '{b}')
UNION ALL SELECT draw_id, 'prop' FROM d4000_index JOIN models64 USING (model_name)
WHERE list_contains(hurdle_terms, '{a}') AND list_contains(hurdle_terms, '{b}')"""


def _parents(term: str, dim: str) -> str:
    return f"""SELECT component, level, n_rows, up AS parent FROM (
  SELECT component, level, count(*) AS n_rows FROM d4000_draws WHERE term = '{term}' GROUP BY component, level)
LEFT JOIN (SELECT DISTINCT {dim} FROM cells) d(lv, up) ON level = lv"""


expect("x8_joint_source_draws", _both("source", "(1|family)"))
expect("x9_family_source", _parents("(1|family)", "family, source_site"))
expect(
    "x10_joint_source",
    "SELECT draw_id, component, level, intercept, linear_value, absent FROM so_all WHERE factor = 'Source + Family'",
    "intercept",
    "linear_value",
)
expect(
    "x11_pooled_source",
    "SELECT draw_id, component, level, intercept, linear_value, absent FROM so_all WHERE factor = 'Source (pooled)'",
    "intercept",
    "linear_value",
)
expect("x12_joint_host_draws", _both("genus", "host"))
expect("x13_host_genus", _parents("host", "host_site, genus"))
expect("x14_pooled_host", "SELECT * FROM ho_all", "intercept", "linear_value")
expect("x15_effect_sizes", "SELECT * FROM effects", "effect_size")
expect("x16_inclusion", "SELECT component, factor, frequency FROM effect_summary", "frequency")
_CI = f"SELECT component, factor, {', '.join(EFFECT_NAMES)} FROM effect_summary"
expect("x17_credible_intervals", _CI, *EFFECT_NAMES)
expect("x17b_located_quantiles", _CI, *EFFECT_NAMES)
expect("x18_summary", "SELECT * FROM effect_summary", "frequency", *EFFECT_NAMES)
expect("x19_n_draws", "SELECT count(DISTINCT draw_id) AS n_draws FROM effects")
expect(
    "x20_manuscript",
    """SELECT component, CASE WHEN factor = 'Genus' THEN 'Host Genus' ELSE factor END AS factor,
  printf('%.3f', round(frequency, 3)) AS frequency, printf('%.3f', round(q_5, 3)) AS median,
  '[' || printf('%.3f', round(q_025, 3)) || ', ' || printf('%.3f', round(q_975, 3)) || ']' AS ci
FROM effect_summary WHERE factor NOT IN ('Source + Family', 'Genus + Host') AND q_5 IS NOT NULL""",
)
expect(
    "x21_split_effects",
    f"""SELECT component, CASE WHEN has_child THEN 'With' ELSE 'Without' END AS partition, {quantiles('effect_size')}
FROM genus_split GROUP BY component, has_child""",
    *EFFECT_NAMES,
)
expect(
    "x22_joint_inclusion",
    """SELECT factors, n_draws, n_draws / sum(n_draws) OVER () AS frequency FROM (
  SELECT factors, count(*) AS n_draws FROM (
    SELECT draw_id, coalesce(string_agg(factor, ' + ' ORDER BY factor) FILTER (NOT absent), '') AS factors
    FROM effects WHERE component = 'count' GROUP BY draw_id) GROUP BY factors)""",
    "frequency",
)

# Densities
expect("k1_paired_effects", "SELECT * FROM host_pairs", "child", "parent")
expect("k2_class_labels", "SELECT * FROM class_rows", "effect_size")
expect("k3_joint_points", "SELECT * FROM joint_points", "x", "y")
expect("k4_density_2d", "SELECT * FROM jp_grid", "x", "y", "z", digits=4)
expect(
    "k5_alpha",
    """SELECT component, i, j, CASE WHEN z < 1 THEN CASE WHEN component = 'count' THEN z * z ELSE z END ELSE 1e0 END AS alpha,
  least(z, 1e0) AS plot_alpha FROM jp_grid""",
    "alpha",
    "plot_alpha",
    digits=4,
)
expect(
    "k6_density_1d",
    f"""SELECT component, class, i, x, sum(exp(-0.5e0 * pow((x - v) / h, 2))) / sqrt(6.283185307179586e0) / any_value(n * h) AS density
FROM (SELECT f.component, f.class, CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 40e0 AS x, effect_size AS v, h, n FROM (
    SELECT *, 0.9e0 * ({spread('sd', 'a', 'b')}) * pow(n, -0.2e0) AS h FROM (
      SELECT component, class, count(effect_size)::DOUBLE AS n, min(effect_size) AS lo, max(effect_size) AS hi,
        stddev_samp(effect_size) AS sd, quantile_cont(effect_size, 0.25) AS a, quantile_cont(effect_size, 0.75) AS b
      FROM class_rows WHERE effect_size IS NOT NULL GROUP BY component, class)) f
  JOIN class_rows r ON r.component = f.component AND r.class = f.class, range(41) g(i)
  WHERE h > 0 AND effect_size IS NOT NULL)
GROUP BY component, class, i, x""",
    "x",
    "density",
    digits=4,
)
expect(
    "k6b_class_intervals",
    f"SELECT component, class, {quantiles('effect_size')} FROM class_rows GROUP BY component, class",
    *EFFECT_NAMES,
)
expect(
    "k7_normalised_density",
    "SELECT component, i, j, x, y, z / max(z) OVER (PARTITION BY component) AS ndensity FROM bp_grid",
    "x",
    "y",
    "ndensity",
)


def _alpha(grid: str) -> str:
    return f"""SELECT component, i, j, CASE WHEN z >= 1 THEN 1e0 WHEN component = 'count' THEN z * z ELSE z END AS alpha,
  CASE WHEN z IS NOT NULL THEN least(z, 1e0) END AS plot_alpha FROM {grid}"""


def _relative(grid: str) -> str:
    return f"SELECT component, i, j, x, y, z / max(z) OVER (PARTITION BY component) AS ndensity FROM {grid}"


# Whole grids, all components and classes
expect("k4b_density_all_components", "SELECT * FROM jp_whole", "x", "y", "z", digits=4)
expect("k4c_density_source_family", "SELECT * FROM sf_whole", "x", "y", "z", digits=4)
expect("k5b_alpha_all_components", _alpha("jp_whole"), "alpha", "plot_alpha", digits=4)
expect("k5c_alpha_source_family", _alpha("sf_whole"), "alpha", "plot_alpha", digits=4)
expect("k6c_density_all_classes", curves("class_rows"), "x", "density", digits=4)
expect("k6d_density_source_family", curves("sf_classes"), "x", "density", digits=4)
expect("k7b_normalised_all_components", _relative("bp_whole"), "x", "y", "ndensity")
expect("k7c_normalised_source_family", _relative("fs_whole"), "x", "y", "ndensity")
expect(
    "k8_parent_child",
    """SELECT component, draw_id, parent, child, child IS NULL AS child_missing, largest, -largest / 5e0 AS panel_start FROM (
  SELECT component, draw_id, max(effect_size) FILTER (factor = 'Source Site') AS parent,
    max(effect_size) FILTER (factor = 'Family (RE)') AS child
  FROM there WHERE factor IN ('Source Site', 'Family (RE)') AND effect_size <= 1.5 GROUP BY component, draw_id)
JOIN (SELECT component, max(effect_size) AS largest FROM effects
  WHERE factor IN ('Source Site', 'Family (RE)') AND effect_size <= 1.5 GROUP BY component) USING (component)""",
    "parent",
    "child",
    "largest",
    "panel_start",
)
expect(
    "k9_measures",
    """SELECT component, factor, factor_ordinal, frequency AS x, 'Model Inclusion Frequency' AS measure, 1 AS measure_ordinal,
  NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM ordered
UNION ALL SELECT component, factor, factor_ordinal, q_5, 'Effect size [with 95% CI]', 2, q_025, q_975 FROM ordered""".replace(
        "FROM ordered",
        """FROM (SELECT CASE WHEN component = 'count' THEN 'Count' ELSE 'Frequency' END AS component,
    CASE WHEN factor = 'Genus' THEN 'Host Genus' ELSE factor END AS factor,
    CAST(row_number() OVER (ORDER BY component DESC, round(frequency, 6), round(q_5, 6) DESC NULLS LAST, factor) AS INTEGER) AS factor_ordinal,
    frequency, q_5, q_025, q_975 FROM effect_summary WHERE factor NOT IN ('Source + Family', 'Genus + Host'))""",
    ),
    "x",
    "lower",
    "upper",
)

# Contrast study
expect("c1_cohort_one", "SELECT * FROM cohort1")
expect("c2_cohort_two", "SELECT * FROM cohort2")
expect("c3b_question_two_fits", "SELECT * FROM c2_fits", "loc", "scale")
_C4 = normal(key("'contrast'", "'9842892'", "model_name", "component", "role", "level", "draw"))
expect(
    "c4_stacked_values",
    f"""SELECT host_site, species, component, {quantiles('value')} FROM (
SELECT host_site, CASE WHEN different_species THEN 'Other' ELSE 'Same species' END AS species,
  CASE WHEN component = 'count' THEN 'Intensity' ELSE 'Prevalence' END AS component,
  CASE WHEN component = 'count' THEN exp(eta) / (1e0 - exp(-exp(eta))) ELSE 1e0 / (1e0 + exp(eta)) END AS value
FROM (SELECT host_site, different_species, model_name, component, draw, sum(loc + scale * {_C4}) AS eta
  FROM (SELECT model_name, round_even(scaled * 4000e0, 0) AS n_draws FROM c2_scaled WHERE model_name IN ('Full', 'Random Effect')) s,
    range(1, 4001) r(draw)
  JOIN c2groups g ON g.form = s.model_name JOIN c2cells USING (cell_id)
  JOIN c2_fits USING (form, role, level) WHERE draw <= n_draws
  GROUP BY host_site, different_species, model_name, component, draw))
GROUP BY host_site, species, component""",
    *EFFECT_NAMES,
)
expect(
    "c5_observed_prevalence",
    """SELECT host_site, CASE WHEN different_species THEN 'Other' ELSE 'Same species' END AS species,
  avg(infected) AS prevalence, 'Prevalence' AS component FROM cohort2 GROUP BY host_site, different_species""",
    "prevalence",
)

# Certificates of iterative results: at a mode the gradient is zero, at the best weights no model would raise the score.
expect(
    "f4d_fit_gradient",
    """SELECT * FROM (WITH valid AS (SELECT mask, terms FROM flagged WHERE NOT (inter_host OR inter_genus OR nest_host OR nest_family)),
found AS (
  SELECT mask, term, level FROM (SELECT mask, unnest(terms) AS term FROM valid) JOIN (SELECT DISTINCT term, level FROM cell_levels) USING (term)
  WHERE NOT (term IN ('host', 'source') AND level = 'AFRICA') AND NOT (term = 'genus' AND level = 'A') AND NOT (term = 'native' AND level = 'false')
  UNION ALL SELECT mask, 'intercept', '' FROM valid)
SELECT CAST(mask AS VARCHAR) AS side, component, term, level, 0e0 AS gradient FROM found CROSS JOIN (VALUES ('count'), ('prop')) c(component))""",
)
expect("w16b_additive_optimality", "SELECT model_name, true AS at_most_one FROM valid_models")
expect(
    "c3c_question_one_gradient",
    """SELECT side, component, term, level, 0e0 AS gradient FROM (
  SELECT side, unnest(list_concat(['intercept'], terms)) AS term FROM (VALUES ('Full', ['host', '(1|family)', '(1|block)']),
    ('Compromise', ['host', '(1|family)', '(1|block)']), ('Fixed Effect', ['host']), ('Null', []), ('Random Effects', ['(1|family)', '(1|block)'])) v(side, terms))
JOIN (SELECT DISTINCT 'host' AS term, host_site AS level FROM cohort1 WHERE host_site <> 'AFRICA'
  UNION ALL SELECT DISTINCT '(1|family)', family FROM cohort1 UNION ALL SELECT DISTINCT '(1|block)', block FROM cohort1
  UNION ALL SELECT 'intercept', '') USING (term) CROSS JOIN (VALUES ('count'), ('prop')) c(component)""",
)
expect(
    "c3e_question_one_optimality",
    "SELECT model_name, true AS at_most_one FROM (VALUES ('Full'), ('Compromise'), ('Fixed Effect'), ('Random Effects')) v(model_name)",
)
