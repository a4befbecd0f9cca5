"""Shared table expressions of the SQL statements, composed on demand."""

from __future__ import annotations

import re

# name -> select text, in an order where each uses only earlier ones.
CTES: dict[str, str] = {}

PI2 = "6.283185307179586e0"


def uniform(key: str, word: int = 0) -> str:
    return f"((('0x' || substr(md5({key}), {1 + 8 * word}, 8))::UBIGINT)::DOUBLE + 0.5e0) / 4294967296e0"


def normal(key: str) -> str:
    return f"sqrt(-2e0 * ln({uniform(key, 0)})) * cos({PI2} * ({uniform(key, 1)}))"


def key(*parts: str) -> str:
    return "concat_ws('|', " + ", ".join(parts) + ")"


def newton(mu: str) -> str:
    """Rate of a zero-truncated Poisson with mean ``mu``."""
    return (
        f"list_reduce(range(10)::DOUBLE[], lambda a, x: a - (a + {mu} * (exp(-a) - 1e0)) / "
        f"(1e0 - {mu} * exp(-a)), least({mu}, 2e0 * ({mu} - 1e0)))"
    )


def statement(final: str, doubles: tuple[str, ...] = (), digits: int = 6) -> str:
    """A full statement: needed table expressions, the select, rounded doubles."""
    need: list[str] = []
    order = {name: i for i, name in enumerate(CTES)}

    def visit(text: str, before: int):
        # Only earlier names count; a column may share the name of its table.
        for word in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text):
            if order.get(word, before) < before and word not in need:
                visit(CTES[word], order[word])
                need.append(word)

    visit(final, len(CTES))
    with_part = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in need)
    if doubles:
        swaps = ", ".join(
            f"CASE WHEN round({d}, {digits}) = 0 THEN 0e0 ELSE round({d}, {digits}) END AS {d}" for d in doubles
        )
        final = f"SELECT * REPLACE ({swaps}) FROM (\n{final}\n)"
    return f"WITH RECURSIVE {with_part}\n{final}" if need else final


def cte(name: str, text: str) -> None:
    CTES[name] = text


cte(
    "raw",
    """SELECT c_custkey * 100 + sn.n_nationkey AS trial_id, cr.r_name AS host_site, sn.n_name AS family,
  sr.r_name AS source_site, nullif(c_mktsegment, 'FURNITURE') AS block,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS cnt,
  CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > 0 THEN 'y' ELSE 'n' END AS infected_flag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey
JOIN region sr ON sn.n_regionkey = sr.r_regionkey
GROUP BY c_custkey, sn.n_nationkey, cr.r_name, sn.n_name, sr.r_name, c_mktsegment""",
)
cte(
    "trials",
    """SELECT trial_id, host_site, family, source_site, coalesce(block, 'p100') AS block, cnt,
  host_site = source_site AS native,
  CASE WHEN host_site IN ('AMERICA', 'ASIA') THEN 'A' ELSE 'M' END AS genus
FROM raw""",
)
cte(
    "cells",
    """SELECT min(trial_id) AS cell_id, host_site, family, source_site, block, genus, native,
  count(*) AS n, count(*) FILTER (cnt = 0) AS n_zero, count(*) FILTER (cnt > 0) AS n_pos,
  CAST(sum(cnt) AS BIGINT) AS sum_y
FROM trials GROUP BY host_site, family, source_site, block, genus, native""",
)
cte(
    "classes",
    """SELECT cell_id, cnt, count(*) AS copies
FROM trials JOIN cells USING (host_site, family, source_site, block, genus, native)
GROUP BY cell_id, cnt""",
)
cte(
    "cell_levels",
    """SELECT cell_id, 'host' AS term, host_site AS level FROM cells
UNION ALL SELECT cell_id, 'source', source_site FROM cells
UNION ALL SELECT cell_id, 'source:host', source_site || ':' || host_site FROM cells
UNION ALL SELECT cell_id, 'genus', genus FROM cells
UNION ALL SELECT cell_id, 'genus:source', genus || ':' || source_site FROM cells
UNION ALL SELECT cell_id, 'native', native::VARCHAR FROM cells
UNION ALL SELECT cell_id, '(1|block)', block FROM cells
UNION ALL SELECT cell_id, '(1|family)', family FROM cells""",
)

# Model space ---------------------------------------------------------------

cte(
    "usable",
    """SELECT term, count(DISTINCT level) AS n_levels,
  list_position(['host', 'source', 'source:host', 'genus', 'genus:source', 'native', '(1|block)', '(1|family)'], term) - 1 AS bit
FROM cell_levels GROUP BY term HAVING count(DISTINCT level) > 1""",
)
cte(
    "subsets",
    """SELECT CAST(pick AS BIGINT) AS mask, list(term ORDER BY bit) AS terms, CAST(sum(n_levels - 1) AS BIGINT) AS n_coef
FROM range(1, 256) r(pick) JOIN usable ON (pick >> bit) & 1 = 1
GROUP BY pick""",
)
cte(
    "flagged",
    """SELECT *,
  list_contains(terms, 'source:host') AND NOT (list_contains(terms, 'host') AND list_contains(terms, 'source')) AS inter_host,
  list_contains(terms, 'genus:source') AND NOT (list_contains(terms, 'genus') AND list_contains(terms, 'source')) AS inter_genus,
  list_contains(terms, 'host') AND NOT list_contains(terms, 'genus') AS nest_host,
  list_contains(terms, '(1|family)') AND NOT list_contains(terms, 'source') AS nest_family
FROM subsets""",
)
cte("loose", "SELECT * FROM flagged WHERE NOT inter_host")
cte(
    "pairs",
    """SELECT c.mask AS count_mask, h.mask AS hurdle_mask, c.n_coef + h.n_coef AS n_coef,
  'cnt ~ ' || array_to_string(c.terms, ' + ') AS count_formula,
  'hu ~ ' || array_to_string(h.terms, ' + ') AS hurdle_formula,
  c.mask * 256 + h.mask AS id, 'combo_run_' || (c.mask * 256 + h.mask) AS model_name,
  c.nest_host OR c.nest_family OR h.nest_host OR h.nest_family AS bad_nest,
  c.inter_host OR c.inter_genus OR h.inter_host OR h.inter_genus AS bad_inter
FROM loose c CROSS JOIN loose h""",
)
cte("valid_models", "SELECT * FROM pairs WHERE NOT bad_nest AND NOT bad_inter")

# Forms and fits ------------------------------------------------------------

cte(
    "forms",
    """SELECT * FROM (VALUES
  ('source', 2, true), ('genus', 8, true), ('native', 32, true), ('host', 9, true),
  ('genus_source', 26, true), ('host_source', 15, true), ('block', 64, false), ('source_family', 130, false)
) v(form, mask, is_fixed)""",
)
cte(
    "form_terms",
    """SELECT * FROM (VALUES
  ('source', ['source'], 'source'), ('genus', ['genus'], 'genus'), ('native', ['native'], 'native'),
  ('host', ['host', 'genus'], 'host + genus'),
  ('genus_source', ['source', 'genus', 'genus:source'], 'source + genus + genus:source'),
  ('host_source', ['host', 'source', 'source:host', 'genus'], 'host + source + source:host + genus'),
  ('block', ['(1|block)'], '(1|block)'),
  ('source_family', ['source', '(1|family)'], 'source + (1|family)')
) v(form, terms, rhs)""",
)
cte(
    "models64",
    """SELECT c.form AS count_form, h.form AS hurdle_form, c.is_fixed AND h.is_fixed AS is_fixed,
  CAST(c.mask * 256 + h.mask AS BIGINT) AS id, 'combo_run_' || (c.mask * 256 + h.mask) AS model_name,
  ct.terms AS count_terms, ht.terms AS hurdle_terms,
  'cnt ~ ' || ct.rhs AS count_formula, 'hu ~ ' || ht.rhs AS hurdle_formula
FROM forms c CROSS JOIN forms h
JOIN form_terms ct ON ct.form = c.form JOIN form_terms ht ON ht.form = h.form""",
)
cte("models36", "SELECT * FROM models64 WHERE is_fixed")
cte(
    "cell_groups",
    """SELECT cell_id, 'source' AS form, 'fixed' AS role, '' AS parent, source_site AS level FROM cells
UNION ALL SELECT cell_id, 'genus', 'fixed', '', genus FROM cells
UNION ALL SELECT cell_id, 'native', 'fixed', '', native::VARCHAR FROM cells
UNION ALL SELECT cell_id, 'host', 'fixed', '', host_site FROM cells
UNION ALL SELECT cell_id, 'genus_source', 'fixed', '', genus || '|' || source_site FROM cells
UNION ALL SELECT cell_id, 'host_source', 'fixed', '', host_site || '|' || source_site FROM cells
UNION ALL SELECT cell_id, 'block', 'parent', '', 'all' FROM cells
UNION ALL SELECT cell_id, 'block', 'random', 'all', block FROM cells
UNION ALL SELECT cell_id, 'source_family', 'parent', '', source_site FROM cells
UNION ALL SELECT cell_id, 'source_family', 'random', source_site, family FROM cells""",
)


def fit_chain(prefix: str, groups: str, cells: str, classes: str) -> None:
    """Statistics, estimates, pooling, fits and closed-form leave-one-out scores."""
    p = prefix
    cte(
        f"{p}stats",
        f"""SELECT form, role, parent, level, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_zero) AS BIGINT) AS n_zero,
  CAST(sum(n_pos) AS BIGINT) AS n_pos, CAST(sum(sum_y) AS BIGINT) AS sum_y
FROM {groups} JOIN {cells} USING (cell_id) GROUP BY form, role, parent, level""",
    )
    cte(
        f"{p}rates",
        f"""SELECT *, {newton('mu')} AS rate FROM (
  SELECT *, (n_zero + 0.5e0) / (n + 1e0) AS p0,
    greatest(CASE WHEN n_pos > 0 THEN sum_y::DOUBLE / n_pos ELSE 1e0 END, 1e0 + 0.5e0 / (n_pos + 1e0)) AS mu
  FROM {p}stats)""",
    )
    cte(
        f"{p}est",
        f"""SELECT form, role, parent, level, n, n_zero, n_pos, sum_y, component, est, info, boundary,
  1e0 / sqrt(info) AS se FROM (
SELECT *, 'prop' AS component, ln(p0 / (1e0 - p0)) AS est, n * p0 * (1e0 - p0) AS info, false AS boundary FROM {p}rates
UNION ALL
SELECT *, 'count', ln(rate), greatest(n_pos::DOUBLE, 0.5e0) * mu * (1e0 + rate - mu), n_pos = 0 OR n_pos = sum_y FROM {p}rates)""",
    )
    cte(
        f"{p}devs",
        f"""SELECT g.form, g.component, g.parent, g.level, g.info, p.est AS center, g.est - p.est AS dev
FROM {p}est g JOIN {p}est p
  ON p.form = g.form AND p.component = g.component AND p.role = 'parent' AND p.level = g.parent
WHERE g.role = 'random'""",
    )
    cte(
        f"{p}tau",
        f"""SELECT form, component, greatest(0e0, CASE WHEN sum(info) - sum(info * info) / sum(info) > 0 THEN
  (sum(info * dev * dev) - sum(info * dev) * sum(info * dev) / sum(info) - (count(*) - 1)) /
  (sum(info) - sum(info * info) / sum(info)) ELSE 0e0 END) AS tau2
FROM {p}devs GROUP BY form, component""",
    )
    cte(
        f"{p}pooled",
        f"""SELECT *, tau2 * info / (1e0 + tau2 * info) * dev AS shrunk_dev, sqrt(tau2 / (1e0 + tau2 * info)) AS shrunk_se
FROM {p}devs JOIN {p}tau USING (form, component)""",
    )
    cte(
        f"{p}fits",
        f"""SELECT form, role, level, component, est AS loc, se AS scale FROM {p}est WHERE role <> 'random'
UNION ALL SELECT form, 'random', level, component, shrunk_dev, shrunk_se FROM {p}pooled""",
    )
    cte(
        f"{p}left_out",
        f"""SELECT form, role, parent, level, cnt, n - 1 AS n, n_zero - (cnt = 0)::INT AS n_zero,
  n_pos - (cnt > 0)::INT AS n_pos, sum_y - cnt AS sum_y
FROM (SELECT DISTINCT form, role, parent, level, cnt FROM {groups} JOIN {classes} USING (cell_id) WHERE role <> 'parent')
JOIN {p}stats USING (form, role, parent, level)""",
    )
    cte(
        f"{p}loo_rates",
        f"""SELECT *, ln(p0 / (1e0 - p0)) AS e0, n * p0 * (1e0 - p0) AS i0, {newton('mu')} AS rate FROM (
  SELECT *, (n_zero + 0.5e0) / (n + 1e0) AS p0,
    greatest(CASE WHEN n_pos > 0 THEN sum_y::DOUBLE / n_pos ELSE 1e0 END, 1e0 + 0.5e0 / (n_pos + 1e0)) AS mu
  FROM {p}left_out)""",
    )
    cte(
        f"{p}loo_eta",
        f"""SELECT r.form, r.role, r.parent, r.level, r.cnt,
  CASE WHEN z.center IS NULL THEN e0 ELSE z.center + z.tau2 * i0 / (1e0 + z.tau2 * i0) * (e0 - z.center) END AS eta_zero,
  CASE WHEN c.center IS NULL THEN ln(rate) ELSE c.center + c.tau2 * i1 / (1e0 + c.tau2 * i1) * (ln(rate) - c.center) END AS eta_count
FROM (SELECT *, greatest(n_pos::DOUBLE, 0.5e0) * mu * (1e0 + rate - mu) AS i1 FROM {p}loo_rates) r
LEFT JOIN (SELECT DISTINCT form, parent, center, tau2 FROM {p}pooled WHERE component = 'prop') z USING (form, parent)
LEFT JOIN (SELECT DISTINCT form, parent, center, tau2 FROM {p}pooled WHERE component = 'count') c USING (form, parent)""",
    )
    cte(
        f"{p}halves",
        f"""SELECT cell_id, cnt, copies, form,
  CASE WHEN cnt = 0 THEN -ln(1e0 + exp(-eta_zero)) ELSE -ln(1e0 + exp(eta_zero)) END AS elpd_zero,
  CASE WHEN cnt = 0 THEN 0e0 ELSE cnt * eta_count - exp(eta_count) - lgamma(cnt + 1) - ln(1e0 - exp(-exp(eta_count))) END AS elpd_count
FROM {groups} JOIN {classes} USING (cell_id) JOIN {p}loo_eta USING (form, role, parent, level, cnt)""",
    )


fit_chain("", "cell_groups", "cells", "classes")

for _n in ("36", "64"):
    cte(
        f"points{_n}",
        f"""SELECT model_name, c.cell_id, c.cnt, c.copies, c.elpd_count + h.elpd_zero AS elpd
FROM models{_n} m JOIN halves c ON c.form = m.count_form
JOIN halves h ON h.form = m.hurdle_form AND h.cell_id = c.cell_id AND h.cnt = c.cnt""",
    )

# Weights -------------------------------------------------------------------

cte(
    "pbma",
    """SELECT model_name, elpd_total, elpd_total - top - ln(sum(exp(elpd_total - top)) OVER ()) AS log_weight FROM (
  SELECT *, max(elpd_total) OVER () AS top FROM (
    SELECT model_name, sum(copies * elpd) AS elpd_total FROM points64 GROUP BY model_name))""",
)
cte(
    "chunked",
    """SELECT model_name, log_weight, row_number() OVER (ORDER BY round(log_weight, 6) DESC, model_name) % 4 + 1 AS chunk FROM pbma""",
)
cte("chunk_points", "SELECT p.*, chunk FROM points64 p JOIN chunked USING (model_name)")


def em_chain(prefix: str, points: str, steps: int, chunk: str = "") -> None:
    """Stacking steps from equal weights."""
    k = f", {chunk}" if chunk else ""
    using = f"(model_name{k})"
    cte(
        f"{prefix}dens",
        f"""SELECT *, exp(elpd - best) AS density FROM (
  SELECT *, max(elpd) OVER (PARTITION BY cell_id, cnt{k}) AS best FROM {points})""",
    )
    part = f"OVER (PARTITION BY {chunk})" if chunk else "OVER ()"
    cte(
        f"{prefix}em0",
        f"SELECT *, 1e0 / count(*) {part} AS weight FROM (SELECT DISTINCT model_name{k} FROM {points})",
    )
    for i in range(1, steps + 1):
        cte(
            f"{prefix}em{i}",
            f"""SELECT model_name{k}, weight * sum(copies * density / mix) / sum(copies) AS weight FROM (
  SELECT *, sum(weight * density) OVER (PARTITION BY cell_id, cnt{k}) AS mix
  FROM {prefix}dens JOIN {prefix}em{i - 1} USING {using})
GROUP BY model_name{k}, weight""",
        )


def stack_chain(prefix: str, tol: str = "1e-8", chunk: str = "", most: int = 12, rounds: int = 4) -> None:
    """Stacking after ``em_chain``: guarded multiplicative steps, then rounds of Newton steps.

    A round takes at most ``most`` models: those with weight, and those that would raise the score.

    A guarded step raises the gradients of the best weights so far to a power,
    which doubles up to 64 while the score rises; where it falls, the next step
    starts from the best weights again with power 1. A Newton step solves the
    second-order conditions by elimination; a weight that would fall below zero
    is stopped there and stays out. The gradients of all models tell whether the
    result is the optimum.
    """
    grp = chunk or "1"
    cte(
        f"{prefix}packed",
        f"""SELECT {grp} AS grp, any_value(copies) AS copies, list(density ORDER BY model_name) AS d FROM {prefix}dens GROUP BY grp, cell_id, cnt""",
    )
    cte(
        f"{prefix}run",
        f"""SELECT 0 AS step, 1 AS power, grp, any_value(list_transform(d, lambda x: 1e0 / len(d))) AS w, any_value(list_transform(d, lambda x: 1e0 / len(d))) AS best,
  any_value(list_transform(d, lambda x: 0e0)) AS best_g, CAST('-infinity' AS DOUBLE) AS best_score, 2e0 AS top FROM {prefix}packed GROUP BY grp
UNION ALL
SELECT step, power, grp, list_transform(raw, lambda x: greatest(x / list_sum(raw), 1e-12)), from_w, from_g, from_score, top FROM (
  SELECT *, list_transform(from_w, lambda x, i: x * pow(from_g[i], power)) AS raw FROM (
    SELECT step + 1 AS step, grp, list_max(g) AS top, CASE WHEN up THEN w ELSE best END AS from_w, CASE WHEN up THEN g ELSE best_g END AS from_g,
      CASE WHEN up THEN score ELSE best_score END AS from_score, CASE WHEN up THEN least(power * 2, 64) ELSE 1 END AS power FROM (
      SELECT *, score >= best_score - 1e-12 * abs(score) AS up FROM (
        SELECT grp, any_value(step) AS step, any_value(power) AS power, any_value(w) AS w, any_value(best) AS best, any_value(best_g) AS best_g,
          any_value(best_score) AS best_score, any_value(score) AS score, list(g ORDER BY i) AS g FROM (
          SELECT grp, i, any_value(step) AS step, any_value(power) AS power, any_value(w) AS w, any_value(best) AS best, any_value(best_g) AS best_g,
            any_value(best_score) AS best_score, sum(copies * ln(mix)) AS score, sum(copies * d[i] / mix) / sum(copies) AS g FROM (
            SELECT r.*, copies, d, list_dot_product(d, w) AS mix FROM {prefix}run r JOIN {prefix}packed USING (grp) WHERE step < 30 AND top > 1e0 + {tol}),
            range(1, 65) a(i) WHERE i <= len(w) GROUP BY grp, i)
        GROUP BY grp))))""",
    )
    names = f"(SELECT *, row_number() OVER (PARTITION BY grp ORDER BY model_name) AS number FROM (SELECT DISTINCT {grp} AS grp, model_name FROM {prefix}em0))"
    cte(
        f"{prefix}few1",
        f"""SELECT grp, model_name, best[number] AS weight, row_number() OVER (PARTITION BY grp ORDER BY best[number] DESC, model_name) AS place FROM (
  SELECT * FROM (SELECT *, max(step) OVER (PARTITION BY grp) AS final FROM {prefix}run) WHERE step = final) JOIN {names} USING (grp)
QUALIFY place <= {most}""",
    )
    # Rows of the system: second derivatives, the constraint, the slopes; a weight that is out moves by zero.
    system = """list_concat(
      list_transform(range(1, m + 1), lambda i: CASE WHEN live[i] = 1 THEN
        list_concat(list_transform(range(1, m + 1), lambda j: live[j] * h[(i - 1) * m + j] + CASE WHEN i = j THEN 1e-13 ELSE 0e0 END), [1e0, g[i]])
        ELSE list_concat(list_transform(range(1, m + 1), lambda j: CASE WHEN i = j THEN 1e0 ELSE 0e0 END), [0e0, 0e0]) END),
      [list_concat(live, [0e0, 0e0])])"""
    solved = """list_reduce(list_concat([a], list_transform(range(1, m + 2), lambda k: [[CAST(k AS DOUBLE)]])), lambda x, k:
      list_transform(x, lambda row, i: CASE WHEN i = CAST(k[1][1] AS INT) THEN list_transform(row, lambda v: v / x[CAST(k[1][1] AS INT)][CAST(k[1][1] AS INT)])
        ELSE list_transform(row, lambda v, j: v - row[CAST(k[1][1] AS INT)] * x[CAST(k[1][1] AS INT)][j] / x[CAST(k[1][1] AS INT)][CAST(k[1][1] AS INT)]) END))"""
    for r in range(1, rounds + 1):
        if r > 1:
            cte(
                f"{prefix}few{r}",
                f"""SELECT grp, model_name, greatest(weight, 1e-4) AS weight, row_number() OVER (PARTITION BY grp ORDER BY weight > 1e-9 DESC, gradient DESC, model_name) AS place
FROM {prefix}found{r - 1} WHERE weight > 1e-9 OR gradient > 1e0 + 1e-9 QUALIFY place <= {most}""",
            )
        cte(
            f"{prefix}small{r}",
            f"""SELECT grp, any_value(copies) AS copies, list(density ORDER BY place) AS d
FROM (SELECT *, {grp} AS grp FROM {prefix}dens) JOIN {prefix}few{r} USING (grp, model_name) GROUP BY grp, cell_id, cnt""",
        )
        cte(
            f"{prefix}newton{r}",
            f"""SELECT 0 AS step, grp, list(weight / total ORDER BY place) AS w, list(1e0 ORDER BY place) AS live, 1e0 AS size
FROM (SELECT *, sum(weight) OVER (PARTITION BY grp) AS total FROM {prefix}few{r}) GROUP BY grp
UNION ALL
SELECT step + 1, grp, list_transform(w, lambda x, i: CASE WHEN live[i] = 0 OR x + part * move[i] < 1e-14 THEN 0e0 ELSE x + part * move[i] END),
  list_transform(live, lambda x, i: CASE WHEN x = 0 OR w[i] + part * move[i] < 1e-14 THEN 0e0 ELSE 1e0 END), list_max(list_transform(move, lambda v: abs(v))) FROM (
  SELECT *, least(1e0, list_min(list_transform(w, lambda x, i: CASE WHEN live[i] = 1 AND move[i] < 0 THEN -x / move[i] ELSE 1e0 END))) AS part FROM (
    SELECT *, list_transform(range(1, m + 1), lambda i: ({solved})[i][m + 2]) AS move FROM (
      SELECT *, {system} AS a FROM (
        SELECT any_value(step) AS step, grp, any_value(w) AS w, any_value(live) AS live, any_value(len(w)) AS m, list(h ORDER BY i, j) AS h, list(g ORDER BY i) FILTER (j = 1) AS g FROM (
          SELECT any_value(step) AS step, grp, any_value(w) AS w, any_value(live) AS live, i, j, sum(copies * d[i] * d[j] / mix / mix) / sum(copies) AS h, sum(copies * d[i] / mix) / sum(copies) AS g FROM (
            SELECT step, grp, w, live, copies, d, list_dot_product(d, w) AS mix FROM {prefix}newton{r} JOIN {prefix}small{r} USING (grp) WHERE step < 40 AND size > 1e-13),
            range(1, {most + 1}) a(i), range(1, {most + 1}) b(j) WHERE i <= len(w) AND j <= len(w) GROUP BY grp, i, j)
        GROUP BY grp))))""",
        )
        cte(
            f"{prefix}all{r}",
            f"""SELECT grp, list(coalesce(w[place], 1e-12) ORDER BY number) AS w FROM {names}
JOIN (SELECT grp, w FROM (SELECT *, max(step) OVER (PARTITION BY grp) AS final FROM {prefix}newton{r}) WHERE step = final) USING (grp)
LEFT JOIN {prefix}few{r} USING (grp, model_name) GROUP BY grp""",
        )
        cte(
            f"{prefix}found{r}",
            f"""SELECT grp, model_name, weight, gradient FROM (
  SELECT grp, i AS number, any_value(w[i]) AS weight, sum(copies * d[i] / mix) / sum(copies) AS gradient FROM (
    SELECT grp, w, copies, d, list_dot_product(d, w) AS mix FROM {prefix}all{r} JOIN {prefix}packed USING (grp)), range(1, 65) a(i)
  WHERE i <= len(w) GROUP BY grp, i) JOIN {names} USING (grp, number)""",
        )
    cte(
        f"{prefix}stacked",
        f"""SELECT model_name{f", grp AS {chunk}" if chunk else ""}, weight, gradient, max(gradient) OVER (PARTITION BY grp) <= 1e0 + {tol} AS converged FROM {prefix}found{rounds}""",
    )


em_chain("m64_", "points64", 5)
em_chain("ch_", "chunk_points", 5, "chunk")
stack_chain("m64_")
stack_chain("ch_", chunk="chunk")

_MASS_KEY = "key_text || '|' || attempt"
cte(
    "class_copies",
    "SELECT DISTINCT cell_id, cnt, copies FROM points64",
)
def boot_chain(prefix: str, replicates: int) -> None:
    """Masses, scores and weights of the Bayesian bootstrap."""
    cte(
        f"{prefix}masses",
        f"""SELECT cell_id, cnt, copies, replicate, coalesce(arg_min(d * v, attempt) FILTER (accepted), any_value(d)) AS mass FROM (
      SELECT *, v > 0 AND ln({uniform(_MASS_KEY, 2)}) <
        0.5e0 * x * x + d - d * v + d * ln(CASE WHEN v > 0 THEN v ELSE 1e0 END) AS accepted FROM (
        SELECT *, pow(1e0 + 1e0 / sqrt(9e0 * d) * x, 3) AS v FROM (
          SELECT *, copies - 1e0 / 3e0 AS d, {normal(_MASS_KEY)} AS x FROM (
            SELECT *, {key("'dirichlet'", "'1234'", "cell_id", "cnt", "replicate")} AS key_text
            FROM class_copies, range(1, {replicates + 1}) r(replicate), range(1, 13) a(attempt)))))
    GROUP BY cell_id, cnt, copies, replicate""",
    )
    cte(
        f"{prefix}boot",
        f"""SELECT replicate, model_name, n_trials * weighted / total_mass AS z FROM (
      SELECT replicate, model_name, sum(mass * elpd) AS weighted
      FROM points64 JOIN {prefix}masses USING (cell_id, cnt) GROUP BY replicate, model_name)
    JOIN (SELECT replicate, sum(mass) AS total_mass, sum(copies) AS n_trials FROM {prefix}masses GROUP BY replicate) USING (replicate)""",
    )
    cte(
        f"{prefix}boot_weights",
        f"""SELECT replicate, model_name, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY replicate) AS weight
    FROM (SELECT *, max(z) OVER (PARTITION BY replicate) AS top FROM {prefix}boot)""",
    )


boot_chain("", 2880)
boot_chain("few_", 50)

# Draws ---------------------------------------------------------------------

cte("study_weights", "SELECT model_name, weight FROM m64_stacked")

# The whole path of weighting.
cte("rough", "SELECT model_name, avg(weight) AS weight FROM few_boot_weights GROUP BY model_name HAVING log10(avg(weight)) > -100")
cte("rough_chunks", "SELECT model_name, row_number() OVER (ORDER BY round(ln(weight), 6) DESC NULLS LAST, model_name) % 4 + 1 AS chunk FROM rough")
cte("rough_points", "SELECT p.*, chunk FROM points64 p JOIN rough_chunks USING (model_name)")
em_chain("rc_", "rough_points", 0, "chunk")
stack_chain("rc_", chunk="chunk")
cte("last_points", "SELECT * FROM points64 WHERE model_name IN (SELECT model_name FROM rc_stacked WHERE weight > 1e-6)")
em_chain("last_", "last_points", 0)
stack_chain("last_")
cte("hosts", "SELECT DISTINCT host_site, genus FROM cells")
cte(
    "bases",
    """SELECT genus, host_site AS base_host, 1e0 / count(*) OVER (PARTITION BY genus) AS w FROM (
  SELECT *, max((host_site = 'AFRICA')::INT) OVER (PARTITION BY genus) AS has_ref FROM hosts)
WHERE has_ref = 0 OR host_site = 'AFRICA'""",
)


def _simple(form: str, term: str, column: str, ref: str, role: str = "fixed") -> list[str]:
    lv = f"(SELECT DISTINCT {column}::VARCHAR AS lv FROM cells)"
    return [
        f"SELECT '{form}' AS form, 'intercept' AS kind, 'intercept' AS term, '' AS level, '{role}' AS role, lv AS group_level, 1e0 AS coef FROM {lv} WHERE lv = '{ref}'",
        f"SELECT '{form}', 'fixed', '{term}', lv, '{role}', lv, 1e0 FROM {lv} WHERE lv <> '{ref}'",
        f"SELECT '{form}', 'fixed', '{term}', lv, '{role}', '{ref}', -1e0 FROM {lv} WHERE lv <> '{ref}'",
    ]


def _nested(form: str, tail: str) -> list[str]:
    return [
        f"SELECT '{form}', 'intercept', 'intercept', '', 'fixed', base_host || '{tail}', w FROM bases WHERE genus = 'A'",
        f"SELECT '{form}', 'fixed', 'genus', genus, 'fixed', base_host || '{tail}', w FROM bases WHERE genus <> 'A'",
        f"SELECT '{form}', 'fixed', 'genus', g.genus, 'fixed', base_host || '{tail}', -w FROM (SELECT DISTINCT genus FROM hosts WHERE genus <> 'A') g, bases b WHERE b.genus = 'A'",
        f"SELECT '{form}', 'fixed', 'host', host_site, 'fixed', host_site || '{tail}', 1e0 FROM hosts WHERE host_site <> 'AFRICA'",
        f"SELECT '{form}', 'fixed', 'host', host_site, 'fixed', base_host || '{tail}', -w FROM hosts JOIN bases USING (genus) WHERE host_site <> 'AFRICA'",
    ]


def _crossed(form: str, term: str, first: str, ref: str, name: str) -> list[str]:
    p = f"(SELECT DISTINCT {first} AS a, source_site AS s FROM cells)"
    out = []
    for level, coef in ((f"'{ref}|' || s", 1), (f"'{ref}|AFRICA'", -1)):
        out.append(
            f"SELECT '{form}', 'fixed', 'source', s, 'fixed', {level}, {coef}e0 FROM {p} WHERE a = '{ref}' AND s <> 'AFRICA'"
        )
    for level, coef in (("a || '|' || s", 1), ("a || '|AFRICA'", -1), (f"'{ref}|' || s", -1), (f"'{ref}|AFRICA'", 1)):
        out.append(
            f"SELECT '{form}', 'interaction', '{term}', {name}, 'fixed', {level}, {coef}e0 FROM {p} WHERE a <> '{ref}' AND s <> 'AFRICA'"
        )
    return out


cte(
    "contrasts",
    "\nUNION ALL ".join(
        _simple("source", "source", "source_site", "AFRICA")
        + _simple("genus", "genus", "genus", "A")
        + _simple("native", "native", "native", "false")
        + _nested("host", "")
        + _nested("host_source", "|AFRICA")
        + _crossed("genus_source", "genus:source", "genus", "A", "a || ':' || s")
        + _crossed("host_source", "source:host", "host_site", "AFRICA", "s || ':' || a")
        + [
            "SELECT 'genus_source', 'intercept', 'intercept', '', 'fixed', 'A|AFRICA', 1e0",
            "SELECT DISTINCT 'genus_source', 'fixed', 'genus', genus, 'fixed', genus || '|AFRICA', 1e0 FROM cells WHERE genus <> 'A'",
            "SELECT DISTINCT 'genus_source', 'fixed', 'genus', genus, 'fixed', 'A|AFRICA', -1e0 FROM cells WHERE genus <> 'A'",
        ]
        + _simple("source_family", "source", "source_site", "AFRICA", "parent")
        + [
            "SELECT DISTINCT 'source_family', 'random', '(1|family)', family, 'random', family, 1e0 FROM cells",
            "SELECT 'block', 'intercept', 'intercept', '', 'parent', 'all', 1e0",
            "SELECT DISTINCT 'block', 'random', '(1|block)', block, 'random', block, 1e0 FROM cells",
        ]
    ),
)
cte(
    "model_sides",
    """SELECT model_name, 'count' AS component, count_form AS form FROM models64
UNION ALL SELECT model_name, 'prop', hurdle_form FROM models64""",
)

_DRAW_KEY = key("'draw'", "'1'", "model_name", "component", "role", "group_level", "draw_in_model")


def draw_chain(per_model: int) -> None:
    """Allocation, draw index, draws and what follows from them."""
    p = f"d{per_model}_"
    cte(
        f"{p}allocation",
        f"""SELECT model_name, weight, id, CAST(round_even(weight / max(weight) OVER () * {per_model}e0, 0) AS BIGINT) AS n_draws
FROM study_weights JOIN models64 USING (model_name)""",
    )
    cte(
        f"{p}index",
        f"""SELECT id * 4294967296 + draw_in_model AS draw_id, model_name, CAST(draw_in_model AS INTEGER) AS draw_in_model FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name
    ORDER BY {uniform(key("'pick'", "'52399832'", "model_name", "draw_in_model"))}, draw_in_model) AS rn
  FROM {p}allocation, range(1, {per_model + 1}) r(draw_in_model))
WHERE rn <= n_draws""",
    )
    cte(
        f"{p}draws",
        f"""SELECT draw_id, model_name, component, kind, term, level, sum(coef * (loc + z * scale)) AS value FROM (
  SELECT *, {normal(_DRAW_KEY)} AS z
  FROM {p}index JOIN model_sides USING (model_name) JOIN contrasts USING (form)
  JOIN (SELECT form, role, level AS group_level, component, loc, scale FROM fits) f
    USING (form, role, group_level, component))
GROUP BY draw_id, model_name, component, kind, term, level""",
    )


for _k in (400, 4000):
    draw_chain(_k)


def value_chain(prefix: str, levels: str) -> None:
    cte(
        f"{prefix}keys",
        f"""SELECT cell_id, term, level FROM {levels}
UNION ALL SELECT cell_id, 'intercept', '' FROM cells""",
    )
    cte(
        f"{prefix}eta",
        f"""SELECT draw_id, model_name, cell_id, sum(value) FILTER (component = 'count') AS eta_count,
  sum(value) FILTER (component = 'prop') AS eta_prop
FROM d400_draws JOIN {prefix}keys USING (term, level) GROUP BY draw_id, model_name, cell_id""",
    )
    cte(
        f"{prefix}values",
        f"""SELECT draw_id, model_name, cell_id, exp(eta_count) / (1e0 - exp(-exp(eta_count))) AS count_ev,
  1e0 / (1e0 + exp(eta_prop)) AS prev_ev FROM {prefix}eta""",
    )


cte("main_levels", "SELECT * FROM cell_levels WHERE term NOT IN ('source:host', 'genus:source')")
value_chain("ev_", "cell_levels")
value_chain("flat_", "main_levels")
cte(
    "site_values",
    """SELECT variable, host_site, source_site, pred FROM (
  SELECT 'Incidence' AS variable, cell_id, count_ev AS pred FROM ev_values
  UNION ALL SELECT 'Prevalence', cell_id, prev_ev FROM ev_values) JOIN cells USING (cell_id)""",
)
cte(
    "needed",
    """SELECT cell_id, term, level FROM cell_levels WHERE term IN ('host', 'source', 'genus', 'native')
AND NOT (term = 'host' AND level = 'AFRICA') AND NOT (term = 'source' AND level = 'AFRICA')
AND NOT (term = 'genus' AND level = 'A') AND NOT (term = 'native' AND level = 'false')""",
)
# What a cell asks for under all terms that vary: nothing where one of a term's factors is at its reference level.
cte(
    "at_reference",
    """SELECT cell_id, term AS factor FROM cell_levels
WHERE (term, level) IN (('host', 'AFRICA'), ('source', 'AFRICA'), ('genus', 'A'), ('native', 'false'))""",
)
cte(
    "needed_all",
    """SELECT cell_id, term, level FROM cell_levels JOIN (SELECT term FROM usable) USING (term)
WHERE (cell_id, term) NOT IN (
  SELECT c.cell_id, c.term FROM (SELECT cell_id, term, unnest(string_split(term, ':')) AS factor FROM cell_levels) c
  JOIN at_reference USING (cell_id, factor))""",
)
cte(
    "held_all",
    """SELECT d.draw_id, c.cell_id, s.component, count(n.term) AS wanted, count(p.term) AS found
FROM d400_index d CROSS JOIN cells c CROSS JOIN (VALUES ('count'), ('prop')) s(component)
LEFT JOIN needed_all n ON n.cell_id = c.cell_id
LEFT JOIN d400_draws p ON p.draw_id = d.draw_id AND p.component = s.component AND p.term = n.term AND p.level = n.level
GROUP BY d.draw_id, c.cell_id, s.component""",
)
cte(
    "held",
    """SELECT d.draw_id, c.cell_id, s.component, count(n.term) AS wanted, count(p.term) AS found
FROM d400_index d CROSS JOIN cells c CROSS JOIN (VALUES ('count'), ('prop')) s(component)
LEFT JOIN needed n ON n.cell_id = c.cell_id
LEFT JOIN d400_draws p ON p.draw_id = d.draw_id AND p.component = s.component AND p.term = n.term AND p.level = n.level
GROUP BY d.draw_id, c.cell_id, s.component""",
)

# Effects -------------------------------------------------------------------

cte(
    "factor_labels",
    """SELECT * FROM (VALUES ('(1|family)', 'Family (RE)'), ('(1|block)', 'Block (RE)'),
  ('source:host', 'Host x Source Interaction'), ('genus:source', 'Genus x Source Interaction'),
  ('genus', 'Genus'), ('host', 'Host Site'), ('source', 'Source Site'), ('native', 'Native')) v(term, factor)""",
)
cte(
    "starts",
    "SELECT draw_id, component, value AS intercept FROM d4000_draws WHERE kind = 'intercept'",
)


def link(eta: str) -> str:
    return f"CASE WHEN component = 'count' THEN exp({eta}) ELSE 1e0 / (1e0 + exp(-({eta}))) END"


cte(
    "present",
    f"""SELECT draw_id, component, factor, term, level, kind, intercept, value, {link('intercept + value')} AS linear_value
FROM d4000_draws JOIN factor_labels USING (term) JOIN starts USING (draw_id, component)""",
)
cte(
    "refs",
    f"""SELECT DISTINCT draw_id, component, factor, intercept, {link('intercept')} AS linear_value
FROM present WHERE kind <> 'random'""",
)
cte(
    "absent_factors",
    """SELECT draw_id, component, factor FROM d4000_index CROSS JOIN (SELECT DISTINCT component, factor FROM present)
EXCEPT SELECT draw_id, component, factor FROM present""",
)


def pool_chain(prefix: str, parent: str, child: str, dim: str, parent_ref: str, child_ref: str, joint: str, pooled: str):
    """Joint and pooled rows of a nested pair."""
    p = prefix
    zero = f"UNION ALL SELECT DISTINCT draw_id, component, '{{}}', intercept, 0e0 FROM present WHERE term = '{{}}'"
    child_zero = zero.format(child_ref, child) if child_ref else ""
    cte(
        f"{p}parents",
        f"""SELECT draw_id, component, level, intercept, value FROM present WHERE term = '{parent}'
{zero.format(parent_ref, parent)}""",
    )
    cte(
        f"{p}children",
        f"""SELECT draw_id, component, level, intercept, value FROM present WHERE term = '{child}'
{child_zero}""",
    )
    cte(
        f"{p}joint",
        f"""SELECT draw_id, component, c.level, c.intercept, {link('c.intercept + p.value + c.value')} AS linear_value
FROM {p}children c JOIN (SELECT DISTINCT {dim} FROM cells) d(lv, up) ON c.level = d.lv
JOIN {p}parents p USING (draw_id, component) WHERE p.level = d.up""",
    )
    shown = lambda ref: f"nullif(level, '{ref}')" if ref else "level"
    cte(
        f"{p}pooled",
        f"""SELECT draw_id, component, level, intercept, linear_value FROM {p}joint
UNION ALL SELECT draw_id, component, level, intercept, {link('intercept + value')} FROM (
  SELECT draw_id, component, {shown(parent_ref)} AS level, intercept, value FROM {p}parents
  UNION ALL SELECT draw_id, component, {shown(child_ref)}, intercept, value FROM {p}children) s
WHERE NOT EXISTS (SELECT 1 FROM {p}joint j WHERE j.draw_id = s.draw_id AND j.component = s.component)""",
    )
    every = "SELECT draw_id, component FROM d4000_index CROSS JOIN (VALUES ('count'), ('prop')) v(component)"
    cte(
        f"{p}all",
        "\nUNION ALL ".join(
            f"""SELECT draw_id, component, '{label}' AS factor, level, intercept, linear_value, false AS absent FROM {p}{t}
UNION ALL SELECT draw_id, component, '{label}', NULL, NULL, NULL, true FROM ({every} EXCEPT SELECT draw_id, component FROM {p}{t})"""
            for label, t in ((joint, "joint"), (pooled, "pooled"))
        ),
    )


pool_chain("so_", "source", "(1|family)", "family, source_site", "AFRICA", "", "Source + Family", "Source (pooled)")
pool_chain("ho_", "genus", "host", "host_site, genus", "A", "AFRICA", "Genus + Host", "Host (pooled)")
cte(
    "effects",
    """SELECT component, factor, draw_id, stddev_samp(linear_value) AS effect_size, bool_or(linear_value IS NULL) AS absent FROM (
  SELECT draw_id, component, factor, linear_value FROM present
  UNION ALL SELECT draw_id, component, factor, linear_value FROM refs
  UNION ALL SELECT draw_id, component, factor, NULL FROM absent_factors
  UNION ALL SELECT draw_id, component, factor, linear_value FROM so_all
  UNION ALL SELECT draw_id, component, factor, linear_value FROM ho_all)
GROUP BY component, factor, draw_id""",
)

EFFECT_NAMES = ("q_025", "q_05", "q_25", "q_5", "q_75", "q_95", "q_975")
_PROBS = (0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975)


def quantiles(value: str, names=EFFECT_NAMES, probs=_PROBS) -> str:
    return ", ".join(f"quantile_cont({value}, {p}) AS {n}" for n, p in zip(names, probs))


cte(
    "effect_summary",
    f"""SELECT component, factor, 1e0 - avg(absent::INT) AS frequency, {quantiles('effect_size')}
FROM effects GROUP BY component, factor""",
)
cte("there", "SELECT * FROM effects WHERE NOT absent")
cte(
    "genus_split",
    """SELECT g.component, g.draw_id, g.effect_size, h.draw_id IS NOT NULL AS has_child FROM there g
LEFT JOIN (SELECT component, draw_id FROM there WHERE factor = 'Host Site') h USING (component, draw_id)
WHERE g.factor = 'Genus'""",
)
cte(
    "host_pairs",
    """SELECT component, draw_id, c.effect_size AS child, p.effect_size AS parent
FROM (SELECT * FROM there WHERE factor = 'Host Site') c
LEFT JOIN (SELECT * FROM there WHERE factor = 'Genus') p USING (component, draw_id)""",
)
cte(
    "class_rows",
    """SELECT component, draw_id, 'Host Site' AS class, effect_size FROM there WHERE factor = 'Host Site'
UNION ALL SELECT component, draw_id, CASE WHEN has_child THEN 'Genus with Host Site' ELSE 'Genus without Host Site' END, effect_size FROM genus_split""",
)
cte(
    "joint_points",
    """SELECT component, draw_id, parent AS x, child AS y FROM (
  SELECT component, draw_id, child, parent FROM host_pairs
  UNION ALL SELECT component, draw_id, 0e0, effect_size FROM genus_split WHERE NOT has_child)
WHERE child < 1.5 AND parent < 1.5""",
)


def spread(sd: str, a: str, b: str) -> str:
    return f"CASE WHEN {b} > {a} THEN least({sd}, ({b} - {a}) / 1.34e0) ELSE {sd} END"


def density_chain(prefix: str, points: str, n: int = 25) -> None:
    h = lambda c: f"1.06e0 * ({spread(f'{c}_sd', f'{c}_a', f'{c}_b')}) * pow(n, -0.2e0)"
    cte(
        f"{prefix}frame",
        f"""SELECT *, {h('x')} AS hx, {h('y')} AS hy FROM (
  SELECT component, count(*)::DOUBLE AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
    stddev_samp(x) AS x_sd, stddev_samp(y) AS y_sd, quantile_cont(x, 0.25) AS x_a, quantile_cont(x, 0.75) AS x_b,
    quantile_cont(y, 0.25) AS y_a, quantile_cont(y, 0.75) AS y_b FROM {points} GROUP BY component)""",
    )
    cte(
        f"{prefix}grid",
        f"""SELECT component, i, j, gx AS x, gy AS y,
  sum(exp(-0.5e0 * pow((gx - px) / hx, 2)) * exp(-0.5e0 * pow((gy - py) / hy, 2))) / {PI2} / any_value(n * hx * hy) AS z
FROM (SELECT f.*, p.x AS px, p.y AS py, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
    x0 + (x1 - x0) * i / {n - 1}e0 AS gx, y0 + (y1 - y0) * j / {n - 1}e0 AS gy
  FROM {prefix}frame f JOIN {points} p USING (component), range({n}) a(i), range({n}) b(j) WHERE hx > 0 AND hy > 0)
GROUP BY component, i, j, gx, gy""",
    )


def whole_density(prefix: str, points: str, n: int = 400) -> None:
    """Exact density on an n x n grid of every component, null without a spread: sums over points as products of lists."""
    if f"{prefix}frame" not in CTES:
        density_chain(prefix, points)
    for axis in "xy":
        at = f"{axis}0 + ({axis}1 - {axis}0) * i / {n - 1}e0"
        cte(
            f"{prefix}{axis}_kernel",
            f"""SELECT component, i, g, list(coalesce(exp(-0.5e0 * pow((g - v) / h, 2)), 0e0) ORDER BY draw_id) AS k{axis}
FROM (SELECT f.component, CAST(i AS INTEGER) AS i, {at} AS g, p.draw_id, p.{axis} AS v, f.h{axis} AS h
  FROM {prefix}frame f JOIN {points} p USING (component), range({n}) a(i)) GROUP BY component, i, g""",
        )
    cte(
        f"{prefix}whole",
        f"""SELECT component, a.i, b.i AS j, a.g AS x, b.g AS y,
  CASE WHEN hx > 0 AND hy > 0 THEN list_dot_product(kx, ky) / {PI2} / (n * hx * hy) END AS z
FROM {prefix}x_kernel a JOIN {prefix}y_kernel b USING (component) JOIN {prefix}frame USING (component)""",
    )


density_chain("jp_", "joint_points")
whole_density("jp_", "joint_points")
cte(
    "wide_effects",
    """SELECT component, draw_id, max(effect_size) FILTER (factor = 'Genus') AS parent,
  max(effect_size) FILTER (factor = 'Host Site') AS child
FROM there WHERE factor IN ('Genus', 'Host Site') AND effect_size <= 1.5 GROUP BY component, draw_id""",
)
cte(
    "both_points",
    "SELECT component, draw_id, child AS x, parent AS y FROM wide_effects WHERE child IS NOT NULL AND parent IS NOT NULL",
)
density_chain("bp_", "both_points")
whole_density("bp_", "both_points")

# The same for the pair of source site and family
cte("source_rows", "SELECT component, draw_id, effect_size FROM there WHERE factor = 'Source Site'")
cte("family_rows", "SELECT component, draw_id, effect_size FROM there WHERE factor = 'Family (RE)'")
cte(
    "source_family",
    """SELECT component, draw_id, s.effect_size AS parent, f.effect_size AS child
FROM source_rows s FULL JOIN family_rows f USING (component, draw_id)""",
)
cte(
    "sf_points",
    """SELECT component, draw_id, parent AS x, coalesce(child, 0e0) AS y FROM source_family
WHERE parent < 1.5 AND coalesce(child, 0e0) < 1.5""",
)
cte("fs_points", "SELECT component, draw_id, child AS x, parent AS y FROM source_family WHERE parent <= 1.5 AND child <= 1.5")
cte(
    "sf_classes",
    """SELECT component, draw_id, 'Family (RE)' AS class, effect_size FROM family_rows
UNION ALL SELECT component, draw_id, CASE WHEN child IS NULL THEN 'Source Site without Family (RE)' ELSE 'Source Site with Family (RE)' END, parent
FROM source_family WHERE parent IS NOT NULL""",
)
whole_density("sf_", "sf_points")
whole_density("fs_", "fs_points")


def curves(rows: str, n: int = 41) -> str:
    """Exact density of every class of ``rows`` on n points, null without a spread."""
    return f"""SELECT component, class, CAST(i AS INTEGER) AS i, any_value(lo + (hi - lo) * i / {n - 1}e0) AS x,
  CASE WHEN any_value(h) > 0 THEN sum(exp(-0.5e0 * pow((lo + (hi - lo) * i / {n - 1}e0 - effect_size) / h, 2)))
    / sqrt(6.283185307179586e0) / any_value(n * h) END AS density
FROM (SELECT *, 0.9e0 * ({spread('sd', 'a', 'b')}) * pow(n, -0.2e0) AS h FROM (
    SELECT component, class, count(effect_size)::DOUBLE AS n, min(effect_size) AS lo, max(effect_size) AS hi,
      stddev_samp(effect_size) AS sd, quantile_cont(effect_size, 0.25) AS a, quantile_cont(effect_size, 0.75) AS b
    FROM {rows} WHERE effect_size IS NOT NULL GROUP BY component, class)) f
  JOIN {rows} r USING (component, class), range({n}) g(i) WHERE effect_size IS NOT NULL
GROUP BY component, class, i"""

# Contrast study ------------------------------------------------------------

cte(
    "cohort1",
    """SELECT trial_id, host_site, family, source_site, CASE WHEN infected_flag = 'y' THEN 1 ELSE 0 END AS infected, cnt,
  coalesce(block, 'na_block') AS block FROM raw WHERE host_site IN ('EUROPE', 'AFRICA') AND source_site = 'AFRICA'""",
)
cte(
    "cohort2",
    """SELECT trial_id, host_site, family, source_site, CASE WHEN infected_flag = 'y' THEN 1 ELSE 0 END AS infected, cnt,
  host_site NOT IN ('EUROPE', 'AFRICA') AS different_species, host_site IN ('AMERICA', 'ASIA') AS different_genus
FROM raw WHERE source_site = 'AFRICA'""",
)
cte(
    "c2cells",
    """SELECT min(trial_id) AS cell_id, host_site, different_species, different_genus, count(*) AS n,
  count(*) FILTER (cnt = 0) AS n_zero, count(*) FILTER (cnt > 0) AS n_pos, CAST(sum(cnt) AS BIGINT) AS sum_y
FROM cohort2 GROUP BY host_site, different_species, different_genus""",
)
cte(
    "c2classes",
    """SELECT cell_id, cnt, count(*) AS copies FROM cohort2 JOIN c2cells USING (host_site)
GROUP BY cell_id, cnt""",
)
_FLAGS = "different_species::VARCHAR || '|' || different_genus::VARCHAR"


def _c2(name: str, parent: str, level: str, random: bool) -> str:
    if not random:
        return f"SELECT cell_id, '{name}' AS form, 'fixed' AS role, '' AS parent, {level} AS level FROM c2cells"
    return (
        f"SELECT cell_id, '{name}', 'parent', '', {parent} FROM c2cells\n"
        f"UNION ALL SELECT cell_id, '{name}', 'random', {parent}, {level} FROM c2cells"
    )


cte(
    "c2groups",
    "\nUNION ALL ".join(
        [
            _c2("Species", "", "different_species::VARCHAR", False),
            _c2("Genus", "", "different_genus::VARCHAR", False),
            _c2("Fixed Effect", "", _FLAGS, False),
            _c2("Full", _FLAGS, "host_site", True),
            _c2("Species + RE", "different_species::VARCHAR", "host_site", True),
            _c2("Genus + RE", "different_genus::VARCHAR", "host_site", True),
            _c2("Random Effect", "'all'", "host_site", True),
        ]
    ),
)
fit_chain("c2_", "c2groups", "c2cells", "c2classes")
cte(
    "c2_points",
    "SELECT form AS model_name, cell_id, cnt, copies, elpd_zero + elpd_count AS elpd FROM c2_halves",
)
em_chain("c2_", "c2_points", 0)
stack_chain("c2_")
cte("c2_scaled", "SELECT model_name, weight, weight / max(weight) OVER () AS scaled FROM c2_stacked")
