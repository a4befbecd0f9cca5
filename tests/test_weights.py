import numpy as np
import pytest
from pyspark.sql import functions as F

from twofold.operators import draws, weights

SCHEMA = "model_name string, cell_id long, cnt long, copies long, elpd double"


def points(spark, table, copies=None):
    """Score table from a dict model -> list of scores."""
    rows = [
        (m, i, 0, 1 if copies is None else copies[i], float(v))
        for m, vs in table.items()
        for i, v in enumerate(vs)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def as_dict(df, col="weight"):
    return {r.model_name: r[col] for r in df.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    table = {f"m{k}": rng.normal(-1.5, 0.7, 60) for k in range(6)}
    return table, points(spark, table)


def test_equal_models_share_the_weight(spark):
    p = points(spark, {m: [-1.0, -2.0, -3.0, -0.5] for m in "abc"})
    for w in (weights.pseudo_bma(p), weights.pseudo_bma_bootstrap(p, 20), weights.stack(p)):
        assert as_dict(w) == pytest.approx({m: 1 / 3 for m in "abc"})


def test_best_everywhere_takes_all(spark):
    p = points(spark, {"a": [-1.0] * 4, "b": [-3.0] * 4, "c": [-4.0] * 4})
    got = as_dict(weights.stack(p, tol=1e-6))
    assert got["a"] == pytest.approx(1.0, abs=1e-4)


def test_huge_negative_scores_stay_finite(spark):
    p = points(spark, {"a": [-2000.0, -2001.0], "b": [-2000.5, -2000.2]})
    for w in (weights.pseudo_bma(p), weights.pseudo_bma_bootstrap(p, 10), weights.stack(p)):
        got = as_dict(w)
        assert sum(got.values()) == pytest.approx(1.0) and all(np.isfinite(list(got.values())))


def test_a_constant_per_trial_changes_nothing(spark, mixed):
    table, p = mixed
    shift = np.linspace(-30, 30, 60)
    moved = points(spark, {m: v + shift for m, v in table.items()})
    assert as_dict(weights.stack(p)) == pytest.approx(as_dict(weights.stack(moved)), abs=1e-9)
    assert as_dict(weights.pseudo_bma(p)) == pytest.approx(as_dict(weights.pseudo_bma(moved)))


def test_stacking_reaches_the_optimum(spark, mixed):
    table, p = mixed
    found = weights.stack(p, tol=1e-5)
    got, grad = as_dict(found), as_dict(found, "gradient")
    assert max(grad.values()) <= 1 + 1e-5 and sum(got.values()) == pytest.approx(1.0)
    density = np.exp(np.array([table[m] for m in sorted(table)]).T)
    w = np.full(6, 1 / 6)
    for _ in range(200000):
        w = w * (density / (density @ w)[:, None]).mean(axis=0)
    mine = np.array([got[m] for m in sorted(got)])
    best, reached = np.log(density @ w).mean(), np.log(density @ mine).mean()
    assert reached >= best - 1e-5
    assert mine == pytest.approx(w, abs=0.01)


def packed_stack(density, copies, tol, max_steps=60):
    """The solver of ``stack`` over one numpy table, and how many passes it took."""
    models = (np.arange(density.shape[1]), np.zeros(density.shape[1], int))
    scaled, one = density / density.max(1, keepdims=True), np.ones((len(density), 1))

    def passes(trials, active):
        sums = weights._class_sums(scaled, one, copies, models, trials, active).reshape(len(trials), -1) / copies.sum()
        k, a = density.shape[1], len(active)
        return [weights._Pass(w, r[0], r[1 : 1 + k], active, r[1 + k :].reshape(a, a)) for w, r in zip(trials, sums)]

    w = np.full(density.shape[1], 1 / density.shape[1])
    state, n = weights._better(passes([w], weights._active(w, None))), 1
    while state.slopes.max() > 1 + tol and n < max_steps:
        before = state.score
        state = weights._better(passes(weights._next_trials(state), weights._active(state.weights, state.slopes)))
        assert state.score >= before - 1e-9
        n += 1
    return state, n


def test_stacking_converges_on_random_tables():
    """50 tables of all spreads, some with two equal models; every one within few passes."""
    rng = np.random.default_rng(11)
    taken = []
    for i in range(50):
        table = rng.normal(-1.5, rng.choice([0.05, 0.3, 0.7, 3.0, 20.0]), (int(rng.integers(40, 400)), int(rng.integers(3, 30))))
        if i % 5 == 0:
            table[:, 1] = table[:, 0]
        copies = rng.integers(1, 6, len(table)).astype(float)
        state, n = packed_stack(np.exp(table - table.max(1, keepdims=True)), copies, 1e-8)
        assert state.slopes.max() <= 1 + 1e-8 and state.weights.sum() == pytest.approx(1)
        taken.append(n)
    assert np.mean(taken) < 12 and max(taken) <= 40


def test_stacking_pairs_equals_stacking_their_products(spark):
    rng = np.random.default_rng(8)
    sides = [f"s{k}" for k in range(4)]
    half = {s: (rng.normal(-1, 0.8, 50), rng.normal(-1, 0.8, 50)) for s in sides}
    copies = [1 + i % 3 for i in range(50)]
    halves = spark.createDataFrame(
        [(s, i, 0, copies[i], float(c[i]), float(z[i])) for s, (c, z) in half.items() for i in range(50)],
        "side string, cell_id long, cnt long, copies long, elpd_count double, elpd_zero double",
    )
    pairs = spark.createDataFrame([(f"{a}-{b}", a, b) for a in sides for b in sides], "model_name string, count_side string, hurdle_side string")
    whole = points(spark, {f"{a}-{b}": half[a][0] + half[b][1] for a in sides for b in sides}, copies)
    found = weights.stack_pairs(halves, pairs, tol=1e-8)
    assert found.where("not converged").count() == 0
    got, want = as_dict(found, "gradient"), as_dict(weights.stack(whole, tol=1e-8), "gradient")
    assert got == pytest.approx(want, abs=1e-5)
    assert as_dict(found) == pytest.approx(as_dict(weights.stack(whole, tol=1e-8)), abs=1e-4)


def test_many_tasks_add_up(spark, mixed, monkeypatch):
    _, p = mixed
    want = as_dict(weights.stack(p))
    monkeypatch.setattr(weights, "FEW_PARTS", 2)
    staged = weights.stage
    monkeypatch.setattr(weights, "stage", lambda df, name: staged(df.repartition(7), name))
    monkeypatch.setattr(weights, "_packed", lambda points, keys, real=weights._packed: real(points, keys).repartition(7))
    assert as_dict(weights.stack(p)) == pytest.approx(want, abs=1e-6)


def test_steps_never_lower_the_score(spark, mixed):
    _, p = mixed
    dens = weights.densities(p).cache()
    w, last = weights.uniform_weights(p), None
    for _ in range(4):
        score = weights.objective(dens, w).first().neg_log_score
        assert last is None or score <= last + 1e-9
        w, last = weights.em_step(dens, w).cache(), score
        assert w.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


def test_classes_equal_single_trials(spark, mixed):
    """A class of m equal trials counts like m trials."""
    table, _ = mixed
    copies = [1 + i % 4 for i in range(60)]
    packed = points(spark, table, copies)
    loose = points(spark, {m: np.repeat(v, copies) for m, v in table.items()})
    assert as_dict(weights.em_steps(packed, 3)) == pytest.approx(as_dict(weights.em_steps(loose, 3)))
    assert as_dict(weights.pseudo_bma(packed)) == pytest.approx(as_dict(weights.pseudo_bma(loose)))
    a = as_dict(weights.pseudo_bma_bootstrap(packed, 400, seed=1))
    b = as_dict(weights.pseudo_bma_bootstrap(loose, 400, seed=2))
    assert a == pytest.approx(b, abs=0.08)


def test_blocked_bootstrap_equals_the_joins(spark, mixed):
    """The product in blocks against one row per class, model and replicate."""
    table, _ = mixed
    p = points(spark, table, [1 + i % 4 for i in range(60)])
    masses = weights.bootstrap_masses(p, 200, 1234)
    want = {(r.replicate, r.model_name): r.weight for r in weights.replicate_weights(weights.bootstrap_scores(p, masses)).collect()}
    got = {(r.replicate, r.model_name): r.weight for r in weights.bootstrap_weights(p, 200).collect()}
    assert got == pytest.approx(want, rel=1e-9) and len(got) == 1200


def test_chunks_are_stacked_apart(spark, mixed):
    _, p = mixed
    chunked = weights.balanced_chunks(weights.pseudo_bma(p), 2)
    sizes = sorted(r["count"] for r in chunked.groupBy("chunk").count().collect())
    assert sizes == [3, 3]
    first = weights.first_pass(p, chunked, tol=1e-4)
    assert [r[0] for r in first.groupBy("chunk").agg(F.sum("weight")).select("sum(weight)").collect()] == pytest.approx([1, 1])
    for c in (1, 2):
        names = [r.model_name for r in chunked.where(F.col("chunk") == c).collect()]
        alone = as_dict(weights.stack(p.where(F.col("model_name").isin(names)), tol=1e-4))
        assert as_dict(first.where(F.col("chunk") == c)) == pytest.approx(alone, abs=1e-6)


def test_one_model_gets_all_weight_and_none_is_an_error(spark):
    one = points(spark, {"a": [-1.0, -2.0]})
    assert as_dict(weights.stack(one)) == {"a": 1.0}
    with pytest.raises(ValueError):
        weights.stack(one.where("model_name = 'b'"))


def test_unfinished_stacking_says_so(spark, mixed):
    _, p = mixed
    early, late = weights.stack(p, max_steps=1), weights.stack(p)
    assert not early.where("converged").count() and not late.where("not converged").count()


def test_allocation_rounds_half_to_even_and_samples_without_replacement(spark):
    table = spark.createDataFrame(
        [("a", 1, 0.8), ("b", 2, 0.1), ("c", 3, 0.1), ("d", 4, 0.05)], "model_name string, id long, weight double"
    )
    got = as_dict(draws.allocate(table, 4), "n_draws")
    assert got == {"a": 4, "b": 0, "c": 0, "d": 0}
    index = draws.draw_index(draws.allocate(table, 400), 400).cache()
    per_model = {r.model_name: r["count"] for r in index.groupBy("model_name").count().collect()}
    assert per_model == {"a": 400, "b": 50, "c": 50, "d": 25}
    assert index.select("draw_id").distinct().count() == index.count()
    assert index.where("draw_in_model NOT BETWEEN 1 AND 400").count() == 0
