import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twofold.operators import density, draws, effects, expected

CELLS = "host_site string, genus string, family string, source_site string"


@pytest.fixture(scope="module")
def tiny(spark):
    """Four draws: neither factor, parent only, child only, both."""
    rows = []

    def add(draw, term, kind, level, value):
        rows.append((draw, "m", "count", kind, term, level, float(value)))

    for d in (1, 2, 3, 4):
        add(d, "intercept", "intercept", "", 0.5)
    add(1, "native", "fixed", "true", 0.1)
    for d in (2, 4):
        add(d, "source", "fixed", "AMERICA", 0.2)
    for d in (3, 4):
        add(d, "(1|family)", "random", "F1", 0.3)
        add(d, "(1|family)", "random", "F2", -0.4)
    schema = "draw_id long, model_name string, component string, kind string, term string, level string, value double"
    draws = spark.createDataFrame(rows, schema)
    index = spark.createDataFrame([(d, "m", d) for d in (1, 2, 3, 4)], "draw_id long, model_name string, draw_in_model int")
    cells = spark.createDataFrame(
        [("AFRICA", "M", "F1", "AFRICA"), ("ASIA", "A", "F2", "AMERICA")], CELLS
    )
    return draws, index, cells


def test_pooled_factor_cases(tiny):
    draws, index, cells = tiny
    rows = effects.pool_source(draws, index, cells, "AFRICA").where("component = 'count'").collect()
    joint = {(r.draw_id, r.level): r for r in rows if r.factor == "Source + Family"}
    assert joint[(4, "F1")].linear_value == pytest.approx(math.exp(0.5 + 0.0 + 0.3))
    assert joint[(4, "F2")].linear_value == pytest.approx(math.exp(0.5 + 0.2 - 0.4))
    assert all(joint[(d, None)].absent for d in (1, 2, 3)) and len(joint) == 5
    pooled = [r for r in rows if r.factor == "Source (pooled)"]
    assert sorted(r.draw_id for r in pooled) == [1, 2, 2, 3, 3, 4, 4]
    assert [r.draw_id for r in pooled if r.absent] == [1]


def test_frequencies_and_sizes(tiny):
    draws, index, cells = tiny
    rows = effects.marginals(draws, index).unionByName(
        effects.pool_source(draws, index, cells, "AFRICA")
    )
    sizes = effects.effect_sizes(rows).where("component = 'count'").cache()
    freq = {r.factor: r.frequency for r in effects.inclusion(sizes).collect()}
    assert freq["Source Site"] == 0.5 and freq["Family (RE)"] == 0.5 and freq["Native"] == 0.25
    assert freq["Source + Family"] == 0.25 and freq["Source (pooled)"] == 0.75
    got = {(r.factor, r.draw_id): r for r in sizes.collect()}
    want = np.std([math.exp(0.5), math.exp(0.7)], ddof=1)
    assert got[("Source Site", 2)].effect_size == pytest.approx(want)
    assert got[("Source Site", 1)].absent and got[("Source Site", 1)].effect_size is None
    # One row per draw and factor: nothing is doubled.
    assert sizes.count() == len(got) and effects.n_draws(sizes).first()[0] == 4
    inside = effects.partition_by_presence(sizes, "Family (RE)", "Source Site", "with", "without")
    assert {r.draw_id: r.partition for r in inside.collect()} == {3: "without", 4: "with"}


def test_one_level_has_no_spread(spark):
    rows = [(1, "count", "Block (RE)", "b1", 0.0, 1.5, False)]
    df = spark.createDataFrame(
        rows, "draw_id long, component string, factor string, level string, intercept double, linear_value double, absent boolean"
    )
    r = effects.effect_sizes(df).first()
    assert r.effect_size is None and not r.absent


def test_each_child_level_has_one_parent(spark, sf_dir):
    from twofold.plans.ensemble import Study

    cells = Study(spark, sf_dir).cells
    for dim in (effects.family_dimension(cells), effects.genus_dimension(cells)):
        assert dim.count() == dim.select("level").distinct().count()


def test_reference_host_takes_its_genus_from_the_trials(spark):
    """The reference host is in genus M, so its joint row includes the genus offset."""
    rows = [
        (1, "m", "count", "intercept", "intercept", "", 0.1),
        (1, "m", "count", "fixed", "genus", "M", 0.7),
        (1, "m", "count", "fixed", "host", "ASIA", 0.4),
    ]
    draws = spark.createDataFrame(
        rows, "draw_id long, model_name string, component string, kind string, term string, level string, value double"
    )
    index = spark.createDataFrame([(1, "m", 1)], "draw_id long, model_name string, draw_in_model int")
    cells = spark.createDataFrame([("AFRICA", "M", "F", "S"), ("ASIA", "A", "F", "S")], CELLS)
    joint = effects.pool_host(draws, index, cells, "A", "AFRICA").where(
        "component = 'count' AND factor = 'Genus + Host'"
    )
    got = {r.level: r.linear_value for r in joint.collect()}
    assert got == pytest.approx({"AFRICA": math.exp(0.8), "ASIA": math.exp(0.5)})


def test_density_equals_direct_sum(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(300, 2))
    df = spark.createDataFrame([("count", i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "component string, draw_id long, x double, y double").repartition(5)
    n = 21
    got = {(r.i, r.j): r.z for r in density.density_2d(df, n).collect()}
    def h(v):
        q = np.quantile(v, [0.25, 0.75])
        return 1.06 * min(v.std(ddof=1), (q[1] - q[0]) / 1.34) * len(v) ** -0.2
    grids = [np.linspace(v.min(), v.max(), n) for v in pts.T]
    k = [np.exp(-0.5 * ((g[:, None] - v[None, :]) / h(v)) ** 2) / np.sqrt(2 * np.pi) / h(v) for g, v in zip(grids, pts.T)]
    z = k[0] @ k[1].T / len(pts)
    assert len(got) == n * n
    for (i, j), v in got.items():
        assert v == pytest.approx(z[i, j], rel=1e-9)
    curve = density.density_1d(df, ["component"], "x", 201).orderBy("x").collect()
    area = np.trapezoid([r.density for r in curve], [r.x for r in curve])
    assert 0.9 < area < 1.01


def test_alpha_rule(spark):
    df = spark.createDataFrame([("count", 0.5), ("prop", 0.5), ("count", 3.0)], "component string, z double")
    assert [(r.alpha, r.plot_alpha) for r in density.with_alpha(df).collect()] == [(0.25, 0.5), (0.5, 0.5), (1.0, 1.0)]


def test_measures_are_ordered_explicitly(spark):
    rows = [("count", "Genus", 0.2, 0.5), ("count", "Native", 0.9, 0.1), ("prop", "Genus", 0.4, 0.3)]
    table = spark.createDataFrame(
        [(c, f, q, m, m - 0.1, m + 0.1) for c, f, q, m in rows],
        "component string, factor string, frequency double, q_5 double, q_025 double, q_975 double",
    )
    got = density.measures(table, []).where("measure_ordinal = 1").orderBy("factor_ordinal").collect()
    assert [(r.component, r.factor) for r in got] == [
        ("Frequency", "Host Genus"),
        ("Count", "Host Genus"),
        ("Count", "Native"),
    ]


def test_groups_without_spread_stay_in_densities(spark):
    rows = [("count", float(i), float(i % 3)) for i in range(9)] + [("prop", float(i), 0.0) for i in range(9)] + [("one", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "component string, x double, y double")
    grid = density.density_2d(df, 5)
    got = {r.component: (r.n, r.zs) for r in grid.groupBy("component").agg(F.count("*").alias("n"), F.count("z").alias("zs")).collect()}
    assert got == {"count": (25, 25), "prop": (25, 0), "one": (25, 0)}
    alpha = density.with_alpha(grid).where("component = 'prop'").select("alpha", "plot_alpha").distinct().collect()
    assert [tuple(r) for r in alpha] == [(None, None)]
    assert density.normalised(grid).groupBy("component").count().count() == 3
    curve = density.density_1d(df, ["component"], "y", 5)
    got = {r.component: (r.n, r.ds, r.low) for r in curve.groupBy("component").agg(F.count("*").alias("n"), F.count("density").alias("ds"), F.min("x").alias("low")).collect()}
    assert got == {"count": (5, 5, 0.0), "prop": (5, 0, 0.0), "one": (5, 0, 2.0)}


def test_wide_draws_hold_every_parameter(spark):
    rows = [(1, "m", "count", "intercept", "", 0.5), (1, "m", "prop", "source:host", "ASIA:h1", 0.2), (2, "n", "count", "(1|block)", "b1", 0.3), (2, "n", "prop", "source", "EUROPE", 0.4)]
    df = spark.createDataFrame(rows, "draw_id long, model_name string, component string, term string, level string, value double")
    wide = draws.wide_draws(df)
    names = ["count_1_block_b1", "count_intercept", "prop_source_EUROPE", "prop_source_host_ASIA_h1"]
    assert wide.columns == ["draw_id", "model_name", *names]
    got = {r.draw_id: tuple(r[2:]) for r in draws.zero_filled(wide).collect()}
    assert got == {1: (0.0, 0.5, 0.0, 0.2), 2: (0.3, 0.0, 0.4, 0.0)}


def test_interactions_with_a_reference_need_no_parameter(spark):
    cells = spark.createDataFrame([(1, "h0", "g", "A"), (2, "h1", "g", "A"), (3, "h1", "g", "B")], "cell_id long, host_site string, genus string, source_site string")
    rows = [(1, "m", "count", "source:host", "B:h1", 0.2), (1, "m", "prop", "host", "h1", 0.1)]
    df = spark.createDataFrame(rows, "draw_id long, model_name string, component string, term string, level string, value double")
    got = expected.complete_share(cells, df, "cell_id", ["source:host"], {"host": "h0", "source": "A"}).collect()
    assert {r.cell_id: (r.prop_count, r.prop_hu) for r in got} == {1: (1.0, 1.0), 2: (1.0, 1.0), 3: (1.0, 0.0)}
