import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twofold.functions import links, rand
from twofold.operators.joins import block_product, salted_join
from twofold.operators.quantiles import grouped_quantiles


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_links_at_known_points(spark):
    r = one(
        spark,
        half=links.prevalence(F.lit(0.0)),
        tiny=links.truncated_mean(F.lit(-40.0)),
        large=links.truncated_mean(F.lit(5.0)),
        back=links.inv_logit(links.logit(F.lit(0.3))),
    )
    assert r.half == 0.5 and r.back == pytest.approx(0.3)
    assert r.tiny == pytest.approx(1.0) and r.large == pytest.approx(math.exp(5.0))


def test_truncated_rate_inverts_the_mean(spark):
    rates = [1e-5, 1e-3, 0.1, 1.0, 3.0, 15.0]
    df = spark.createDataFrame([(x,) for x in rates], "rate double")
    mean = links.truncated_mean(F.ln("rate"))
    for r in df.select("rate", links.truncated_rate(mean).alias("found")).collect():
        assert r.found == pytest.approx(r.rate, rel=1e-6)


def test_ln_factorial(spark):
    ys = [0, 1, 2, 10, 20, 21, 50, 1000, 10**6]
    df = spark.createDataFrame([(y,) for y in ys], "y long")
    for r in df.select("y", links.ln_factorial(F.col("y")).alias("v")).collect():
        assert r.v == pytest.approx(math.lgamma(r.y + 1), rel=1e-12, abs=1e-12)


def test_hurdle_density_sums_to_one(spark):
    df = spark.range(60).select(
        F.exp(links.hurdle_log_density(F.col("id"), F.lit(0.4), F.lit(1.1))).alias("p")
    )
    assert df.agg(F.sum("p")).first()[0] == pytest.approx(1.0, abs=1e-12)


def test_uniforms_do_not_depend_on_partitioning(spark):
    k = rand.key("test", 7, F.col("id"))
    a = spark.range(0, 1000, 1, 1).select("id", rand.uniform(k).alias("u"))
    b = spark.range(0, 1000, 1, 9).select("id", rand.uniform(k).alias("u"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    u = np.array([r.u for r in a.collect()])
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03


@pytest.mark.parametrize("shape", [1, 2, 40, 100000])
def test_gamma_moments(spark, shape):
    df = rand.with_gamma(spark.range(20000), "g", rand.key("g", 1, F.col("id")), F.lit(shape))
    r = df.agg(F.avg("g").alias("m"), F.var_samp("g").alias("v"), F.min("g").alias("low")).first()
    assert r.low > 0
    assert abs(r.m - shape) < 5 * math.sqrt(shape / 20000)
    assert r.v == pytest.approx(shape, rel=0.1)


def test_quantiles_equal_numpy(spark):
    """A hot group, ties, values in one narrow bin, both signs, infinities, tiny and empty groups, a null key."""
    rng = np.random.default_rng(3)
    rows = [("big", float(v)) for v in rng.lognormal(size=30000)]
    rows += [("ties", float(v)) for v in rng.integers(0, 5, 20000)]
    rows += [("zeros", 0.0)] * 9000 + [("zeros", float(v)) for v in rng.random(1000)]
    rows += [("narrow", 1e9 + float(v) * 1e-3) for v in rng.random(5000)]
    rows += [("signs", float(v)) for v in rng.normal(size=4001) * 10.0 ** rng.integers(-300, 300, 4001)]
    rows += [("powers", 2.0**e * f) for e in range(-40, 40) for f in (1.0, 1 - 2**-53, 1 + 2**-52)]
    rows += [("endless", float("inf"))] * 5 + [("endless", 1.0)] * 5 + [("tiny", 1.0), ("tiny", 2.0), (None, 5.0), ("tiny", None), ("void", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = (0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0)
    names = tuple(f"q{i}" for i in range(len(probs)))
    got = {r.k: r for r in grouped_quantiles(df, ["k"], "v", probs, names, extra=(F.count("*").alias("n"),)).collect()}
    assert set(got) == {"big", "ties", "zeros", "narrow", "signs", "powers", "endless", "tiny", "void", None}
    for k in set(got) - {"void", "endless"}:
        values = [v for g, v in rows if g == k and v is not None]
        for p, n in zip(probs, names):
            assert got[k][n] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=0)
        assert got[k].n == sum(g == k for g, _ in rows)
    assert [got["endless"][n] for n in names] == [1.0, 1.0, 1.0, float("inf"), float("inf"), float("inf"), float("inf")]
    assert [got["void"][n] for n in names] == [None] * 7 and got["void"].n == 1
    twice = df.selectExpr("k AS a", "cast(v > 1 AS string) AS b", "v AS rank", "1 AS bin")
    want = {(r.a, r.b): (r.m, r.n) for r in twice.groupBy("a", "b").agg(F.expr("percentile(rank, 0.5)").alias("m"), F.count("*").alias("n")).collect()}
    found = grouped_quantiles(twice, ["a", "b"], "rank", (0.5,), ("m",), extra=(F.sum("bin").alias("n"),)).collect()
    assert {(r.a, r.b): (r.m, r.n) for r in found} == want


def test_salted_join_and_block_product(spark):
    facts = spark.createDataFrame([(i, 1 if i % 3 else 2) for i in range(300)], "id long, k long")
    dims = spark.createDataFrame([(1, "a"), (2, "b")], "k long, name string")
    joined = salted_join(facts, dims, "k", spread="id")
    assert joined.count() == 300 and joined.where("name = 'b'").count() == 100
    left, right = spark.range(13).toDF("a"), spark.range(7).toDF("b")
    pairs = block_product(left, right, "a", "b", 4, 3)
    assert pairs.count() == 91 and pairs.distinct().count() == 91
