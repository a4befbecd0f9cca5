"""Exact quantiles per group, with linear interpolation between ranks.

One way for groups of any size. Values are counted in bins first, partial counts
before the shuffle; running counts tell which bin holds each rank that is asked
for, and only values of such bins go on. Bins of the first pass are steps of one
part in 256 of a power of two, those of the second are 4,096 equal steps of a bin
that was hit; the third counts distinct values. No task sees a whole group, and a
group without values keeps its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twofold.sources.tables import stage

STEPS = 256
FINE_STEPS = 4096


def _coarse(v: Column) -> Column:
    """Bin of a value, ascending with it: sign, power of two and the step within it.

    Zero has a bin of its own, infinities and NaN (above all else, as Spark sorts it) too.
    """
    size = F.abs(v)
    power = F.greatest(F.floor(F.log2(size)), F.lit(-1080))
    step = power * STEPS + F.floor((size / F.pow(F.lit(2.0), power.cast("double")) - 1) * STEPS) + 300_000
    finite = F.when(v > 0, step).when(v < 0, -step).otherwise(F.lit(0))
    inf = F.lit(float("inf"))
    return F.when(F.isnan(v), F.lit(2_000_000)).when(v == inf, F.lit(1_000_000)).when(v == -inf, F.lit(-1_000_000)).otherwise(finite).cast("long")


def _fine(v: Column, low: Column, high: Column) -> Column:
    """Step of a value between the least and greatest of its bin."""
    part = F.floor((v - low) / (high - low) * FINE_STEPS)
    return F.when((high > low) & (high - low < float("inf")) & ~F.isnan(high), part).otherwise(F.lit(0)).cast("long")


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs,
    names,
    extra: tuple[Column, ...] = (),
) -> DataFrame:
    """One row per group with a column per probability, nulls skipped.

    ``extra`` are further aggregates of the same groups. A null key is a group as
    in ``groupBy``; a group with nulls only has null quantiles. Columns of ``df``
    other than keys and value are read by ``extra`` alone.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(o) for k, o in zip(keys, own)]
    groups = df.groupBy(*keys).agg(*extra, F.count(value).alias("_size"))
    groups = stage(groups, "groups")
    rows = stage(df.where(F.col(value).isNotNull()).select(*named, F.col(value).cast("double").alias("v")), "values")

    def same(left: str, right: str) -> Column:
        out = F.lit(True)
        for o in own:
            out = out & F.col(f"{left}.{o}").eqNullSafe(F.col(f"{right}.{o}"))
        return out

    position = [F.lit(float(p)) * (F.col("_size") - 1) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in position])))
    want = groups.where("_size > 0").select(*named, F.explode(ranks).alias("rank")).withColumn("left", F.col("rank"))

    def located(counts: DataFrame, want: DataFrame, within: list[str], order: str) -> DataFrame:
        """``want`` with the bin that holds each rank, and the rank left within it."""
        run = Window.partitionBy(*own, *within).orderBy(order)
        upto = counts.withColumn("upto", F.sum("n").over(run))
        on = same("w", "c")
        for c in within:
            on = on & (F.col(f"w.{c}") == F.col(f"c.{c}"))
        at = on & (F.col("w.left") < F.col("c.upto")) & (F.col("w.left") >= F.col("c.upto") - F.col("c.n"))
        kept = [F.col(f"w.{o}") for o in own] + [F.col("w.rank"), (F.col("w.left") - F.col("c.upto") + F.col("c.n")).alias("left")]
        return want.alias("w").join(upto.alias("c"), at).select(*kept, *[F.col(f"c.{c}") for c in counts.columns if c not in (*own, "n")])

    def inside(rows: DataFrame, hit: DataFrame, on: list[str], more: list[str]) -> DataFrame:
        few = hit.select(*own, *on, *more).distinct()
        match = same("r", "h")
        for c in on:
            match = match & (F.col(f"r.{c}") == F.col(f"h.{c}"))
        return rows.alias("r").join(few.alias("h"), match).select("r.*", *[f"h.{c}" for c in more])

    coarse = rows.withColumn("bin", _coarse(F.col("v")))
    bins = coarse.groupBy(*own, "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    hit = stage(located(bins, want, [], "bin"), "hit")
    fine = inside(coarse, hit, ["bin"], ["low", "high"]).withColumn("step", _fine(F.col("v"), F.col("low"), F.col("high")))
    steps = fine.groupBy(*own, "bin", "step").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    hit = stage(located(steps, hit.select(*own, "rank", "left", "bin"), ["bin"], "step"), "hit")
    values = inside(fine.select(*own, "v", "bin", "step"), hit, ["bin", "step"], []).groupBy(*own, "bin", "step", "v").agg(F.count("*").alias("n"))
    found = located(values, hit.select(*own, "rank", "left", "bin", "step"), ["bin", "step"], "v").select(*own, "rank", "v")
    by_rank = found.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def quantile(x: Column) -> Column:
        a, b = F.element_at("at", F.floor(x)), F.element_at("at", F.ceil(x))
        return F.when(a == b, a).otherwise(a + (x - F.floor(x)) * (b - a))

    joined = groups.join(by_rank, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)], "left")
    rest = [c for c in groups.columns if c not in (*keys, "_size")]
    return joined.select(*keys, *rest, *[quantile(x).alias(n) for x, n in zip(position, names)])


def intervals(quantiles: DataFrame, keys: list[str], spec: list[tuple[float, str, str]]) -> DataFrame:
    """Rows (interval, direction, value) from lower and upper quantile columns."""
    rows = F.array(
        *[
            F.struct(F.lit(width).alias("interval"), F.lit(side).alias("direction"), F.col(c).alias("value"))
            for width, lo, hi in spec
            for side, c in (("lower", lo), ("upper", hi))
        ]
    )
    return quantiles.select(*keys, F.inline(rows))
