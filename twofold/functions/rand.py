"""Reproducible randomness as column expressions.

Each variate is a function of a text key only, so a value never depends on
partitioning, task order or retries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def key(purpose: str, *parts) -> Column:
    """Join the parts of a random key with ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", F.lit(purpose), *[c.cast("string") for c in cols])


def uniform(k: Column, word: int = 0) -> Column:
    """Uniform on (0, 1) from one of the four 32-bit words of md5(k)."""
    digits = F.substring(F.md5(k), 1 + 8 * word, 8)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(_TWO_32)


def exponential(k: Column) -> Column:
    return -F.ln(uniform(k))


def normal(k: Column) -> Column:
    """Box-Muller from the first two words of md5(k)."""
    return F.sqrt(F.lit(-2.0) * F.ln(uniform(k, 0))) * F.cos(F.lit(2.0 * math.pi) * uniform(k, 1))


def with_gamma(df: DataFrame, name: str, k: Column, shape: Column, attempts: int = 12) -> DataFrame:
    """Add a Gamma(shape, 1) variate, for shape >= 1, by Marsaglia and Tsang's squeeze.

    A sum of ``shape`` unit exponentials has this law, so the weight of a class
    of equal trials costs one variate, not one per trial. At most one attempt in
    twenty is rejected: the first is plain column arithmetic, the rest run only
    for rows that need them, and running out has probability below 1e-15.
    """

    def cube(x: Column, d: Column) -> Column:
        return F.pow(F.lit(1.0) + F.lit(1.0) / F.sqrt(F.lit(9.0) * d) * x, F.lit(3.0))

    def accepted(x: Column, v: Column, u: Column, d: Column) -> Column:
        bound = F.lit(0.5) * x * x + d - d * v + d * F.ln(v)
        return (v > 0) & (F.ln(u) < bound)

    def again(found: Column, number: Column) -> Column:
        at = F.concat_ws("|", "_key", number.cast("string"))
        tried = F.transform(
            F.array(F.struct(normal(at).alias("x"), uniform(at, 2).alias("u"))),
            lambda t: F.when(
                accepted(t["x"], cube(t["x"], F.col("_d")), t["u"], F.col("_d")),
                F.col("_d") * cube(t["x"], F.col("_d")),
            ),
        )
        return F.coalesce(found, tried[0])

    first = F.concat_ws("|", "_key", F.lit("1"))
    later = F.aggregate(F.sequence(F.lit(2), F.lit(attempts)), F.lit(None).cast("double"), again)
    x, v, u, d = (F.col(c) for c in ("_x", "_v", "_u", "_d"))
    return (
        df.withColumns({"_key": k, "_d": shape.cast("double") - F.lit(1.0 / 3.0)})
        .withColumns({"_x": normal(first), "_u": uniform(first, 2)})
        .withColumn("_v", cube(x, d))
        .withColumn(name, F.when(accepted(x, v, u, d), d * v).otherwise(F.coalesce(later, d)))
        .drop("_key", "_d", "_x", "_u", "_v")
    )


def seed32(k: Column, limit: int) -> Column:
    """Integer in [1, limit]."""
    return (F.floor(uniform(k) * F.lit(float(limit))) + F.lit(1)).cast("long")
