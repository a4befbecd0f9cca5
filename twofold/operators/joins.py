"""Joins that keep hot keys and all-by-all products spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(
    facts: DataFrame,
    dims: DataFrame,
    keys: str | list[str],
    spread: str,
    salts: int = 8,
    how: str = "inner",
) -> DataFrame:
    """Equi-join with each key cut into ``salts`` parts.

    ``dims`` (few rows per key) is repeated once per part, so a key that holds a
    third of ``facts`` goes to several tasks. ``spread`` is the fact column that
    picks the part.
    """
    on = [keys] if isinstance(keys, str) else list(keys)
    cut = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    return cut.join(dims.withColumn("_salt", parts), [*on, "_salt"], how).drop("_salt")


def block_product(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_blocks: int | None = None,
    right_blocks: int = 4,
) -> DataFrame:
    """Every left row with every right row, as an equi-join on block numbers.

    For results that are by definition one row per (left, right). Each side is
    cut into blocks by its id and repeated once per block of the other side, so
    the work splits into ``left_blocks * right_blocks`` even groups. By default
    the left side is cut as finely as the session's shuffles.
    """
    if left_blocks is None:
        left_blocks = max(8, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def block(col: str, n: int):
        return F.pmod(F.xxhash64(col), F.lit(n))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    a = left.withColumn("_lb", block(left_id, left_blocks)).withColumn("_rb", every(right_blocks))
    b = right.withColumn("_rb", block(right_id, right_blocks)).withColumn("_lb", every(left_blocks))
    return a.join(b, ["_lb", "_rb"]).drop("_lb", "_rb")
