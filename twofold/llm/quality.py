"""Quality rules on texts and their hosts, in plain column expressions.

Each text is measured by itself; failures of the text rules are then summed by
host, rates are shrunk to a beta prior fitted to all hosts, and a host whose
shrunk rate is above the limit takes its documents with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twofold.llm.text import WORD
from twofold.sources.tables import stage

LEAST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
HOST_LIMIT = 0.5
_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more, from the hashes of a text's windows in order.

    Windows are sorted with their places, so equals are neighbours; the places of
    those with an equal neighbour, in order, each cover the words up to the next.
    """

    def places(sorted_: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return (F.get(sorted_, i - 1)["h"] == x["h"]) | (F.get(sorted_, i + 1)["h"] == x["h"])

        return F.sort_array(F.transform(F.filter(sorted_, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["p"]))

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    covered = F.aggregate(
        _let(placed, places),
        F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(
            p.alias("last"), (acc["n"] + F.coalesce(F.least(p - acc["last"], F.lit(window)), F.lit(window))).cast("long").alias("n")
        ),
    )["n"]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def text_measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    first = docs.select(
        *keep,
        _without(text, _BLANKS).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, _SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.transform(split, lambda w: F.xxhash64(w)).alias("words"),
    )
    n = F.size("words")

    def windows(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    hashed = F.when(n > WINDOW, windows(F.col("words"))).otherwise(F.array().cast("array<bigint>"))
    second = first.select(*keep, n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", hashed.alias("windows")).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("windows")).alias("n_repeat_words")
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    return second.withColumn("base_failed", failed)


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """(host, n_docs, n_failed, rate): failure rates shrunk to a beta prior.

    The prior's mean is that of all documents; its strength comes from how far
    hosts' rates vary beyond what their sizes explain, between 1 and a million
    documents. Rows without a host are in no host.
    """
    per = stage(
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")),
        "hosts",
    )
    n, f = F.col("n_docs"), F.col("n_failed")
    all_ = per.agg(F.sum(f).alias("f"), F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff")).first()
    mean = all_.f / all_.n if all_.n else 0.0
    spread = mean * (1 - mean)
    strength = 1e6
    effective = all_.n - all_.nn / all_.n if all_.n else 0.0
    if effective > 0 and spread > 0:
        # Weighted sum of squares between hosts against its expectation without any difference.
        between = (all_.ff - all_.n * mean * mean - (all_.k - 1) * spread) / effective
        if between > 0:
            strength = min(max(spread / between - 1, 1.0), 1e6)
    rate = (f + F.lit(mean * strength)) / (n + F.lit(strength))
    return per.withColumn("rate", rate)


def quality_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures of each row of ``docs`` with base_failed, host_rate and kept.

    A row is kept if it passes the text rules and its host's shrunk failure rate
    is at most ``limit``. Null and empty texts have no words and fail. Rows
    without a host are judged by their text alone. Repeated rows count each; only
    doc_id, text and the host column are read. An empty table gives an empty table.
    """
    measured = stage(text_measures(docs, ("doc_id", host)), "measures")
    rates = host_rates(measured, host).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"))
    joined = measured.join(rates, F.col(host) == F.col("_host"), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_rate") <= limit, F.lit(True)))
