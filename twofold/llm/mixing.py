"""Mixing sources to target weights by weighted sampling without replacement.

A document's key is an exponential variate divided by its quality weight
(Efraimidis and Spirakis), so ascending keys draw documents with probability
proportional to weight. A source is first taken whole, once per complete epoch
of its target; the rest of the target is filled in key order up to the budget.
Running sums are taken in two levels: over slices of the key's range, then
within the one slice that holds the boundary, so no task sorts a whole source.
What a document gives then follows from its source's boundary alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twofold.functions.rand import exponential, key
from twofold.llm.text import WORD, word_count
from twofold.sources.tables import stage

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
SLICE_ROWS = 5_000
_MARKS = "0123456789#*$%&|<>@{}[]\\/=+_~^"


def quality_weight(text: Column) -> Column:
    """Share of a text's characters that are not digits or marks, 0.1 at least; 0.1 for null and empty texts."""
    plain = F.length(F.translate(text, _MARKS, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.coalesce(plain, F.lit(0.0)), F.lit(0.1))


def keyed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` with size (words) and key; the key depends on doc_id and text only, so reruns agree."""
    text = F.coalesce("text", F.lit(""))
    variate = exponential(key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))))
    return docs.withColumns({"size": word_count(F.col("text")), "key": variate / quality_weight(F.col("text"))})


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target) from rows with source and size.

    Sources in code point order, null last, get the weights in turn and share
    ``percent`` of all sizes. A target stops at ``most`` times its source's size
    and the excess is shared by the others, until none is above. In order of cap
    per weight, the level that fits when all sources before are capped first
    stays within the cap at the true level, and falls from there on. The table
    has a row per source: its windows run over sources, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1).cast("long")
    ranked = per.withColumn("weight", given).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    capped, used = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("cap", "weight"))
    levels = ranked.withColumn(
        "level",
        (F.sum("source_size").over(every) * F.lit(percent) / F.lit(100.0) - capped) / (F.sum("weight").over(every) - used),
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.coalesce(F.max(fits).over(every) * F.col("weight"), F.col("cap").cast("double"))
    return levels.select("source", "source_size", "n_docs", F.least(level, F.col("cap").cast("double")).alias("target"))


def boundaries(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with epochs, and the key and words of the document at the boundary of the last, partial epoch.

    ``sizes`` has source, size and key. ``last_key`` is null where no partial epoch is needed.
    """
    goal = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    per = targets.withColumn("epochs", epochs).withColumn("rest", goal - F.col("epochs") * F.col("source_size"))
    open_ = stage(per.where("rest > 0").withColumnRenamed("source", "of"), "targets")
    slices = F.ceil(F.col("n_docs") / SLICE_ROWS)
    within = (
        sizes.where("size > 0")
        .join(open_.select("of", "n_docs", "rest"), F.col("source").eqNullSafe(F.col("of")))
        .select("of", "rest", "size", "key", F.floor((1 - F.exp(-F.col("key"))) * slices).alias("slice"))
    )
    sums = within.groupBy("of", "rest", "slice").agg(F.sum("size").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy("of").orderBy("slice"))
    hit = sums.withColumn("before", upto - F.col("sum")).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") >= F.col("rest")))
    last = within.join(
        hit.select(F.col("of").alias("at"), F.col("slice").alias("piece"), "before"),
        F.col("of").eqNullSafe(F.col("at")) & (F.col("slice") == F.col("piece")),
    )
    run = F.col("before") + F.sum("size").over(Window.partitionBy("of").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = (
        last.withColumn("run", run)
        .where((F.col("run") >= F.col("rest")) & (F.col("run") - F.col("size") < F.col("rest")))
        .select(F.col("of").alias("edge"), F.col("key").alias("last_key"), (F.col("rest") - F.col("run") + F.col("size")).alias("last_words"))
    )
    return stage(per.join(edge, F.col("source").eqNullSafe(F.col("edge")), "left").drop("edge", "rest", "n_docs"), "boundaries")


def taken_words(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows`` (source, size, key and more) with source_size, target, epochs and part, the words of the partial epoch."""
    joined = rows.join(bounds.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    part = (
        F.when(F.col("key") < F.col("last_key"), F.col("size"))
        .when(F.col("key") == F.col("last_key"), F.least("last_words", "size"))
        .otherwise(0)
    )
    return joined.withColumn("part", part.cast("long"))


def _planned(docs: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    sizes = stage(keyed(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size", "key"), "sizes")
    return sizes, boundaries(sizes, source_targets(sizes, weights, percent, most))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs``.

    Null and empty texts have size 0 and give nothing; rows without a source are a
    source of their own, in last place. Repeated rows (same doc_id and text) have
    the same key; at the boundary each gives the same part. Rows without doc_id
    are told apart by text. Only doc_id, text and source are read. An empty table
    gives an empty table.
    """
    sizes, bounds = _planned(docs, weights, percent, most)
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return taken_words(sizes, bounds).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: rows of ``docs``, one per complete epoch and one for the partial epoch.

    The document at the boundary is cut to its first words, joined by one space.
    Cases are those of ``mix_plan``; a text without words is in no epoch.
    """
    _, bounds = _planned(docs, weights, percent, most)
    rows = taken_words(keyed(docs.select("doc_id", "text", "source", "lang", "n_chars")), bounds).where("size > 0")
    copies = F.concat(
        F.array_repeat(F.col("size"), F.col("epochs").cast("int")),
        F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")),
    )
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")
    out = rows.withColumn("words", F.explode(copies)).withColumn("text", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text")))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
