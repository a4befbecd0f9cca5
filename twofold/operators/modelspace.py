"""Candidate two-part models: generation, structural pruning, run settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twofold.functions import rand
from twofold.operators.trials import CELL_KEYS
from twofold.rules import (
    ADAPT_DELTA,
    INTERACTION_RULES,
    NESTING_RULES,
    TERMS,
    Form,
)

MAX_SEED = 2**31 - 1
PRIORS_TYPE = "array<struct<dist:string,class:string,dpar:string>>"


def term_level(term: str) -> Column:
    """Level of a term in a design cell; interactions join their two levels."""
    columns = {
        "host": ("host_site",),
        "source": ("source_site",),
        "source:host": ("source_site", "host_site"),
        "genus": ("genus",),
        "genus:source": ("genus", "source_site"),
        "native": ("native",),
        "(1|block)": ("block",),
        "(1|family)": ("family",),
    }[term]
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def cell_levels(cells: DataFrame) -> DataFrame:
    """One row per cell and term: the level of that term in the cell."""
    rows = F.array(*[F.struct(F.lit(t).alias("term"), term_level(t).alias("level")) for t in TERMS])
    return cells.select("cell_id", F.inline(rows))


def usable_terms(trials: DataFrame) -> DataFrame:
    """Terms that vary in the trials, with their number of levels.

    A term with one level cannot be estimated and stays out of the model space.
    """
    cells = trials.select(*CELL_KEYS).distinct().withColumn("cell_id", F.lit(0).cast("long"))
    number = F.array_position(F.array(*[F.lit(t) for t in TERMS]), F.col("term")) - 1
    return (
        cell_levels(cells)
        .groupBy("term")
        .agg(F.countDistinct("level").alias("n_levels"))
        .where(F.col("n_levels") > 1)
        .withColumn("bit", number)
    )


def _offends(terms: Column, rule: tuple[str, tuple[str, ...]]) -> Column:
    return bad_combo(terms, [rule[0]], list(rule[1]))


def bad_combo(terms: Column, higher: list[str], required: list[str]) -> Column:
    """True if any higher term is present while any required term is missing."""
    need = F.array(*[F.lit(r) for r in required])
    return F.arrays_overlap(terms, F.array(*[F.lit(h) for h in higher])) & (
        F.size(F.array_except(need, terms)) > 0
    )


def term_subsets(usable: DataFrame) -> DataFrame:
    """All non-empty subsets of the usable terms, as a bit mask and an array.

    The term list is one row of at most eight terms; the subsets are generated
    by exploding their numbers.
    """
    one = usable.agg(
        F.sort_array(F.collect_list(F.struct("bit", "term", "n_levels"))).alias("parts")
    )
    last = F.pow(F.lit(2.0), F.size("parts")).cast("long") - 1
    picks = F.explode(F.sequence(F.lit(1).cast("long"), last))
    chosen = F.filter(
        "parts", lambda x, i: F.getbit(F.col("pick"), i.cast("int")) == 1
    )
    total = lambda f: F.aggregate("chosen", F.lit(0).cast("long"), f)
    return (
        one.withColumn("pick", picks)
        .withColumn("chosen", chosen)
        .select(
            total(lambda a, x: a + F.pow(F.lit(2.0), x["bit"]).cast("long")).alias("mask"),
            F.col("chosen.term").alias("terms"),
            total(lambda a, x: a + x["n_levels"] - 1).alias("n_coef"),
        )
    )


def drop_broken_interactions(subsets: DataFrame, strict: bool = True) -> DataFrame:
    """Drop subsets with an interaction but not both its main effects.

    ``strict=False`` applies the first rule only, which is what the published
    analysis in effect did at this step.
    """
    rules = INTERACTION_RULES if strict else INTERACTION_RULES[:1]
    kept = subsets
    for rule in rules:
        kept = kept.where(~_offends(F.col("terms"), rule))
    return kept


def formula(terms: Column, response: str) -> Column:
    return F.concat(F.lit(f"{response} ~ "), F.array_join(terms, " + "))


def two_part(subsets: DataFrame) -> DataFrame:
    """Every count part with every hurdle part.

    The size of the model space is set by the number of terms (255 subsets at
    most), so the subsets travel as one array that is exploded once per part.
    """
    part = F.struct("mask", "terms", "n_coef")
    return (
        subsets.agg(F.sort_array(F.collect_list(part)).alias("parts"))
        .select("parts", F.inline("parts").alias("count_mask", "count_terms", "count_coef"))
        .select(
            "count_mask",
            "count_terms",
            "count_coef",
            F.inline("parts").alias("hurdle_mask", "hurdle_terms", "hurdle_coef"),
        )
        .withColumn("count_formula", formula(F.col("count_terms"), "cnt"))
        .withColumn("hurdle_formula", formula(F.col("hurdle_terms"), "hu"))
    )


def has_random(text: Column) -> Column:
    return F.contains(text, F.lit("block")) | F.contains(text, F.lit("family"))


def has_fixed(text: Column) -> Column:
    """Any fixed predictor, by substring of the formula's right-hand side."""
    words = ("host", "source", "native", "genus")
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def with_effect_flags(candidates: DataFrame) -> DataFrame:
    return (
        candidates.withColumn("count_random", has_random(F.col("count_formula")))
        .withColumn("hurdle_random", has_random(F.col("hurdle_formula")))
        .withColumn("count_fixed", has_fixed(F.col("count_formula")))
        .withColumn("hurdle_fixed", has_fixed(F.col("hurdle_formula")))
    )


def priors() -> Column:
    """Prior list from the four effect flags."""

    def one(dist, cls, dpar):
        return F.struct(F.lit(dist).alias("dist"), F.lit(cls).alias("class"), F.lit(dpar).alias("dpar"))

    # Prior families and scales.
    specs = F.array(
        one("normal(0, 6)", "Intercept", ""),
        F.when(F.col("hurdle_random"), one("student_t(7, 0, 1)", "sd", "hu")),
        F.when(F.col("count_random"), one("student_t(7, 0, 1.5)", "sd", "")),
        F.when(F.col("hurdle_fixed"), one("normal(0, 1)", "b", "hu")),
        F.when(F.col("count_fixed"), one("normal(0, 1.5)", "b", "")),
    )
    return F.filter(specs, lambda x: x.isNotNull())


def prior_text(col: str = "priors") -> Column:
    spec = F.transform(col, lambda p: F.concat_ws("/", p["dist"], p["class"], p["dpar"]))
    return F.array_join(spec, "; ")


def model_id(count_mask: Column, hurdle_mask: Column) -> Column:
    return count_mask * F.lit(256).cast("long") + hurdle_mask


def with_run_settings(candidates: DataFrame, seed: int = 93093) -> DataFrame:
    """Identifier, name, tuning value and a seed that depends on the model only."""
    return (
        candidates.withColumn("id", model_id(F.col("count_mask"), F.col("hurdle_mask")))
        .withColumn("model_name", F.concat(F.lit("combo_run_"), F.col("id").cast("string")))
        .withColumn("adapt_delta", F.lit(ADAPT_DELTA))
        .withColumn("rng_seed", rand.seed32(rand.key("seed", seed, F.col("id")), MAX_SEED))
    )


def split_formula(text: Column) -> Column:
    """Terms of a formula: response removed, cut at `` + ``."""
    return F.split(F.regexp_replace(text, r"^.+ ~ ", ""), r" \+ ")


def prune(candidates: DataFrame, rules=None) -> DataFrame:
    """Keep candidates whose two parts both obey every rule."""
    rules = NESTING_RULES + INTERACTION_RULES if rules is None else rules
    kept = candidates
    for part in ("count_terms", "hurdle_terms"):
        for rule in rules:
            kept = kept.where(~_offends(F.col(part), rule))
    return kept


def keep_named(settings: DataFrame, names: DataFrame) -> DataFrame:
    return settings.join(names.select("model_name"), "model_name", "left_semi")


def still_to_run(settings: DataFrame, completed: DataFrame) -> DataFrame:
    return settings.join(completed.select("model_name"), "model_name", "left_anti")


def part_rows(settings: DataFrame) -> DataFrame:
    """One row per model and part."""
    return settings.select("id", "model_name", "count_formula", "hurdle_formula").unpivot(
        ["id", "model_name"], ["count_formula", "hurdle_formula"], "part", "formula"
    )


def candidates(usable: DataFrame, strict: bool = True) -> DataFrame:
    """The pruned model space with run settings.

    Both parts obey the same rules, so subsets are pruned before the product.
    """
    valid = drop_broken_interactions(term_subsets(usable), strict)
    for rule in NESTING_RULES + INTERACTION_RULES:
        valid = valid.where(~_offends(F.col("terms"), rule))
    return with_run_settings(two_part(valid))


def form_candidates(spark: SparkSession, forms: tuple[Form, ...], paired: bool = True) -> DataFrame:
    """Two-part candidates built from forms with a closed-form fit.

    ``paired=True`` gives all pairs of forms, else the same form in both parts.
    """
    rows = [
        (c.name, h.name, c.mask, h.mask, list(c.terms), list(h.terms))
        for c in forms
        for h in forms
        if paired or c == h
    ]
    schema = (
        "count_form string, hurdle_form string, count_mask long, hurdle_mask long, "
        "count_terms array<string>, hurdle_terms array<string>"
    )
    table = spark.createDataFrame(rows, schema)
    return with_run_settings(
        table.withColumn("count_formula", formula(F.col("count_terms"), "cnt")).withColumn(
            "hurdle_formula", formula(F.col("hurdle_terms"), "hu")
        )
    )
