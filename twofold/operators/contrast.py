"""Contrast study: one source against chosen hosts, with named candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twofold.operators.trials import fill_block, flag_to_int, with_native_and_genus
from twofold.rules import INTERCEPT_SD, Design, Form

MISSING = "na_block"
FLAGS = ("different_species", "different_genus")
COHORT2_KEYS = ("host_site", "different_species", "different_genus")

# Named candidates of the first question. Scales are prior sds.
QUESTION1 = (
    ("Full", ("host", "(1|family)", "(1|block)"), "student_t"),
    ("Compromise", ("host", "(1|family)", "(1|block)"), "normal"),
    ("Fixed Effect", ("host",), "none"),
    ("Null", (), "none"),
    ("Random Effects", ("(1|family)", "(1|block)"), "student_t"),
)
FIXED_SD = {"prop": 0.5, "count": 0.25}
RANDOM_SD = {"prop": 0.25, "count": 0.125}
# The candidates that are weighted against each other.
QUESTION1_STACKED = ("Full", "Compromise", "Fixed Effect", "Random Effects")

# Named candidates of the second question.
QUESTION2 = (
    Form("Full", ("different_genus", "different_species", "(1|host)"), ("host_site",), FLAGS),
    Form("Species + RE", ("different_species", "(1|host)"), ("host_site",), ("different_species",)),
    Form("Genus + RE", ("different_genus", "(1|host)"), ("host_site",), ("different_genus",)),
    Form("Species", ("different_species",), ("different_species",)),
    Form("Genus", ("different_genus",), ("different_genus",)),
    Form("Fixed Effect", ("different_genus", "different_species"), FLAGS),
    Form("Random Effect", ("(1|host)",), ("host_site",), ()),
)


def _columns(raw: DataFrame) -> DataFrame:
    infected = flag_to_int(F.col("infected_flag")).alias("infected")
    return raw.select(
        "trial_id", "host_site", "family", "source_site", infected, F.col("cnt"), "block"
    )


def cohort1(raw: DataFrame, hosts: tuple[str, str] = ("EUROPE", "AFRICA"), source: str = "AFRICA") -> DataFrame:
    """Trials of one source on two host sites."""
    kept = raw.where(F.col("host_site").isin(*hosts) & (F.col("source_site") == source))
    return fill_block(_columns(kept), MISSING)


def cohort2(
    raw: DataFrame,
    same_species: tuple[str, ...] = ("EUROPE", "AFRICA"),
    source: str = "AFRICA",
    design: Design = Design(),
) -> DataFrame:
    """Trials of one source on all hosts, flagged by distance from its own host."""
    kept = _columns(raw.where(F.col("source_site") == source)).drop("block")
    return kept.withColumn("different_species", ~F.col("host_site").isin(*same_species)).withColumn(
        "different_genus", F.col("host_site").isin(*design.genus_a_hosts)
    )


def cohort1_cells(cohort: DataFrame) -> DataFrame:
    return with_native_and_genus(cohort)


def question1_sides(spark: SparkSession) -> DataFrame:
    rows = [(name, list(terms), prior) for name, terms, prior in QUESTION1]
    return spark.createDataFrame(rows, "side string, terms array<string>, prior string")


def question1_prior(side: str, component: str, term: str) -> tuple[str, float]:
    """Kind and scale of a prior of the first question's candidates, for ``additive.fit_sides``.

    The compromise differs from the full candidate by a normal prior on the sd of
    its random groups, where the others have a Student prior.
    """
    if term == "intercept":
        return "normal", INTERCEPT_SD
    if term.startswith("(1|"):
        kinds = {name: kind for name, _, kind in QUESTION1}
        return ("sd_normal" if kinds[side] == "normal" else "sd_t"), RANDOM_SD[component]
    return "normal", FIXED_SD[component]


def species_label(df: DataFrame) -> DataFrame:
    return df.withColumn("species", F.when(F.col("different_species"), "Other").otherwise("Same species"))


def observed(cohort: DataFrame) -> DataFrame:
    """Observed prevalence by host and species."""
    return (
        species_label(cohort)
        .groupBy("host_site", "species")
        .agg(F.avg(F.col("infected").cast("double")).alias("prevalence"))
        .withColumn("component", F.lit("Prevalence"))
    )
