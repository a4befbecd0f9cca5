"""Stages of an ensemble study over the star-schema trials.

The trials are aggregated once to classes of equal trials, which are staged;
every later table derives from that small one. Stages are shared by the
analyses of a session that use the same input and parameters.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twofold.operators import additive, contrast, draws, effects, expected, fit, modelspace, scores, trials, weights
from twofold.rules import FIXED_FORMS, FORMS, Design, Form
from twofold.sources import star
from twofold.sources.tables import stage_once


class Study:
    """Lazy stage tables of one study; each is built on first use."""

    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str,
        forms: tuple[Form, ...] = FORMS,
        per_model: int = 4000,
        tol: float = 1e-10,
        design: Design = Design(),
    ):
        self.spark, self.sf_dir = spark, sf_dir
        self.forms, self.per_model, self.tol, self.design = forms, per_model, tol, design

    def _stage(self, name: str, build, *depends) -> DataFrame:
        key = (type(self).__name__, self.sf_dir, self.design, *depends)
        return stage_once(self.spark, key, name, build)

    @property
    def _scores(self) -> tuple:
        """What the score tables depend on."""
        return (self.forms,)

    @property
    def _pool(self) -> tuple:
        """What the pooled draws depend on."""
        return (self.forms, self.tol, self.per_model)

    @cached_property
    def raw(self) -> DataFrame:
        return star.raw_trials(self.spark, self.sf_dir, self.design.sources)

    @cached_property
    def trials(self) -> DataFrame:
        return trials.clean(self.raw, self.design)

    @cached_property
    def classes(self) -> DataFrame:
        return self._stage("classes", lambda: trials.count_classes(self.trials))

    @cached_property
    def cells(self) -> DataFrame:
        return self._stage("cells", lambda: trials.cells_from_classes(self.classes))

    @cached_property
    def stats(self) -> DataFrame:
        return self._stage("stats", lambda: fit.form_stats(self.cells, self.forms), *self._scores)

    @cached_property
    def fits(self) -> DataFrame:
        return fit.fits(self.stats)

    @cached_property
    def candidates(self) -> DataFrame:
        """All pairs of closed-form fits, as named two-part models."""
        return modelspace.form_candidates(self.spark, self.forms)

    @cached_property
    def same_form(self) -> DataFrame:
        return modelspace.form_candidates(self.spark, self.forms, paired=False)

    @cached_property
    def halves(self) -> DataFrame:
        return scores.half_scores(self.classes, self.stats, self.forms)

    @cached_property
    def points(self) -> DataFrame:
        """Score of every class under every candidate."""
        return scores.pointwise(self.candidates, self.halves)

    @cached_property
    def staged_points(self) -> DataFrame:
        return self._stage("pointwise", lambda: self.points, *self._scores)

    @cached_property
    def stacked(self) -> DataFrame:
        """Stacking weights with gradient and whether the tolerance was reached."""
        return self._stage("weights", lambda: weights.stack(self.staged_points, tol=self.tol), self.forms, self.tol)

    @cached_property
    def weights(self) -> DataFrame:
        """Converged stacking weights; draws are not pooled by any others."""
        if not self.stacked.where("not converged").isEmpty():
            raise RuntimeError("stacking has not converged; raise tol")
        return self.stacked.select("model_name", "weight")

    @cached_property
    def allocation(self) -> DataFrame:
        named = self.weights.join(self.candidates.select("model_name", "id"), "model_name")
        return draws.allocate(named, self.per_model)

    @cached_property
    def index(self) -> DataFrame:
        return self._stage(
            "draw-index", lambda: draws.draw_index(self.allocation, self.per_model), *self._pool
        )

    @cached_property
    def parameters(self) -> DataFrame:
        return self._stage(
            "parameters",
            lambda: draws.parameters(draws.contrasts(self.cells, self.design), self.fits),
            *self._scores,
        )

    @cached_property
    def draws(self) -> DataFrame:
        return self._stage(
            "draws", lambda: draws.make_draws(self.index, self.candidates, self.parameters), *self._pool
        )

    @cached_property
    def details(self) -> DataFrame:
        return draws.draw_details(self.index, self.candidates)

    @cached_property
    def predictors(self) -> DataFrame:
        return expected.linear_predictors(self.cells, self.draws)

    @cached_property
    def values(self) -> DataFrame:
        return expected.expected_values(self.predictors)

    @cached_property
    def staged_values(self) -> DataFrame:
        return self._stage("values", lambda: self.values, *self._pool)

    @cached_property
    def marginals(self) -> DataFrame:
        return effects.marginals(self.draws, self.index)

    @cached_property
    def pooled_source(self) -> DataFrame:
        return effects.pool_source(self.draws, self.index, self.cells, self.design.source)

    @cached_property
    def pooled_host(self) -> DataFrame:
        return effects.pool_host(self.draws, self.index, self.cells, self.design.genus, self.design.host)

    @cached_property
    def effect_sizes(self) -> DataFrame:
        rows = self.marginals.unionByName(self.pooled_source).unionByName(self.pooled_host)
        return effects.effect_sizes(rows)

    @cached_property
    def staged_effects(self) -> DataFrame:
        return self._stage("effect-sizes", lambda: self.effect_sizes, *self._pool)

    @property
    def reference(self) -> dict[str, str]:
        """Reference level of each fixed term."""
        return {
            "host": self.design.host,
            "source": self.design.source,
            "genus": self.design.genus,
            "native": "false",
        }


class AdditiveStudy(Study):
    """Study over every pair of additive sides that obeys the structural rules.

    Sides are fitted with estimated group variances, scored by leaving out one trial
    to first order, and weighted as pairs; draws have the fits' correlations.
    """

    @property
    def _scores(self) -> tuple:
        return ("additive",)

    @property
    def _pool(self) -> tuple:
        return ("additive", self.tol, self.per_model)

    @cached_property
    def sides(self) -> DataFrame:
        return additive.valid_sides(modelspace.usable_terms(self.cells))

    @cached_property
    def design_rows(self) -> DataFrame:
        rows = fit.design_rows(self.cells, self.sides.select("side", "terms"), self.reference)
        return self._stage("side-design", lambda: rows, *self._scores)

    @cached_property
    def fitted(self) -> DataFrame:
        """Estimate, precision and Cholesky row of every parameter of every side."""
        return self._stage("side-fits", lambda: additive.fit_sides(self.design_rows, self.cells), *self._scores)

    @cached_property
    def side_scores(self) -> DataFrame:
        def build():
            return additive.additive_half_scores(self.classes, additive.cell_fits(self.design_rows, self.fitted))

        return self._stage("side-scores", build, *self._scores)

    @cached_property
    def candidates(self) -> DataFrame:
        settings = modelspace.candidates(modelspace.usable_terms(self.cells))
        sides = {f"{part}_side": F.col(f"{part}_mask").cast("string") for part in ("count", "hurdle")}
        return self._stage("side-pairs", lambda: settings.withColumns(sides), *self._scores)

    @cached_property
    def stacked(self) -> DataFrame:
        return self._stage("weights", lambda: weights.stack_pairs(self.side_scores, self.candidates, tol=self.tol), *self._scores, self.tol)

    @cached_property
    def draws(self) -> DataFrame:
        pairs = self.candidates.select("model_name", "count_side", "hurdle_side")
        return self._stage("draws", lambda: additive.additive_draws(self.index, pairs, self.fitted), *self._pool)


def grouped_estimates(study: Study) -> DataFrame:
    """Fitted against observed expected values per (host, source) pair."""
    pair = tuple(f for f in FIXED_FORMS if f.name == "host_source")
    est = fit.estimates(fit.form_stats(study.cells, pair))
    wide = est.groupBy("level", "n", "n_zero", "n_pos", "sum_y").agg(
        F.max(F.when(F.col("component") == "count", F.col("est"))).alias("log_rate"),
        F.max(F.when(F.col("component") == "prop", F.col("est"))).alias("zero_logit"),
        F.bool_or("boundary").alias("boundary"),
    )
    site = F.split("level", r"\|")
    return wide.select(
        site[0].alias("host_site"),
        site[1].alias("source_site"),
        "n",
        expected.truncated_mean(F.col("log_rate")).alias("expected_count"),
        expected.prevalence(F.col("zero_logit")).alias("expected_prevalence"),
        (F.col("sum_y") / F.col("n_pos")).alias("observed_count"),
        (F.col("n_pos") / F.col("n")).alias("observed_prevalence"),
        "boundary",
    )
