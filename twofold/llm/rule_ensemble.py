"""Quality scores by a sparse ensemble of rules over statistics of a text.

Small trees are grown on random halves of a bounded sample of labelled rows; each
path from a root to a node is a rule, a conjunction of bounds on statistics. A
logistic model with a lasso penalty picks few of the rules. What is left is
compiled into one Spark column expression over the statistics' columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twofold.llm.language import fold

STATISTICS = (
    "n_words distinct_share same_next top_share mean_word longest_word upper_share digit_share symbol_share stop_share "
    "exclaim_share comma_share n_lines line_words repeated_lines"
).split()
PER_LABEL = 4_000
TREES, DEPTH, LEAST_LEAF, BINS = 40, 3, 12, 32
PENALTY, STEPS = 4e-3, 600
WINDOW = 100
FOLDS, HELD_OUT = 3, 1
_LEADS = np.ones(256, bool)
_LEADS[0x80:0xC0] = False  # bytes that go on a character


def statistics(text: str | None) -> tuple[float, ...]:
    """Values of ``STATISTICS`` for a whole text; a text without words has zeros.

    Words are runs of characters other than space and U+0009 to U+000D. The share of
    distinct words is the mean over pieces of ``WINDOW`` words, as it would fall with
    the length of a text otherwise. Shares of characters are taken over the characters of words, shares of letters over A-Z
    and a-z, shares of lines over lines with a word.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    counts = np.bincount(codes)
    distinct = len(np.unique(np.arange(n) // WINDOW * len(seen) + codes))
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(int(of[_LEADS].sum() - of[9:14].sum() - of[32]), 1)
    upper, lower = int(of[65:91].sum()), int(of[97:123].sum())

    def share(characters: bytes) -> float:
        return float(of[list(characters)].sum() / chars)

    lines = [x.split() for x in raw.split(b"\n")]
    lines = [b" ".join(x) for x in lines if x]
    return (
        float(n),
        distinct / n,
        float((codes[1:] == codes[:-1]).sum() / n),
        float(counts.max() / n),
        chars / n,
        float(max(map(len, words))),
        upper / max(upper + lower, 1),
        share(b"0123456789"),
        share(b"#*$%&|<>@~^_=+{}[]\\"),
        share(b"."),
        share(b"!?"),
        share(b",;:"),
        float(len(lines)),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
    )


def with_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``measured``, a struct of the statistics of ``text``."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def measure(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in text], columns=STATISTICS)

    return rows.withColumn("measured", measure(F.coalesce("text", F.lit(""))))


@dataclass(frozen=True, order=True)
class Rule:
    """Bounds (statistic, at most?, value) that all hold."""

    bounds: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, most, value in self.bounds:
            v = x[:, STATISTICS.index(name)]
            out &= v <= value if most else v > value
        return out

    def column(self, measured: Column) -> Column:
        out = F.lit(True)
        for name, most, value in self.bounds:
            v = measured[name]
            out = out & (v <= F.lit(value) if most else v > F.lit(value))
        return out


@dataclass
class RuleEnsemble:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def column(self, measured: Column) -> Column:
        """The score as an expression without Python."""
        z = F.lit(float(self.bias))
        for rule, w in self.rules:
            z = z + F.when(rule.column(measured), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _tidy(path: list[tuple[int, bool, float]]) -> Rule:
    """A path with one bound per statistic and side."""
    tight: dict[tuple[int, bool], float] = {}
    for f, most, value in path:
        old = tight.get((f, most), value)
        tight[f, most] = min(old, value) if most else max(old, value)
    return Rule(tuple((STATISTICS[f], most, v) for (f, most), v in sorted(tight.items())))


def grow_rules(x: np.ndarray, y: np.ndarray, c: np.ndarray, seed: int = 5) -> list[Rule]:
    """Distinct paths of ``TREES`` trees; a split lowers the Gini impurity most over some statistics and quantile cuts."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.round(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]), 6)) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
    some = max(2, int(np.ceil(np.sqrt(x.shape[1]))) + 1)
    rules: dict[Rule, None] = {}

    def split(at: np.ndarray, path: list) -> None:
        if path:
            rules.setdefault(_tidy(path))
        if len(path) >= DEPTH or len(at) < 2 * LEAST_LEAF:
            return
        best = (1e-9, None, None)
        for f in rng.choice(x.shape[1], some, replace=False):
            size = len(cuts[f]) + 1
            rows = np.cumsum(np.bincount(codes[at, f], minlength=size))[:-1]
            mass = np.cumsum(np.bincount(codes[at, f], c[at], size))
            good = np.cumsum(np.bincount(codes[at, f], c[at] * y[at], size))
            whole, ones = mass[-1], good[-1]
            left, lg = mass[:-1], good[:-1]
            ok = (rows >= LEAST_LEAF) & (len(at) - rows >= LEAST_LEAF) & (left > 0) & (left < whole)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, (lg**2 / left + (ones - lg) ** 2 / (whole - left) - ones**2 / whole) / whole, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(f), k)
        _, f, k = best
        if f is not None:
            below = codes[at, f] <= k
            split(at[below], [*path, (f, True, float(cuts[f][k]))])
            split(at[~below], [*path, (f, False, float(cuts[f][k]))])

    for _ in range(TREES if len(x) >= 2 * LEAST_LEAF else 0):
        split(np.sort(rng.choice(len(x), len(x) // 2, replace=False)), [])
    return list(rules)


def lasso(a: np.ndarray, y: np.ndarray, c: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Bias and weights of least mean logistic loss plus ``penalty`` per unit of weight and spread of its rule; accelerated proximal steps."""
    c = c / c.sum()
    spread = np.sqrt(np.maximum(c @ a - (c @ a) ** 2, 1e-4))
    z = np.c_[np.ones(len(a)), (a - c @ a) / spread]
    rate = 4 / max(np.linalg.eigvalsh((z * c[:, None]).T @ z)[-1], 1e-12)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(STEPS):
        u = v - rate * (z.T @ (c * (1 / (1 + np.exp(-np.clip(z @ v, -30, 30))) - y)))
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = u + (before - 1) / t * (u - w), u
    weights = w[1:] / spread
    return float(w[0] - (c @ a) @ weights), weights


def fit_ensemble(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> RuleEnsemble:
    """Rules and weights for rows with statistics ``x``, labels ``y`` and masses ``c``; one label alone gives a constant near it."""
    mean = float(np.clip(c @ y / c.sum(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    constant = RuleEnsemble(float(np.log(mean / (1 - mean))))
    rules = grow_rules(x, y, c) if 0 < y.sum() < len(y) else []
    if not rules:
        return constant
    held = np.stack([r.holds(x) for r in rules], 1)
    _, first = np.unique(held, axis=1, return_index=True)
    first = np.sort([k for k in first if held[:, k].any() and not held[:, k].all()]).astype(int)
    if not len(first):
        return constant
    bias, w = lasso(held[:, first].astype(float), y, c)
    return RuleEnsemble(bias, [(rules[k], float(v)) for k, v in zip(first, w) if v])


def learned_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, labels and masses of about ``per_label`` rows of each label, at most four times as many in all.

    Rows are chosen by a hash of the id; masses bring the labels back to their shares.
    """
    known = labels.where(F.col(label).isin(0, 1)).where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", F.col(label).alias("y")).distinct()
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return np.empty((0, len(STATISTICS))), np.empty(0), np.empty(0)
    share = F.create_map(*[F.lit(x) for k in sizes for x in (k, min(1_000_000, 1 + per_label * 1_000_000 // sizes[k]))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1_000_000))
    chosen = known.withColumn("place", place).where(F.col("place") < share[F.col("y")])
    # The hash bounds this side: about 2 * per_label ids.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = with_statistics(rows).select("place", "y", "measured.*").orderBy("place", "y", *STATISTICS).limit(4 * per_label).toPandas()
    y = found["y"].to_numpy(float)
    got = {k: max((y == k).sum(), 1) for k in sizes}
    return found[STATISTICS].to_numpy(float), y, np.array([sizes[k] / got[k] for k in y])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Learned from labels 0 and 1 of rows outside the held-out fold; other labels are
    not used, and without any every score is one half. Null and empty texts have
    zero statistics and are scored by them; texts of any length are read whole.
    Rows without doc_id are not held out and not learned from. Repeated rows are
    scored each, ties of statistics get equal scores. Columns other than doc_id and
    text are not read, and doc_id is no input of a score. An empty table gives an
    empty table.
    """
    model = fit_ensemble(*learned_sample(docs, labels, label, per_label))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    measured = with_statistics(docs.select("doc_id", held.alias("held_out"), "text"))
    scored = measured.select("doc_id", "held_out", model.column(F.col("measured")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
