"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its lower-cased terms, hashed: words, and the stems that
inflected words share. The machine adds a
weight per term and, for each pair of terms present, the product of their factor
vectors, so an insult beside a group mention can count for more than the two
alone. It is fitted by adaptive gradient steps with a penalty that keeps
few weights, on a bounded sample of labelled rows; terms that fewer than ``LEAST_ROWS`` sampled rows have carry no weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.llm.language import fold

BITS = 18
RANK = 4
STEMS = (4, 5)
PER_LABEL = 4_000
LEAST_ROWS = 5
EPOCHS = 6
RATE = 0.1
SPARSITY, FACTOR_PENALTY = 0.02, 2e-3
FOLDS, HELD_OUT = 4, 2
_TERM = regex.compile(r"[\p{L}\p{N}']+")


def term_ids(text: str | None) -> np.ndarray:
    """Sorted distinct hashed terms of a whole text: words, and stems of four and five characters."""
    terms = set(_TERM.findall((text or "").lower()))
    terms |= {f"^{t[:n]}" for t in terms for n in STEMS if len(t) > n}
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms), np.uint64, len(terms))
    return np.unique((hashes >> np.uint64(64 - BITS)).astype(np.int32))


@dataclass
class FactorizationMachine:
    """Bias, a weight per term and a factor vector per term."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, at: np.ndarray) -> float:
        v = self.factors[at]
        s = v.sum(0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(term_ids(text)), -30, 30))))


def fit_machine(rows: list[tuple[np.ndarray, int, float]], seed: int = 11) -> FactorizationMachine:
    """Fit to (terms, label, weight) rows in the given order."""
    size = 1 << BITS
    seen = np.zeros(size, np.int32)
    for at, _, _ in rows:
        seen[at] += 1
    used = seen >= LEAST_ROWS
    rows = [(at[used[at]], y, c) for at, y, c in rows]
    w = np.zeros(size)
    v = np.random.default_rng(seed).normal(0, 0.01, (size, RANK)) * used[:, None]
    total = sum(c for *_, c in rows)
    mean = min(max(sum(c * y for _, y, c in rows) / total, 1e-6), 1 - 1e-6) if total else 1e-6
    b = float(np.log(mean / (1 - mean)))
    gw, gv, gb = np.full(size, 1e-8), np.full((size, RANK), 1e-8), 1e-8
    for _ in range(EPOCHS):
        for at, y, c in rows:
            va = v[at]
            s = va.sum(0)
            z = b + w[at].sum() + 0.5 * (s @ s - (va * va).sum())
            g = c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            gb += g * g
            b -= RATE * g / np.sqrt(gb)
            gw[at] += g * g
            rate = RATE / np.sqrt(gw[at])
            x = w[at] - rate * g
            w[at] = np.sign(x) * np.maximum(np.abs(x) - rate * SPARSITY, 0)
            d = g * (s - va) + FACTOR_PENALTY * va
            gv[at] += d * d
            v[at] -= 0.1 * RATE * d / np.sqrt(gv[at])
    return FactorizationMachine(b, w.astype(np.float32), (v * used[:, None]).astype(np.float32))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> FactorizationMachine:
    """Fit to about ``per_label`` labelled rows of each label, weighted back to the labels' shares.

    Labels of the held-out fold are not read. The sample goes by a hash of the id,
    so reruns agree.
    """
    known = labels.where("toxic is not null").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", "toxic").distinct()
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit_machine([])
    share = F.create_map(*[F.lit(x) for k in sizes for x in (k, min(1_000_000, 1 + per_label * 1_000_000 // sizes[k]))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000))
    chosen = known.withColumn("place", place).where(F.col("place") < share[F.col("toxic")])

    def terms(batches):
        for pdf in batches:
            yield pd.DataFrame({"place": pdf["place"], "toxic": pdf["toxic"], "at": [term_ids(t).tobytes() for t in pdf["text"]]})

    # About 2 * per_label rows by the line above, so this side is small at any size of the tables.
    sample = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "place").mapInPandas(terms, "place long, toxic int, at binary").collect()
    )
    sample.sort(key=lambda r: (r["place"] * 7919 % 1_000_003, r["toxic"], bytes(r["at"])))
    got = {k: max(1, sum(r["toxic"] == k for r in sample)) for k in sizes}
    total = sum(sizes.values())
    rows = [(np.frombuffer(r["at"], np.int32), int(r["toxic"] == 1), len(sample) / total * sizes[r["toxic"]] / got[r["toxic"]]) for r in sample]
    return fit_machine(rows)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Null and empty texts have no terms and get the score of the bias. Rows without
    doc_id are not held out and not learned from. Labels that are null are not
    used; without any label all scores are near 0. Repeated rows are scored each;
    an empty table gives an empty table. Only doc_id and text are read, and doc_id
    is no input of a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))  # bounded: hash size times rank

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(model.value.score)

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
