"""Language identification by sparse multinomial logistic regression on character n-grams.

Features are hashed runs of one to three characters, weighted by log counts and
inverse document frequency over all learnable documents, at unit length. Weights
are fitted by follow-the-regularised-leader steps with elastic-net penalties on
a bounded sample; a temperature, fitted on a part of the sample kept apart,
calibrates the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14
PER_LANGUAGE = 1_500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
FOLDS, HELD_OUT = 3, 1


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, case folded."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = c * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    two = c[:-1] * np.uint64(31) + c[1:]
    three = two[:-1] * np.uint64(31) + c[2:]
    h = np.concatenate([c, two ^ np.uint64(0xA5A5), three ^ np.uint64(0x5A5A5A)]) * np.uint64(0xD6E8FEB86659FD93)
    return np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class LanguageModel:
    """Languages in order, a weight column per language, biases, idf and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        at, x = _vector(text, self.idf)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each hashed n-gram, over all rows; a task sends one row per n-gram at most."""

    def run(batches):
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for pdf in batches:
            for t in pdf["text"]:
                seen += ngram_counts(t or "") > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": np.r_[at, -1], "n": np.r_[seen[at], n]})

    rows = docs.select("text").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found = {r["at"]: r["n"] for r in rows}
    total = found.pop(-1, 0)
    out = np.zeros(1 << BITS)
    out[list(found)] = list(found.values())
    return out, total


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after ``EPOCHS`` passes in the given order."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def weights(z, n, l1):
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def step(z, n, w, g):
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        n += g * g
        return z, n

    for _ in range(EPOCHS):
        for at, x, y in rows:
            za, na = z[at], n[at]
            w, b = weights(za, na, L1), weights(zb, nb, 0.0)
            p = x @ w + b
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            z[at], n[at] = step(za, na, w, x[:, None] * p)
            zb, nb = step(zb, nb, b, p)
    return weights(z, n, L1), weights(zb, nb, 0.0)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least log loss, from 1/8 to 8."""

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    return min((2.0 ** (k / 8) for k in range(-24, 25)), key=loss) if len(y) else 1.0


def fit_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on ``docs`` with text and lang. Frequencies cover all rows; weights use about ``per_language`` rows of each language.

    The sample is chosen by a hash of the text, so reruns agree.
    """
    rows = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0)), np.zeros(0), np.zeros(1 << BITS), 1.0)
    seen, total = _document_frequency(rows)
    idf = np.log((1 + total) / (1 + seen)) + 1
    place = F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1_000_000, 1 + per_language * 1_000_000 // sizes[k]))])

    def vectors(batches):
        for pdf in batches:
            found = [_vector(t, idf) for t in pdf["text"]]
            yield pd.DataFrame(
                {"place": pdf["place"], "lang": pdf["lang"], "at": [a.astype(np.int32).tobytes() for a, _ in found], "x": [x.astype(np.float32).tobytes() for _, x in found]}
            )

    sample = (
        rows.select("text", "lang", place.alias("place"))
        .where(F.col("place") < share[F.col("lang")])
        .mapInPandas(vectors, "place long, lang string, at binary, x binary")
        .collect()
    )
    sample.sort(key=lambda r: (r["place"] * 7919 % 1_000_003, r["lang"], bytes(r["at"]), bytes(r["x"])))
    data = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(float), languages.index(r["lang"])) for r in sample]
    apart = data[::5] if len(data) >= 50 else []
    kept = [d for i, d in enumerate(data) if i % 5] if apart else data
    weights, bias = _ftrl(kept, len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in apart]).reshape(-1, len(languages))
    return LanguageModel(languages, weights.astype(np.float32), bias, idf, _temperature(logits, np.array([y for *_, y in apart], int)))


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (any columns) with lang_pred and score. A text that is null or has no letter is ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: hash size times languages

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score"])

    out = docs.withColumn("_predicted", predict(F.coalesce("text", F.lit(""))))
    return out.withColumns({"lang_pred": F.col("_predicted.lang_pred"), "score": F.col("_predicted.score")}).drop("_predicted")


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: outside the held-out fold."""
    return docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def language_predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs``.

    Learned from text and non-null lang of rows outside the held-out fold; doc_id,
    lang and source are no inputs of a prediction. Rows without doc_id are in no
    fold: not held out and not learned from. Without anything to learn from all
    rows are ``und``. Repeated rows are predicted each; an empty table gives an
    empty table.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = fit_language(learnable(rows))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return predict_language(rows.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
