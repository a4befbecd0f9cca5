import numpy as np
import pytest
from pyspark.sql import functions as F

from twofold.llm.rule_ensemble import (
    STATISTICS,
    WINDOW,
    Rule,
    RuleEnsemble,
    fit_ensemble,
    lasso,
    learned_sample,
    quality_scores,
    statistics,
    with_statistics,
)


def naive(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in text or "").split(" ") if w]
    if not words:
        return dict.fromkeys(STATISTICS, 0.0)
    chars, n = "".join(words), len(words)
    lines = [" ".join(x) for x in ([w for w in "".join(" " if c in "\t\x0b\f\r" else c for c in ln).split(" ") if w] for ln in text.split("\n")) if x]
    upper, lower = sum("A" <= c <= "Z" for c in chars), sum("a" <= c <= "z" for c in chars)
    share = lambda some: sum(c in some for c in chars) / len(chars)
    return {
        "n_words": n,
        "distinct_share": sum(len(set(words[i : i + WINDOW])) for i in range(0, n, WINDOW)) / n,
        "same_next": sum(a == b for a, b in zip(words, words[1:])) / n,
        "top_share": max(map(words.count, words)) / n,
        "mean_word": len(chars) / n,
        "longest_word": max(len(w.encode()) for w in words),
        "upper_share": upper / max(upper + lower, 1),
        "digit_share": share("0123456789"),
        "symbol_share": share("#*$%&|<>@~^_=+{}[]\\"),
        "stop_share": share("."),
        "exclaim_share": share("!?"),
        "comma_share": share(",;:"),
        "n_lines": len(lines),
        "line_words": n / len(lines),
        "repeated_lines": 1 - len(set(lines)) / len(lines),
    }


@pytest.mark.parametrize("text", [None, "", " \n", "A b, b.\nA  b, b.\n\n#1 日本 é!", "word " * 950, "x y\x85z " + "q " * 250, "a|b\x0bc\fd"])
def test_statistics_equal_plain_counting(text):
    assert dict(zip(STATISTICS, statistics(text))) == pytest.approx(naive(text))


def test_expression_equals_rules_in_python(spark, table):
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(1, 1, (400, len(STATISTICS))))
    y = ((x[:, 1] > 1) & (x[:, 8] < 1.2)).astype(float)
    model = fit_ensemble(x, y, np.ones(400))
    assert model.rules and ((model.scores(x) >= 0.5) == y).mean() > 0.95
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *STATISTICS])
    got = rows.select("i", model.column(F.struct(*STATISTICS)).alias("s")).orderBy("i").toPandas()["s"]
    assert np.allclose(got, model.scores(x), rtol=0, atol=1e-12)
    assert "Python" not in rows.select(model.column(F.struct(*STATISTICS)))._jdf.queryExecution().toString()


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(2)
    a = (rng.uniform(size=(300, 30)) < rng.uniform(0.1, 0.9, 30)).astype(float)
    y = (a[:, 0] + a[:, 1] * a[:, 2] + rng.normal(0, 0.3, 300) > 0.8).astype(float)
    c, penalty = np.full(300, 1 / 300), 0.01
    bias, w = lasso(a, y, c, penalty)
    p = 1 / (1 + np.exp(-(bias + a @ w)))
    spread = np.sqrt(np.maximum(c @ a - (c @ a) ** 2, 1e-4))
    slope = (c * (p - y)) @ (a - c @ a) / spread
    assert abs(c @ (p - y)) < 1e-4
    assert (np.abs(slope[w == 0]) <= penalty + 1e-4).all() and 0 < (w != 0).sum() < 30
    assert np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-4)


def test_rules_bound_statistics():
    x = np.zeros((2, len(STATISTICS)))
    x[1, 0] = 5
    assert list(Rule((("n_words", True, 3.0),)).holds(x)) == [True, False]
    assert list(RuleEnsemble(0.0, [(Rule((("n_words", False, 3.0),)), 2.0)]).scores(x)) == pytest.approx([0.5, 1 / (1 + np.exp(-2))])


def test_held_out_accuracy(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 100 and (found["predicted"] == found["quality"]).mean() > 0.97


def test_held_out_labels_are_not_read(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality_scores(docs, labels).collect()) == sorted(quality_scores(docs, turned).collect())


def test_odd_rows(spark, table):
    good = " ".join(f"word{i}" for i in range(40)) + "."
    docs = [(i, good + f" tail{i}") for i in range(60)] + [(i, "buy buy buy buy " * 10) for i in range(60, 120)]
    docs += [(None, good), (500, None), (501, ""), (502, "very long text here. " * 200_000), (3, good + " tail3")]
    labels = spark.createDataFrame([(i, int(i < 60), "x") for i in range(120)] + [(500, None, "x"), (None, 1, "x"), (502, 7, "x")], "doc_id long, quality int, score string")
    got = quality_scores(table(docs), labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.predicted for r in got if r.doc_id is not None and r.doc_id < 60} == {1} and {r.predicted for r in got if r.doc_id in range(60, 120)} == {0}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.score for r in quality_scores(table(docs), labels.where("doc_id = 500")).collect()} == {0.5}
    assert quality_scores(table(docs).where("doc_id < 0"), labels).collect() == []


def test_copies_do_not_break_the_sample_bound(spark, table):
    docs = table([(1, f"copy {i}") for i in range(300)] + [(2, "other text")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(learned_sample(docs, labels, "quality", 10)[1]) <= 40


def test_long_texts_keep_their_distinct_share(spark, table):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(400)]
    short, long = (" ".join(rng.choice(vocab, n)) for n in (300, 60_000))
    one, two = (r.measured.distinct_share for r in with_statistics(table([(1, short), (2, long)])).orderBy("doc_id").collect())
    assert abs(one - two) < 0.05
