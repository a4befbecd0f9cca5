import math
import random
import re

import numpy as np
import pytest

from twofold.llm import lexical
from twofold.llm.lexical import best_of_chunk, search, term_counts, terms


@pytest.fixture(scope="module")
def items(spark):
    schema = "item_id long, text string, rank string, score string, block string"
    return lambda rows: spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)


def naive_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, limit=10):
    words = [(d, naive_terms(t)) for d, t in docs]
    n_docs, n_all = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    out, asked = [], {}
    for i, t in items:
        asked.setdefault(i, set()).update(naive_terms(t))
    for i, want in asked.items():
        found = []
        for d, w in words:
            s = 0
            for t in want:
                tf = w.count(t)
                if tf:
                    df = sum(t in v for _, v in words)
                    m = 10 + 90 * len(w) * n_docs // n_all
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:limit])]
    return sorted(out, key=str)


def answer(df):
    return sorted(map(tuple, df.collect()), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdefg" for b in ("é", "x", "7", "日")]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    docs = [(d, rng.choice([" ", "-", "\n", ". "]).join(rng.choices(vocab, weights, k=rng.randint(0, 40)))) for d in range(n)]
    docs += [(1000 + d, docs[3][1].upper()) for d in range(30)]
    return docs, [(i, " ".join(rng.sample(vocab, rng.randint(1, 9)))) for i in range(30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, table, items, seed, monkeypatch):
    docs, asked = corpus(seed)
    got = answer(search(table(docs), items(asked), block_items=7))
    assert got == brute(docs, asked)
    monkeypatch.setattr(lexical, "chunks", lambda batches: (p.iloc[a : a + 5] for p in batches for a in range(0, len(p), 5)))
    assert answer(search(table(docs), items(asked))) == got


def test_accumulators_stop_and_scores_stay_exact():
    """Chunks of random postings: the best of the limited search are those of full sums, and few accumulators are made."""
    rng = np.random.default_rng(3)
    made = 0
    for _ in range(50):
        n, k = 400, 12
        at = [np.sort(rng.choice(n, size=int(n * share), replace=False)) for share in np.geomspace(0.02, 0.9, k)]
        values = [np.maximum(1, (1000 * np.log(n / len(a)) * rng.uniform(0.3, 1, len(a))).astype(np.int64)) for a in at]
        order = np.argsort([len(a) for a in at])

        class Lists:
            size, top = n, np.array([v.max() for v in values])

            def __getitem__(self, t):
                return at[t], values[t]

        full = np.zeros(n, np.int64)
        for a, v in zip(at, values):
            full[a] += v
        live, score = best_of_chunk(Lists(), order, 10)
        assert (score == full[live]).all()
        best = np.lexsort((np.arange(n), -full))[:10]
        assert list(live[np.lexsort((live, -score))[:10]]) == list(best)
        made += len(live)
    assert made < 50 * 400 // 2


def test_odd_rows(spark, table, items):
    docs = [(1, "A b"), (1, "A b"), (2, None), (3, ""), (None, "a c"), (4, "a " * 3_000_000), (5, "...!"), (6, "c")]
    asked = [(1, "a"), (1, "B"), (2, None), (3, ""), (None, "c c"), (4, "zzz")]
    assert answer(search(table(docs), items(asked))) == brute(docs, asked)


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    text = "Alpha beta\x00gamma--alpha ÄÖ日本 beta" * 3
    vocabulary = {t: i for i, t in enumerate(sorted(set(terms(text))))}
    n, at, count = term_counts(text, vocabulary)
    want = [t.encode() for t in naive_terms(text)]
    assert n == len(want) and {t: want.count(t) for t in vocabulary} == dict(zip([sorted(vocabulary)[i] for i in at], count))


def test_empty_tables(spark, table, items):
    docs, asked = table([(1, "a")]), items([(1, "a")])
    assert search(docs.where("doc_id > 1"), asked).collect() == []
    assert search(docs, asked.where("item_id > 1")).collect() == []
