import random
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from twofold.llm.ngram_join import across_components, features, ngram_components, signatures


def brute(rows, num=75, den=100):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(set(features(t, 5).tolist()))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        for x in sets[a]:
            for y in sets[b]:
                if x and y and den * len(x & y) >= num * len(x | y):
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows, doc = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 8, 20, 60, 150]))]
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((doc * 7 % 997, " ".join(copy)))
            doc += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, table, seed):
    rows = corpus(seed)
    got = {r.doc_id: r.component_id for r in ngram_components(table(rows), few=2, common=3).collect()}
    assert got == brute(rows)


def test_every_linked_pair_shares_a_signature():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.choice([1, 2, 3, 4, 5, 7, 8, 12, 16, 31, 33, 64, 100, 200])
        words = [f"v{rng.randrange(10**6)}" for _ in range(n + 4)]
        other = list(words)
        for _ in range(rng.randint(0, max(1, n // 20))):
            other[rng.randrange(len(other))] = "z"
        other = other[: rng.randint(max(5, len(other) - n // 8), len(other))]
        a, b = features(" ".join(words), 5), features(" ".join(other), 5)
        both = len(set(a.tolist()) & set(b.tolist()))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            (x, slack), (y, least) = signatures(a, len(a), 75, 100), signatures(b, len(b), 75, 100)
            assert len(set(x.tolist()) & set(y.tolist())) >= max(slack, least, 1)


def test_odd_rows(spark, table):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (None, "one two"), (7, long), (8, long + " end"), (9, "Éa"), (10, "éa"), (4, "One two")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(table(rows)).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, None), (7, 29996, 7), (8, 29997, 7), (9, 1, 9), (10, 1, 10)]
    assert got == sorted(want, key=str)


def test_empty_table(spark, table):
    assert ngram_components(table([(1, "a")]).where("doc_id > 1")).count() == 0


def near_copies(rng, n, least, most):
    base = [f"b{i}" for i in range(150)]
    rows = []
    for doc in range(n):
        copy = list(base)
        for _ in range(rng.randint(least, most)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(40)}"
        rows.append((doc, " ".join(copy)))
    return rows


def test_many_near_copies_of_one_text_equal_brute_force(spark, table):
    rows = near_copies(random.Random(7), 90, 0, 9)
    got = {r.doc_id: r.component_id for r in ngram_components(table(rows), few=2, common=3, hubs=1).collect()}
    assert len(set(got.values())) > 5
    assert got == brute(rows)


def test_copies_too_far_apart_to_be_linked_make_no_pairs(spark, table):
    rows = near_copies(random.Random(8), 80, 6, 6)
    texts = table(rows).select(F.col("doc_id").alias("comp"), F.lit(1).alias("members"), "text")
    found = {(r.a, r.b) for r in across_components(texts, 5, 75, 100, 64, 16).collect()}
    sets = {d: set(features(t, 5).tolist()) for d, t in rows}
    linked = {(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked <= found
    assert len(found) < 80 * 79 // 2 // 4
