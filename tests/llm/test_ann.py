import numpy as np

from twofold.llm.ann import nearest


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, list int, chunk string")


def exact(x, ids, k, every=20):
    out = {}
    x = x.astype(np.float32).astype(np.float64)
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        other = np.flatnonzero(ids != ids[i])
        order = other[np.lexsort((ids[other], -s[other]))][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=(6000, 48)), rng.normal(size=(6000, 48)) + 3 * rng.normal(size=(30, 48))[rng.integers(0, 30, 6000)]):
        ids = np.arange(6000)
        x = x * rng.uniform(0.5, 2, (6000, 1))
        got = {}
        for r in nearest(frame(spark, [(int(i), v.tolist(), 0, 1, "c") for i, v in zip(ids, x)])).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        want = exact(x, ids, 20)
        hits = 0
        for q, best in want.items():
            assert sorted(got[q]) == list(range(1, 21))
            assert [s for _, (_, s) in sorted(got[q].items())] == sorted((s for _, s in got[q].values()), reverse=True)
            hits += len({i for i, _ in best} & {i for i, _ in got[q].values()})
        assert hits / (20 * len(want)) >= 0.9


def test_ties_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0], 0, 0, "") for i in range(60)]
    rows += [(100, None, 0, 0, ""), (120, [0.0, 0.0, 0.0], 0, 0, ""), (140, [1.0, float("nan"), 0.0], 0, 0, ""), (160, [1.0, None, 0.0], 0, 0, ""), (180, [float("inf"), 0.0, 0.0], 0, 0, ""), (None, [1.0, 0.0, 0.0], 0, 0, "")]
    got = {}
    for r in nearest(frame(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40}
    for q, found in got.items():
        assert found == [(i, 1.0) for i in [i for i in range(60) if i != q][:20]]


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0], 0, 0, ""), (1, [0.5, 0.5], 0, 0, ""), (2, [-1.0, 0.0], 0, 0, "")]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(frame(spark, rows)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert nearest(frame(spark, rows).where("vec_id > 9")).count() == 0


def test_recall_with_heavy_tailed_lengths(spark):
    rng = np.random.default_rng(4)
    ids = np.arange(8000)
    x = rng.normal(size=(8000, 32)) * np.exp(rng.normal(size=(8000, 1)))
    got = {}
    for r in nearest(frame(spark, [(int(i), v.tolist(), 0, 1, "c") for i, v in zip(ids, x)])).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(x, ids, 20)
    assert sum(len({i for i, _ in best} & got[q]) for q, best in want.items()) / (20 * len(want)) >= 0.9


def test_very_many_copies_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 2.0], 0, 0, "") for i in range(3000)] + [(i, (0.1 * rng.normal(size=3)).tolist(), 0, 0, "") for i in range(3000, 3500)]
    rows += [(7, [1.0, 2.0, 2.0], 0, 0, "")] * 500 + [(9, [9.0, 9.0, 9.0], 0, 0, "")]
    got = {}
    for r in nearest(frame(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert len(got) == 175
    for q in range(0, 3000, 20):
        assert got[q] == [(9, 45.0)] + [(i, 9.0) for i in [i for i in range(21) if i not in (9, q)][:19]]


def test_double_precision_input_keeps_its_digits(spark):
    data = [(0, [1.0, 0.0]), (1, [0.1, 0.3]), (2, [0.1 + 1e-12, 0.3])]
    rows = nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(2, 0.1 + 1e-12), (1, 0.1)]
