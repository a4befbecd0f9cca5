import random

from twofold.llm.mixing import keyed, mix_plan, mixed_documents


def filled(sizes, weights, percent, most):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out = sum(sizes.values()) * percent / 100, {}
    free = set(names)
    while free:
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s] + 1e-9]
        if not over:
            total = sum(w[x] for x in free)
            out.update({s: left * w[s] / total for s in free})
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["b", "a", "a", "a", "é", "z", None, "B"])
        rows.append((i, " ".join("word" for _ in range(rng.choice([0, 1, 5, 40, 300]))), "en", source))
    return rows


def test_plan_follows_targets_and_key_order(spark, table):
    for seed in (1, 2):
        rows = corpus(seed)
        got = {r.doc_id: r for r in mix_plan(table(rows)).collect()}
        size = {d: len(t.split()) for d, t, *_ in rows}
        total, taken = {}, {}
        for d, _, _, s in rows:
            total[s] = total.get(s, 0) + size[d]
            taken[s] = taken.get(s, 0) + got[d].taken
            assert got[d].size == size[d] and got[d].taken <= 2 * size[d]
        want = filled(total, (5, 2, 1), 150, 2)
        keys = {r.doc_id: r.key for r in keyed(table(rows)).collect()}
        for s in total:
            mine = [d for d, _, _, x in rows if x == s]
            assert all(abs(got[d].target - want[s]) < 1e-6 and got[d].source_size == total[s] for d in mine)
            assert abs(taken[s] - want[s]) <= 0.5
            whole = int(want[s] + 0.5) // total[s] if total[s] else 0
            extra = [got[d].taken - whole * size[d] for d in sorted(mine, key=keys.get) if size[d]]
            full = [e == size[d] for e, d in zip(extra, [d for d in sorted(mine, key=keys.get) if size[d]])]
            assert full == sorted(full, reverse=True) and sum(0 < e and not f for e, f in zip(extra, full)) <= 1


def test_documents_hold_the_words_taken(spark, table):
    rows = corpus(3)
    plan = {r.doc_id: r.taken for r in mix_plan(table(rows)).collect()}
    words = {}
    for r in mixed_documents(table(rows)).collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert {d: n for d, n in plan.items() if n} == words


def test_odd_rows(spark, table):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (None, "x y z", None, None), (None, "x y z", None, None), (3, "q " * 50_000, None, "b"), (4, "t", None, "c"), (4, "t", None, "c")]
    got = mix_plan(table(rows)).collect()
    assert len(got) == len(rows) and all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 2 * r.size for r in got)
    assert mix_plan(table(rows).where("doc_id > 99")).count() == 0
    assert mixed_documents(table(rows).where("doc_id > 99")).count() == 0
