import random

from twofold.llm.substrings import SuffixAutomaton, deduplicated_documents, without_repeats


def brute(rows, window=13):
    words = [(d, (t or "").split()) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([12, 13, 14, 20, 60]))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(vocab) for _ in range(rng.randint(0, 30))] + rng.choice(passages) * rng.choice([1, 1, 1, 2])
        rows.append((d * 37 % 101, " ".join(w)))
    return rows + [(200, "a " * 40), (201, "a " * 40), (202, "b c " * 30), (203, "c b " * 30)]


def test_kept_words_equal_brute_force(spark, table):
    for seed in (1, 2):
        rows = corpus(seed)
        got = sorted((r.doc_id, r.n_words, r.n_removed, " ".join(r.kept.split())) for r in without_repeats(table(rows), with_text=True).collect())
        assert got == sorted(brute(rows))


def test_automaton_finds_smaller_owners_only():
    a = SuffixAutomaton()
    a.add([1, 2, 3, 4, 5], 10)
    a.add([9, 2, 3, 4], 5)
    a.close()
    assert a.covered([0, 2, 3, 4, 7], 3, 6) == [(1, 4)]
    assert a.covered([1, 2, 3, 4, 5], 3, 10) == [(1, 4)]
    assert a.covered([1, 2, 3, 4, 5], 3, 11) == [(0, 5)]
    assert a.covered([2, 3, 4], 3, 5) == []


def test_odd_rows(spark, table):
    words = " ".join(f"x{i}" for i in range(13))
    rows = [(1, words), (2, words), (3, words + "\n y"), (4, None), (5, ""), (None, words), (6, " ".join(f"x{i}" for i in range(12))), (1, words)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in without_repeats(table(rows)).collect()), key=str)
    want = [(1, 13, 0), (1, 13, 0), (2, 13, 13), (3, 14, 13), (4, 0, 0), (5, 0, 0), (None, 13, 0), (6, 12, 0)]
    assert got == sorted(want, key=str)
    left = {r.doc_id: r.text for r in deduplicated_documents(table(rows)).collect()}
    assert left[3] == "y" and 2 not in left and left[6] == rows[6][1]


def test_empty_table(spark, table):
    assert without_repeats(table([(1, "a")]).where("doc_id > 1")).count() == 0


def test_very_long_texts(spark, table):
    rng = random.Random(5)
    long = [f"v{rng.randrange(400)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[500:40_000] + ["z"] + long[:900])), (3, " ".join(long[59_980:] + long[:15]))]
    got = sorted((r.doc_id, r.n_words, r.n_removed, " ".join(r.kept.split())) for r in without_repeats(table(rows), with_text=True).collect())
    assert got == sorted(brute(rows))
