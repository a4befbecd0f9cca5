import hashlib
import random
import zlib

import pytest

from twofold.llm.conversations import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, x1 string, digest string"


@pytest.fixture(scope="module")
def talk(spark):
    return lambda rows: spark.createDataFrame([(*r, -1, "x", "y") for r in rows], SCHEMA)


def brute(rows, share=5, spread=9):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    plain = {}
    for c, t in turns.items():
        plain[c] = [(r, x) for _, _, r, x in sorted(t, key=lambda v: (v[0], v[1], hashlib.md5(f"{len(v[2])}:{v[2]}{v[3]}".encode()).hexdigest()))]
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % spread
        donor = c - (abs(c) % share) * (1 if c >= 0 else -1)
        built[c] = tuple(plain.get(donor, [])[:h] + own[h:])
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), up, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def answer(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(talk, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 80), 70):
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b", "ü"])) for t in range(rng.randint(1, 11))]
    assert answer(prefix_trie(talk(rows))) == sorted(brute(rows), key=str)


def test_many_copies_make_one_path(talk):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 2000, 5) for t in range(3)]
    assert answer(prefix_trie(talk(rows))) == sorted(brute(rows), key=str)


def test_odd_rows(talk):
    rows = [
        (0, None, None, None), (0, 2, "user", "b"), (0, 2, "user", "b"), (0, 1, "user", None), (0, 2, "bot", "b"),
        (1, 1, "", ""), (7, 5, "user", "long " * 200_000), (7, 1, "user", "x"), (None, 1, "user", "lost"), (9, 1, "user", "x"),
    ]
    assert answer(prefix_trie(talk(rows))) == sorted(brute(rows), key=str)


def test_empty_table(talk):
    assert prefix_trie(talk([(1, 1, "user", "a")]).where("conv_id > 1")).collect() == []
    assert prefix_trie(talk([(None, 1, "user", "a")])).collect() == []
