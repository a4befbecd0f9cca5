import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from twofold.llm.packing import Encoder, pack  # noqa: E402
from twofold.llm.token_counts import PrefixCounter, prefix_counts, token_counts, truncated  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ITEMS = ["a", "b", "'", "'s", "re", "'ll", "1", "22", ".", "!?", "é", "中", "😀", "\t", "\n", "\xa0", "\x1c", " ", "  ", " the", "ing", "<|endoftext|>", "<|endof", "́"]
ROWS = [(1, None), (2, ""), (3, " "), (4, "the end<|endoftext|>the"), (None, "x y"), (5, "word " * 3000), (5, "word " * 3000), (6, "z" * 20_000), (7, "a  b\n\n c"), (8, "日本語 text")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n=250):
    rng = random.Random(3)
    return ["".join(rng.choice(ITEMS) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_every_prefix_equals_the_library(library):
    counter = PrefixCounter(PATH)
    for t in texts():
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert counter.prefixes(t).tolist() == want
        assert counter.total(t) == want[-1]


def test_ids_equal_the_library(library):
    for encoder in (Encoder(PATH, RANKS), Encoder(PATH)):
        for t in texts():
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_counts_of_odd_rows(spark, table, library):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(table(ROWS), PATH, 1024).collect()), key=str)
    want = []
    for d, t in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert token_counts(table(ROWS).where("doc_id > 99"), PATH, 1024).count() == 0


def test_truncation_needs_no_second_encoding(spark, table, library):
    rows = [(i, t) for i, t in enumerate(texts(30))]
    got = {r.doc_id: (r.text, r.n_tokens) for r in truncated(prefix_counts(table(rows), PATH), 5).collect()}
    for d, t in rows:
        text, n = got[d]
        assert t.startswith(text) and n <= 5 and len(library.encode(text, add_special_tokens=False).ids) == n
        longer = [i for i in range(len(text) + 1, len(t) + 1) if len(library.encode(t[:i], add_special_tokens=False).ids) <= 5]
        assert not longer


@pytest.mark.parametrize("parts", [1, 7])
def test_pieces_hold_every_id_once(spark, table, library, parts):
    rows = ROWS + [(100 + i, "some words here " * (i % 90)) for i in range(300)]
    docs = table(rows).repartition(parts)
    pieces = [r.asDict() for r in pack(docs, PATH, 64, ranks=RANKS, most=4).collect()]
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        copies, whole = len(ids[d]), ids[d][0]
        assert sum(p["length"] for p in ps) == copies * len(whole)
        cover = np.zeros(len(whole), int)
        for p in ps:
            part = np.array(whole[p["start"] : p["start"] + p["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(whole)
            cover[p["start"] : p["start"] + p["length"]] += 1
        assert (cover == copies).all()
    padded = 0
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["offset"])
        n = 0
        for p in ps:
            assert p["offset"] == n
            n += p["length"]
        assert n <= 64
        padded += 0 if n & (n - 1) == 0 else 64 - n
    assert padded < 0.1 * sum(p["length"] for p in pieces)


def test_packing_an_empty_table(spark, table):
    assert pack(table(ROWS).where("doc_id > 9999"), PATH, 64).count() == 0
