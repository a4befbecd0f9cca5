import re
from collections import Counter

from twofold.llm.quality import quality_rules


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a b c d e " * 3), (5, "a a a a a a"), (6, "x\ny\nx\n\n \nx"), (7, "#*$%&|<> é\xa0ü 日本"),
    (None, "one two three four five six seven eight nine ten"), (8, " ".join(f"w{i}" for i in range(30_000))), (9, "z " * 9000), (10, "a b c d e f a b c d e g"), (10, "a b c d e f a b c d e g"),
]


def test_measures_equal_brute_force(spark, table):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(table(ROWS)).collect()), key=str)
    want = []
    for d, t in ROWS:
        m = measures(t)
        want.append((d, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert got == sorted(want, key=str)
    assert quality_rules(table(ROWS).where("doc_id > 99")).count() == 0


def test_hosts_with_many_failures_lose_their_documents(spark, table):
    good = " ".join(f"w{i}" for i in range(20))
    rows = [(i, good if i % 10 else "bad", "en", f"h{i % 7}") for i in range(700)]
    rows += [(1000 + i, "bad" if i % 10 else good, "en", "spam") for i in range(100)] + [(2000, good, "en", None), (2001, "bad", "en", "tiny"), (2002, good, "en", "tiny")]
    kept = {r.doc_id: r.kept for r in quality_rules(table(rows)).collect()}
    assert all(kept[d] == (t == good) for d, t, _, s in rows if s != "spam")
    assert not any(kept[d] for d, _, _, s in rows if s == "spam")
