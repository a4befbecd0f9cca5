from twofold.llm.language import language_predictions
from twofold.llm.ngram_join import ngram_components
from twofold.llm.substrings import without_repeats

import corpus_pipeline

WORDS = [f"{a}{b}" for a in ("lo", "ma", "ti", "ren", "sul") for b in ("ka", "vo", "nim", "dre", "ost", "el")]


def line(seed, n):
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] + str((seed + i) % 13) for i in range(n))


def test_each_stage_works_on_what_is_left(spark, table, tmp_path):
    rows = [(i, line(i, 40 + i % 30), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(10)] + [(200 + i, rows[i][1] + "\n" + line(900 + i, 80), "en", "s1") for i in range(10)]
    rows += [(300, None, "en", "s0"), (301, "", "en", "s0"), (302, "123", "en", "s0")]
    docs = table(rows).select(*corpus_pipeline.COLUMNS)
    frames = [docs]
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        step(spark, frames[-1], "").write.parquet(path)
        frames.append(spark.read.parquet(path))
    language, near, cut, mix, packed = frames[1:]
    ids = lambda df: {r.doc_id for r in df.collect()}
    want = {r.doc_id for r in language_predictions(docs).collect() if r.lang_pred != "und"}
    assert ids(language) == want and not want & {300, 301, 302}
    assert ids(near) == {r.component_id for r in ngram_components(language).collect()}
    kept = {r.doc_id: r.n_words - r.n_removed for r in without_repeats(near).collect()}
    assert {r.doc_id: len(r.text.split()) for r in cut.collect()} == {d: n for d, n in kept.items() if n}
    total = sum(len(r.text.split()) for r in mix.collect())
    assert abs(total - 1.5 * sum(kept.values())) <= 3
    assert ids(packed) == ids(mix)
    assert all(f.columns == corpus_pipeline.COLUMNS for f in (language, near, cut, mix))


def test_empty_table(spark, table, tmp_path):
    table([(1, "a")]).select(*corpus_pipeline.COLUMNS).where("doc_id > 1").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
