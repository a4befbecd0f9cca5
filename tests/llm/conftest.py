import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
for folder in (ROOT, os.path.join(ROOT, "tests")):
    if folder not in sys.path:
        sys.path.insert(0, folder)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, words string, size string"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns whose names the operators use inside."""

    def make(rows):
        full = []
        for r in rows:
            doc, text, lang, source = (*r, *(None,) * (4 - len(r)))
            full.append((doc, text, lang, source, None if text is None else len(text), -1, "x", "y"))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def small_dir():
    return os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.001")
