import importlib
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from glyphmend.plans import registry

SMALL = (
    "az_fold", "char_labels", "word_spans", "sentences", "corpus_stats", "lexicon_best", "lexicon_stats", "context_best", "restore_lexicon", "restore_context", "rates", "error_kinds", "suspicious_keys", "tagger_decisions", "chat_usable", "html_clean",
    "word_splits", "name_rules", "unsure_letters", "rate_limiter", "edit_stretches", "changes_reverted", "request_answers", "chat_import")


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", SMALL)
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "events"):
        con.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    got, want = registry.queries()[name](spark, sf).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry_survives_a_failing_import():
    """A library that only the training-data operators need is missing, or the operators are."""
    for gone in ("xxhash", "glyphmend.llm", "corpus_pipeline"):
        code = f"import sys\nsys.modules[{gone!r}] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()), 'op1_exact_top_k' in e.queries(), 'pipeline' in e.queries())"
        n, _, ops, whole = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
        assert int(n) >= len(registry.queries()) and whole == "False"
        assert ops == str(gone == "corpus_pipeline" and importlib.util.find_spec("glyphmend.llm") is not None)


def test_nothing_else_imports_the_training_data_subpackage():
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith(('glyphmend.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\n"
    code += "sys.meta_path.insert(0, No())\nimport glyphmend.service, glyphmend.plans.registry, glyphmend.operators.annotate, glyphmend.streaming.filters\nprint(len(glyphmend.plans.registry.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 50
    assert importlib.util.find_spec("glyphmend") is not None
