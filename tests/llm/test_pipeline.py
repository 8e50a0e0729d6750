"""The five stages of the pipeline, each against a brute-force version on its own input, and its odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_copies import slow_groups
from test_near_duplicates import slow_cuts
from test_mixing_sharding_urls import count, targets
from tokenizers import Tokenizer

import corpus_pipeline
from glyphmend.llm import toxicity
from glyphmend.llm.queries import default_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"passage{i}" for i in range(70))
OTHER = " ".join(f"other{{0}}{i}" for i in range(60))
ODD = [
    (90001, None, None, None, None), (90002, "", "en", "web", 0), (90003, "  \n", None, "web", 3), (90004, "one", "en", None, 3), (90005, "w " * 30_000, "en", "news", 60_000),
    (90006, f"begins here {PASSAGE} ends here {OTHER.format('a')}", "en", "web", 1), (90007, f"other words {PASSAGE} at the end {OTHER.format('b')}", "de", "news", 1), (90008, "é" * 70_000, "fr", "web", 70_000),
    (90009, "same row", "en", "web", 8), (90009, "same row", "en", "web", 8), (None, "no id at all", "en", "web", 12),
]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """[(documents before, documents after)] of every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame(ODD, SCHEMA))
    docs = docs.withColumn("_row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("_hash", F.lit(2))
    out, folder = [], tmp_path_factory.mktemp("stages")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs.collect(), after.collect()))
        if i < 4:
            assert after.columns == corpus_pipeline.COLUMNS
        docs = after
    return out


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "packing"]


def test_toxicity_stage(stages, spark, sf):
    before, after = stages[0]
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    known = sorted((r.doc_id, r.text) for r in before if r.doc_id in labels)
    weights, intercept = toxicity.fit([t for _, t in known], np.array([labels[i] for i, _ in known]))
    place = np.empty(toxicity.SLOTS, dtype=np.int32)
    clean = [r.doc_id for r in before if float(weights[toxicity.slots_of(r.text, place)].sum(dtype=np.float64)) + intercept < 0]
    assert sorted(clean, key=str) == sorted((r.doc_id for r in after), key=str) and len(after) > 0.7 * len(before)


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    groups = slow_groups({r.doc_id if r.doc_id is not None else 1 << 60: r.text for r in before})
    assert sorted(r.doc_id if r.doc_id is not None else 1 << 60 for r in after) == sorted(set(groups.values())), "texts without words are copies of one another"


def test_substring_stage(stages):
    before, after = stages[2]
    want = slow_cuts([(r.doc_id, r.text) for r in before])
    got = {r.doc_id: r for r in after}
    for r in before:
        cut = want[r.doc_id, r.text]
        assert got[r.doc_id].text == cut if cut == r.text or cut.strip(" ") else r.doc_id not in got
    assert got[90007].n_chars == len(got[90007].text) < 900 and PASSAGE in got[90006].text


def test_mixing_stage(stages):
    before, after = stages[3]
    sizes, taken = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + count(r.text)
        assert r.n_chars == len(r.text)
    want = targets(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) < len(sizes) + 1e-6 for s in sizes)
    texts = {r.doc_id: r.text for r in before}
    assert all(re.sub(r"[ \t-\r]+", " ", texts[r.doc_id]).startswith(r.text) or texts[r.doc_id] == r.text for r in after)


def test_packing_stage(stages):
    before, after = stages[4]
    tokenizer = Tokenizer.from_file(default_tokenizer())
    held = {}
    for r in after:
        held.setdefault(r.doc_id, []).append(np.frombuffer(r.ids, "<u4").tolist())
    for i in {r.doc_id for r in before}:
        want = sorted(x for r in before if r.doc_id == i for x in tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])
        assert sorted(x for piece in held[i] for x in piece) == want


def test_empty_tables(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
