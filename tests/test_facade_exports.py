import json

import pytest
from pyspark.sql import functions as F

from glyphmend import facade
from glyphmend.functions.sentences import split_name
from glyphmend.functions.words import tokens
from glyphmend.operators import lexicon as lex
from glyphmend.operators import restore as R
from glyphmend.operators import analysis, scoring, spelling, training
from glyphmend.operators import spelling_grid as grid
from glyphmend.sources import exports, files

LINES = ["Qız məktəbə getdi.", "İşıq söndü."] * 3


@pytest.fixture(scope="module")
def words(spark):
    return lex.build_lexicon(tokens(spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string"), id_col="doc_id", text_col="text"))


@pytest.fixture(scope="module")
def vocabulary(spark):
    rows = [("kitab", "kitab", 900), ("salam", "salam", 50), ("mekteb", "məktəb", 40), ("kitap", "kitap", 6), ("dunya", "dünya", 9)]
    return spark.createDataFrame(rows, "key string, form string, n long"), spark.createDataFrame([("lar",)], "ending string")


def test_engine_answers_requests(spark, words):
    engine = facade.Engine(R.LexiconRestorer(words))
    asked = spark.createDataFrame([(1, "Qiz", "u", 0.0), (2, "getdi", "u", 1.0), (3, "isiq", "u", 2.0), (4, "x" * 30, "v", 0.0), (5, "isiq", "v", 500.0)], "id long, text string, user string, time double")
    got = {r.id: (r.status, r.text, [(c["from"], c["to"]) for c in r.changes]) for r in engine.requests(asked, allowance=2, window=60.0, max_characters=20).collect()}
    assert got == {1: (200, "Qız", [("Qiz", "Qız")]), 2: (200, "getdi", []), 3: (429, None, []), 4: (422, None, []), 5: (200, "işıq", [("isiq", "işıq")])}
    assert [r.restored for r in engine.restore(spark.createDataFrame([(1, "mektebe")], "id long, text string")).collect()] == ["məktəbə"]
    assert engine.check(asked).count() == 0 and engine.check(asked).columns == ["id", "start", "end", "typed", "options"]
    assert [tuple(r) for r in facade.health(spark).collect()] == [("ok",)]


def test_engine_checks_with_a_vocabulary(spark, vocabulary):
    engine = facade.Engine(R.Identity(), *vocabulary)
    rows = engine.check(spark.createDataFrame([(1, "salam ktab dunya")], "id long, text string")).collect()
    assert [(r.start, r.end, r.typed, r.options) for r in rows] == [(6, 10, "ktab", ["kitab"])]


def test_engine_from_environment(spark, words, vocabulary, tmp_path):
    assert facade.from_environment(spark, {}).restorer.name == "identity"
    assert facade.from_environment(spark, {"GLYPHMEND_LEXICON": str(tmp_path / "none"), "GLYPHMEND_VOCABULARY": ""}).words is None
    files.write_lexicon(words, str(tmp_path / "l"))
    files.write_vocabulary(*vocabulary, str(tmp_path / "v"))
    engine = facade.from_environment(spark, {"GLYPHMEND_LEXICON": str(tmp_path / "l"), "GLYPHMEND_VOCABULARY": str(tmp_path / "v")})
    assert engine.restorer.name == "lexicon" and engine.words.count() == 5 and [r.ending for r in engine.endings.collect()] == ["lar"]


def test_typo_pairs_and_grid(spark, vocabulary):
    words, endings = vocabulary
    keys = words.select("key")
    pairs = grid.typo_pairs(keys, words, 4).collect()
    assert pairs == grid.typo_pairs(keys.repartition(3), words, 4).collect() and 0 < len(pairs) <= 4
    assert not {r.typed for r in pairs} & {r.key for r in words.collect()} and all(r.key != r.typed for r in pairs)
    tried = grid.settings(min_count=[5], rare=[20], dominance=[10.0, 1000.0])
    assert tried == [{"min_count": 5, "rare": 20, "dominance": 10.0}, {"min_count": 5, "rare": 20, "dominance": 1000.0}]
    made = spark.createDataFrame([("kitab", "kiatb"), ("salam", "slam")], "key string, typed string")
    rows = grid.grid(made, keys, words, tried).collect()
    # kitap is one edit from kitab, which is 150 times as frequent: a false alarm at a dominance of 10 only.
    assert [(r.dominance, r.total, r.flagged, r.top1, r.top3, r.false_alarms) for r in rows] == [(10.0, 2, 2, 2, 2, 1), (1000.0, 2, 2, 2, 2, 0)]
    assert spelling.MIN_COUNT == 5


def test_shouted_and_masked(spark):
    df = spark.createDataFrame([("iki işıq",), ("",)], "t string")
    got = [r[0] for r in df.select(training.shouted(F.col("t"), rate=1.0)).collect()]
    assert got == ["İKİ İŞIQ", ""]
    assert [r[0] for r in df.select(training.shouted(F.col("t"), rate=0.0)).collect()] == ["iki işıq", ""]
    assert spark.createDataFrame([("işıq x",)], "t string").select(training.masked_labels(F.col("t"))).first()[0] == [0, 1, 1, -100, -100, -100]


def test_first_rows_and_batches(spark):
    df = spark.createDataFrame([(i, "x" * (i % 17 + 1)) for i in range(100)], "id long, text string")
    assert [r.id for r in training.first_rows(df, 3, "id").collect()] == [0, 1, 2] and training.first_rows(df, None, "id").count() == 100
    rows = training.length_batches(df, text_col="text", size=8, chunk=4).collect()
    batches = {}
    for r in rows:
        batches.setdefault((r.chunk, r.batch), []).append(len(r.text))
    assert len(rows) == 100 and max(len(b) for b in batches.values()) <= 8
    for chunk in {c for c, _ in batches}:
        spans = [(min(b), max(b)) for (c, _), b in sorted(batches.items()) if c == chunk]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_bundle_and_sidecar(spark, words, vocabulary, tmp_path):
    model = tmp_path / "net.onnx"
    model.write_bytes(b"net")
    chars = spark.createDataFrame([("b", 3, 5), ("a", 2, 9)], "ch string, id int, n long")
    assert exports.write_sidecar(str(model), chars, {"window": 256, "overlap": 32}).endswith("net.json")
    back, config = exports.read_sidecar(spark, str(model))
    assert [tuple(r) for r in back.orderBy("id").collect()] == [("a", 2), ("b", 3)] and config == {"window": 256, "overlap": 32}
    folder = tmp_path / "bundle"
    folder.mkdir()
    parts = {r.name: r.bytes for r in exports.write_bundle(str(folder), lexicon=words, words=vocabulary[0], endings=vocabulary[1], model_path=str(model)).collect()}
    assert set(parts) == {"lexicon", "vocabulary", "net.onnx", "net.json"} and parts["net.onnx"] == 3 and all(parts.values())
    got = {(r.key, r.form, r.n) for r in exports.read_confident_lexicon(spark, str(folder / "lexicon")).collect()}
    assert got == {("qiz", "qız", 3), ("mektebe", "məktəbə", 3), ("isiq", "işıq", 3), ("sondu", "söndü", 3)}


def test_upsert_in_an_order(spark):
    old, new = spark.createDataFrame([("b", 1), ("z", 1), ("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("m", 2)], "k string, v int")
    assert [tuple(r) for r in exports.upsert_ranked(old, new, "k", ["b", "a"]).collect()] == [("b", 1), ("a", 2), ("m", 2), ("z", 1)]


def test_exports_by_suffix(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"messages": [{"type": "message", "from": "A", "text": ["one ", {"type": "bold", "text": "two"}]}, {"type": "service", "text": "s"}, {"type": "message", "from": "B", "text": "[hi] you"}]}), encoding="utf-8-sig")
    (tmp_path / "x.txt").write_text("1/2/24, 10:00 - A: one\ntwo\n1/2/24, 10:01 - B: three\n", encoding="utf-8")
    assert [(r.author, r.text) for r in exports.read_export(spark, str(tmp_path / "x.json")).orderBy("pos").collect()] == [("A", "one two"), ("B", "[hi] you")]
    assert [(r.author, r.text) for r in exports.read_export(spark, str(tmp_path / "x.txt")).orderBy("pos").collect()] == [("A", "one two"), ("B", "three")]


def test_byte_budget_counts_and_report(spark):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["ab", "", "şş", "d", "longer"])], "file string, pos int, line string")
    # 3 + 1 + 5 + 2 bytes fit; the line that the budget cuts is dropped.
    assert [(r.doc, r.lines) for r in exports.documents_within(lines, 13).orderBy("doc").collect()] == [(0, ["ab"]), (1, ["şş", "d"])]
    pages = spark.createDataFrame([("long enough",), ("no",), (None,)], "text string")
    assert tuple(exports.extraction_counts(pages, least=5).first()) == (1, 2)
    assert exports.markdown(spark.createDataFrame([("a", 0.125, None)], "x string, y double, z int")) == "| x | y | z |\n|-|-|-|\n| a | 0.12 |  |"


def test_rates_by_domain_and_training_titles(spark):
    counters = dict(words=10, correct=5, ambiguous=2, ambiguous_correct=1, chars=50, wrong_chars=5, sentences=1, exact=0, unseen=0)
    rows = [{"lang": lang, "system": system, **counters, "correct": right} for lang, system, right in (("a", "x", 5), ("a", "y", 8), (None, "x", 2), (None, "y", 1))]
    df = spark.createDataFrame(rows, "lang string, system string, " + ", ".join(f"{c} long" for c in counters))
    got = {(r.lang, r.system): (r.word_accuracy, r.word_accuracy_gain) for r in scoring.by_domain(df, "lang", first="x").collect()}
    assert got == {("a", "x"): (0.5, 0.0), ("a", "y"): (0.8, 0.3), (None, "x"): (0.2, 0.0), (None, "y"): (0.1, -0.1)}
    ids = spark.range(200)
    kept = analysis.in_training(ids, id_col="id").count()
    assert 150 < kept < 200 and analysis.in_training(ids, id_col="id").select(split_name(F.col("id").cast("string")).alias("s")).distinct().collect()[0].s == "train"
