import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glyphmend.functions.words import tokens, with_neighbours
from glyphmend.operators import annotate, context, scoring, spelling, tagger
from glyphmend.operators import lexicon as lex
from glyphmend.operators import restore as R
from glyphmend.plans import catalogue

BASE = ["Səncə nədən başlayaq?", "Qız məktəbə getdi.", "Qız bağçada oynayır.", "İşıq söndü.", "Şəhərdə yaşayır."]


def texts(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")


def lexicon(spark, lines):
    return lex.build_lexicon(tokens(texts(spark, lines), id_col="doc_id", text_col="text"))


def restored(restorer, spark, *lines):
    return [r.restored for r in restorer.transform(texts(spark, lines), id_col="doc_id").orderBy("doc_id").collect()]


def test_lexicon(spark):
    words = lexicon(spark, BASE)
    assert [(c.form, c.n) for c in lex.candidates(words).where("key = 'qiz'").first().candidates] == [("qız", 2)]
    rare = lexicon(spark, ["Bir kitab aldı."] * 200 + ["Bır kitab aldı."])
    assert lex.best_forms(rare).where("key = 'bir'").first().forms == 2
    assert lex.ambiguous_keys(rare).count() == 0
    often = lexicon(spark, ["Qız gəldi."] * 100 + ["Qiz gəldi."] * 20)
    assert [(r.key, r.runner_up, r.total) for r in lex.ambiguous_keys(often).collect()] == [("qiz", 20, 120)]
    pruned = lex.prune(lexicon(spark, ["Qız qız qız gəldi.", "Qiz sözü."]))
    assert [(r.key, r.form, r.n) for r in pruned.collect()] == [("qiz", "qız", 3)]
    assert lex.confident(lexicon(spark, BASE)).count() == 1


def test_identity_and_lexicon_restorers(spark):
    words = lexicon(spark, BASE)
    assert restored(R.LexiconRestorer(words), spark, "sence neden baslayaq?", "kompyuter", "  Isiq   sondu...  ", "iSIQ", "") == ["səncə nədən başlayaq?", "kompyuter", "  İşıq   söndü...  ", "iSIQ", ""]
    assert restored(R.Identity(), spark, "x y") == ["x y"]


def model(spark, lines, vocabulary=None):
    rows = tokens(texts(spark, lines), id_col="doc_id", text_col="text")
    words = lex.build_lexicon(rows)
    vocab = spark.createDataFrame([(v,) for v in vocabulary], "key string") if vocabulary else None
    forms, sides = context.train(with_neighbours(rows, id_col="doc_id"), lex.ambiguous_keys(words), vocab)
    return words, forms, sides, vocab


CONTEXT = ["Qız məktəbə getdi."] * 60 + ["Qız bağçaya getdi."] * 40 + ["Bu qiz sözü qədimdir."] * 30


def test_context_model(spark):
    _, forms, sides, _ = model(spark, CONTEXT)
    asked = spark.createDataFrame([("qiz", "<s>", "mektebe"), ("qiz", "bu", "sozu")], "key string, left string, right string")
    best = {r.left: r.form for r in context.best(context.scores(asked, forms, sides, 50_000)).collect()}
    assert best == {"<s>": "qız", "bu": "qiz"}
    _, _, sides, _ = model(spark, CONTEXT, ["bu"])
    assert {r.feature for r in sides.where("side = 'right'").collect()} == {"<unk>"}
    assert context.prune(sides.withColumn("n", F.lit(1))).count() == 0


@pytest.mark.parametrize(("margin", "want"), [(0.0, "Qiz sözü qədimdir."), (100.0, "Qız sözü qədimdir.")])
def test_margin(spark, margin, want):
    words, forms, sides, vocab = model(spark, ["Qız gəldi."] * 90 + ["Qiz sözü qədimdir."] * 10, ["geldi", "sozu"])
    assert restored(R.ContextRestorer(words, forms, sides, vocab, 5, margin), spark, "Qiz sozu qedimdir.") == [want]


def test_hybrid(spark):
    words = lexicon(spark, ["Şulaveri kəndi qədimdir."] * 9 + CONTEXT)
    plain = lambda t: t.select("id", F.col("text").alias("restored"))
    assert restored(R.HybridRestorer(plain, words), spark, "Sulaveri kendi, x") == ["Şulaveri kəndi, x"]
    assert restored(R.HybridRestorer(plain, words, min_count=50), spark, "Sulaveri kendi") == ["Sulaveri kendi"]
    base, forms, sides, vocab = model(spark, CONTEXT)
    ctx = R.ContextRestorer(base, forms, sides, vocab, 50_000)
    assert restored(R.HybridRestorer(plain, base, ctx, min_count=1000), spark, "Qiz mektebe", "Bu qiz sozu") == ["Qız mektebe", "Bu qiz sozu"]


def test_changes_and_revert(spark):
    rows = spark.createDataFrame([(1, "bu isiq sondu", "bu işıq söndü")], "id long, text string, restored string")
    found = R.changes(rows, id_col="id", text_col="text")
    assert [(r.start, r.end, r.typed, r.to) for r in found.orderBy("start").collect()] == [(3, 7, "isiq", "işıq"), (8, 13, "sondu", "söndü")]
    back = R.revert(found, rows, spark.createDataFrame([(1, 8)], "id long, start long"), id_col="id", text_col="text")
    assert back.first().restored == "bu işıq sondu"
    assert rows.select(R.restored_letters(F.col("text"), F.col("restored")).alias("n")).first().n == 4
    with pytest.raises(PySparkException):
        R.changes(rows.withColumn("restored", F.lit("x")), id_col="id", text_col="text").collect()


def test_letter_view(spark):
    df = spark.createDataFrame([("əec", [0.1, 0.62, 0.2])], "t string, p array<double>")
    view = df.select(R.letter_view(F.col("t"), F.col("p")).alias("v")).first().v
    assert [(x.probability, x.marked, x.source) for x in view] == [(1.0, True, "typed"), (0.62, True, "model"), (0.2, False, "model")]
    assert len(df.select(R.unsure_letters(R.letter_view(F.col("t"), F.col("p"))).alias("v")).first().v) == 2


def pairs(spark, rows):
    return spark.createDataFrame([(i, i // 4, a, b) for i, (a, b) in enumerate(rows)], "id long, grp long, expected string, produced string")


def test_scores(spark):
    words = lexicon(spark, BASE)
    same = scoring.rates(scoring.total(scoring.tallies(pairs(spark, [(t, t) for t in BASE]), words))).first()
    assert (same.word_accuracy, same.sentence_accuracy, same.character_error_rate, same.ambiguous_accuracy) == (1.0, 1.0, 0.0, 0.0)
    none = scoring.total(scoring.tallies(pairs(spark, [("səncə nədən başlayaq", "sence neden baslayaq")]), words)).first()
    assert (none.words, none.correct, none.wrong_chars, none.exact, none.unseen) == (3, 0, 5, 0, 0)
    with pytest.raises(PySparkException):
        scoring.tallies(pairs(spark, [("a", "b")]), words).collect()


def test_bootstrap(spark):
    words = lexicon(spark, BASE)
    good = scoring.tallies(pairs(spark, [(t, t) for t in BASE * 8]), words).withColumn("system", F.lit("good"))
    bad = scoring.tallies(pairs(spark, [(t, t.replace("ə", "e").replace("ö", "o") if i % 3 == 0 else t) for i, t in enumerate(BASE * 8)]), words).withColumn("system", F.lit("bad"))
    out = {(a, b): (lo, hi) for a, b, lo, hi in scoring.bootstrap(bad.unionByName(good), ["bad", "good"], pairs=[(0, 1), (1, 1)]).collect()}
    assert out["good", "word_accuracy"] == (1.0, 1.0) and out["good - good", "word_accuracy"] == (0.0, 0.0)
    assert 0 < out["good - bad", "sentence_accuracy"][0] <= out["good - bad", "sentence_accuracy"][1] < 1
    with pytest.raises(ValueError):
        scoring.bootstrap(bad.limit(0), ["bad"])
    with pytest.raises(ValueError):
        scoring.bootstrap(bad.unionByName(good.where("grp = 0")), ["bad", "good"])


VOCABULARY = [("xahis", "xahiş", 1711), ("xayis", "xayiş", 4), ("xalis", "xalis", 60), ("ev", "ev", 8895), ("ve", "və", 1084336), ("mekteb", "məktəb", 4000), ("ne", "nə", 500000), ("bilim", "bilim", 90), ("kitab", "kitab", 3000), ("gedirem", "gedirəm", 40), ("men", "mən", 9000)]


def speller(spark):
    return spark.createDataFrame(VOCABULARY, "key string, form string, n long"), spark.createDataFrame([("lar",), ("ler",), ("lari",)], "ending string")


def test_spelling(spark):
    words, endings = speller(spark)
    keys = spark.createDataFrame([(k,) for k in ("mektb", "xayis", "ev", "kitablari", "xy", "nebilim")], "key string")
    doubtful = spelling.suspicious(keys, words, endings)
    assert {r.key for r in doubtful.collect()} == {"mektb", "xayis", "nebilim"}
    got = {r.key: r.options for r in spelling.options(spelling.candidates(doubtful, words), words).collect()}
    assert got["xayis"][0] == ["xahiş"] and ["xalis"] in got["xayis"]
    assert got["nebilim"][0] == ["nə", "bilim"] and got["mektb"][0] == ["məktəb"]
    lines = spark.createDataFrame([(1, "Mektb. mən mektb gedirəm Xayis")], "id long, text string")
    found = spelling.check(lines, words, endings).orderBy("start").collect()
    assert [(r.start, r.end, r.typed, r.options[0]) for r in found] == [(0, 5, "Mektb", "Məktəb"), (11, 16, "mektb", "məktəb")]


def slow_edits(key):
    out = set()
    for i in range(len(key) + 1):
        a, b = key[:i], key[i:]
        if b:
            out.add(a + b[1:])
        if len(b) > 1:
            out.add(a + b[1] + b[0] + b[2:])
        for c in spelling.LETTERS:
            if b and c != b[0]:
                out.add(a + c + b[1:])
            out.add(a + c + b)
    return out


def test_edits_and_two_step_candidates(spark):
    keys = ["mekt", "w", "bxlm", "kwitab", "xhs", "ab"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: set(r.e) for r in df.select("key", spelling.edits1(F.col("key")).alias("e")).collect()}
    assert got == {k: slow_edits(k) for k in keys}
    words, _ = speller(spark)
    known = {k for k, _, n in VOCABULARY if n >= 5}
    want = {}
    for k in keys:
        one = (slow_edits(k) & known) - {k}
        want[k] = one or ({w for e in slow_edits(k) for w in slow_edits(e)} & known) - {k}
    found = {k: set() for k in keys}
    for r in spelling.candidates(df, words).where(F.size("words") == 1).collect():
        found[r.key].add(r.words[0])
    assert found == want


def test_typos_are_reproducible_mistakes(spark):
    df = spark.createDataFrame([(k,) for k, _, _ in VOCABULARY], "key string")
    rows = spelling.typos(df).collect()
    assert rows and rows == spelling.typos(df).collect()
    assert all(r.typed in slow_edits(r.key) or r.typed == r.key for r in rows)
    words, endings = speller(spark)
    s = spelling.score(spelling.typos(df), words, endings).first()
    assert s.total == len(rows) >= s.flagged >= s.top3 >= s.top1


def test_suffixes(spark):
    stems = [f"stem{a}{b}" for a in "abcdef" for b in "abcdef"]
    words = spark.createDataFrame([(s + e, s + e, 9) for s in stems for e in ("", "lar")] + [("stemaalik", "x", 9)], "key string, form string, n long")
    found = {r.ending: r.stems for r in spelling.suffixes(words, min_stems=30).collect()}
    assert found["lar"] == 36 and "lik" not in found and found["siniz"] is None


@pytest.mark.parametrize("length", [0, 1, 16, 17, 40, 99, 256, 700])
def test_windows_cover_every_position_once(spark, length):
    out = spark.range(1).select(tagger.window_bounds(F.lit(length), 16, 4).alias("w")).first().w
    if length:
        assert [x for w in out for x in range(w.commit_start, w.commit_end)] == list(range(length))
        assert [tuple(w) for w in out] == tagger.bounds(length, 16, 4)
    assert all(w.start <= w.commit_start and w.commit_end <= w.end <= w.start + 16 for w in out)


def test_taggers(spark):
    learnt = texts(spark, ["Qız məktəbə getdi."] * 6 + ["Səncə nədən başlayaq?"] * 6)
    m = tagger.train(learnt, id_col="doc_id")
    out = tagger.tag(texts(spark, ["Qiz mektebe getdi.", "sence", "", "xyz"]), m, id_col="doc_id").orderBy("doc_id").collect()
    assert [r.restored for r in out] == ["Qız məktəbə getdi.", "səncə", "", "xyz"]
    d = tagger.decisions(tagger.probabilities(learnt, m, id_col="doc_id")).first()
    assert d.positions == d.correct > 0
    every_e = lambda lines: [[int(c == "e") for c in x] for x in lines]
    got = tagger.predict_with(every_e, texts(spark, ["mən sence", ""]), id_col="doc_id").orderBy("doc_id").collect()
    assert [r.restored for r in got] == ["mən səncə", ""]


def test_answers(spark):
    rows = [(1, "isiq sondu", "işıq sondu", ""), (2, "isiq sondu", "işıq sondu", "işıq söndü"), (3, "isiq sondu", "işıq sondu", "söndü"), (4, "yeni yeni", "yeni yeni", "yəni"), (5, "YENI EV", "YENI EV", "yəni"), (6, "isiq", "işıq", "başqa")]
    df = spark.createDataFrame(rows, "id long, typed string, suggestion string, answer string")
    assert {r.id: r.correct for r in annotate.applied_answers(df).collect()} == {1: "işıq sondu", 2: "işıq söndü", 3: "işıq söndü", 4: None, 5: "YƏNİ EV", 6: None}
    assert annotate.pending(df, df.where("id < 6")).count() == 1


def test_registered_candidates_against_brute_force(spark, tmp_path):
    text = ("kitab " * 10 + "salam " * 12 + "dunya " * 8 + "mektub " * 9 + "ktob salamdnya salamkitab kitap mktubb zzzzzz").split()
    docs = [(i, " ".join(text), "az", "web") for i in range(1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {w: text.count(w) for w in text}
    known, total = {w: n for w, n in counts.items() if n >= 5}, len(text)

    def near(k):
        cut = [(k[:i], k[i:]) for i in range(len(k) + 1)]
        return {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1} | {a + c + b[1:] for a, b in cut if b for c in spelling.LETTERS} | {a + c + b for a, b in cut for c in spelling.LETTERS}

    true = {}
    for k in (w for w in counts if w not in known):
        one = {w for w in near(k) if w in known and w != k}
        wide = [(k, 0)] + ([] if one else [(s, 1) for s in near(k)])
        found = [((w,), math.log(known[w] / total) + math.log(0.05)) for w in one]
        found += [] if one else [((w,), math.log(known[w] / total) + 2 * math.log(0.05)) for w in {x for s in near(k) for x in near(s)} if w in known and w != k]
        found += [((s[:c], s[c:]), math.log(known[s[:c]] * known[s[c:]] / total**2) + d * math.log(0.05)) for s, d in wide for c in range(2, len(s) - 1) if s[:c] in known and s[c:] in known]
        for words, score in found:
            true[k, " ".join(words)] = max(score, true.get((k, " ".join(words)), -1e9))
    got = {(r.key, r.words): r.score for r in catalogue.QUERIES["spell_candidates"](spark, str(tmp_path)).collect()}
    assert ("ktob", "kitab") in true and ("salamdnya", "salam dunya") in true
    assert got == pytest.approx(true, abs=1e-8)
