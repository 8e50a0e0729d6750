"""What keeps the restoration queries in proportion to their input, and the same results by the plain way."""

from collections import Counter

from pyspark.sql import functions as F

from glyphmend.functions import letters as L
from glyphmend.functions import sentences as S
from glyphmend.functions import words as W
from glyphmend.operators import analysis, annotate, draws, scoring, spelling, tagger, windows
from glyphmend.operators import lexicon as lex
from glyphmend.operators import restore as R

DOCS = ["Səncə nədən başlayaq? Qız, qız QIZ.", "Qız məktəbə getdi. it's", "", None, "Qiz sözü; İşıq ışıq"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, lines=DOCS):
    return spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")


def test_draws_are_those_of_the_digest(spark):
    groups = ["0", "7", "12345", "x" * 49, "x" * 50, "ə" * 40, ""]
    got = draws.times_of(groups, 120, 3, scoring.POISSON)
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i int, g string").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(119))))
    for x in rows.select("i", "r", scoring.times_drawn(F.col("g"), F.col("r"), 3).alias("t")).collect():
        assert got[x.i, x.r] == x.t


def test_bootstrap_makes_no_row_for_a_group_and_resample(spark):
    one = spark.range(50).select(F.col("id").alias("grp"), F.lit("a").alias("system"), *[(F.col("id") % 7 + 1).alias(c) for c in scoring.COUNTERS])
    out = scoring.bootstrap(one, ["a"], resamples=40)
    assert "Generate explode(sequence" not in plan_of(out)
    wide = one.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("t", scoring.times_drawn(F.col("grp").cast("string"), F.col("resample"), 0))
    want = wide.groupBy("resample").agg((F.sum(F.col("t") * F.col("correct")) / F.sum(F.col("t") * F.col("words"))).alias("v")).agg(F.percentile("v", F.lit(0.025)).alias("p")).first().p
    assert out.where("rate = 'word_accuracy'").first().low == want


def test_words_are_counted_in_hash_tables(spark):
    rows = W.tokens(texts(spark), id_col="doc_id", text_col="text")
    counted = lex.count_words(rows)
    assert "SortAggregate" not in plan_of(counted)
    want = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first_seen"))
    assert sorted(counted.collect()) == sorted(want.collect())
    odd = spark.createDataFrame([("a", -(1 << 63), 5), ("a", (1 << 63) - 1, 0), ("b", (1 << 63) - 1, (1 << 31) - 1), ("c", None, 3), ("c", 1, 2)], "word string, doc_id long, pos int")
    odd = odd.select("word", "doc_id", F.coalesce("pos", F.lit(0)).alias("pos"))
    assert "SortAggregate" not in plan_of(lex.count_words(odd))
    got = {r.word: (r.n, *r.first_seen) for r in lex.count_words(odd).collect()}
    assert got == {"a": (2, -(1 << 63), 5), "b": (1, (1 << 63) - 1, (1 << 31) - 1), "c": (2, None, 3)}


def test_rows_do_not_meet_every_key(spark):
    rows = spark.createDataFrame([(1, "g", "", "a", "a", "a", "a"), (1, "g", " ", "b", "b", "b", "b"), (2, "g", "", "zz", "zz", "zz", "zz")], "id long, grp string, gap string, word string, expected string, out string, key string")
    facts = spark.range(1_000_100).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(False).alias("is_ambiguous")).unionByName(spark.createDataFrame([("a", True), ("b", False)], "key string, is_ambiguous boolean"))
    out = scoring.row_tallies(rows, facts, id_col="id", group_col="grp")
    assert "SortMergeJoin" not in plan_of(out)
    r = out.first()
    assert (r.words, r.correct, r.ambiguous, r.unseen, r.chars, r.sentences) == (3, 3, 1, 1, 5, 2)


def test_equal_words_are_counted_before_they_meet_their_key(spark):
    words = lex.build_lexicon(W.tokens(texts(spark), id_col="doc_id", text_col="text"))
    pairs = spark.createDataFrame([(i, 3, "Qız", "Qız", "qiz") for i in range(5)] + [(9, 0, "Qız", "Qiz", "qiz")], "doc_id long, pos int, expected string, produced string, key string")
    out = analysis.error_kinds(pairs, words)
    plan = plan_of(out)
    assert plan.index("Join") < plan.index("HashAggregate(keys=[key")  # the plan is written from its end
    assert {r.kind: (r.words, r.errors) for r in out.collect()} == {"capitalised, mid-sentence": (5, 0), "capitalised, first word": (1, 1), "all": (1, 1)}


def test_places_are_summed_inside_the_text(spark):
    found = W.text_spans(texts(spark), id_col="doc_id", text_col="text")
    assert "Window" not in plan_of(found)
    for r in found.collect():
        assert DOCS[r.doc_id][r.start : r.end] == r.word
    rows = W.pieces(texts(spark), id_col="doc_id", text_col="text")
    assert sorted(map(str, found.collect())) == sorted(map(str, W.spans(rows, id_col="doc_id").select(*found.columns).collect()))


def test_reverting_shuffles_changes_only(spark):
    rows = texts(spark, ["bu isiq sondu", "x", "", None])
    found = spark.createDataFrame([(0, 3, 7, "isiq", "işıq"), (0, 8, 13, "sondu", "söndü")], "doc_id long, start long, end long, typed string, to string")
    back = R.revert(found, rows, found.where("start = 8"), id_col="doc_id", text_col="text")
    assert "Window" not in plan_of(back) and "posexplode" not in plan_of(back)
    assert {r.doc_id: r.restored for r in back.collect()} == {0: "bu işıq sondu", 1: "x", 2: ""}


ODD = ["Şəkər çay, ΟΔΟΣ ISIQ", "İstanbul şəhəri ЖЖ çoxdur", "", None, "漢字 c 漢字 " + "".join(chr(0x4E00 + i) + "c" for i in range(200))] * 3


def slow_letters(texts):
    lower = lambda t: t.translate({ord("I"): "ı", ord("İ"): "i"}).lower().translate(str.maketrans(L.ACCENTED, L.PLAIN))
    for i, t in enumerate(texts):
        key, plain = "    " + lower(t or "") + "    ", (t or "").translate(str.maketrans(L.ACCENTED, L.PLAIN))
        for at, c in enumerate(plain):
            if c in L.PLAIN:
                yield i, at, c, int(c != t[at]), key[at : at + 9]


def test_windows_are_counted_and_met_as_letter_by_letter(spark, monkeypatch):
    monkeypatch.setattr(tagger, "BLOCK", 100)  # several blocks
    monkeypatch.setattr(windows, "AT_ONCE", 50)
    rows = list(slow_letters(ODD))
    seen, marked = Counter(), Counter()
    for _, _, _, label, around in rows:
        for r in tagger.RADII:
            seen[r, around[4 - r : 5 + r]] += 1
            marked[r, around[4 - r : 5 + r]] += label
    df = texts(spark, ODD)
    trained = tagger.train(df, id_col="doc_id")
    assert plan_of(trained).count("Exchange") == 1 + plan_of(df).count("Exchange")
    model = {(x.radius, x.ctx): (x.seen, x.marked) for x in trained.collect()}
    assert model == {k: (n, marked[k]) for k, n in seen.items() if n >= 3}
    # A model that does not know some windows: narrower ones decide.
    model = {k: v for i, (k, v) in enumerate(sorted(model.items())) if i % 3}
    table = spark.createDataFrame([(*k, *v) for k, v in model.items()], "radius int, ctx string, seen long, marked long")
    got = {(x.doc_id, x.at): (x.letter, x.label, x.probability) for x in tagger.probabilities(df, table, id_col="doc_id").collect()}
    want = {}
    for i, at, c, label, around in rows:
        known = [model[r, around[4 - r : 5 + r]] for r in tagger.RADII if (r, around[4 - r : 5 + r]) in model]
        want[i, at] = (c, label, known[0][1] / known[0][0] if known else 0.0)
    assert got == want
    tagged = {x.doc_id: x.restored for x in tagger.tag(df, table, id_col="doc_id").collect()}
    for i, t in enumerate(ODD):
        marks = {at for (j, at), (_, _, p) in want.items() if j == i and p > 0.5}
        assert tagged[i] == (None if t is None else "".join(c.translate(str.maketrans(L.PLAIN, L.ACCENTED)) if at in marks else c for at, c in enumerate(t)))


def test_sentences_stay_inside_their_text(spark):
    rows = texts(spark, ["Bu prof. Əli gəldi. O getdi!  \n\n Son prof.", "", None, " \n ", "a.\nb", "x… y? z. "])
    out = S.sentences(rows, id_col="doc_id", text_col="text")
    assert "Window" not in plan_of(out) and "Exchange" not in plan_of(out)
    got = sorted((r.doc_id, r.sent_pos, r.sentence) for r in out.collect())
    assert got == [(0, 0, "Bu prof. Əli gəldi."), (0, 1, "O getdi!"), (0, 2, "Son prof."), (4, 0, "a. b"), (5, 0, "x…"), (5, 1, "y?"), (5, 2, "z.")]


def test_answers_shuffle_named_words_only(spark):
    named = [f"k{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(80)]
    many = " ".join(named)
    rows = [(1, "isiq sondu", "işıq sondu", "söndü"), (2, many, many, many + " kab"), (3, "a b", "a b", "!"), (4, many, many, " ".join(named[:0:-1]))]
    out = annotate.applied_answers(spark.createDataFrame(rows, "id long, typed string, suggestion string, answer string"))
    assert "array_contains" in plan_of(out)
    assert {r.id: r.correct for r in out.collect()} == {1: "işıq söndü", 2: many, 3: "a b", 4: many}


def test_alarms_are_counted_by_key(spark):
    words = spark.createDataFrame([("qiz", "qız", 9), ("ev", "ev", 9)], "key string, form string, n long")
    endings = spark.createDataFrame([("lar",)], "ending string")
    rows = spelling.false_alarms(texts(spark, ["Qız ev qqq. Qqq Qqq qqq", None, ""]), words, endings, id_col="doc_id", text_col="text")
    assert tuple(rows.first()) == (6, 3, 4)
    assert tuple(spelling.false_alarms(texts(spark, [""]), words, endings, id_col="doc_id", text_col="text").first())[0] == 0


def test_scored_words_do_not_meet_every_key(spark):
    words = lex.build_lexicon(W.tokens(texts(spark), id_col="doc_id", text_col="text"))
    big = words.select("key", "form", "n", "first_seen").unionByName(spark.range(1_000_100).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("x").alias("form"), F.lit(1).cast("long").alias("n"), F.struct(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("pos")).alias("first_seen")))
    pairs = spark.createDataFrame([(1, 1, "Qız söz", "Qiz soz"), (2, 1, "zz ev", "zz ev")], "id long, grp long, expected string, produced string")
    out = scoring.tallies(pairs, big)
    assert "SortMergeJoin [key" not in plan_of(out)
    r = out.first()
    assert (r.words, r.correct, r.wrong_chars, r.exact, r.unseen, r.chars, r.sentences) == (4, 2, 2, 1, 3, 12, 2)


def test_pieces_are_judged_by_their_last_characters(spark):
    tails = ["prof.", "Prof.", "x prof.", "xprof.", "a.b.", "İ.", "xİ.", "x İ.", "..", "prof..", "akad.", "1akad.", "b", "söz.", "mln.akad.", ".", "ə.", "ΟΔΟΣ.", "q\tY."]
    df = spark.createDataFrame([(x,) for x in tails], "p string")
    for r in df.select("p", S._abbreviated(F.col("p")).alias("a"), (F.col("p").endswith(".") & S.ends_with_abbreviation(F.col("p"))).alias("b")).collect():
        assert (r.a and r.p.endswith(".")) == r.b, r.p


def test_usable_as_counted(spark):
    lines = ["Bu bir uzun cümlədir ki.", "Bu bir  uzunca", "a  b\u00a0c d eeeeeeeeeeeeeeeeee", "Жук bir iki üç dörd beş altı", "Söz 1234567 8901234 567890 12", "Bu bir iki | üç dörd beş", "1 Bu bir iki üç dörd beş"]
    letters, s = F.regexp_count("s", F.lit(r"\p{L}")), F.col("s")
    slow = F.length(s).between(20, 300) & (F.regexp_count(s, F.lit(f"[^{S.SPACE[1:-2]}]+")) >= 4) & ~s.rlike(S.MARKUP) & s.rlike(r"^\p{L}") & (letters / F.length(s) >= 0.6) & (letters == F.regexp_count(s, F.lit(f"[{S.AZ_LETTERS}a-zA-Z]")))
    fast = S.is_usable(F.col("s"))
    assert "regexp_extract_all" not in str(fast) and "regexp_count" not in str(fast)
    rows = spark.createDataFrame([(x,) for x in lines], "s string").select("s", slow.alias("a"), fast.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and {r.a for r in rows} == {True, False}
