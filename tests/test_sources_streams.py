import json

import pytest
from pyspark.sql import functions as F

from glyphmend import service
from glyphmend.functions.words import tokens
from glyphmend.operators import analysis, chat, corpus, markup
from glyphmend.operators import lexicon as lex
from glyphmend.operators import restore as R
from glyphmend.sources import files
from glyphmend.streaming.filters import restore_stream
from glyphmend.streaming.limits import admit, limited, limited_stream

LINES = ["Qız məktəbə getdi.", "İşıq söndü."] * 3


@pytest.fixture(scope="module")
def words(spark):
    return lex.build_lexicon(tokens(spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string"), id_col="doc_id", text_col="text"))


def test_lexicon_file(spark, words, tmp_path):
    files.write_lexicon(words, str(tmp_path / "lexicon"))
    back = files.read_lexicon(spark, str(tmp_path / "lexicon"))
    assert {(r.key, r.form, r.n) for r in back.collect()} == {(r.key, r.form, r.n) for r in words.collect()}
    restorer = service.load_restorer(spark, lexicon=str(tmp_path / "lexicon"), context="")
    assert restorer.name == "lexicon" and service.load_restorer(spark).name == "identity"
    assert service.load_restorer(spark, lexicon=str(tmp_path / "lexicon"), tagger=lambda t: t).name == "hybrid"


def test_vocabulary_file(spark, words, tmp_path):
    endings = spark.createDataFrame([("lar",), ("ler",)], "ending string")
    vocab = words.select("key", "form", "n")
    files.write_vocabulary(vocab, endings, str(tmp_path / "v"), least=3)
    back, ends = files.read_vocabulary(spark, str(tmp_path / "v"))
    assert back.count() == vocab.where("n >= 3").count() and {r.ending for r in ends.collect()} == {"lar", "ler"}


def test_wiki_dump(spark, tmp_path):
    page = "<page><title>{t}</title><ns>{ns}</ns><id>{i}</id>{r}<revision><id>9</id><text>{x}</text></revision></page>"
    (tmp_path / "dump.xml").write_text("<mediawiki>" + page.format(t="T0", ns=0, i=1, r="", x="'''Bold''' [[File|link]] text {{t}}") + page.format(t="R", ns=0, i=2, r='<redirect title="x" />', x="y") + page.format(t="Talk", ns=1, i=3, r="", x="z") + "</mediawiki>", encoding="utf-8")
    rows = files.extract_articles(files.wiki_pages(spark, str(tmp_path / "dump.xml")), least=5).collect()
    assert [(r.id, r.title, r.text) for r in rows] == [("1", "T0", "Bold link text")]
    files.write_articles(spark.createDataFrame(rows), str(tmp_path / "a"))
    assert files.articles(spark, str(tmp_path / "a")).count() == 1


def test_clean(spark):
    raw = "<ref name=a/>Text<ref>gone</ref> here , [https://x.org site] .\nthumb|294x294px|Caption\n{| table |}\n\n\n\n== Head ==\n|}\n"
    assert spark.createDataFrame([(raw,)], "t string").select(markup.clean(F.col("t")).alias("r")).first().r == "Text here, site.\nCaption\n\nHead"


def test_blank_line_documents_and_upsert(spark):
    lines = ["a", "b", "", "", "c", " ", "d"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, pos int, line string")
    assert [(r.doc, r.lines) for r in files.blank_line_documents(df).orderBy("doc").collect()] == [(0, ["a", "b"]), (1, ["c"]), (2, ["d"])]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in files.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    with pytest.raises(ValueError):
        files.score_predictions(old.toDF("id", "text"), new.toDF("id", "text").limit(1))


def test_corpus(spark):
    line = "Bu cümlə adi bir nəsr cümləsidir."
    docs = spark.createDataFrame([(1, line + " " + line.upper().replace("I", "İ")), (2, line), (3, "qısa.")], "id long, text string")
    kept = corpus.build(docs, id_col="id", text_col="text").collect()
    assert [(r.id, r.sent_pos, r.sentence) for r in kept] == [(1, 0, line)] or len(kept) == 2
    reasons = {(r.id, r.sent_pos): r.reason for r in corpus.web_reasons(docs, docs.limit(0).withColumn("sentence", F.col("text")), id_col="id", text_col="text").collect()}
    assert reasons[3, 0] == "prose filter" and reasons[2, 0] == "duplicate" and reasons[1, 0].startswith("kept")
    stats = corpus.stats(docs, id_col="id", text_col="text").first()
    assert stats.articles == 3 and stats.kept == stats.kept_train + stats.kept_dev + stats.kept_test


WHATSAPP = """24.09.2026, 14:05 - Messages are end-to-end encrypted.
more of the notice
24.09.2026, 14:06 - Aysel: salam necesen bu gun
davam edir
[24.09.2026, 2:07:33 PM] Orxan K: yaxsi sen: necesen
24.09.2026, 14:08 - Aysel: <Media omitted>"""


def test_chat(spark, tmp_path):
    (tmp_path / "c.txt").write_text("﻿" + WHATSAPP, encoding="utf-8")
    rows = chat.whatsapp_messages(files.lines_of(spark, str(tmp_path / "c.txt"))).orderBy("pos").collect()
    assert [(r.author, r.text) for r in rows] == [("Aysel", "salam necesen bu gun davam edir"), ("Orxan K", "yaxsi sen: necesen"), ("Aysel", "<Media omitted>")]
    export = {"messages": [{"type": "message", "from": "A", "text": "salam dostum nece"}, {"type": "message", "from": "B", "text": ["bu ", {"type": "bold", "text": "qalin"}, " yazi"]}, {"type": "service", "text": "x"}, {"type": "message", "from": "A", "text": "y", "forwarded_from": "Z"}]}
    told = chat.telegram_messages(spark.createDataFrame([(json.dumps(export),)], "json string")).orderBy("pos").collect()
    assert [(r.author, r.text) for r in told] == [("A", "salam dostum nece"), ("B", "bu qalin yazi")]
    dropped = ["‎image omitted now here", "<Media omitted>", "This message was deleted", "bax https://x.az bura indi", "mail a@b.com yaz indi", "zeng et 055 123 45 67 indi", "iki soz", "x" * 260 + " a b", "tt hh nn"]
    df = spark.createDataFrame([(i, "A", t) for i, t in enumerate([*dropped, "bu  cox yaxsidir <This message was edited>"])], "pos int, author string, text string")
    kept = chat.kept_lines(df)
    assert [r.text for r in kept.collect()] == ["bu cox yaxsidir"]
    assert chat.kept_lines(df, kept).count() == 0 and chat.sample(kept, 5).count() == 1
    assert {(r.author, r.n) for r in chat.author_histogram(df).collect()} == {("A", 10)}


def test_requests(spark, words):
    rows = spark.createDataFrame([(1, "isiq sondu."), (2, "x" * 10_001)], "id long, text string")
    out = {r.id: r for r in service.restore_requests(rows, R.LexiconRestorer(words)).collect()}
    assert out[1].status == 200 and out[1].text == "işıq söndü." and [(c.start, c.end, c["from"], c.to) for c in out[1].changes] == [(0, 4, "isiq", "işıq"), (5, 10, "sondu", "söndü")]
    assert out[2].status == 422 and out[2].text is None and out[2].changes == []
    assert service.info(spark, R.Identity(), []).first().stores_text is False


def test_command_line(spark, words, tmp_path, capsys):
    files.write_lexicon(words, str(tmp_path / "lexicon"))
    assert service.main(["isiq", "sondu", "--lexicon", str(tmp_path / "lexicon")]) == 0
    assert capsys.readouterr().out.strip().endswith("işıq söndü")
    assert service.main(["x", "--lexicon", str(tmp_path / "none")]) == 1
    assert service.main(["x"]) == 2


def slow_limit(rows, allowance, window):
    held, out = {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        past = [x for x in held.get(u, []) if t - x <= window]
        out[i] = len(past) < allowance
        held[u] = past + [t] * out[i]
    return out


def test_rate_limits(spark, tmp_path):
    from collections import deque

    assert admit([0, 1, 2], deque(), 2, 60) == [True, True, False] and admit([0, 30, 61], deque(), 2, 60) == [True, True, True]
    rows = [(i, i % 3, float(i * 7 % 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, u long, t double")
    got = {r.id: r.admitted for r in limited(df, user_col="u", time_col="t", id_col="id", allowance=4, window=20.0).collect()}
    assert got == slow_limit(rows, 4, 20.0)
    rows.sort(key=lambda r: (r[2], r[0]))
    for k in range(2):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], "id long, u long, t double").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("id long, u long, t double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    limited_stream(stream, user_col="u", time_col="t", id_col="id", allowance=4, window=20.0).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.admitted for r in spark.table("limits").collect()} == slow_limit(rows, 4, 20.0)


def test_restore_stream(spark, words, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("isiq sondu\n\nqiz\n", encoding="utf-8")
    restore_stream(spark.readStream.text(str(tmp_path / "in")), R.LexiconRestorer(words), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r.restored for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"işıq söndü", "qız"}


def test_name_rules(spark):
    pairs = spark.createDataFrame([("Muraşkonun", "Muraskonun", 3), ("Şuşa", "Susa", 2), ("Bakı", "Bakı", 5)], "expected string, produced string, n long")
    names = analysis.title_names(spark.createDataFrame([("Muraşko",), ("Şuşa",), ("Şuşa Bakı",)], "t string"), title_col="t")
    none = spark.createDataFrame([], "key string, form string, n long")
    got = {r.rule: (r.changed, r.fixed, r.broken, r.net) for r in analysis.name_rules(pairs, names, none).collect()}
    assert got["titles spell it one way"] == (2, 2, 0, 2) and got["a name and a suffix"][1] == 5
