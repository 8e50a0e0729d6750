import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glyphmend.functions import letters as L
from glyphmend.functions import sentences as S
from glyphmend.functions import words as W


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'array<int>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values)))
    return df.select(f(*[F.col(n) for n in names]).alias("r")).first()["r"]


@pytest.mark.parametrize(("f", "cases"), [
    (L.az_lower, {"IŞIQ": "ışıq", "İSTİFADƏ": "istifadə", "": ""}),
    (L.az_upper, {"ışıq": "IŞIQ", "istifadə": "İSTİFADƏ", "ß": "SS"}),
    (L.strip_diacritics, {"səncə nədən başlayaq": "sence neden baslayaq", "İSTİFADƏ": "ISTIFADE"}),
    (L.key_of, {"Səncə": "sence", "İŞIQ": "isiq", "isiq": "isiq"}),
    (L.mark, {"e": "ə", "I": "İ", "x": "x"}),
])
def test_scalars(spark, f, cases):
    rows = spark.createDataFrame(list(cases.items()), "a string, b string").select(f(F.col("a")).alias("r"), "b").collect()
    assert [r.r for r in rows] == [r.b for r in rows]


def test_labels(spark):
    assert one(spark, L.to_labels, "səncə") == [0, 1, 0, 0, 1]
    assert one(spark, L.to_labels, "qız") == [0, 1, 0]
    assert one(spark, L.to_labels, "İdman")[0] == 1
    assert one(spark, L.to_labels, "") == []
    assert one(spark, L.foldable_positions, "sence") == [0, 1, 3, 4]
    assert one(spark, L.restore_with_labels, "mən sence", [0] * 9) == "mən sence"
    with pytest.raises(PySparkException):
        one(spark, L.apply_labels, "sence", [0])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abcçeəıiİIğöşüÜ xyz.😀", max_size=12), min_size=1, max_size=30))
def test_letter_properties(spark, texts):
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(
        t, L.strip_diacritics(t).alias("s"), L.strip_diacritics(L.strip_diacritics(t)).alias("ss"), L.apply_labels(L.strip_diacritics(t), L.to_labels(t)).alias("back")
    )
    for r in rows.collect():
        assert len(r.s) == len(r.t) and r.ss == r.s and r.back == r.t


@pytest.mark.parametrize(("typed", "form", "want"), [("sence", "səncə", "səncə"), ("Sence", "səncə", "Səncə"), ("SENCE", "səncə", "SƏNCƏ"), ("Idman", "idman", "İdman"), ("ISIQ", "ışıq", "IŞIQ")])
def test_restore_case(spark, typed, form, want):
    assert one(spark, L.restore_case, typed, form) == want


def test_case_classes(spark):
    first = F.lit(True)
    assert [one(spark, lambda c: L.case_of(c, first), w) for w in ("BAKI", "Bakı", "bakı", "A")] == ["all capitals", "capitalised, first word", "lowercase", "capitalised, first word"]


def test_words_and_spans(spark):
    df = spark.createDataFrame([(1, "  Azərbaycan'da, x²  1990 il…"), (2, ""), (3, "...")], "id long, t string")
    assert [(r.start, r.end, r.word) for r in W.text_spans(df, id_col="id", text_col="t").orderBy("id", "pos").collect()] == [(2, 15, "Azərbaycan'da"), (17, 19, "x²"), (26, 28, "il")]
    back = W.joined(W.pieces(df, id_col="id", text_col="t"), id_col="id", word_col="word", out="t").collect()
    assert {r.id: r.t for r in back} == {r.id: r.t for r in df.collect()}


SENTENCES = {
    "Bir. İki! Üç?": ["Bir.", "İki!", "Üç?"],
    "Bir\nİki": ["Bir", "İki"],
    "Kitab, jurnal və s. burada saxlanılır. Növbəti cümlə.": ["Kitab, jurnal və s. burada saxlanılır.", "Növbəti cümlə."],
    "Şəhər b.e.ə. VII əsrdə salınıb. Sonra böyüdü.": ["Şəhər b.e.ə. VII əsrdə salınıb.", "Sonra böyüdü."],
    "  ": [],
    "Sonu yox": ["Sonu yox"],
    "Bölmə 5. Next one. \n\n x": ["Bölmə 5. Next one.", "x"],
    "": [],
}


def test_sentences(spark):
    texts = list(SENTENCES)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {t: [] for t in texts}
    for r in S.sentences(df, id_col="id", text_col="t").orderBy("id", "sent_pos").collect():
        got[texts[r.id]].append(r.sentence)
    assert got == SENTENCES


def test_normal_form_and_prose_filter(spark):
    assert one(spark, S.normalize, " a\x1f b　c  é ") == unicodedata.normalize("NFC", "a b c é")
    good = "Bu cümlə adi bir nəsr cümləsidir."
    cases = {good: True, "qısa cümlə budur": False, "| " + good: False, "1 " + good: False, good + " слово": False, "uzunsöz " * 50: False, "Bu a b " + "1234567890" * 3: False}
    rows = spark.createDataFrame(list(cases.items()), "t string, ok boolean").select(S.is_usable(F.col("t")).alias("r"), "ok").collect()
    assert [r.r for r in rows] == [r.ok for r in rows]


def test_split_is_stable(spark):
    import hashlib

    ids = [str(i) for i in range(300)]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", S.bucket_of(F.col("id")).alias("b")).collect()
    assert {r.id: r.b for r in rows} == {i: hashlib.sha1(i.encode()).digest()[0] % 100 for i in ids}
