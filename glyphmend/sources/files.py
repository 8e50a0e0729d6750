"""Readers and writers of the pipeline's files; all of them distributed, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARTICLE = "id string, title string, text string"
LEXICON = "key string, forms map<string,bigint>"


def articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLE).json(path)


def write_articles(rows: DataFrame, path: str) -> None:
    rows.select("id", "title", "text").write.mode("overwrite").json(path)


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """id, title, text of the articles of a MediaWiki dump (bz2 is split); nothing is inferred."""
    schema = "id string, ns string, redirect string, revision struct<text:string>, title string"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    text = F.col("revision.text")
    return pages.where((F.col("ns") == "0") & F.col("redirect").isNull() & text.isNotNull() & (text != "")).select("id", "title", text.alias("text"))


def extract_articles(pages: DataFrame, *, least: int = 200) -> DataFrame:
    """Pages as prose, without stubs."""
    from glyphmend.operators.markup import clean

    return pages.withColumn("text", clean(F.col("text"))).where(F.length("text") >= least)


def blank_line_documents(lines: DataFrame, *, line_col: str = "line", pos_col: str = "pos", file_col: str = "file") -> DataFrame:
    """file, doc, lines: runs of lines between blank ones, numbered from 0 in a file."""
    blank = (F.trim(F.col(line_col)) == "").cast("int")
    upto = Window.partitionBy(file_col).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_run", F.sum(blank).over(upto)).where(F.trim(F.col(line_col)) != "")
    runs = rows.groupBy(file_col, "_run").agg(F.transform(F.sort_array(F.collect_list(F.struct(pos_col, line_col))), lambda x: x[line_col]).alias("lines"))
    return runs.withColumn("doc", F.row_number().over(Window.partitionBy(file_col).orderBy("_run")) - 1).select(file_col, "doc", "lines")


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """JSON lines of key and forms, sorted by key, forms by count."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "first_seen", "form", "n")))
    forms = F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["form"], x["n"])))
    lexicon.groupBy("key").agg(forms.alias("forms")).orderBy("key").write.mode("overwrite").json(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """key, form, n, first_seen (the place among the key's forms)."""
    rows = spark.read.schema(LEXICON).json(path)
    return rows.select("key", F.posexplode("forms").alias("at", "form", "n")).select("key", "form", "n", F.struct(F.lit(0).cast("long").alias("doc_id"), "at").alias("first_seen"))


def write_context(forms: DataFrame, sides: DataFrame, vocabulary: DataFrame, path: str) -> None:
    for name, rows in (("forms", forms), ("sides", sides), ("vocabulary", vocabulary)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_context(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("forms", "sides", "vocabulary"))


def write_vocabulary(words: DataFrame, endings: DataFrame, path: str, *, least: int = 5) -> None:
    """Gzipped text: a line of suffixes, then key, form and count, sorted."""
    header = endings.agg(F.concat(F.lit("@suffixes\t"), F.array_join(F.array_sort(F.collect_set("ending")), ",")).alias("value"))
    rows = words.where(F.col("n") >= least).select(F.concat_ws("\t", "key", "form", F.col("n").cast("string")).alias("value"))
    # "@" sorts before every key.
    header.unionByName(rows).orderBy("value").write.mode("overwrite").option("compression", "gzip").text(path)


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(key, form, n) and (ending)."""
    lines = spark.read.text(path)
    head, p = lines.where(F.col("value").startswith("@suffixes\t")), F.split("value", "\t")
    words = lines.where(~F.col("value").startswith("@suffixes\t")).select(p[0].alias("key"), p[1].alias("form"), p[2].cast("long").alias("n"))
    return words, head.select(F.explode(F.split(p[1], ",")).alias("ending")).where("ending <> ''")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of text files, without a byte-order mark; a file is one row while it is cut."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def score_predictions(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """id, expected, produced of two (id, text) frames; a different number of rows is an error."""
    a, b = references.count(), predictions.count()
    if a != b:
        raise ValueError(f"{a} references but {b} predictions")
    return references.select("id", F.col("text").alias("expected")).join(predictions.select("id", F.col("text").alias("produced")), "id")
