"""Files that the engine ships or takes in besides its tables: bundles, sidecars, ranked results, chat exports, budgets."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmend.operators.chat import telegram_messages, whatsapp_messages
from glyphmend.operators.lexicon import confident
from glyphmend.sources.files import blank_line_documents, lines_of, write_vocabulary


def write_confident_lexicon(lexicon: DataFrame, path: str, *, least: int = 2) -> None:
    """Gzipped lines of key, form and count, sorted by key: keys with one spelling that has marks."""
    rows = confident(lexicon, least=least).select(F.concat_ws("\t", "key", "form", F.col("n").cast("string")).alias("value"))
    rows.orderBy("value").write.mode("overwrite").option("compression", "gzip").text(path)


def read_confident_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """key, form, n, first_seen."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).select(p[0].alias("key"), p[1].alias("form"), p[2].cast("long").alias("n"))
    return rows.withColumn("first_seen", F.struct(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("at")))


def sidecar_path(model_path: str) -> str:
    return os.path.splitext(model_path)[0] + ".json"


def write_sidecar(model_path: str, characters: DataFrame, config: dict) -> str:
    """The characters (ch, id: one row a character, a bounded table) and the windows of a network, beside its file."""
    path = sidecar_path(model_path)
    known = [r["ch"] for r in characters.orderBy("id").select("ch").collect()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"characters": known, "config": config}, f, ensure_ascii=False)
    return path


def read_sidecar(spark: SparkSession, model_path: str) -> tuple[DataFrame, dict]:
    """(ch, id) and the windows."""
    with open(sidecar_path(model_path), encoding="utf-8") as f:
        side = json.load(f)
    return spark.createDataFrame([(c, i + 2) for i, c in enumerate(side["characters"])], "ch string, id int"), side["config"]


def write_bundle(folder: str, *, lexicon: DataFrame, words: DataFrame, endings: DataFrame, model_path: str | None = None) -> DataFrame:
    """Writes the shipped tables (and copies a network with its sidecar) into a folder; returns name and bytes of each part."""
    write_confident_lexicon(lexicon, f"{folder}/lexicon")
    write_vocabulary(words, endings, f"{folder}/vocabulary")
    if model_path is not None:
        for path in (model_path, sidecar_path(model_path)):
            shutil.copy(path, folder)
    sizes = []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        files = [path] if os.path.isfile(path) else [os.path.join(path, f) for f in os.listdir(path)]
        sizes.append((name, sum(os.path.getsize(f) for f in files)))
    return lexicon.sparkSession.createDataFrame(sizes, "name string, bytes long")


def upsert_ranked(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key, in the order of a list of keys; unlisted keys come last, sorted."""
    place = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        place = F.when(F.col(key) == name, i).otherwise(place)
    rows = old.join(new.select(key), key, "left_anti").unionByName(new)
    return rows.withColumn("rank", place).orderBy("rank", key).drop("rank")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """pos, author, text of a chat export: JSON by its suffix, else lines."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("json"))
        return telegram_messages(whole).select("pos", "author", "text")
    return whatsapp_messages(lines_of(spark, path)).select("pos", "author", "text")


def documents_within(lines: DataFrame, most_bytes: int, *, line_col: str = "line", pos_col: str = "pos", file_col: str = "file") -> DataFrame:
    """file, doc, lines of the documents between blank lines, of what fits into a budget of bytes a file; the line that it cuts is dropped."""
    upto = Window.partitionBy(file_col).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_upto", F.sum(F.octet_length(line_col) + 1).over(upto)).where(F.col("_upto") <= most_bytes).drop("_upto")
    return blank_line_documents(rows, line_col=line_col, pos_col=pos_col, file_col=file_col)


def extraction_counts(pages: DataFrame, *, least: int = 200) -> DataFrame:
    """One row: pages kept and skipped as stubs."""
    from glyphmend.operators.markup import clean

    long = F.length(clean(F.col("text"))) >= least
    return pages.agg(F.count_if(long).alias("kept"), F.count_if(~F.coalesce(long, F.lit(False))).alias("skipped"))


def markdown(rows: DataFrame, *, digits: int = 2, most: int = 200) -> str:
    """A report of at most ``most`` rows as a table of text, numbers with so many digits."""
    shown = rows.limit(most).collect()
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in shown])
