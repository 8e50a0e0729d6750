"""Character tagger: keep or mark, for each foldable letter.

The default predictor learns from letters alone: for every foldable position, how often training marks
it between the same neighbours, for windows of radius 4 down to 1; the widest window with enough
support decides.  Any other predictor (for instance an exported network) plugs in as a function over
Arrow batches of texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glyphmend.functions.letters import PLAIN, apply_labels, characters, strip_diacritics, to_labels
from glyphmend.operators import windows
from glyphmend.operators.stored import small, stored

RADII = (4, 3, 2, 1)
SUPPORT = 3
#: Characters of a block of texts, whose letters one task holds.
BLOCK = 4_000_000
WINDOW, OVERLAP = 256, 32


def window_bounds(length: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Structs (start, end, commit_start, commit_end) that commit every position of a long text once."""
    stride, half = window - overlap, overlap // 2
    last = F.greatest(F.ceil((length - window) / stride), F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            (i * stride).alias("start"), F.least(i * stride + window, length).cast("int").alias("end"),
            F.when(i == 0, 0).otherwise(i * stride + half).alias("commit_start"),
            F.when(i == last, length).otherwise(i * stride + window - half).cast("int").alias("commit_end"),
        ),
    )


def train(texts: DataFrame, *, id_col: str = "id", text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """radius, ctx, seen, marked of windows with enough support.

    Tasks count the widest windows of many texts at once and shuffle distinct ones, by their five middle characters:
    the narrower windows are summed where the wider ones meet.  The narrowest are few.
    """
    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(windows.counting(windows.key_table(texts.sparkSession)), "path string, seen long, marked long")
    each = F.when(F.length("path") == 3, F.array("path")).otherwise(F.array("path", F.substring("path", 1, 7), F.substring("path", 1, 5)))
    rows = rows.withColumn("_meet", F.substring("path", 1, 5)).repartition("_meet").select("_meet", "seen", "marked", F.explode(each).alias("path"))
    sums = rows.groupBy("_meet", "path").agg(F.sum("seen").alias("seen"), F.sum("marked").alias("marked")).where(F.col("seen") >= support)
    return sums.select(((F.length("path") - 1) / 2).cast("int").alias("radius"), _outside(F.col("path")).alias("ctx"), "seen", "marked")


def _outside(path: Column) -> Column:
    """The window of a path: see ``windows.INSIDE_OUT``."""
    n, char = F.length(path), lambda i: F.substring(path, i, 1)
    inner = F.when(n >= 7, F.concat(char(6), F.substring(path, 1, 5), char(7))).otherwise(path)
    return F.when(n == 9, F.concat(char(8), inner, char(9))).otherwise(inner)


def _path(ctx: Column) -> Column:
    """The path of a window of five, seven or nine characters."""
    n, char = F.length(ctx), lambda i: F.substring(ctx, i, 1)
    wide = F.concat(F.substring(ctx, 3, 5), char(2), char(8), char(1), char(9))
    return F.when(n == 9, wide).when(n == 7, F.concat(F.substring(ctx, 2, 5), char(1), char(7))).otherwise(ctx)


def _blocks(texts: DataFrame, model: DataFrame, *, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(block, id, text) rows, and the windows of each block that a mark is possible in: (block, path, probability).

    A window meets the model once for each block of texts, not once for each letter.
    """
    size = texts.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = -(-size // BLOCK) or 1
    dealt = texts.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).alias("block"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = dealt.repartition(blocks, "block").groupBy("block").applyInArrow(windows.asking(windows.key_table(texts.sparkSession)), "block long, path string")
    known = model.withColumn("probability", F.col("marked") / F.col("seen"))
    wide = known.where("radius > 1").select(_path(F.col("ctx")).alias("path"), F.col("radius").cast("int").alias("kind"), F.lit(None).cast("long").alias("block"), "probability")
    rows = wide.unionByName(asked.select("path", F.lit(9).alias("kind"), "block", F.lit(None).cast("double").alias("probability")))
    rows = rows.repartition(F.substring("path", 1, 5)).sortWithinPartitions("path", "kind").mapInArrow(windows.resolving, "block long, path string, probability double")
    narrow = small(stored(known.where("radius = 1").select(F.col("ctx").alias("_ctx"), F.col("probability").alias("_narrow"))))
    rows = rows.join(narrow, F.substring("path", 2, 3) == F.col("_ctx"), "left")
    return dealt, rows.select("block", "path", F.coalesce("probability", "_narrow").alias("probability")).where("probability > 0")


def probabilities(texts: DataFrame, model: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, at, letter, label (as typed), probability of the mark by the widest known window (0 if none)."""
    dealt, hits = _blocks(texts, model, id_col=id_col, text_col=text_col)
    kind = dealt.schema["id"].dataType
    place = windows.placing(windows.key_table(texts.sparkSession), to_arrow_type(kind))
    out = dealt.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(place, f"id {kind.simpleString()}, at int, place int, label int, probability double")
    return out.select(F.col("id").alias(id_col), "at", F.lit(PLAIN).substr(F.col("place") + 1, F.lit(1)).alias("letter"), "label", "probability")


def tag(texts: DataFrame, model: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, restored: marks of probability over one half, and all that were typed."""
    dealt, hits = _blocks(texts, model, id_col=id_col, text_col=text_col)
    mark = windows.marking(windows.key_table(texts.sparkSession), 0.5)
    out = dealt.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(mark, f"id {dealt.schema['id'].dataType.simpleString()}, restored string")
    return out.select(F.col("id").alias(id_col), "restored")


def decisions(found: DataFrame) -> DataFrame:
    """One row: how many foldable letters, how many decided as typed."""
    right = ((F.col("probability") > 0.5).cast("int") == F.col("label")).cast("long")
    return found.agg(F.count(F.lit(1)).alias("positions"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"))


def char_vocabulary(texts: DataFrame, *, text_col: str, least: int = 20) -> DataFrame:
    """ch, id: frequent stripped characters in order, numbered from 2 (0 pads, 1 is unknown)."""
    from pyspark.sql import Window

    counts = texts.select(F.explode(characters(strip_diacritics(F.col(text_col)))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # One row a character: a bounded table.
    return counts.withColumn("id", F.row_number().over(Window.orderBy("ch")) + 1).select("ch", "id", "n")


def predict_with(predictor: Callable[[list[str]], list[list[int]]], texts: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, restored by an injected predictor: stripped texts in, one label a character out."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "typed": b["typed"], "labels": [[int(x) for x in row] for row in predictor(b["plain"].tolist())]})

    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("typed"), strip_diacritics(F.col(text_col)).alias("plain"))
    out = rows.mapInPandas(run, f"id {kind}, typed string, labels array<int>")
    union = F.zip_with(to_labels(F.col("typed")), F.col("labels"), lambda a, b: F.greatest(a, b))
    return out.select(F.col("id").alias(id_col), apply_labels(strip_diacritics(F.col("typed")), union).alias("restored"))


def onnx_predictor(model_path: str, sidecar_path: str) -> Callable[[list[str]], list[list[int]]]:
    """Labels by an exported network (ids to logits), windowed as its sidecar says; loaded once a worker."""
    held: dict = {}

    def predict(texts: list[str]) -> list[list[int]]:
        if not held:
            import onnxruntime

            with open(sidecar_path, encoding="utf-8") as f:
                side = json.load(f)
            held.update(run=onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"]), ids={c: i + 2 for i, c in enumerate(side["characters"])}, config=side["config"])
        window, overlap = held["config"]["window"], held["config"]["overlap"]
        out = []
        for text in texts:
            labels: list[int] = []
            for start, end, a, z in bounds(len(text), window, overlap):
                ids = np.array([[held["ids"].get(c, 1) for c in text[start:end]]], dtype=np.int64)
                logits = held["run"].run(None, {held["run"].get_inputs()[0].name: ids})[0][0]
                labels += (logits[:, 1] > logits[:, 0]).astype(int)[a - start : z - start].tolist()
            out.append(labels)
        return out

    return predict


def bounds(length: int, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """window_bounds for one length, in plain Python."""
    if length == 0:
        return []
    stride, half = window - overlap, overlap // 2
    last = max(0, -(-(length - window) // stride))
    return [(i * stride, min(i * stride + window, length), i * stride + half if i else 0, length if i == last else i * stride + window - half) for i in range(last + 1)]
