"""The engine as one object: restore, check, requests with limits, health; chosen by the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmend.operators import spelling, tagger
from glyphmend.service import MAX_CHARACTERS, load_restorer, restore_requests
from glyphmend.sources import files
from glyphmend.streaming.limits import ALLOWANCE, WINDOW_S, limited

PREFIX = "GLYPHMEND_"


@dataclass
class Engine:
    """A restorer, and a vocabulary (key, form, n) with its endings where spelling is checked."""

    restorer: object
    words: DataFrame | None = None
    endings: DataFrame | None = None

    def restore(self, texts: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
        return self.restorer.transform(texts, id_col=id_col, text_col=text_col)

    def check(self, texts: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """id, start, end, typed, options; without a vocabulary nothing is doubted."""
        if self.words is None:
            kind = texts.schema[id_col].dataType.simpleString()
            return texts.sparkSession.createDataFrame([], f"{id_col} {kind}, start long, end long, typed string, options array<string>")
        return spelling.check(texts, self.words, self.endings, id_col=id_col, text_col=text_col)

    def requests(self, requests: DataFrame, *, user_col: str = "user", time_col: str = "time", allowance: int = ALLOWANCE, window: float = WINDOW_S, max_characters: int = MAX_CHARACTERS) -> DataFrame:
        """id, status, text, changes of (id, text, user, time) rows: 429 for a user who asks too often, 422 for a text too long, else 200."""
        admitted = limited(requests, user_col=user_col, time_col=time_col, id_col="id", allowance=allowance, window=window).select("id", "admitted")
        marked = requests.join(admitted, "id")
        done = restore_requests(marked.where("admitted").select("id", "text"), self.restorer, max_characters=max_characters)
        kinds = {f.name: f.dataType for f in done.schema.fields}
        refused = marked.where("not admitted").select("id", F.lit(429).alias("status"), F.lit(None).cast("string").alias("text"), F.array().cast(kinds["changes"]).alias("changes"))
        return done.unionByName(refused)


def health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ok",)], "status string")


def from_environment(spark: SparkSession, env: Mapping[str, str] | None = None) -> Engine:
    """The engine that LEXICON, CONTEXT, MODEL (an exported network) and VOCABULARY, each after the prefix, name.

    Empty names and missing files count as not named; a network needs its sidecar.
    """
    env = os.environ if env is None else env

    def named(what: str) -> str | None:
        path = env.get(PREFIX + what, "")
        return path if path and os.path.exists(path) else None

    model, vocabulary = named("MODEL"), named("VOCABULARY")
    tag = None
    if model is not None:
        from glyphmend.sources.exports import sidecar_path

        predictor = tagger.onnx_predictor(model, sidecar_path(model))
        tag = lambda texts: tagger.predict_with(predictor, texts)
    words, endings = files.read_vocabulary(spark, vocabulary) if vocabulary else (None, None)
    return Engine(load_restorer(spark, lexicon=named("LEXICON"), context=named("CONTEXT"), tagger=tag), words, endings)
