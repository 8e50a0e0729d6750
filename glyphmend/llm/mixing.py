"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source is a queue of shuffled documents.  A document's virtual finish time is the cumulative size of its source up
to and including it, divided by the source's target; later passes over the same source (repeats) go on counting.
All occurrences are range-sorted by finish time over all sources, and their running total is cut at the total
budget (the words of all sources); what each source has before the cut is its share of the mix.  An occurrence that is
in service when its source reaches its target is two packets, one before and one after that time, so a very long
document takes no source past its target.

Cumulative sizes are two-level: rows lie in runs, of a source's shuffle order and of virtual time, of about
``RUN_ROWS`` rows; run totals give the offsets.  Rows equal in id, source and text are one packet with a count, so
one row repeated in a third of the table is one row of the sort, and is dealt out again in chunks; an id that many
texts share, or none, is shuffled with the text's digest.

Defined cases: null or empty text has size 0 and takes 0; null sources are one source, last
in order; repeated rows are documents of their own; very long texts are counted whole; an empty table gives an empty
result; other columns, whatever their names, are kept by ``weighted_fair_mix`` and ignored by ``mix_documents``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmend.llm.common import WORD_RE, checkpointed, unpacked, whole_row

RUN_ROWS = 1 << 16
LEAST_RUNS = 256
#: Copies of a row that one row of the result's last step stands for at most.
CHUNK = 1 << 12
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (src, source_size) rows, one a source: src, source_size, target double.

    Weights repeat over the sources in code-point order, null last.  Targets are capped at
    ``max_epochs`` times the source's size.  The capped sources are a prefix in order of
    cap / weight, so the excess is reshared in one pass instead of a loop.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * max_epochs).cast("double")
    order = (F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    rates = (
        sizes.withColumn("w", w)
        .withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    )
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    return rates.withColumn("final_level", level).select(
        "src", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final_level") * F.col("w")).alias("target")
    )


def _keyed(docs: DataFrame, *, text_col: str, id_col: str, source_col: str, seed: str, row: Column | None = None) -> DataFrame:
    """_id, _src, _size and _key (the shuffle order), and _row if given."""
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest))
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), word_count(F.col(text_col)).alias("_size"), key.alias("_key"), *([] if row is None else [row]))


def _run(runs: int) -> Column:
    return (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * runs / F.lit(1 << 32)).cast("int")


def _runs(rows: int) -> int:
    return max(LEAST_RUNS, -(-rows // RUN_ROWS))


def _sources(base: DataFrame, runs: int, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """_osrc, _orun, _ostart (words of the source before the run), _onth (rows before it), _source_size, _target of each run of each source."""
    totals = base.groupBy("_src", _run(runs).alias("_run")).agg(F.sum(F.col("_size") * F.col("_n")).alias("words"), F.sum("_n").alias("rows"))
    before = Window.partitionBy("_src").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        totals.withColumn("_ostart", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("_onth", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .withColumn("source_size", F.sum("words").over(Window.partitionBy("_src")))
    )
    targets = source_targets(totals.groupBy(F.col("_src").alias("src")).agg(F.first("source_size").alias("source_size")), weights, max_epochs)
    return totals.join(targets.select("src", F.col("target").alias("_target")), F.col("_src").eqNullSafe(F.col("src"))).select(
        F.col("_src").alias("_osrc"), F.col("_run").alias("_orun"), "_ostart", "_onth", F.col("source_size").alias("_source_size"), "_target"
    )


def _placed(rows: DataFrame, sources: DataFrame, runs: int) -> DataFrame:
    """Adds _start (words of the source before the row), _nth (rows before it), _source_size and _target."""
    order = Window.partitionBy("_src", "_run").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("_size") * F.col("_n")
    return (
        rows.withColumn("_run", _run(runs))
        .withColumn("_words", F.sum(words).over(order) - words)
        .withColumn("_rows", F.sum("_n").over(order) - F.col("_n"))
        .join(sources, F.col("_src").eqNullSafe(F.col("_osrc")) & (F.col("_run") == F.col("_orun")))
        .withColumn("_start", F.col("_ostart") + F.col("_words"))
        .withColumn("_nth", F.col("_onth") + F.col("_rows"))
        .drop("_osrc", "_orun", "_ostart", "_onth", "_words", "_rows", "_run", "_key")
    )


def _epochs(max_epochs: int) -> Column:
    """The passes over its source that a row may be served in, from 0."""
    served = F.least(F.lit(max_epochs), F.greatest(F.lit(1), F.ceil(F.try_divide(F.col("_target"), F.col("_source_size"))))).cast("int")
    return F.sequence(F.lit(0), F.coalesce(served, F.lit(1)) - 1)


def packets(placed: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """src, begun (words of the source before it), words, finish (virtual time) of every packet of sources with a target."""
    rows = placed.where("_target > 0 and _size > 0").withColumn("_epoch", F.explode(_epochs(max_epochs)))
    rows = rows.select(F.col("_src").alias("src"), F.col("_target").alias("target"), (F.col("_epoch") * F.col("_source_size") + F.col("_start")).alias("begun"), (F.col("_size") * F.col("_n")).alias("words"))
    finish = (F.col("begun") + F.col("words")) / F.col("target")
    split = (F.col("begun") < F.col("target")) & (F.col("begun") + F.col("words") > F.col("target"))
    first = F.when(split, F.floor(F.col("target") - F.col("begun") + F.lit(1e-6))).otherwise(F.col("words")).cast("long")
    whole = F.struct(F.col("begun").alias("begun"), first.alias("words"), F.when(split, F.lit(1.0)).otherwise(finish).alias("finish"))
    rest = F.struct((F.col("begun") + first).alias("begun"), (F.col("words") - first).alias("words"), finish.alias("finish"))
    return rows.select("src", F.explode(F.when(split, F.array(whole, rest)).otherwise(F.array(whole))).alias("p")).select("src", "p.begun", "p.words", "p.finish")


def source_cuts(placed: DataFrame, sources: DataFrame, runs: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """src, cut: the words of each source before the cut of all packets, range-sorted by finish time, at the total budget."""
    # Up to virtual time 1 all sources together are served at one rate: equal stretches of it hold equal words.
    ranged = packets(placed, max_epochs).withColumn("stretch", F.least(F.floor(F.col("finish") * runs), F.lit(4 * runs)).cast("int"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # One row a stretch.
    offsets = ranged.groupBy("stretch").agg(F.sum("words").alias("w")).select(F.col("stretch").alias("ostretch"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("stretch").orderBy("finish", F.col("src").asc_nulls_last(), "begun", "words").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("upto", F.sum("words").over(inside)).join(offsets, F.col("stretch") == F.col("ostretch")).withColumn("upto", F.col("upto") + F.col("offset"))
    budget = sources.select("_osrc", "_source_size").distinct().agg(F.sum("_source_size").alias("budget"))
    # The budget is one row.
    left = F.col("budget") - (F.col("upto") - F.col("words"))
    return running.join(F.broadcast(budget)).groupBy("src").agg(F.sum(F.greatest(F.lit(0), F.least(F.col("words"), left))).alias("cut"))


def _plan(docs: DataFrame, *, text_col: str, id_col: str, source_col: str, weights: tuple[int, ...], max_epochs: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows with a count, placed; runs of the sources; cuts; number of runs).  The texts are read once, for their sizes."""
    rows = _keyed(docs, text_col=text_col, id_col=id_col, source_col=source_col, seed=seed)
    base = checkpointed(rows.groupBy("_id", "_src", "_size", "_key").agg(F.count(F.lit(1)).alias("_n")))
    runs = _runs(base.count())
    sources = checkpointed(_sources(base, runs, weights, max_epochs))
    placed = _placed(base, sources, runs)
    return placed, sources, checkpointed(source_cuts(placed, sources, runs, max_epochs)), runs


def _taken(begun: Column, size: Column, cut: Column) -> Column:
    return F.greatest(F.lit(0), F.least(size, F.coalesce(cut, F.lit(0)) - begun)).cast("long")


def mix_documents(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix",
) -> DataFrame:
    """id, source, size, source_size, target, taken (words in the mix, repeats counted): one row for each row of docs."""
    placed, _, cuts, _ = _plan(docs, text_col=text_col, id_col=id_col, source_col=source_col, weights=weights, max_epochs=max_epochs, seed=seed)
    found = placed.join(cuts.withColumnRenamed("src", "_csrc"), F.col("_src").eqNullSafe(F.col("_csrc")), "left")
    chunks = found.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK)))).repartition("_src", "_nth", "_chunk")
    first = F.col("_chunk") * CHUNK
    each = chunks.withColumn("_copy", F.explode(F.sequence(first, F.least(F.col("_n"), first + CHUNK) - 1)))
    begun = F.col("_start") + F.col("_copy") * F.col("_size")
    passes = [_taken(begun + e * F.col("_source_size"), F.col("_size"), F.col("cut")) for e in range(max_epochs)]
    return each.select(
        F.col("_id").alias(id_col), F.col("_src").alias(source_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        reduce(lambda a, b: a + b, passes).alias("taken"),
    )


def weighted_fair_mix(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix",
) -> DataFrame:
    """The mix itself: occurrences with words in it, range-sorted by virtual finish time; a cut one keeps its first words,
    joined by one space.

    Returns the columns of docs, repeats as rows.  Texts are sorted twice, in the runs of their source and by time; rows equal
    in id, source and text lie in one run here.
    """
    cols, names = docs.columns, {"text_col": text_col, "id_col": id_col, "source_col": source_col, "seed": seed}
    _, sources, cuts, runs = _plan(docs, weights=weights, max_epochs=max_epochs, **names)
    placed = _placed(_keyed(docs, row=whole_row(docs), **names).withColumn("_n", F.lit(1).cast("long")), sources, runs)
    found = placed.join(cuts.withColumnRenamed("src", "_csrc"), F.col("_src").eqNullSafe(F.col("_csrc"))).withColumn("_epoch", F.explode(_epochs(max_epochs)))
    begun = F.col("_epoch") * F.col("_source_size") + F.col("_start")
    mixed = found.withColumn("_take", _taken(begun, F.col("_size"), F.col("cut"))).withColumn("_finish", (begun + F.col("_size")) / F.col("_target")).where("_take > 0")
    text = F.col("_row").getField(text_col)
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_RE), 0), F.lit(1), F.col("_take").cast("int")), " ")
    cut = F.when(F.col("_take") < F.col("_size"), first).otherwise(text)
    return mixed.orderBy("_finish", F.col("_src").asc_nulls_last(), "_nth", "_epoch").select(*unpacked(cols, **{text_col: cut}))
