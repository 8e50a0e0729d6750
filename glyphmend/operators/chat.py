"""Chat exports: messages of one author as clean lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmend.functions.letters import strip_diacritics
from glyphmend.functions.sentences import collapse

# What begins a message, and what an export writes in place of one.
HEADER = r"^\x{200e}?\[?\d{1,4}[./-]\d{1,2}[./-]\d{1,4},?\s\d{1,2}:\d{2}(?::\d{2})?(?:[\s\x{202f}]?[APap]\.?[Mm]\.?)?(?:\]\s|\s-\s)"
LINK = r"(?i)https?://|www\.|\S+@\S+\.\w+"
DIGITS = r"\d[\d\s()+-]{5,}\d"
DELETED = ("this message was deleted", "you deleted this message", "null")
EDITED = "<This message was edited>"
LEAST_WORDS, MOST_CHARACTERS = 3, 250


def whatsapp_messages(lines: DataFrame, *, line_col: str = "line", pos_col: str = "pos", file_col: str = "file") -> DataFrame:
    """file, pos, author, text: a header begins a message, other lines continue it; notices have no author and go."""
    head = F.col(line_col).rlike(HEADER)
    upto = Window.partitionBy(file_col).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_head", head).withColumn("_nth", F.sum(F.col("_head").cast("int")).over(upto)).where(F.col("_head") | F.col(line_col).rlike(r"\S"))
    body = F.when(F.col("_head"), F.regexp_replace(F.col(line_col), HEADER, "")).otherwise(F.col(line_col))
    parts = rows.where("_nth > 0").groupBy(file_col, "_nth").agg(F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("p"), body.alias("b")))).alias("x"))
    first = F.col("x")[0]["b"]
    author, text = F.trim(F.regexp_extract(first, r"^([^:]+?):\s(.*)$", 1)), F.regexp_extract(first, r"^([^:]+?):\s(.*)$", 2)
    rest = F.transform(F.expr("slice(x, 2, size(x))"), lambda y: y["b"])
    whole = F.array_join(F.concat(F.array(text), rest), " ")
    return parts.where(first.rlike(r"^[^:]+?:\s")).select(file_col, F.col("x")[0]["p"].alias(pos_col), author.alias("author"), whole.alias("text"))


def telegram_messages(exports: DataFrame, *, json_col: str = "json") -> DataFrame:
    """pos, author, text of an export's own messages; the JSON type says whether a text is a string or a list of parts."""
    rows = exports.select(F.variant_get(F.try_parse_json(F.col(json_col)), "$.messages", "array<variant>").alias("ms")).select(F.posexplode("ms").alias("pos", "m"))
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    whole = F.try_variant_get("m", "$.text", "variant")
    part = lambda p: F.coalesce(F.when(F.schema_of_variant(p) == "STRING", get(p, "$")).otherwise(get(p, "$.text")), F.lit(""))
    parts = F.array_join(F.transform(F.try_variant_get(whole, "$", "array<variant>"), part), "")
    text = F.when(F.schema_of_variant(whole).startswith("ARRAY"), parts).otherwise(F.coalesce(get("m", "$.text"), F.lit("")))
    own = (get("m", "$.type") == "message") & get("m", "$.forwarded_from").isNull()
    return rows.where(own).select("pos", F.coalesce(get("m", "$.from"), F.lit("")).alias("author"), text.alias("text"))


def usable(text: Column) -> Column:
    """One line of plain text, or null: notices, links, long numbers, texts too short or too long, or without a letter that could carry a mark."""
    line = collapse(F.translate(text, "‎‏", "  "))
    line = F.trim(F.when(line.endswith(EDITED), line.substr(F.lit(1), F.length(line) - len(EDITED))).otherwise(line))
    low = F.lower(line)
    bad = (
        text.startswith("‎") | (low.startswith("<") & low.endswith(">")) | low.endswith(" omitted") | low.isin(*DELETED) | low.contains("attached:")
        | line.rlike(LINK) | line.rlike(DIGITS) | (F.size(F.split(line, " ")) < LEAST_WORDS) | (F.length(line) > MOST_CHARACTERS) | ~F.lower(strip_diacritics(line)).rlike("[cegiosu]")
    )
    return F.when(~bad, line)


def author_histogram(messages: DataFrame) -> DataFrame:
    return messages.groupBy("author").agg(F.count(F.lit(1)).alias("n"))


def kept_lines(messages: DataFrame, existing: DataFrame | None = None, *, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """text and its first place: clean, each once, none that exists already."""
    rows = messages.withColumn("text", usable(F.col("text"))).where("text is not null").groupBy("text").agg(F.min(F.struct(*order)).alias("first_seen"))
    return rows if existing is None else rows.join(existing.select("text"), "text", "left_anti")


def sample(lines: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """A reproducible sample: the first by order of a hash."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("text")))
    return lines.orderBy(key, "text").limit(count)
