"""The registered opN_<name> queries: thin contracts over the operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmend.llm import toxicity
from glyphmend.llm.chunks import dedup_substrings
from glyphmend.llm.common import table
from glyphmend.llm.extract import extract_main_text
from glyphmend.llm.kmeans_tree import approximate_neighbours
from glyphmend.llm.mixing import MAX_EPOCHS, WEIGHTS, mix_documents
from glyphmend.llm.packing import pack_documents
from glyphmend.llm.pivots import exact_top_k
from glyphmend.llm.sharding import minimax_shards
from glyphmend.llm.simhash import near_duplicates
from glyphmend.llm.urls import CONTRACT_RULES, judge_sql, judge_urls

SHARDS = 24


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


#: Products are doubles here, exact below 2**53; beyond, the tests hold the operator against whole numbers.
OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e) as product
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by product desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, case when product >= 9223372036854775807 then 9223372036854775807 when product <= -9223372036854775808 then -9223372036854775808 else product::bigint end as score
from ranked where rank <= 5"""


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_neighbours(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key
  from documents),
rows_ as (select doc_id, source, size, key, count(*) as n from sized group by all),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select source, source_size, [{", ".join(f"{w}.0" for w in WEIGHTS)}][((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int] ::double as w,
         ({MAX_EPOCHS} * source_size)::double as cap, sum(source_size) over ()::double as total
  from sources),
leveled as (
  select *, (total - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level
  from weighed),
capped as (select *, cap <= level * w as is_capped from leveled),
targets as (
  select source, source_size,
         case when is_capped then cap else w * max(case when not is_capped then level end) over () end as target
  from capped),
placed as (
  select s.doc_id, s.source, s.size, s.n, t.source_size, t.target,
         sum(s.size * s.n) over (partition by s.source order by s.key, s.doc_id, s.size rows between unbounded preceding and current row) - s.size * s.n as start
  from rows_ s join targets t on s.source is not distinct from t.source),
occurrences as (
  select source, target, epoch * source_size + start as begun, size * n as words
  from (select *, unnest(range(least({MAX_EPOCHS}, greatest(1, ceil(target / source_size)))::bigint)) as epoch from placed where target > 0 and size > 0)),
split as (
  select *, (begun + words) / target as finish, case when begun < target and begun + words > target then floor(target - begun + 1e-6) else words end as first
  from occurrences),
packets as (
  select source, begun, first as words, case when first < words then 1.0 else finish end as finish from split
  union all select source, begun + first, words - first, finish from split where first < words),
ranged as (
  select *, sum(words) over (order by finish, source nulls last, begun, words rows between unbounded preceding and current row) - words as before from packets),
cuts as (
  select source, sum(greatest(0, least(words, (select sum(source_size) from sources) - before))) as cut from ranged group by source),
copies as (
  select p.*, coalesce(c.cut, 0) as cut, unnest(range(n)) as copy from placed p left join cuts c on c.source is not distinct from p.source)
select doc_id, source, size, source_size, target,
       ({" + ".join(f"greatest(0, least(size, cut - ({e} * source_size + start + copy * size)))" for e in range(MAX_EPOCHS))})::bigint as taken
from copies"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), CONTRACT_RULES)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the text without passages that an earlier place has, and what was cut."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_removed").alias("removed_chars"), F.col("_gone").alias("removed_spans"))


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer or default_tokenizer())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


FOLDS = 5


def fold(c: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id")) != 0)
    scored = toxicity.score_texts(docs, *toxicity.train(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minimax_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_top_k": op1_exact_top_k,
        "op2_neighbours": op2_neighbours,
        "op3_mixing": op3_mixing,
        "op4_simhash": op4_simhash,
        "op5_url_filter": op5_url_filter,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_packing": op7_packing,
        "op8_html_extraction": op8_html_extraction,
        "op9_toxicity": op9_toxicity,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": OP1_SQL, "op3_mixing": OP3_SQL, "op5_url_filter": judge_sql(CONTRACT_RULES)}
