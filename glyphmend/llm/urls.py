"""URL filter: rules by host and path, and link-graph propagation for all other urls.

DataFrame functions only.  Hosts are nodes; the absolute links in a page's html are edges from
its host, weighted by their share of the host's outgoing links.  Pages that a rule decides are the
seeds: allowed ones put trust on their host, blocked ones distrust.  Trust flows along the links by
personalised PageRank, distrust along the reversed links (who links to the blocked is distrusted),
both in one iteration over a table with a ``kind`` column.  A host is blocked if its distrust is
over ``threshold`` times its trust; a host that neither reaches is allowed.

Scale: link counts and seeds are summed per host before any shuffle of pages, so a host with a third
of all pages costs one partial row a task; the verdict join carries page ids only and is salted.
Iterations work on hosts; a host that most others link to is salted there, by the other end of its links.  Lineage
is cut by checkpoint().

Defined cases: null urls and urls without ``://`` have empty host and path, get no rule and are
allowed; null html has no links; very long urls and html are read whole; repeated pages count repeatedly; ties of
trust and distrust are allowed; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmend.llm.common import ascii_lower, checkpointed

HREF_RE = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""
DAMPING = 0.85
ITERATIONS = 8
THRESHOLD = 1.0
#: Copies of each host's verdict and scores, met by the salt of the pages and links.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the op5 contract.
CONTRACT_RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Index of the longest fitting rule, or null; rules of equal length: the first."""
    out = None
    for i, r in sorted(enumerate(rules), key=lambda x: (-len(x[1].name), x[0])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return F.lit(None).cast("int") if out is None else out


def _of_rule(index: Column, values: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(index == i, v).otherwise(out)
    return out


def parsed(pages: DataFrame, rules: tuple[Rule, ...], *, url_col: str = "url") -> DataFrame:
    """The columns of pages with _host, _path, _rule (index or null)."""
    return (
        pages.withColumn("_host", host_of(F.col(url_col)))
        .withColumn("_path", path_of(F.col(url_col)))
        .withColumn("_rule", rule_column(F.col("_host"), F.col("_path"), rules))
    )


def host_links(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """src, dst, share (of src's links) over links between different hosts, from parsed pages."""
    link = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF_RE), 1))
    raw = pages.where(F.col(html_col).rlike(HREF_RE)).select(F.col("_host").alias("src"), link.alias("link"))
    dst = ascii_lower(F.regexp_extract("link", r"^(?:[A-Za-z]+:)?//([^/?#]*)", 1))
    counts = raw.select("src", dst.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(F.col("src").alias("osrc")).agg(F.sum("n").alias("of"))
    return counts.join(out, F.col("src") == F.col("osrc")).select("src", "dst", (F.col("n") / F.col("of")).alias("share"))


def host_seeds(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """kind, host, mass: shares of all allowed and of all blocked pages, from parsed pages."""
    verdict = _of_rule(F.col("_rule"), [r.verdict for r in rules])
    kind = F.when(verdict == "allow", "trust").otherwise("distrust")
    counts = pages.where("_rule is not null and _host <> ''").groupBy(kind.alias("kind"), F.col("_host").alias("host")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(F.col("kind").alias("tkind")).agg(F.sum("n").alias("of"))
    return counts.join(totals, F.col("kind") == F.col("tkind")).select("kind", "host", (F.col("n") / F.col("of")).alias("mass"))


def propagate(seeds: DataFrame, links: DataFrame, *, damping: float = DAMPING, iterations: int = ITERATIONS, salts: int = SALTS) -> DataFrame:
    """kind, host, score: ``iterations`` rounds of score = (1 - damping) * seed + damping * what comes in."""
    back = links.join(links.groupBy(F.col("dst").alias("odst")).agg(F.sum("share").alias("of")), F.col("dst") == F.col("odst"))
    edges = checkpointed(
        links.select(F.lit("trust").alias("ekind"), F.col("src").alias("at"), F.col("dst").alias("to"), "share").unionByName(
            back.select(F.lit("distrust").alias("ekind"), F.col("dst").alias("at"), F.col("src").alias("to"), (F.col("share") / F.col("of")).alias("share"))
        ).withColumn("salt", F.pmod(F.xxhash64("to"), F.lit(salts)).cast("int"))
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    seeds = checkpointed(seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score")))
    if edges.isEmpty():
        return seeds
    scores = seeds
    for k in range(iterations):
        sent = scores.withColumn("ssalt", every).join(edges, (F.col("kind") == F.col("ekind")) & (F.col("host") == F.col("at")) & (F.col("ssalt") == F.col("salt"))).select(
            "kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")
        )
        scores = seeds.unionByName(sent).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % 4 == 3:
            scores = checkpointed(scores)
    return scores


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    damping: float = DAMPING, iterations: int = ITERATIONS, threshold: float = THRESHOLD, salts: int = SALTS,
) -> DataFrame:
    """id, host, path, rule (its host and path, or null), verdict, trust, distrust for each row of pages."""
    known = parsed(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")), rules, url_col="_url")
    links = host_links(known.select("_host", "_html"), html_col="_html")
    scores = propagate(host_seeds(known.select("_host", "_rule"), rules), links, damping=damping, iterations=iterations, salts=salts)
    by_host = (
        scores.groupBy(F.col("host").alias("_jhost"))
        .agg(
            F.round(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)), 12).alias("trust"),
            F.round(F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)), 12).alias("distrust"),
        )
        .withColumn("_jsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    asked = known.select("_id", "_host", "_path", "_rule").withColumn("_salt", F.pmod(F.xxhash64("_id", "_path"), F.lit(salts)).cast("int"))
    joined = asked.join(by_host, (F.col("_host") == F.col("_jhost")) & (F.col("_salt") == F.col("_jsalt")), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce(_of_rule(F.col("_rule"), [r.verdict for r in rules]), F.when(distrust > threshold * trust, "block").otherwise("allow"))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        _of_rule(F.col("_rule"), [r.name for r in rules]).alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"),
    )


def judge_sql(rules: tuple[Rule, ...], *, damping: float = DAMPING, iterations: int = ITERATIONS, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``judge_urls`` over the pages table."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ordered = sorted(enumerate(rules), key=lambda x: (-len(x[1].name), x[0]))
    fits = lambda r: f"((host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}'))"
    case = lambda f: "case " + " ".join(f"when {fits(r)} then '{f(r)}'" for _, r in ordered) + " end"
    rounds = ["s0 as (select kind, host, mass * {d} as score from seeds)".format(d=1 - damping)]
    for k in range(1, iterations + 1):
        rounds.append(
            f"s{k} as (select kind, host, sum(score) as score from (select kind, host, mass * {1 - damping} as score from seeds union all"
            f" select s.kind, e.dst, s.score * e.share * {damping} from s{k - 1} s join edges e on s.kind = e.kind and s.host = e.src) group by 1, 2)"
        )
    href = HREF_RE.replace("'", "''")
    return f"""
with parsed as (
  select page_id, html,
         coalesce({lower.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
known as (select *, {case(lambda r: r.name)} as rule, {case(lambda r: r.verdict)} as ruled from parsed),
raw as (select host as src, {lower.format("regexp_extract(link, '^(?:[A-Za-z]+:)?//([^/?#]*)', 1)")} as dst
        from (select host, unnest(regexp_extract_all(html, '{href}', 1)) as link from known)),
counts as (select src, dst, count(*) as n from raw where src <> dst and src <> '' and dst <> '' group by 1, 2),
shares as (select src, dst, n / sum(n) over (partition by src) as share from counts),
edges as (select 'trust' as kind, src, dst, share from shares union all
          select 'distrust', dst, src, share / sum(share) over (partition by dst) from shares),
seeded as (select case when ruled = 'allow' then 'trust' else 'distrust' end as kind, host, count(*) as n
           from known where ruled is not null and host <> '' group by 1, 2),
seeds as (select kind, host, n / sum(n) over (partition by kind) as mass from seeded),
{", ".join(rounds)},
judged as (select host,
                  round(sum(case when kind = 'trust' then score else 0 end), 12) as trust,
                  round(sum(case when kind = 'distrust' then score else 0 end), 12) as distrust
           from s{iterations} group by host)
select k.page_id, k.host, k.path, k.rule,
       coalesce(k.ruled, case when coalesce(j.distrust, 0) > {threshold} * coalesce(j.trust, 0) then 'block' else 'allow' end) as verdict,
       coalesce(j.trust, 0.0)::double as trust, coalesce(j.distrust, 0.0)::double as distrust
from known k left join judged j on j.host = k.host"""
