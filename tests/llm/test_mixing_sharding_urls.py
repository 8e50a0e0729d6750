import itertools
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphmend.llm import queries as Q
from glyphmend.llm import mixing
from glyphmend.llm.mixing import mix_documents, weighted_fair_mix
from glyphmend.llm.sharding import minimax_shards
from glyphmend.llm.urls import CONTRACT_RULES, judge_urls


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Shares by weight, capped at three times a source's size, the excess reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        now = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if now[s] > 3 * sizes[s]}
        if not over:
            return out | now
        for s in over:
            out[s] = 3.0 * sizes[s]
        free -= over


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "abcdefg"[min(i % 20, 6)], i) for i in range(300)]
    rows += [(400, None, "a", 1), (401, "", None, 2), (402, "x y\tz", None, 3), (None, "p q", "g", 4), (5, " ".join(["w"] * 36), "f", 5), (5, " ".join(["w"] * 36), "f", 5), (403, "only", "z", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _src long")


def check_mix(rows, documents):
    """Sizes, targets and taken words of mix_documents rows against the shares by definition."""
    sizes, taken, shares = {}, {}, {}
    for r in rows:
        sizes[r.source], taken[r.source] = sizes.get(r.source, 0) + r.size, taken.get(r.source, 0) + r.taken
        shares.setdefault(r.source, set()).add((r.source_size, r.target))
        assert 0 <= r.taken <= 3 * r.size
    want = targets(sizes)
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((r.doc_id or -1, count(r.text)) for r in documents.collect())
    assert sum(taken.values()) == sum(sizes.values()), "the budget"
    for s in sizes:
        # The closed form: each source is cut at its target; whole words of all sources are left over.
        assert abs(taken[s] - want[s]) < len(sizes) + 1e-6
        assert len(shares[s]) == 1 and all(n == sizes[s] and abs(t - want[s]) < 1e-6 for n, t in shares[s])


def test_mixing_reaches_its_targets(documents):
    check_mix(mix_documents(documents).collect(), documents)


def test_mix_against_a_queue(spark, documents, monkeypatch):
    """Sources and words one by one: the packet of the least finish time is served next, until the budget is spent."""
    monkeypatch.setattr(mixing, "RUN_ROWS", 16)
    placed, _, cuts, _ = mixing._plan(documents, text_col="text", id_col="doc_id", source_col="source", weights=(5, 2, 1), max_epochs=3, seed="mix")
    rows = sorted(mixing.packets(placed).collect(), key=lambda p: (p.finish, p.src is None, p.src or "", p.begun, p.words))
    left, served = sum(count(r.text) for r in documents.collect()), {}
    for p in rows:
        served[p.src] = served.get(p.src, 0) + min(left, p.words)
        left -= min(left, p.words)
    assert left == 0 and {r.src: r.cut for r in cuts.collect()} == served


def test_mixing_one_row_or_id_in_a_third_of_the_table(spark, documents):
    same, shared = [(77, "the same row each time", "a", 0)] * 6000, [(None, f"words of text {i}", "b", i) for i in range(3000)]
    long = [(9000, "w " * 200_000, "c", 0), (9001, "w\u00a0x " * 3000, "d", 0)]
    docs = documents.unionByName(spark.createDataFrame(same + shared + long, documents.schema))
    rows = mix_documents(docs).collect()
    check_mix(rows, docs)
    key = lambda r: (r.doc_id or -1, r.source or "", r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, mix_documents(docs.repartition(9)).collect()))


def test_mix_repeats_rows_and_is_stable(documents):
    mixed = weighted_fair_mix(documents)
    assert mixed.columns == documents.columns
    first, again = mixed.collect(), weighted_fair_mix(documents.repartition(5)).collect()
    assert first == again
    rows = mix_documents(documents).collect()
    words = {}
    for r in rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.taken
    for r in first:
        words[r.doc_id] -= count(r.text)
    assert not any(words.values())
    assert weighted_fair_mix(documents.limit(0)).count() == 0 and mix_documents(documents.limit(0)).count() == 0


def minimax(sizes, shards):
    """Least capacity over all contiguous partitions."""
    best = {(0, 0): 0}
    sums = [0, *itertools.accumulate(sizes)]
    for k in range(1, shards + 1):
        for j in range(len(sizes) + 1):
            best[k, j] = min((max(best[k - 1, i], sums[j] - sums[i]) for i in range(j + 1) if (k - 1, i) in best), default=0)
    return best[shards, len(sizes)]


@pytest.mark.parametrize("shards", [1, 3, 7, 24])
def test_shards_are_minimax(spark, sf, shards):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + i, "copy " * 300) for i in range(60)] + [(2000, None), (2001, ""), (None, None), (7, "same"), (7, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minimax_shards(docs, shards, segments=64).collect()
    assert sorted((r.doc_id or 0, r.size) for r in out) == sorted((i or 0, len((t or "").encode()) + 8) for i, t in rows)
    by_shard, groups = {}, {}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    for r in out:
        by_shard.setdefault(r.shard, []).append(r)
        groups.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        assert r.text_crc32 in {zlib.crc32((t or "").encode()) for t in texts[r.doc_id]}
    for rs in by_shard.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    assert all(len(s) == 1 for (crc, size), s in groups.items() if size > 8)
    keys = {}
    import hashlib

    for _, t in rows:
        keys.setdefault("0" * 32 if t is None else hashlib.md5(t.encode()).hexdigest(), []).append(len((t or "").encode()) + 8)
    sizes = [sum(keys[k]) for k in sorted(keys)]
    assert max(sum(r.size for r in rs) for rs in by_shard.values()) == minimax(sizes, shards)
    assert minimax_shards(docs.limit(0), shards).count() == 0


PAGES = [
    (1, "http://A.Example.com/en/7x?q", '<a href="http://bad.org/">x</a>'),
    (2, "https://bad.org/es/1", "<a href='https://worse.org/x'>y</a>"),
    (3, "https://friend.org/x", "<a href=//bad.org/es/>y</a><a href='/own'>z</a>"),
    (4, "http://example.net/de/81", None),
    (5, "http://notnet/de/8", ""),
    (6, None, "<a href='http://bad.org'>x</a>"),
    (7, "no scheme", "x"),
    (8, "http://worse.org", ""),
    (9, "http://x.com/en/9#f", ""),
    (9, "http://x.com/en/9#f", ""),
]


def test_urls_against_sql(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.trust, r.distrust) for r in judge_urls(pages, CONTRACT_RULES).collect())
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(tuple(r) for r in con.execute(Q.oracle_sql()["op5_url_filter"]).fetchall())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[k] - w[k]) < 1e-9 for g, w in zip(got, want) for k in (5, 6))
    found = {g[0]: g[1:5] for g in got}
    assert found[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert found[4] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert found[5] == ("notnet", "/de/8", None, "allow")
    assert found[6] == ("", "", None, "allow") and found[7] == ("", "", None, "allow")
    assert found[3] == ("friend.org", "/x", None, "block"), "it links to a blocked host"
    assert judge_urls(pages.limit(0), CONTRACT_RULES).count() == 0


@pytest.mark.parametrize("share", [2 / 24, 1 / 3])
def test_shards_are_near_equal_beside_a_large_group(spark, share):
    texts = [f"{i} " + "x" * 90 for i in range(4800)]
    copies = int(share / (1 - share) * len(texts))
    docs = spark.createDataFrame(list(enumerate(texts + ["y" * 95] * copies)), "doc_id long, text string")
    sizes = {r.shard: r.s for r in minimax_shards(docs, 24, segments=64).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    rest = sorted(sizes.values())[:-1]
    assert len(sizes) == 24
    assert rest[-1] <= 1.1 * sum(rest) / 23 and rest[0] >= 0.5 * sum(rest) / 23


def test_shards_of_one_row_in_a_third_of_the_table(spark):
    rows = [(i, f"text {i}", "b", 0) for i in range(600)] + [(7, "the same row", "s", 1)] * 9000 + [(None, "w " * 100_000, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, slot long")
    out = minimax_shards(docs, 24, sub_rows=50).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in out) == sorted((-1 if i is None else i, len(t) + 8) for i, t, _, _ in rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in out if r.doc_id == 7 and r.size == 20}) == 1


def test_a_host_that_all_link_to(spark):
    rows = [(i, f"http://h{i}.org/x", "<a href='http://hub.org/'>x</a><a href='http://example.net/'>y</a>", i, "s") for i in range(300)]
    rows += [(1000, "http://hub.org/es/1", "<a href='http://h3.org/'>x</a>", 1, "s"), (1001, "http://example.net/de/1", None, 2, "t"), (1002, "http://x.org/" + "y" * 100_000, "z" * 200_000, 3, "u")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long, salt string")
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toPandas())
    want = sorted(tuple(r) for r in con.execute(Q.oracle_sql()["op5_url_filter"]).fetchall())
    for salts in (1, 16):
        got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.trust, r.distrust) for r in judge_urls(pages, CONTRACT_RULES, salts=salts).collect())
        assert [g[:5] for g in got] == [w[:5] for w in want] and all(abs(g[k] - w[k]) < 1e-9 for g, w in zip(got, want) for k in (5, 6))
