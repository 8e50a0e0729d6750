import bisect
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmend.llm import chunks, simhash
from glyphmend.llm.chunks import boundaries, dedup_substrings, runs
from glyphmend.llm import components as components_module
from glyphmend.llm.common import checkpointed
from glyphmend.llm.components import components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """Smallest key reachable over links of two bits or fewer; fps: {id: fingerprint}."""
    ids, root = sorted(fps), {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and root[b] > root[a]:
                    root[b], changed = root[a], True
    return root


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "A b c d É é", "x\x0by\x1cz w q " * 9, "wörter " * 50])
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_tree_meets_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = np.concatenate([base ^ np.uint64(1 << int(rng.integers(63))) ^ np.uint64(1 << int(rng.integers(63))) for _ in range(6)])
    fps = np.unique(np.concatenate([base, near, [np.uint64(0), np.uint64(3)]]))
    tree = simhash.Tree.fit(fps[::3], len(fps), shard=60)
    assert tree.shards > 4
    shards, places = tree.deal(fps)
    met = set()
    for s in range(tree.shards):
        a, b = simhash.local_links(np.sort(fps[places[shards == s]]), leaf=16)
        met |= set(zip(a.tolist(), b.tolist()))
    parent = {int(x): int(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in met:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    true = slow_components({int(x): int(x) for x in fps})
    assert {x: find(x) for x in parent} == true


def test_near_duplicates_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, shard=16).collect()}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == slow_components(fps)
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(slow_components(fps).values()))


def test_fingerprint_of_a_very_long_text(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(3 * 1000 + 5))
    whole = slow_fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 1000)
    assert simhash.fingerprint(text) == whole


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d", "x"), (2, "A b c  d", "y"), (2, "A b c  d", "y"), (None, "a b c d", "z"), (3, None, "u"), (4, "", None), (None, "q r s t u", "v"), (None, "q r s t u", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.component_id if r.component_id is not None else 99) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (99, 1), (99, 99), (99, 99)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 99) for r in kept.collect()) == [1, 3, 99]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    edges = spark.createDataFrame([*path, (100, 105), (105, 101), (200, 200)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100, 200: 200}
    assert components(edges.limit(0)).count() == 0


def test_components_of_few_edges_take_few_tasks(spark, monkeypatch):
    """Every shuffle of a round leaves files for each task, whatever the edges: few edges must not go through all partitions."""
    parts, settings = [], {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    monkeypatch.setattr(components_module, "checkpointed", lambda df: parts.append((out := checkpointed(df)).rdd.getNumPartitions()) or out)
    kept = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
        assert {r.root for r in components_module.components(edges).collect()} == {0}
        assert len(parts) > 2 and set(parts[1:]) == {1}
        monkeypatch.setattr(components_module, "EDGES", 20)
        parts.clear()
        assert {r.root for r in components_module.components(edges).collect()} == {0}
        assert set(parts[1:]) == {11}
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_boundaries_come_back_after_an_insertion():
    rng = random.Random(3)
    text = words(rng, 400).encode()
    a = boundaries(np.frombuffer(text, np.uint8))
    b = boundaries(np.frombuffer(b"inserted " + text, np.uint8)) - 9
    assert set(a[a > 8].tolist()) <= set(b.tolist())


def slow_runs(text):
    """(bytes, start, end) of every run by its definition, byte by byte."""
    raw, h, last, cuts = text.encode(), 0, -1, [0]
    blank = lambda b: b == 32 or 9 <= b <= 13
    for i in range(len(raw) - 1):
        h = (2 * h + int(chunks.GEAR[raw[i]])) % (1 << 16)
        last = i if blank(raw[i]) else last
        word = blank(raw[i]) and not blank(raw[i + 1]) and h % 256 < chunks.CUT
        inside = i - last > chunks.STRETCH and raw[i + 1] & 0xC0 != 0x80 and h % 256 < chunks.CUT_INSIDE
        if word or inside:
            cuts.append(i + 1)
    if raw:
        cuts.append(len(raw))
    out, starts = [], [m.start() for m in re.finditer(rb"[^ \t-\r]+", raw)]
    for i, a in enumerate(cuts):
        for z in cuts[i + 1 :]:
            if bisect.bisect_left(starts, z) - bisect.bisect_left(starts, a) >= chunks.MIN_WORDS or z - a >= chunks.MIN_BYTES:
                out.append((raw[a:z], a, z))
                break
    return out


def slow_cuts(rows):
    """{(id, text): the text without runs that an earlier place has}, in order of id (null last), text digest, position."""
    seen, out = {}, {}
    order = lambda r: (r[0] is None, r[0] or 0, chunk_hash(r[1]))
    for i, text in sorted({r for r in rows if r[1]}, key=order):
        raw, gone = text.encode(), set()
        for run, a, z in slow_runs(text):
            if seen.setdefault(run, (i, text, a)) != (i, text, a):
                gone.update(range(a, z))
        out[i, text] = bytes(b for k, b in enumerate(raw) if k not in gone).decode() if gone else text
    return out | {(i, t): t for i, t in rows if not t}


def chunk_hash(text):
    """The signed 64-bit digest by which texts of one id are ordered (Spark's xxhash64, seed 42)."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_substring_dedup_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(i + 100_000, t) for i, t in rows[:20]] + [(rows[5][0], rows[6][1] + " and more"), (None, rows[7][1]), (None, "x " + rows[8][1])]
    want = slow_cuts(rows)
    for parts in (3, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "text")
        out = dedup_substrings(docs, buckets=5).collect()
        assert sorted((str(r.doc_id), r.text or "") for r in out) == sorted((str(i), want[i, t] or "") for i, t in rows)


def test_repeated_passages_are_cut_once(spark):
    rng = random.Random(5)
    passages = [words(rng, 60) for _ in range(30)]
    rows = []
    for i in range(120):
        rows.append((i, f"{words(rng, 80)} {passages[i % 30]} {words(rng, 80)}" if i < 90 else words(rng, 150)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in dedup_substrings(docs).collect()}
    for i, text in rows:
        if i < 30 or i >= 90:
            assert out[i].text == text and out[i]._removed == 0
        else:
            assert out[i]._removed > 150, i
            assert out[i].text.split()[:60] == text.split()[:60] and out[i].text.split()[-60:] == text.split()[-60:]


def test_substring_dedup_odd_rows(spark):
    rng = random.Random(6)
    long, dense = words(rng, 300), "".join(rng.choice("漢字仮名交文章例日本語処理分割重複") for _ in range(600))
    rows = [(1, long, 1, "a"), (1, long, 1, "a"), (2, long, 2**60 + 1, "b"), (None, long, None, "c"), (3, None, 3, "d"), (4, "", 4, "e"), (5, "short", 5, "f"), (6, dense, 6, "g"), (7, dense, 7, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket long, _x string")
    out = dedup_substrings(docs)
    assert out.columns == [*docs.columns, "_removed", "_gone"]
    got = {(r._x, r.doc_id): r for r in out.collect()}
    assert out.count() == 9
    assert got["a", 1].text == long
    assert len(got["b", 2].text) < 150 and got["b", 2].bucket == 2**60 + 1
    assert len(got["c", None].text) < 150 and got["c", None].bucket is None
    assert got["d", 3].text is None and got["e", 4].text == "" and got["f", 5].text == "short"
    assert got["g", 6].text == dense and len(got["h", 7].text) < 200
    assert dedup_substrings(docs.limit(0)).count() == 0
    assert out.where(F.col("_removed") < 0).count() == 0


def test_repeats_within_one_document_are_cut(spark):
    rng = random.Random(8)
    passage, other = words(rng, 60), words(rng, 60)
    text = f"{other} {passage} {words(rng, 80)} {passage} {words(rng, 40)}"
    rows = [(1, text), (1, text), (2, words(rng, 300)), (3, f"{words(rng, 20)} {passage} {words(rng, 20)}")]
    out = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in out:
        if r.doc_id == 1:
            assert r._removed > 150 and r.text.split()[:120] == text.split()[:120] and r.text.split()[-40:] == text.split()[-40:]
            assert all(g.start >= len(f"{other} {passage}") for g in r._gone)
        else:
            assert (r._removed > 150) == (r.doc_id == 3)


def test_passages_of_over_50_words_hold_a_run():
    rng, missed = random.Random(9), 0
    for _ in range(2500):
        passage = words(rng, 51)
        found = [set(runs(f"{words(rng, 30)} {passage} {words(rng, 30)}".encode())[0].tolist()) for _ in range(2)]
        missed += not found[0] & found[1]
    assert missed <= 4


def test_long_runs_are_cut_whole_wherever_their_rows_are(spark):
    rows = [(1, "a" * 80_000), (2, "é" * 40_000), (3, "a" * 80_000), (4, "é" * 40_000), (5, "a" * 80_000)]
    for parts in (1, 5):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        assert {r.doc_id: len(r.text) for r in dedup_substrings(docs).collect()} == {1: 80_000, 2: 40_000, 3: 0, 4: 0, 5: 0}
