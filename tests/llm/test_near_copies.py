import random

import numpy as np

import corpus_pipeline
from glyphmend.llm import near_copies as near
from glyphmend.llm.near_copies import near_copies, rarest
from glyphmend.llm.simhash import Tree


def slow_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(texts):
    """{id: smallest id reachable over pairs of similarity 0.8 or more}."""
    sets, root = {i: slow_shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def replaced(rng, text, k):
    words = text.split()
    for i in rng.sample(range(len(words)), k):
        words[i] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_stage_finds_the_near_copies_of_the_rule(spark):
    rng = random.Random(11)
    texts = {}
    for g, (n, k) in enumerate([(100, 1), (300, 3), (1000, 5), (100, 2), (300, 5), (1000, 20), (100, 12), (300, 40)] * 3):
        texts[10 * g] = " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
        for c in range(1, 4):
            texts[10 * g + c] = replaced(rng, texts[10 * g], k)
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    true = slow_groups(texts)
    assert len(set(true.values())) < 60
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == true
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == sorted(set(true.values()))


def test_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    true = slow_groups({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == true


def test_stage_odd_rows(spark):
    rows = [(1, "a b c d", "x"), (2, "A b c  d", "y"), (2, "A b c  d", "y"), (None, "a b c d", "z"), (3, None, "u"), (4, "", None), (None, "q r s t u", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted((r.doc_id or 99, r.component_id or 99) for r in near_copies(docs).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (99, 1), (99, 99)]
    assert near_copies(docs.limit(0)).count() == 0


def test_texts_on_one_template_are_not_paired(spark):
    """Texts that share a third to nine tenths of their words with a template: links as by brute force, few of them compared."""
    rng = random.Random(12)
    template = [f"t{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        k = (40, 60, 80, 108)[i % 4]
        texts[i] = " ".join(template[:k] + [f"n{rng.randrange(10**9)}" for _ in range(120 - k)])
    texts |= {1000 + i: texts[i] + " again" for i in range(0, 150, 10)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    true = slow_groups(texts)
    for paired in (4, 64):
        assert {r.doc_id: r.component_id for r in near_copies(docs, paired=paired).collect()} == true
    rows = spark.createDataFrame(list(texts.items()), "node long, text string")
    first = rarest(rows).groupBy("shingle").count().agg({"count": "max"}).first()[0]
    assert first <= 60, "the template's own shingles are in no prefix but those of texts that are nearly all template"


def dense_group(rng, n):
    """A group of near copies that are 0.6 to 0.95 similar to each other, and as many texts of their own."""
    base = [f"b{i}" for i in range(120)]
    texts = {i: " ".join(f"n{rng.randrange(10**9)}" if rng.random() < (i % 5) / 100 else w for w in base) for i in range(n)}
    return texts | {n + i: " ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for i in range(n)}


def test_candidates_come_from_the_trees(spark):
    """Trees and shards join just the texts that one fingerprint and the other bits bring near, as by comparing all with all."""
    texts = dense_group(random.Random(13), 300)
    signed = np.array([near.signature(near.shingles(t)) for t in texts.values()])
    apart = np.bitwise_count(signed["tree"][:, None] ^ signed["tree"][None]).min(axis=2)
    checked = np.bitwise_count(signed["checked"][:, None] ^ signed["checked"][None]).sum(axis=2)
    true, links = np.arange(len(texts)), np.argwhere((apart <= near.RADIUS) & (checked <= near.APART))
    near._union(true, links[:, 0], links[:, 1])
    true = [near._find(true, i) for i in range(len(texts))]
    distinct = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in zip(texts, signed)], "fp long, signature binary")
    for shard in (40, 1 << 17):
        root = np.arange(len(texts))
        found = near.candidate_links(distinct, shard=shard).collect()
        assert len(found) <= near.TREES * 40 * len(texts), "one link a text in a shard"
        near._union(root, np.array([r.a for r in found]), np.array([r.b for r in found]))
        assert [near._find(root, i) for i in range(len(texts))] == true
    tree = Tree.fit(np.ascontiguousarray(signed["tree"][:, 0]), len(texts), radius=near.RADIUS, shard=40)
    assert tree.shards > 4 and len(tree.deal(signed["tree"][:, 0], near.RADIUS)[1]) > len(texts), "shards overlap"


def test_fingerprints_are_near_for_what_is_similar():
    rng, lost, far = random.Random(14), 0, 0
    for _ in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((9, 40, 98)))]
        other = words[:-1] if len(words) == 9 else replaced(rng, " ".join(words), 0).split()
        if len(words) > 9:
            other[rng.randrange(4, len(words) - 4)] = "x"
            other[0] = "y" if len(words) == 98 else other[0]
        a, b = (near.shingles(" ".join(w)) for w in (words, other))
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            x, y = near.signature(a), near.signature(b)
            lost += np.bitwise_count(x["tree"] ^ y["tree"]).min() > near.RADIUS or np.bitwise_count(x["checked"] ^ y["checked"]).sum() > near.APART
            far += 1
    assert far > 700 and lost <= 3
