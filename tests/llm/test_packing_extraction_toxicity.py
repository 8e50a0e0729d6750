import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphmend.llm import extract, toxicity
from glyphmend.llm.extract import extract_main_text, main_text
from glyphmend.llm.packing import Bins, _tokenise, coder, pack, pack_documents
from glyphmend.llm.queries import default_tokenizer


@pytest.fixture(scope="module")
def bpe():
    return coder(default_tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abzéÀß'st re.,!19 \t\n…<|ſK", max_size=60) | st.just("a <|endoftext|> b"))
def test_word_bpe_equals_the_tokenizer(text):
    bpe = coder(default_tokenizer())
    assert np.frombuffer(bpe.encode_many([text])[0], "<u4").tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_bpe_on_documents(spark, bpe):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [e.ids for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_many(texts)] == want
    assert bpe.encode_many([None, "", " "]) == [b"", b"", b""]


def first_fit(sizes, room):
    bins, out = [], []
    for s in sizes:
        for i, free in enumerate(bins):
            if free >= s:
                break
        else:
            i = len(bins)
            bins.append(room)
        bins[i] -= s
        out.append(i)
    return out


def test_tournament_tree_is_first_fit():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    tree = Bins(len(sizes), 100)
    assert [tree.first_fit(s) for s in sizes] == first_fit(sizes, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_pack_places_every_token_once(sizes):
    pieces = pack(sizes, 64, 4)
    for i, n in enumerate(sizes):
        own = sorted((a, m) for d, a, m, _, _ in pieces if d == i)
        assert sum(m for _, m in own) == n and all(a + m == b for (a, m), (b, _) in zip(own, own[1:])) and own[0][0] == 0
    held = {}
    for _, _, m, s, o in sorted(pieces, key=lambda p: p[3:]):
        assert held.get(s, 0) == o
        held[s] = o + m
    assert sorted(held) == list(range(len(held)))
    assert all(n <= 64 and (n >= 60 or n & (n - 1) == 0) for n in held.values())


def test_packed_documents_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "again"), (9003, "again"), (None, "no id")], "doc_id long, text string"))
    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = pack_documents(docs, default_tokenizer(), group_docs=64, keep_ids=True).collect()
    held, ids = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        ids.setdefault(r.doc_id, {}).setdefault(r.start, []).append(np.frombuffer(r.ids, "<u4").tolist())
        held.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
    for seq in held.values():
        seq.sort()
        assert [o for o, _, _ in seq] == [0, *np.cumsum([n for _, n, _ in seq])[:-1].tolist()]
        used, length = sum(n for _, n, _ in seq), seq[0][2]
        assert used <= length <= 2048 and (length == 2048 or used == length and used & (used - 1) == 0)
    for r in docs.collect():
        if r.doc_id != 9003:
            got = [x for a in sorted(ids[r.doc_id]) for x in ids[r.doc_id][a][0]]
            assert got == tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
    assert len(ids[9003][0]) == 2
    total = sum(n for s in held.values() for _, n, _ in s)
    assert sum(s[0][2] for s in held.values()) <= 1.01 * total
    assert pack_documents(docs.limit(0), default_tokenizer()).count() == 0


ARTICLE = "Some words that make a paragraph of the article, long enough to be dense."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just &amp; text\n here", "just & text here"),
        (f"<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p><b>{ARTICLE}<br><p>Two&nbsp;x</p></article><footer>&copy; f</footer>", f"T\n\n{ARTICLE}\n\nTwo x"),
        (f"<body><div class='site-header'>logo</div><div id=content><p>{ARTICLE}</p><p>{ARTICLE}</p></div><div class='comments'><p>{ARTICLE} {ARTICLE} {ARTICLE}</p></div>", f"{ARTICLE}\n\n{ARTICLE}"),
        (f"<article><h1>A</h1><section><p>{ARTICLE}</p><p>{ARTICLE}</p></section><section><p>{ARTICLE}</p></section><form>f</form><script>if (a<b) c('</p>')</script></article>", f"A\n\n{ARTICLE}\n\n{ARTICLE}\n\n{ARTICLE}"),
        (f"<body><ul><li><a href=a>one</a><li><a href=b>two</a></ul><div><p>{ARTICLE}</p><ul><li>x<li>y</ul></div>", f"{ARTICLE}\n\nx\n\ny"),
        ("<article><p>" + "<i>" * 5000 + "deep" + "</i>" * 5000 + "</p></article>", "deep"),
        ("<article><p>cut &am", "cut &am"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


LONG = "".join(f"<p>Paragraph {i} of a long article with words enough to be the main text of its page, and some more.</p>" for i in range(8))
AROUND = "<html><body><nav><ul>" + "".join(f"<li><a href=/{i}>Menu {i}</a>" for i in range(8)) + "</ul></nav>%s<footer>Copyright of the site.</footer></body></html>"


@pytest.mark.parametrize(
    ("wrapper", "blocks", "first"),
    [
        ("<div class='content no-sidebar'>%s</div>", 8, "Paragraph 0"),
        ("<div class=has-banner>%s</div>", 8, "Paragraph 0"),
        ("<section class=search-engines>%s</section>", 8, "Paragraph 0"),
        ("<form id=aspnet><div>%s</div></form>", 8, "Paragraph 0"),
        ("<article><header><h1>Title</h1></header>%s</article>", 9, "Title"),
        ("<article><h1>Title</h1><div class=body>%s</div><div class=comments><p>I liked this one a lot, thanks.</p></div></article>", 9, "Title"),
        ("<main><article><h1>Title</h1>%s</article><article><h2>Teaser</h2><p>A teaser of another story stands here.</p></article></main>", 9, "Title"),
        ("<article><section><h2>One</h2>%s</section><section><h2>Two</h2><p>The second part has text too, some of it rather long.</p></section></article>", 11, "One"),
        ("<article>%s<div class=ad>Buy this now, it is cheap.</div><aside>Read more here.</aside></article>", 8, "Paragraph 0"),
    ],
)
def test_furniture_words_drop_no_article(wrapper, blocks, first):
    found = main_text(AROUND % (wrapper % LONG)).split("\n\n")
    assert len(found) == blocks and found[0].startswith(first)
    assert not any("Copyright" in b or "Menu" in b or "eas" in b.split() for b in found)


def densities(node, share):
    """Composite densities by their definition, over nested (tag, children) tuples: (tag, characters, density) from the root on."""
    tag, children = node
    parts = [densities(c, share) for c in children if not isinstance(c, str)]
    direct = [p[0] for p in parts]
    chars = sum(len(c.replace(" ", "")) for c in children if isinstance(c, str)) + sum(p["chars"] for p in direct)
    tags = sum(p["tags"] + 1 for p in direct)
    links = chars if tag == "a" else sum(p["links"] for p in direct)
    link_tags = sum(p["link_tags"] + (p["tag"] == "a") for p in direct)
    own = {"tag": tag, "chars": chars, "tags": tags, "links": links, "link_tags": link_tags, "density": 0.0}
    if chars:
        base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
        ratio = chars / max(1, links) * max(1, tags) / max(1, link_tags)
        own["density"] = chars / max(1, tags) * max(0.0, math.log(ratio) / (math.log(base) if base > 1 + 1e-9 else 1.0))
    return [own] + [x for p in parts for x in p]


def test_densities_by_their_definition():
    tree = ("body", [("ul", [("li", [("a", ["one two"])]), ("li", [("a", ["three"])])]), ("div", [("p", ["Some text with ", ("a", ["a link"]), " in it and more."]), ("p", ["Another paragraph stands here."])])])
    def html(node):
        return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(html, node[1])) + f"</{node[0]}>"
    builder = extract._Builder()
    builder.feed(html(tree))
    body = builder.root.children[0]
    nodes = extract._preorder(body)
    extract._measure(nodes)
    total = densities(tree, 0.0)[0]
    want = densities(tree, total["links"] / total["chars"])
    assert [n.tag for n in nodes] == [w["tag"] for w in want]
    assert all(n.chars == w["chars"] and abs(n.density - w["density"]) < 1e-6 for n, w in zip(nodes, want))
    assert [n.tag for n in extract._main(nodes)] == ["div"]


def test_very_long_page():
    assert len(main_text("<article><h1>T</h1>" + "<p>word after word in a long page</p>" * 50000 + "</article>").split("\n\n")) == 50001


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b</p>", 2**60 + 1), (1, "u", "<p>a b</p>", None), (None, None, None, 3)], "page_id long, url string, html string, text long")
    out = extract_main_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, "", 0), (1, "a b", 3), (1, "a b", 3)]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_slots_do_not_depend_on_pieces(monkeypatch):
    place = np.empty(toxicity.SLOTS, dtype=np.int32)
    text = "Some  Text with ÜMLAUTS and 漢字 " * 40
    whole = toxicity.slots_of(text, place).tolist()
    assert len(set(whole)) == len(whole)
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert sorted(toxicity.slots_of(text, place).tolist()) == sorted(whole)
    assert toxicity.slots_of(None, place).tolist() == [] == toxicity.slots_of("", place).tolist()


def test_toxicity_on_held_out_rows(spark):
    from glyphmend.llm.queries import op9_toxicity

    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op9_toxicity(spark, d).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(t, got[i].predicted) for i, t in labels if got[i].held_out]
    # Junk documents of this table are labelled toxic without a toxic word in them.
    assert sum(p for t, p in held if t) >= 0.8 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.01 * sum(1 - t for t, _ in held)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i}" + " you idiot" * (i % 2), 2**60 + 1) for i in range(40)] + [(None, None, None), (99, "", 1)], "doc_id long, text string, _score long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (3, 1), (99, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score_texts(docs, *model, keep=["doc_id", "text"]).collect()
    assert len(out) == 42
    assert all((r._score >= 0.5) == bool(r.doc_id % 2) for r in out if r.doc_id is not None and r.doc_id < 40)
    none = toxicity.train(docs, labels.limit(0))
    assert {r._score < 1e-9 for r in toxicity.score_texts(docs, *none, keep=["doc_id"]).collect()} == {True}
    assert toxicity.score_texts(docs.limit(0), *model, keep=["doc_id"]).count() == 0


def two_classes(rows, words):
    """Texts of words of two vocabularies, by turns, and their classes."""
    rng = np.random.default_rng(7)
    names = ["".join(x) for x in rng.choice(list("abcdefghijklmnop"), (2, 300, 6)).reshape(600, 6)]
    toxic = np.arange(rows) % 2
    return [" ".join(names[i] for i in 300 * y + rng.integers(0, 300, words)) for y in toxic], toxic


def test_fit_takes_little_memory_beside_its_places():
    texts, toxic = two_classes(2000, 500)
    tracemalloc.start()
    weights, _ = toxicity.fit(texts, toxic, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    place = np.empty(toxicity.SLOTS, dtype=np.int32)
    held = sum(np.count_nonzero(weights[toxicity.slots_of(t, place)]) for t in texts)
    # Counts, worths and scratch by slot; 16 bits a place in pieces and in a row; blocks.
    assert held > 4_000_000 and peak < 80 * toxicity.SLOTS + 4 * held + 32 * toxicity.BLOCK


def test_fit_in_tasks_is_fit_in_one(spark):
    texts, toxic = two_classes(300, 150)
    texts[:4] = [None, "", texts[2] * 300, texts[3] * 300]
    rows = [(i, t, int(y)) for i, (t, y) in enumerate(zip(texts, toxic))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(7)
    weights, b = toxicity.train(docs, docs.select("doc_id", "toxic"), keep=900)
    order = [r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 'toxicity') AS h").orderBy("h").collect()]
    expected, intercept = toxicity.fit([texts[i] for i in order], toxic[order], keep=900)
    assert np.count_nonzero(weights) == 900 and weights.tolist() == expected.tolist() and b == intercept
    assert toxicity.train(docs, docs.where("toxic = 1").select("doc_id", "toxic"))[1] == 40.0


def test_workers_keep_no_pieces_after_a_task():
    path = default_tokenizer()
    batch = pa.RecordBatch.from_pydict({"_id": [1, 2], "_text": ["some words and xkqzjv", None], "_hash": [5, 6]})
    out = [b for b in _tokenise(path, 1, 1)(iter([batch, batch]))]
    assert [len(b) for b in out] == [2, 2] and out[0]["ids"] == out[1]["ids"] and len(out[0]["ids"][0].as_py()) > 9
    assert not coder(path).cache
