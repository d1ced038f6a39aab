import itertools
import time
import zlib

import numpy as np
import pytest

from questmill.llm.embed_dup import similar_vectors
from questmill.llm.hilbert import curve_index, hilbert_shards, write_shards
from questmill.llm.html_main import extract_pages, main_text


def test_main_text_of_a_full_page():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body class="with-sidebar"><header><h2>Site</h2></header><div id="topNav"><a href=1>A</a></div>
    <div class="wrap"><div class="sidebar"><p>Side, text, with, many, commas, and words.</p></div><article><h1>Title &amp; more</h1><div class=body><p>First, with &lt;b&gt;  and
    a line<br>break.<p>Second <a href=x>link</a>, tail. &#233;&nbsp;x</div><ul><li>one<li>two</ul><div class="share-buttons">Share</div></article>
    <form><p>Name, please, and mail, and more, and more.</p></form><section id="comments"><p>Nice, really, nice, article, all of it, yes.</p></section></div><!-- x --><footer>f</footer>"""
    assert main_text(page) == "Title & more\nFirst, with <b> and a line break.\nSecond link, tail. é x\none\ntwo"


@pytest.mark.parametrize("source,want", [(None, ""), ("", ""), ("plain & simple", "plain & simple"), ("<p>one<p>two", "one\ntwo"), ("<div>" * 2000 + "deep, text", "deep, text"), ("<script>x", ""), ("<a <b 'x", "")])
def test_main_text_of_odd_pages(source, want):
    assert main_text(source) == want


def test_container_without_article():
    page = "<body><div class=menu><a>x</a></div><div class=content><h1>T</h1>" + "".join(f"<p>Sentence number {i}, with words, and more words to be long.</p>" for i in range(4)) + "</div><div><p>tiny</p></div></body>"
    assert main_text(page).split("\n")[0] == "T" and "number 3" in main_text(page)


@pytest.mark.parametrize("wrapper", ['div class="container has-sidebar"', 'div class="layout-sidebar-right"', 'div id="page-header-fixed"', 'section class="no-comments"'])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_named_like_furniture(wrapper, inner):
    body = "".join(f"<p>Sentence number {i}, with words, and more words to be long.</p>" for i in range(6))
    side = '<div class="sidebar"><p>Side, text, with, many, commas, and words.</p></div><div class="related"><article><a href=x>Other</a></article></div>'
    page = f"<body><div class=menu><a href=x>x</a></div><{wrapper}><{inner}>{body}</{inner}>{side}<section id=comments><p>Nice, really, nice, all of it.</p></section></{wrapper.split()[0]}></body>"
    assert main_text(page) == "\n".join(f"Sentence number {i}, with words, and more words to be long." for i in range(6))


@pytest.mark.parametrize("wrapper", ['div class="content side-by-side"', 'div id="search-results-page"', 'div class="has-sidebar widget-area"'])
def test_pages_of_one_wrapper_named_like_furniture(wrapper):
    body = "".join(f"<p>Sentence number {i}, with words, and more words to be long.</p>" for i in range(3))
    assert main_text(f"<body><{wrapper}>{body}</div><footer>f</footer></body>").count("Sentence") == 3


def test_header_of_an_article_stays():
    body = "".join(f"<p>Sentence number {i}, with words, and more words to be long.</p>" for i in range(4))
    page = f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>Lead, in short.</p><nav><a href=x>n</a></nav></header>{body}<footer>f</footer></article></body>"
    assert main_text(page).split("\n")[:3] == ["Title", "Lead, in short.", "Sentence number 0, with words, and more words to be long."]


@pytest.mark.parametrize("head,part", [("", "<button>"), ("<div>", "</p>"), ("<div>", "<li></li>"), ("<div>", "<body>")])
def test_parts_without_their_counterpart_take_linear_time(head, part):
    spent = []
    for n in (10_000, 40_000):
        began = time.process_time()
        assert main_text(head * n + part * n + "word") == "word"
        spent.append(time.process_time() - began)
    assert spent[1] < 10 * spent[0] + 0.5


def test_comments_longer_than_the_text_are_left_out():
    text = "".join(f"<p>Sentence number {i}, with words, and more words to be long.</p>" for i in range(4))
    comments = "".join(f"<p>Comment number {i}, with words, and more words to be long.</p>" for i in range(8))
    assert "Comment" not in main_text(f"<body><div class=content>{text}</div><div class=comments>{comments}</div></body>")


def test_given_pages(spark, small):
    rows = extract_pages(spark.read.parquet(f"{small}/pages.parquet")).collect()
    assert len(rows) == 50 and all(r.text and r.n_chars == len(r.text) and "track(" not in r.text and "©" not in r.text for r in rows)
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x</p>", "t"), (None, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in extract_pages(odd).collect()) == ["", "x", "x"]
    assert extract_pages(odd.limit(0)).collect() == []


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    order = np.argsort(curve_index(points, bits))
    assert sorted(curve_index(points, bits)) == list(range(len(points)))
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


def test_hilbert_shards(documents, odd, none, spark, tmp_path):
    for docs in (documents, odd):
        rows = hilbert_shards(docs).collect()
        n = docs.count()
        sizes = np.bincount([r.shard for r in rows], minlength=8)
        assert len(rows) == n and sizes.max() - sizes.min() <= 1
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
        text = {r.doc_id: r.text or "" for r in docs.collect()}
        assert all(r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows)
        places = {s: [r.curve for r in rows if r.shard == s] for s in range(8)}
        ends = [(min(v), max(v)) for _, v in sorted(places.items()) if v]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert hilbert_shards(none).collect() == []
    write_shards(documents, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == documents.count()


def test_similar_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, vectors = [], []
    for g in range(30):
        base = rng.normal(size=12)
        for _ in range(6):
            v = (base + rng.normal(size=12) * rng.choice([0.05, 0.25, 0.4])).astype(np.float32)
            vectors.append((v, g % 3))
    vectors += [(vectors[0][0], 0)] * 5 + [(np.zeros(12, np.float32), 0), (np.full(12, np.nan, np.float32), 0), (vectors[1][0], None), (vectors[2][0] * np.float32(3), 0)]
    ids = rng.permutation(len(vectors)) + 10
    for i, (v, label) in zip(ids, vectors, strict=True):
        rows.append((int(i), [float(x) for x in v], label, "rep", 1))
    rows += [(5, None, 0, "rep", 1), (6, [1.0, None], 0, "rep", 1), (7, [], 0, "rep", 1), (8, [1.0, 2.0], 0, "rep", 1), (9, [2.0, 4.0], 0, "rep", 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string, block int")
    want = {}
    good = [(i, np.array(v, float), g) for i, v, g, _, _ in rows if g is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {r[0]: set() for r in rows}
    for i, v, g in good:
        for j, w, h in good:
            if i != j and g == h and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= 0.93:
                links[i].add(j)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want[i] = (len(links[i]), min(seen))
    for block in (2048, 7):
        got = similar_vectors(frame, block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
    assert similar_vectors(frame.limit(0)).collect() == []


def test_shards_keep_every_row_and_copies_together(spark, tmp_path):
    rows = [(i, f"text {i} " + "x" * (i % 50), "src", "en") for i in range(1000)]
    rows += [(i * 97, "the same words in many places", f"src{i % 5}", ("en", None)[i % 2]) for i in range(10)]
    rows += [(None, "no id", None, None), (None, "no id", None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    write_shards(docs, str(tmp_path / "out"))
    back = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*docs.columns).collect()]
    assert sorted(back, key=repr) == sorted(rows, key=repr)
    placed = hilbert_shards(docs).collect()
    same = sorted((r.shard, r.slot) for r in placed if r.size == 30 and r.text_crc32 == zlib.crc32(b"the same words in many places"))
    sizes = {s: sum(r.shard == s for r in placed) for s in range(8)}
    gaps = [(b[1] - a[1] == 1) if a[0] == b[0] else (b[0] == a[0] + 1 and b[1] == 0 and a[1] == sizes[a[0]] - 1) for a, b in zip(same, same[1:], strict=False)]
    assert len(same) == 10 and all(gaps)
    with pytest.raises(ValueError):
        write_shards(docs.withColumnRenamed("lang", "shard"), str(tmp_path / "no"), lang_col="source")


def test_labels_of_any_type(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1.2), (2, v, 1.7), (3, v, 1.2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1)}
    near = [1.0, 2.0, 3.01]
    rows = [(1, v, "a"), (2, near, "a"), (3, v, "b"), (4, near, None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


LONG = "It was a long day, with rain in the morning, and the road went on for many miles. " * 4


@pytest.mark.parametrize(
    "part,want",
    [
        ('<h2 class="section-header">The second part</h2>', "The second part"),
        ('<div class="post-header"><h1>A title of its own</h1></div>', "A title of its own"),
        ('<p class="social-history">A paragraph on how people lived.</p>', "A paragraph on how people lived."),
        ('<ul><li><a href="a">first</a></li><li><a href="b">second</a></li><li><a href="c">third</a></li></ul>', "first\nsecond\nthird"),
        ('<div class="comments"><h3>Comments</h3><p>I do not agree, said one.</p></div>', ""),
        ('<div class="related"><h3>Related</h3><a href="a">Another page to read</a> <a href="b">One more of them</a></div>', ""),
        ('<div class="share-header"><h3>Share</h3></div>', ""),
        ('<div class="post-footer">Posted by someone</div>', ""),
    ],
)
def test_names_inside_an_article(part, want):
    page = f"<html><body><nav>Home</nav><article><p>{LONG}</p>{part}<p>{LONG}</p></article></body></html>"
    body = LONG.strip()
    assert main_text(page) == "\n".join([body, *([want] if want else []), body])
