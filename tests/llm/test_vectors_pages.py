from __future__ import annotations

import hashlib
import html as H
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaloom.llm import html_blocks, kdtree, warc
from tests.test_oracles import duck, rows_of  # noqa: F401


def brute_top(rows, queries, k=5):
    out = set()
    ok = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for qi, q in ok:
        if qi in queries:
            best = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, v))), i) for i, v in ok if i != qi and len(v) == len(q))[:k]
            out |= {(qi, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard,leaf,block", [(8192, 64, 4096), (50, 4, 3), (7, 1, 1)])
def test_top_k_equals_brute_force(spark, shard, leaf, block):
    rng = random.Random(shard)
    rows = [(k, [rng.choice((-0.5, -0.25, 0.0, 0.1, 0.25, 0.5)) for _ in range(6)]) for k in range(300)]
    rows += [(1000, None), (1001, []), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, [None] + [0.1] * 5), (1005, [0.5] * 4), (1006, [0.25] * 4), (None, [0.1] * 6)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    asked = {k for k in range(0, 1010, 9)} | {1005}
    got = kdtree.top_k(table, table.where(F.col("vec_id").isin(*asked)), shard_rows=shard, leaf_rows=leaf, block_rows=block)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, asked)


def test_top_k_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kdtree.top_k(empty, empty).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in kdtree.top_k(few, few.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 256 * 256 * 3), (0, 2, 1, 256 * 256 * 3)]
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in kdtree.top_k(huge, huge.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
    over = spark.createDataFrame([(0, [1.7e308, -1.7e308]), (1, [1e306, 1.0]), (2, [-1e308, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in kdtree.top_k(over, over.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_queries_from_elsewhere(spark):
    """Queries that are no rows of the table have all their answers, and ids may be shared by rows."""
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(200)]
    others = [(1000 + k // 2, [rng.gauss(0, 3) for _ in range(5)]) for k in range(30)]
    make = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in kdtree.top_k(make(rows), make(others), k=4, shard_rows=40, leaf_rows=5, block_rows=7).collect())
    floor = lambda v: np.floor(256 * np.array(v))
    want = []
    for i, q in others:
        best = sorted((-int(floor(q) @ floor(v)), j) for j, v in rows)[:4]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_boxes_bound_all_products():
    rng = np.random.default_rng(0)
    points = np.floor(rng.standard_normal((500, 8)) * 100)
    order, nodes, low, high = kdtree.build_tree(points, 16)
    leaves = nodes[nodes[:, 2] < 0]
    assert sorted(order.tolist()) == list(range(500)) and (leaves[:, 1] - leaves[:, 0]).max() <= 16 and (leaves[:, 1] - leaves[:, 0]).sum() == 500
    p, q = points[order], points[:20]
    for (begin, end, child), lo, hi in zip(nodes, low, high):
        assert (p[begin:end].min(axis=0) == lo).all() and (p[begin:end].max(axis=0) == hi).all()
        assert ((np.maximum(q, 0) @ hi + np.minimum(q, 0) @ lo) >= (q @ p[begin:end].T).max(axis=1)).all()
        assert child < 0 or (nodes[child][0] == begin and nodes[child][1] == nodes[child + 1][0] and nodes[child + 1][1] == end)


def test_walks_skip_leaves():
    """A query far out on one side doesn't score the leaves on the other."""
    rng = np.random.default_rng(1)
    points = np.floor(rng.standard_normal((4096, 2)) * 100)
    order, nodes, low, high = kdtree.build_tree(points, 32)

    class Counting(np.ndarray):
        read = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Counting.read += key.stop - key.start
            return super().__getitem__(key)

    best = kdtree.Best(np.full(1, -np.inf), 5)
    q = np.array([[50.0, 3.0]])
    kdtree.search_shard(order, points[order].view(Counting), nodes, low, high, np.array([-1]), q, best)
    assert Counting.read < 400 and sorted(best.score.tolist()) == sorted((points @ q[0]).tolist())[-5:]


@pytest.mark.parametrize("module", [kdtree, warc])
def test_sql(spark, sf, duck, module):  # noqa: F811
    for name, sql in module.ORACLES.items():
        assert rows_of(module.QUERIES[name](spark, sf).toPandas()) == rows_of(duck.sql(sql).df())


# Main text.


def truth(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    return " ".join(H.unescape(re.sub(r"</?(?:p|br|h1)>", " ", body).replace("<b>", "").replace("</b>", "")).split())


def test_article_text(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = html_blocks.op7_block_labeller(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    assert sum(r.text != truth(pages[r.page_id].html) for r in rows) == 0
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)


def test_invented_pages(spark):
    rng = random.Random(12345)
    right = total = skipped = 0
    for _ in range(200):
        page, labels = html_blocks.made_page(rng)
        blocks = html_blocks.leaf_blocks(page)
        if len(blocks) != len(labels):
            skipped += 1  # markup left open joins blocks; train leaves such pages out, too
            continue
        found = html_blocks.label(*html_blocks.padded([html_blocks.vectors(blocks)]), html_blocks.trained(spark))[0] >= 0.5
        right, total = right + (found == np.array(labels)).sum(), total + len(labels)
    assert right / total > 0.97 and skipped < 10


_ENGLISH = "the river rose again last night and several families left their homes before the water reached the lower road while volunteers carried sand from an old quarry to close the gap".split()


def prose(n, shift=0):
    words = [_ENGLISH[(k * 7 + shift) % len(_ENGLISH)] for k in range(n)]
    for k in range(0, n, 12):
        words[k] = words[k].capitalize()
        words[k - 1] += "."
    return " ".join(words)


def layouts():
    """Pages of layouts that the generator doesn't make, and their articles."""
    p = lambda *sizes: [prose(n, k) for k, n in enumerate(sizes)]
    paragraphs = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    a = p(40, 55, 33, 61)
    yield f"<html><body><div class='topnav'><a href=/>Home</a> <a href=/n>News</a></div><div class='story'><h1>Floods return</h1>{paragraphs(a)}</div><div class='foot'>&copy; 2020 Example Inc. All rights reserved</div></body></html>", ["Floods return", *a]
    a = p(45, 38, 52)
    yield f"<table><tr><td><a href=/>Home</a><br><a href=/b>About us</a></td><td><h2>Big news today</h2>{paragraphs(a)}</td></tr></table><hr><font size=1>Copyright 1999</font>", ["Big news today", *a]
    yield f"<html><head><title>T</title></head><body><h1>Head of it</h1>{paragraphs(a)}</body></html>", ["Head of it", *a]
    a = p(50, 44, 70)
    yield "<body><div><div><a href=a>One</a></div><div><a href=b>Two</a></div></div><div>" + "".join(f"<div>{t}</div>" for t in a) + "</div><div>Contact | Terms | Privacy</div></body>", a
    a = p(60, 48, 25, 66)
    yield f"<ul class='x1'><li><a href=a>Start</a><li><a href=b>Shop</a></ul><section class='longform zz'><h1>Topic of the day</h1><p>{a[0]}</p><h2>Second part</h2><p>{a[1]}</p><blockquote>{a[2]}</blockquote><p>{a[3]}</p></section><div class='legal'><p>&copy; Firm</p></div>", ["Topic of the day", a[0], "Second part", *a[1:]]
    a = p(35, 90)
    yield f"<body><main><header><a href=/>Site</a></header><div id='mw-text'>{paragraphs(a)}</div></main><nav><ul><li><a href=1>Edit</a></li><li><a href=2>History</a></li></ul></nav></body>", a


def rich_layouts():
    """Articles with a table, definitions, a listing, a long list, and equal paragraphs."""
    p = lambda *sizes: [prose(n, k) for k, n in enumerate(sizes)]
    top = "<body><nav><a href=/>Home</a> <a href=/n>News</a></nav>"
    end = "<footer><p>&copy; 2020 Example Inc.</p></footer></body>"
    a = p(40, 55)
    cells = ["Town", "Families", "Losses", "Upper Ford", "120", "3 million", "Lower Ford", "87", "1 million"]
    rows = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in cells[k : k + 3]) + "</tr>" for k in (0, 3, 6))
    yield f"{top}<article><h1>Floods in figures</h1><p>{a[0]}</p><table>{rows}</table><p>{a[1]}</p></article>{end}", ["Floods in figures", a[0], *cells, a[1]]
    terms = ["Quarry", prose(14, 3), "Levee", prose(20, 5)]
    yield f"{top}<article><h1>Words of the flood</h1><p>{a[0]}</p><dl><dt>{terms[0]}</dt><dd>{terms[1]}</dd><dt>{terms[2]}</dt><dd>{terms[3]}</dd></dl><p>{a[1]}</p></article>{end}", ["Words of the flood", a[0], *terms, a[1]]
    yield f"{top}<main><h1>Reading levels</h1><p>{a[0]}</p><pre><code>level = read(7);\nprint(level);</code></pre><p>{a[1]}</p></main>{end}", ["Reading levels", a[0], "level = read(7); print(level);", a[1]]
    items = [prose(4 + k, k) for k in range(12)]
    yield f"{top}<article><h1>What to pack</h1><p>{a[0]}</p><ul>{''.join(f'<li>{t}</li>' for t in items)}</ul></article>{end}", ["What to pack", a[0], *items]
    yield f"{top}<div class='story'><p>{a[0]}</p><p>{a[0]}</p></div>{end}", [a[0], a[0]]


def bare_pages():
    """Pages without an article."""
    notice = prose(40, 2)
    yield f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Shop</a></li></ul></nav><div class='cookie-notice'><p>{notice}</p></div><footer>&copy; 2020 Firm</footer></body>"
    yield f"<body><nav><a href=/>Home</a></nav><section class='comments'><p>{prose(22, 1)}</p><p>{prose(31, 4)}</p></section></body>"
    yield "<body><header><a href=/>Site</a></header><form><label>Name</label><button>Send</button></form><footer>&copy; Firm</footer></body>"


def unseen_layouts():
    """Written after generator and seed were settled; measured, never used to choose anything."""
    p = lambda *sizes: [prose(n, 3 * k + 1) for k, n in enumerate(sizes)]
    a = p(48, 37, 64)
    yield f"<body><div class='site-top'><a href=/>Daily</a> <a href=/s>Sport</a></div><div class='page-body'><h1>The quarry opens</h1><p>{a[0]}</p><p>{a[1]}</p><p>{a[2]}</p></div><div class='legal-line'>&copy; Daily | Terms</div></body>", ["The quarry opens", *a]
    yield f"<body><header><a href=/>Wiki</a></header><main><article><h1>Levees</h1><p>{a[0]}</p><h2>Kinds</h2><ol><li>{prose(9, 2)}</li><li>{prose(6, 5)}</li></ol><p>{a[2]}</p></article><aside><h3>See also</h3><ul><li><a href=1>Dams</a></li></ul></aside></main><footer>Text is free</footer></body>", ["Levees", a[0], "Kinds", prose(9, 2), prose(6, 5), a[2]]
    yield f"<table width=90%><tr><td colspan=2><a href=/>Index</a> <a href=/m>Map</a></td></tr><tr><td valign=top><h1>Report</h1><p>{a[0]}</p><p>{a[1]}</p></td></tr></table>", ["Report", *a[:2]]


def word_f1(w, page, article):
    want, got = " ".join(article).split(), html_blocks.main_texts([page], w)[0].split()
    return 2 * sum((Counter(want) & Counter(got)).values()) / (len(want) + len(got))


def test_development_layouts(spark):
    """Layouts that the seed and the generator were chosen by. Two articles without any heading, in containers without a
    telling name, aren't found: known misses, stated in the README."""
    w = html_blocks.trained(spark)
    scores = [word_f1(w, *x) for x in (*layouts(), *rich_layouts())]
    print("word F1 of development layouts", [round(s, 2) for s in scores])
    assert {k for k, s in enumerate(scores) if s < 0.95} <= {5, 10}


def test_unseen_layouts(spark):
    scores = [word_f1(html_blocks.trained(spark), *x) for x in unseen_layouts()]
    print("word F1 of unseen layouts", [round(s, 2) for s in scores])
    assert sum(scores) / len(scores) >= 0.85


def test_pages_without_article_are_empty(spark):
    assert html_blocks.main_texts(list(bare_pages()), html_blocks.trained(spark)) == ["", "", ""]


def test_a_short_training_lowers_the_loss():
    w = html_blocks.train(pages=60, epochs=2)
    rng, right, total = random.Random(3), 0, 0
    for _ in range(30):
        page, labels = html_blocks.made_page(rng)
        blocks = html_blocks.leaf_blocks(page)
        if len(blocks) == len(labels):
            found = html_blocks.label(*html_blocks.padded([html_blocks.vectors(blocks)]), w)[0] >= 0.5
            right, total = right + (found == np.array(labels)).sum(), total + len(labels)
    assert right / total > 0.6


@pytest.mark.parametrize("page", ["<div>a" * 20_000, "<a " * 60_000, '<a x=">"' * 30_000, "<div>" * 20_000 + "<option></option>" * 20_000, "<b>" * 20_000 + "<hr>" * 20_000, "<div>" * 20_000 + "</span></x>" * 20_000, "<!--" * 40_000, "<title>" * 30_000, "<textarea>x" * 20_000, '<a "' * 40_000 + ">x"])
def test_reading_is_linear(page):
    began = time.time()
    blocks = html_blocks.leaf_blocks(page)
    if blocks:
        html_blocks.vectors(blocks)
    assert time.time() - began < 8


def test_gradients():
    rng = np.random.default_rng(0)
    x, lengths = html_blocks.padded([rng.standard_normal((n, html_blocks.SIZE)).astype(np.float32) for n in (3, 5)])
    y = np.zeros((2, 5), np.float32)
    y[0, 1] = y[1, 3] = 1
    w = html_blocks.new_weights(np.random.default_rng(1))
    _, grad = html_blocks.gradients(x, lengths, y, w)
    for name in w:
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        loss = []
        for step in (0.01, -0.01):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += step
            loss.append(html_blocks.gradients(x, lengths, y, moved)[0])
        assert abs((loss[0] - loss[1]) / 0.02 - grad[name][at]) < 1e-3


def test_blocks_of_odd_markup():
    texts = lambda h: [b[1] for b in html_blocks.leaf_blocks(h)]
    assert texts("<p>a &amp; b&nbsp;c<br>d<p>e <b>f</b>g<script>x</script>") == ["a & b c d", "e fg"]
    assert texts("<![bad<p>x</p>") is not None and texts(None) == [] and texts("") == [] and texts("plain") == ["plain"]
    assert texts("<ul><li>a<li>b</ul><!-- no --><style>p{}</style>c") == ["a", "b", "c"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert texts(deep) == ["x"]


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<article><h1>T</h1><p>Some words here.</p></article>"), (4, "u", "<p>" + "word " * 100_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_blocks.extract_main_text(pages).collect()}
    assert got[1].text == got[2].text == "" and "Some words here." in got[None].text and len(got) == 4
    assert html_blocks.extract_main_text(pages.limit(0)).count() == 0


# WARC.


def test_archive_round_trip(spark, tmp_path):
    long = "x" * 1500
    pages = spark.createDataFrame([(1, "http://a/1", long), (2, "http://a/2\r\nEvil: 1", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é" * 600), (7, "u", "é" * 600), (7, "u", "é" * 600), (None, "u", long)], "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages.repartition(2), path)
    rows = warc.read_archives(spark, path).where(F.col("record_type").isin("response", "revisit")).collect()
    got = sorted((str(r.record_id), r.record_type, r.refers_to, r.payload_bytes) for r in rows)
    assert got == sorted([("1", "revisit", 2, 1500), ("2", "response", None, 1500), ("3", "response", None, 5), ("4", "response", None, 5), ("5", "response", None, 0), ("6", "revisit", 7, 1200), ("7", "response", None, 1200), ("7", "response", None, 1200), ("None", "revisit", 2, 1500)])
    for r in rows:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    assert {r.target_uri for r in rows if r.record_id == 2} == {"http://a/2Evil: 1"}


def test_filters_are_pushed(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(k, f"u{k}", "y" * (900 + 50 * k)) for k in range(20)], "page_id long, url string, html string")
    warc.write_archives(pages, path)
    table = warc.read_archives(spark, path)
    some = table.where((F.col("record_id") >= 5) & (F.col("target_uri") == "u7") & (F.col("record_type") == "response"))
    assert [r.record_id for r in some.collect()] == [7]
    assert table.where(F.col("refers_to").isNotNull()).count() == 0
    reader = warc.WarcReader(path, True)
    from pyspark.sql.datasource import EqualTo, StringContains

    rest = list(reader.pushFilters([EqualTo(("record_type",), "warcinfo"), StringContains(("payload",), "y")]))
    assert len(rest) == 1 and [r[2] for p in reader.partitions() for r in reader.read(p)] == ["warcinfo"] * len(reader.partitions())
    bare = warc.read_archives(spark, path, payload=False).where("record_type = 'response'").collect()
    assert len(bare) == 20 and all(r.payload is None for r in bare)


def test_uncommitted_files_are_ignored(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string"), path)
    (tmp_path / "w" / "part-lost.warc").write_bytes(b"garbage")
    assert warc.read_archives(spark, path).where("record_type = 'response'").count() == 1
    empty = f"file://{tmp_path}/e"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def foreign(version, kind, headers, block):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", "WARC-Date: 2020-01-01T00:00:00Z", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_origin(spark, tmp_path):
    """Hand-written files of both versions: base32 digests, none, chunks, codings, other types, compressed files."""
    import base64
    import gzip

    html = b"<html>caf\xc3\xa9</html>" * 90
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    http = lambda body, *extra: b"\r\n".join([b"HTTP/1.1 200 OK", b"Content-Type: text/html", *extra]) + b"\r\n\r\n" + body
    resp = "Content-Type: application/http; msgtype=response"
    chunked = b"%x\r\n" % 100 + html[:100] + b"\r\n%x;x=1\r\n" % (len(html) - 100) + html[100:] + b"\r\n0\r\n\r\n"
    coded = gzip.compress(html)
    old = [
        foreign("1.0", "warcinfo", ["Content-Type: application/warc-fields"], b"software: x\r\n"),
        foreign("1.0", "request", ["WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        foreign("1.0", "response", ["WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{sha(html)}", resp], http(html)),
        foreign("1.0", "response", ["WARC-Target-URI: http://b/", resp], http(chunked, b"Transfer-Encoding: chunked")),
    ]
    new = [
        foreign("1.1", "response", ["WARC-Target-URI: http://c/", f"WARC-Payload-Digest: sha1:{sha(coded)}", resp], http(coded, b"Content-Encoding: gzip")),
        foreign("1.1", "resource", ["WARC-Target-URI: http://d/", "Content-Type: text/plain", f"WARC-Payload-Digest: sha-256:{hashlib.sha256(b'text').hexdigest()}"], b"text"),
        foreign("1.1", "conversion", ["WARC-Target-URI: http://e/", "Content-Type: text/plain"], b"converted"),
        foreign("1.1", "revisit", ["WARC-Target-URI: http://f/", "WARC-Refers-To: <urn:uuid:x>", resp], http(b"")),
    ]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "old.warc").write_bytes(b"".join(old))
    (tmp_path / "f" / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, new)))
    (tmp_path / "f" / "other.txt").write_bytes(b"no archive")
    path = f"file://{tmp_path}/f"
    got = {(r.record_type, r.target_uri): r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == 8
    for uri in ("http://a/", "http://b/", "http://c/"):
        assert bytes(got["response", uri].payload) == html
    assert got["response", "http://a/"].payload_digest == hashlib.sha1(html).hexdigest() and got["response", "http://b/"].payload_digest is None
    assert bytes(got["resource", "http://d/"].payload) == b"text" and bytes(got["conversion", "http://e/"].payload) == b"converted"
    assert got["revisit", "http://f/"].payload is None and got["revisit", "http://f/"].refers_to_urn == "<urn:uuid:x>"
    assert warc.read_archives(spark, path).where("target_uri = 'http://c/'").count() == 1
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(old)))
    assert warc.read_archives(spark, f"file://{tmp_path}/whole.warc.gz").where("record_type = 'response'").count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(old[2].replace(b"caf", b"cat", 1))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archives(spark, f"file://{tmp_path}/bad").collect()


def test_revisits_name_their_response(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([(k, f"u{k}", "z" * 2000) for k in range(4)], "page_id long, url string, html string"), path)
    rows = warc.read_archives(spark, path).where("record_type <> 'warcinfo'").collect()
    by_type = {t: [r for r in rows if r.record_type == t] for t in ("response", "revisit")}
    assert len(by_type["revisit"]) == 3 and {r.refers_to_urn for r in by_type["revisit"]} == {by_type["response"][0].record_urn}
    assert len({r.record_urn for r in rows}) == 4
