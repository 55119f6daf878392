"""Operators on pages and vectors against brute force, and their defined results for odd rows."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest

from marketloom.llm import html_text, markup, neighbours, url_filter, warc

PAGES = "page_id bigint, url string, html string"
URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "https://example.org/en/1?x=/y", "https://example.org/en/2", "http://sub.b.com/fr/1#z",
        "http://b.com/de/", "http://b.com/de", "http://xcom/de/", "https://org", "https://org/", "https://c.net?u=http://d.org/", "ftp://É.com/fr/É"]


def rule_by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, prefix in [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]:
        own, start = prefix.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(prefix) > len(best[1])):
            best = (verdict, prefix)
    return host, path, best


def test_url_rules(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    given = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(10_000 + i, u, None) for i, u in enumerate(URLS)] + [(None, URLS[5], None)] * 2, PAGES)
    frame = given.unionByName(odd).selectExpr("*", "'x' AS host", "'x' AS path", "'x' AS verdict", "'x' AS suffix")
    rows = url_filter.judged(frame, labels).collect()
    urls = {r["page_id"]: r["url"] for r in frame.collect()}
    assert len(rows) == frame.count()
    for r in rows:
        host, path, best = rule_by_hand(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")
    assert url_filter.judged(frame.limit(0), labels).count() == 0
    assert {r["verdict"] for r in url_filter.judged(odd, labels.limit(0)).where("rule IS NULL").collect()} == {"allow"}


def test_url_trees_learn_from_labels(spark):
    rng = random.Random(3)
    rows = [(i, f"http://{'pay-4-click' if i % 3 == 0 else 'site'}{rng.randrange(9)}.net/{'a/b/c/' if i % 3 == 0 else ''}p/{i}{'?x=1&y=2' if i % 3 == 0 else ''}", None) for i in range(600)]
    pages = spark.createDataFrame(rows, PAGES)
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(0, 600, 2)], "doc_id bigint, quality int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, labels).collect()}
    held = [i for i in range(1, 600, 2)]
    assert sum(got[i] == ("block" if i % 3 == 0 else "allow") for i in held) > 0.95 * len(held)


def test_entropy(spark):
    frame = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "url string")
    got = [r[0] for r in frame.select(url_filter._entropy(frame["url"])).collect()]
    assert got == pytest.approx([1.0, 0.0, 2.0])


def test_warc_round_trip(spark, sf):
    big, small = "<p>" + "long payload é " * 20, "tiny"
    rows = [(5, "http://www.B.com/x", big), (3, "http://a.com/y?q", big), (9, None, big), (None, "http://a.com/", big), (1, "u\r\nX-Evil: 1", small), (2, "http://a.com/y?q", small),
            (4, "", None), (10 ** 15, "http://far.com", "far"), (2 ** 63 - 1, "http://far.com", big), (-(2 ** 63), "http://far.com", small),
            (6, "http://a.com", "\r\n\r\nWARC/1.1\r\n\r\n"), (3, "http://a.com/y?q", big), (7, "http://c.com", "h" * 300_000)]
    odd = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS digest", "'x' AS bytes", "'x' AS first", "'x' AS block")
    given = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    for frame in (odd, given, given.limit(0)):
        path = warc.fresh_path(spark, "warc-test")
        history = warc.captured(frame, path).collect()
        want, first = [], {}
        held = [(r["page_id"], (r["html"] or "").encode(), r["url"]) for r in frame.collect()]
        for i, payload, _ in held:
            if i is not None:
                first[payload] = min(i, first.get(payload, i))
        shared = {p for p in first if len(p) >= 100 and sum(q == p for _, q, _ in held) > 1}
        for i, payload, _ in held:
            refers = first[payload] if payload in shared and i != first[payload] else None
            want.append((str(i), len(payload), hashlib.sha256(payload).hexdigest(), "response" if refers is None else "revisit", refers))
        got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in history]
        assert sorted(got, key=str) == sorted(want, key=str)
        keys = [(r["url_key"].encode(), r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in history]
        assert keys == sorted(keys)
        for r in history[:20]:  # the index leads to the record
            with gzip.open(r["archive"].removeprefix("file:")) as file:
                record = file.read()[r["offset"]:r["offset"] + r["record_bytes"]]
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and record.endswith(b"\r\n\r\n")


def test_warc_files_are_bounded_by_bytes(spark, monkeypatch):
    import os

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    pages = spark.createDataFrame([(i, "http://a.com/", chr(97 + i % 26) * (9000 if i % 7 == 0 else 700)) for i in range(40)], PAGES).repartition(3)
    path = warc.fresh_path(spark, "warc-test")
    assert warc.captured(pages, path).count() == 40
    files = [os.path.join(top, f) for top, _, names in os.walk(path) for f in names if f.startswith("part-")]
    for name in files:
        plain = gzip.open(name).read()
        assert len(plain) <= 5004 or len(list(warc.parsed(plain))) == 1
    assert 10 < len(files) < 30


def test_loser_tree_merges():
    rng = random.Random(1)
    for runs in range(9):
        lists = [sorted((rng.randrange(20),) for _ in range(rng.randrange(6))) for _ in range(runs)]
        merged = [lists[r][i] for r, i in warc.merged_order(lists)]
        assert merged == sorted(x for some in lists for x in some)


ARTICLE = "<article><h1>T{0}</h1><p>One &amp; <b>t</b>wo{0}</p>{1}</article>"


def test_html_leaves_out_what_is_not_the_article():
    asides = ('<nav>m</nav>', '<div class="ad">BUY</div>', '<form><label>mail</label><input></form>', '<section id="comments"><p>first!</p></section>', '<script>var x="</p>";</script>',
              '<div role="alert">!</div>', '<aside>s</aside>', '<!-- c -->', '<style>p{}</style>', '<p hidden>no</p>')
    pages = [f"<html><head><title>x</title></head><body><header>H</header><div id='cookie-notice'>c</div>{ARTICLE.format(i, a)}<footer>f</footer></body>" for i, a in enumerate(asides)]
    path = markup.region(markup.wrapper(pages))
    assert [markup.text_of(markup.regions(markup.tree(p), path)) for p in pages] == [f"T{i} One & two{i}" for i in range(len(pages))]


def test_html_wrapper_is_union_free():
    pages = ["<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li></ul><hr><p>x</p>"]
    assert markup.expression(markup.wrapper(pages)) == "<ul>(<li>#</li>)+</ul>(<hr></hr>)?<p>x</p>"


def test_html_without_an_article_element():
    page = "<body><div class=nav><a href=x>Home</a></div><div class=box><h2>{0}</h2><p>Story {0} goes on.<p>And on {0}.</div><div class=side><a>l</a></div>"
    path = markup.region(markup.wrapper([page.format(i) for i in range(3)]))
    assert markup.text_of(markup.regions(markup.tree(page.format(7)), path)) == "7 Story 7 goes on. And on 7."


def texts_by_id(spark, pages):
    rows = [(i, "http://no-article.org/x", page) for i, page in enumerate(pages)]
    return [r["text"] for r in sorted(html_text.main_texts(spark.createDataFrame(rows, PAGES)).collect(), key=lambda r: r["page_id"])]


def test_html_keeps_all_blocks_without_an_article_element(spark):
    long, short = "large block {0} " * 7, "second block {0} " * 3
    page = "<body><div class=top>Our site</div><h1>Title {0}</h1><div class=a><p>" + long + "</p></div><div class=b><p>" + short + "</p></div><div class=end>All rights</div>"
    want = [f"Title {i} {(long + short).format(i)}".strip() for i in range(30)]
    path = markup.region(markup.wrapper([page.format(i) for i in range(3)]))
    assert path == ["body"]
    assert texts_by_id(spark, [page.format(i) for i in range(30)]) == want


def test_html_keeps_what_the_sample_did_not_show(spark):
    page = "<body><div class=top>Our site</div><div class=a><p>Text {0}</p></div>{1}"
    late = {17: "<div class=late>Only here</div>", 23: "<div class=top>Our site says more</div>"}
    want = [" ".join([f"Text {i}", re.sub("<[^>]*>", "", late.get(i, ""))]).strip() for i in range(30)]
    assert texts_by_id(spark, [page.format(i, late.get(i, "")) for i in range(30)]) == want
    mixed = [f"<body><div>Fixed</div>Hello <b>dear</b> reader {i}<div><p>See <i>this</i> number {i}</div>" for i in range(9)]
    assert texts_by_id(spark, mixed) == [f"Hello dear reader {i} See this number {i}" for i in range(9)]
    assert texts_by_id(spark, ["<body><div class=a>70 percent of it</div><div class=b>the rest</div>"]) == ["70 percent of it the rest"]


def test_html_keeps_sentences_that_all_pages_share(spark):
    pages = [f"<body><div class=top>Our site</div><div class=a>Shared first part of the story.</div><div class=b>Part {i}</div><div class=end>All rights</div>" for i in range(12)]
    assert texts_by_id(spark, pages) == [f"Shared first part of the story. Part {i}" for i in range(12)]


def test_html_sample_is_of_different_pages(spark):
    page = "<body><div class=top>Our site</div><ul class=links><li>Home</li></ul><div class=b>Text {0}</div><div class=end>All rights</div>"
    pages = [page.format(5)] * 400 + [page.format(i) for i in range(6, 9)]
    assert texts_by_id(spark, pages) == ["Text 5"] * 400 + [f"Text {i}" for i in range(6, 9)]


def test_html_names_inside_an_article_do_not_cut_text(spark):
    page = "<body><nav>m</nav><article><h1>T{0}</h1><div class='search tips'>Tip {0}</div><p class=reply>Reply {0}</p><div class=ad>BUY</div><section id=comments><p>mine!</p></section></article>"
    assert texts_by_id(spark, [page.format(i) for i in range(9)]) == [f"T{i} Tip {i} Reply {i}" for i in range(9)]


def test_html_groups_of_several_parts():
    assert markup.expression(markup.wrapper(["<h2>a</h2><p>x</p><h2>b</h2><p>y</p>"])) == "(<h2>#</h2><p>#</p>)+"
    pages = ["<h1>t</h1><h2>a</h2><p>x</p><h2>b</h2><p>y</p><h2>c</h2><p>z</p><hr>", "<h1>u</h1><h2>d</h2><p>w</p><hr>", "<h1>v</h1><hr>"]
    assert markup.expression(markup.wrapper(pages)) == "<h1>#</h1>((<h2>#</h2><p>#</p>))*<hr></hr>".replace("((", "(").replace("))", ")")


def test_html_of_menus_that_repeat(spark):
    """A repeated group keeps the texts that all pages share apart from those that vary."""
    page = "<body><ul class=links><li>Home</li><li>News</li><li>About</li></ul><div class=list><p>First {0}</p><p>Then {0}</p>{1}</div>"
    pages = [page.format(i, "<p>More</p>" if i % 3 == 0 else "") for i in range(24)]
    assert texts_by_id(spark, pages) == [f"First {i} Then {i}" + (" More" if i % 3 == 0 else "") for i in range(24)]


def test_html_of_long_pages_in_seconds():
    import random
    import time

    rng = random.Random(1)
    start = time.time()
    pairs = ["".join(f"<h2>a{k}{i}</h2><p>text {i} of {k}</p>" for i in range(20_000)) for k in range(2)]
    disorder = ["".join(f"<{t}>x{i}{k}</{t}>" for i, t in enumerate(rng.choices(["p", "h2", "ul", "pre", "div"], k=30_000))) for k in range(2)]
    for pages in (pairs, disorder):
        wrap = markup.wrapper(pages)
        fixed = markup.template_texts(markup.tree(pages[0]), markup.unpacked(markup.packed(wrap)))
        assert not fixed
    assert len(markup.tree("<b></i>" * 200_000).children) == 1
    markup.tree("<p>" + "<font>" * 100_000 + "<p>x" * 50_000)
    markup.tree("<article>" + "<b>" * 100_000 + "</article>" * 2 + "</main></p>" * 100_000)
    assert time.time() - start < 60


# Pages of several templates, and their text as a person reads it.
LABELLED = [
    ("<html><body><header><a href=/>Daily</a></header><div id=menu><a href=/a>A</a><a href=/b>B</a></div><div class=story><h1>Rain {0}</h1><p>It rained on day {0}.</p>"
     "<ul><li>wet</li><li>cold {0}</li></ul></div><div class=sidebar><p>Read more {0}</p></div><footer>Daily Inc</footer></body></html>",
     "Rain {0} It rained on day {0}. wet cold {0}"),
    ("<body><div class=head>Shop</div><div class=prod><h2>Lamp {0}</h2><table><tr><td>Price<td>{0} EUR<tr><td>Size<td>M</table></div><form><p>Mail {0}</p></form><div class=foot>Imprint</div>",
     "Lamp {0} Price {0} EUR Size M"),
    ("<body><div class=logo>Blog</div><article><header><h1>Post {0}</h1></header><p>Body {0} &amp; more</p><aside>Buy {0}</aside></article><div class=comments><p>Nice {0}</p></div>",
     "Post {0} Body {0} & more"),
    ("<body><div class=logo>Wiki</div><div class=c><p>Intro {0}</p><h2>Part</h2><p>One {0}</p><h2>Rest</h2><p>Two {0}</p></div><script>x({0})</script><div class=cookie-notice>Cookies {0}!</div>",
     "Intro {0} Part One {0} Rest Two {0}"),
    ("<body><main><h1>Talk {0}</h1><blockquote>Quote {0}</blockquote><nav>next {0}</nav></main><div role=contentinfo>Owner {0}</div>", "Talk {0} Quote {0}"),
]


def test_html_of_labelled_templates(spark):
    rows = [(100 * t + i, f"http://site{t}.org/{i}", page.format(i)) for t, (page, _) in enumerate(LABELLED) for i in range(25)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {100 * t + i: text.format(i) for t, (_, text) in enumerate(LABELLED) for i in range(25)}


def test_html_of_templates_that_the_sample_did_not_show(spark):
    first = "<body><div class=top>Our site</div><article><p>Text {0}</p></article>"
    other = "<body><div class=top>Our site</div><div class=lead><h2>Head {0}</h2></div><div class=box><p>Other {0}</p></div><div class=end>All rights</div>"
    pages = [first.format(i) for i in range(300)] + [other.format(i) for i in range(3)]
    assert texts_by_id(spark, pages) == [f"Text {i}" for i in range(300)] + [f"Head {i} Other {i}" for i in range(3)]


def test_html_texts_are_the_templates_only_if_all_pages_have_them(spark):
    page = "<body><section><b>Acme</b><i>{}</i></section><div><p>Own text {}</p></div></body>"
    writer = lambda i: "By Bob" if i % 60 == 17 else "By Ann"
    rows = [(i, f"http://sampled{i // 60}.org/", page.format(writer(i), i)) for i in range(300)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Acme{writer(i)} Own text {i}" for i in range(300)}


def test_html_of_an_article_that_the_sample_did_not_show(spark):
    rows = [(i, "http://mixed.org/", f"<body><div>Top {i}</div><p>Own text {i}</p></body>") for i in range(60)]
    rows[41] = (41, "http://mixed.org/", "<body><div>Top 41</div><article><p>Told here</p></article></body>")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: "Told here" if i == 41 else f"Top {i} Own text {i}" for i in range(60)}


def test_html_labels_leave_out_numbers_of_pages(spark):
    page = "<body><div class=top>Our site</div><div class='entry post{0}' id='post-{0}'><p>Text {0}</p></div><div class=end>All rights</div>"
    assert markup.tree(page.format(7)).children[0].children[1].label == "div.entry.post"
    assert texts_by_id(spark, [page.format(i) for i in range(40)]) == [f"Text {i}" for i in range(40)]


def test_html_of_very_deep_pages(spark):
    page = "<body>" + "<font><div>" * 5000 + "deep {0}"
    rows = html_text.main_texts(spark.createDataFrame([(i, "http://deep.org/", page.format(i)) for i in range(3)], PAGES)).collect()
    assert sorted(r["text"] for r in rows) == [f"deep {i}" for i in range(3)]
    wrap = markup.wrapper([page.format(i) for i in range(2)])
    assert markup.expression(wrap) == "<body>" + "<font><div>" * 5000 + "#" + "</div></font>" * 5000 + "</body>"


def test_html_rows(spark, sf):
    import html

    given = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(None, None, None), (10_001, None, ""), (10_002, "http://a.com", "plain &lt;text"), (10_003, "x", "<p>" + "w " * 100_000), (10_003, "x", "<div<<>>&#x;"), (2 ** 63 - 1, "x", "far"), (2 ** 63 - 2, "x", "far")], PAGES)
    frame = given.unionByName(odd).selectExpr("*", "'x' AS host", "'x' AS path", "'x' AS text")
    got = html_text.main_texts(frame).collect()
    assert len(got) == frame.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[None] == "" and texts[10_001] == "" and texts[10_002] == "plain <text"
    for r in given.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)
        if inner:
            assert texts[r["page_id"]] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner[1])).split())
    assert html_text.main_texts(frame.limit(0)).count() == 0


def exact(vectors, ids, query):
    score = vectors @ vectors[ids == query][0]
    order = sorted((-s, i) for s, i in zip(score, ids) if i != query)
    return order[:neighbours.NEAREST]


def test_neighbours_recall_and_scores(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = neighbours.neighbours(frame, lambda i: i % 20 == 0).collect()
    held = frame.where("embedding IS NOT NULL").toPandas()
    vectors, ids = np.stack(held["embedding"].to_numpy()).astype(float), held["vec_id"].to_numpy()
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        want = exact(vectors, ids, q)
        assert [r[0] for r in own] == list(range(1, len(want) + 1))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in want})
        total += len(want)
    assert hits >= 0.9 * total


def test_neighbours_with_many_lists(spark, monkeypatch):
    """More than 100 lists, several shards and groups of queries: recall, and how much of the vectors a query reads."""
    monkeypatch.setattr(neighbours, "LIST", 16)
    monkeypatch.setattr(neighbours, "SHARD", 40)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(200, 12))
    vectors = np.repeat(centres, 20, axis=0) + 0.2 * rng.normal(size=(4000, 12))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    rows = neighbours.neighbours(frame, lambda i: i % 20 == 0).collect()
    ids, hits = np.arange(4000), 0
    for q in range(0, 4000, 20):
        own = {r["vec_id"] for r in rows if r["query_id"] == q}
        hits += len(own & {i for _, i in exact(vectors, ids, q)})
    assert hits >= 0.95 * 20 * 200
    index = neighbours.build(vectors, float(np.linalg.norm(vectors, axis=1).max()), neighbours.list_count(4000))
    assert len(index.centroids) == 128
    found, far = neighbours.nearest_lists(index, neighbours.lifted_queries(vectors[::20]), neighbours.PROBES)
    read = [len(neighbours._within(i, f, neighbours.PROBE_RATIO, neighbours.LEAST_PROBES)) for i, f in zip(found, far)]
    assert np.mean(read) < 0.7 * 128


def test_neighbours_walk_in_bounded_memory():
    """4,096 lists, 768 of them for a query: what a task and the driver hold does not grow with lists times queries of a batch."""
    import tracemalloc

    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(16_384, 64))
    longest = float(np.linalg.norm(vectors, axis=1).max())
    index = neighbours.build(vectors, longest, 4_096)
    assert len(index.centroids) == 4_096
    points = neighbours.lifted_queries(vectors[:256])
    tracemalloc.start()
    found, far = neighbours.nearest_lists(index, points, 768)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6
    for i in range(0, 256, 51):
        assert len(set(found[i])) == 768 and np.allclose(far[i], np.linalg.norm(index.centroids[found[i]] - points[i], axis=1))
        assert (np.diff(far[i]) >= 0).all()


def test_neighbours_do_not_depend_on_places(spark, monkeypatch):
    """One place or many, shards of a list and groups of queries: the same neighbours, single precision or double."""
    monkeypatch.setattr(neighbours, "LIST", 16)
    monkeypatch.setattr(neighbours, "PROBES", 12)
    monkeypatch.setattr(neighbours, "LEAST_PROBES", 6)
    monkeypatch.setattr(neighbours, "PROBE_SHARE", 0.1)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate((rng.normal(size=(3000, 8)) * 8).round() / 8)]
    got = []
    for shard, kind, least in ((65_536, "double", 65_536), (65_536, "float", 50), (25, "float", 25)):
        monkeypatch.setattr(neighbours, "SHARD", shard)
        monkeypatch.setattr(neighbours, "LEAST_PLACE", least)
        frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
        got.append(sorted(tuple(r) for r in neighbours.neighbours(frame, lambda i: i % 5 == 0).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 600 * 20


def test_neighbours_lists_of_a_place():
    assert neighbours.place_runs([3, 3, 3, 9, 0, 1, 8, 2], 8) == [0, 0, 1, 2, 3, 3, 4, 5]
    assert neighbours.place_runs([1] * 6, 2) == [0, 0, 1, 1, 2, 2]


def test_neighbours_ties_go_to_the_smallest_ids(spark):
    """199 vectors tie with the query, in many orders of their parts: the smallest ids win."""
    rng = np.random.default_rng(6)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(int(i), [1.0, *(float(x) for x in rng.integers(-4, 5, 3))]) for i in rng.permutation(np.arange(1, 200))]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(7)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in neighbours.neighbours(frame, lambda i: i == 0).collect())
    assert got == [(k, k, 1.0) for k in range(1, 21)]


def test_neighbours_of_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, rep string, h1 string"
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60, [0.0, 2.0]), (61, [3.0, 0.0]), (62, None), (63, [0.0, 0.0]), (64, [1.0, None]), (65, [float("nan"), 1.0]), (66, [float("inf"), 0.0]),
                                                   (67, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (80, [-0.0, 1.0])]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = {}
    for r in neighbours.neighbours(frame, lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 60, 80}
    assert sorted(got[0]) == [(1, 61, 3.0)] + [(k + 1, k, 1.0) for k in range(1, 20)]
    assert sorted(got[20]) == [(1, 61, 3.0)] + [(k + 2, k, 1.0) for k in range(19)]
    assert sorted(got[60])[0] == (1, 80, 2.0)
    assert neighbours.neighbours(frame.limit(0), lambda i: i % 20 == 0).count() == 0
