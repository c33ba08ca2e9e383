"""Jaccard join, nearest neighbours, HTML extraction, line dedup and URL filters against brute force."""

import html
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import html_extraction, jaccard_join, line_dedup, nearest_neighbours, url_filters
from keelson.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(docs):
    sets = {}
    for i, (_, text) in enumerate(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(str((doc, len(sets[i]), least.get(find(i)))) for i, (doc, _) in enumerate(docs))


def near_copies(seed, n_groups=12, size=14, n_words=60):
    """Groups of copies with edits of all sizes around the threshold, and a passage that all share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(n_groups):
        base = [word() for _ in range(n_words)] + passage
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy[: r.randint(70, 90)]))
    out += [" ".join(passage + [word() for _ in range(r.randint(0, 20))]) for _ in range(30)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    texts = near_copies(seed) + [None, "", " ", "one two", "ONE  two", "one two three", "a b c d e", "A B c d E", "dup " * 400]
    docs = [(1000 - i, t) for i, t in enumerate(texts)] + [(7, texts[0]), (7, texts[0]), (None, texts[1]), (None, "lonely text without any id")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, cid int").repartition(6)
    got = sorted(str((g["doc_id"], g["n_shingles"], g["component_id"])) for g in jaccard_join.jaccard_components(df).collect())
    assert got == brute_components(docs)


def test_components_of_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(df).count() == 0
    lone = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard_join.jaccard_components(lone).collect()] == [(1, 0, 1)]


def test_star_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {g["cid"]: g["comp"] for g in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == label[x] for x in label)


def test_linked_sets_share_a_listed_shingle():
    """Whatever shingles are held for frequent."""
    g = np.random.default_rng(1)
    for _ in range(300):
        pool = np.unique(g.integers(0, 1 << 63, 60).astype(np.uint64))
        a, b = (np.unique(g.choice(pool, g.integers(1, 60))) for _ in range(2))
        b = np.unique(np.concatenate([g.permutation(a)[: len(a) * 9 // 10], b[: len(a) // 12]]))
        frequent = np.sort(g.choice(pool, g.integers(0, len(pool)), replace=False))
        levels = g.integers(1, 9, len(frequent)).astype(np.uint8)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both) and both:
            assert len(np.intersect1d(jaccard_join.prefix(a, frequent, levels), jaccard_join.prefix(b, frequent, levels)))


@pytest.mark.parametrize("blocks", [(8192, 32768, 4096), (7, 50, 16)])
def test_neighbours_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(nearest_neighbours, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(nearest_neighbours, "CANDIDATE_BLOCK", blocks[1])
    g = np.random.default_rng(3)
    x = g.normal(size=(300, 12)).astype(np.float32)
    x[50:120] = x[50]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 12), (1020, [float("nan")] + [1.0] * 11), (1040, [None] + [1.0] * 11), (1060, [float("inf")] * 12), (None, [1.0] * 12), (1080, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {}
    for r in nearest_neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    full = x.astype(np.float64)
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        scores = np.array([(full[q] * v).sum() for v in full])
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:20]
        assert [(k + 1, i) for k, i in enumerate(order)] == [(a, b) for a, b, _ in found]
        assert np.allclose([s for _, _, s in found], scores[order], atol=1e-12)


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [9.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest_neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    assert nearest_neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_pages_equal_their_articles(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extraction.extract(pages).collect():
        article = re.search("<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<p>|</p>|<h1>|</h1>|<br>", article))
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<div>a<b> b</b>\n c</div>d", "a b c\nd"),
        ("<nav>n</nav><header>h</header><main><header><h2>T</h2></header>x</main><aside>s</aside><form>f<input></form><footer>f</footer>", "T\nx"),
        ("<article>x<div class='comments'>c<p>d</div><div id=cookie-notice>n</div><div class='sidebar'>s</div></article>", "x"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>c</p> --><p>t &#233; &lt;b&gt;</p>", "t é <b>"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a\nb\n1\n2"), ("<p>a</i></b>b</p></div>c", "ab\nc"), ("<p>unclosed <b", "unclosed"),
        ("<div class='adventure header-image-caption'>kept?</div><p class='shadow'>yes</p>", "yes"), ("<body class='menu'><p>x</p></body>", "x"), ("a<br>b", "a b"),
        ('<p>t <a href="x>link</a> more</p>', "t link more"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_page_text(page, text):
    assert html_extraction.page_text(page) == text


def test_site_tree_cuts_what_recurs(spark):
    """Without any telling name, a block that recurs over a host's pages goes; varied ones stay."""
    page = lambda i: f"<div class=top>Welcome to the site</div><div class=body><p>Story {i} first</p><p>and second {i * 7}</p></div><div class=end>Write to us</div>"
    rows = [(i, f"http://a.com/{i}", page(i), "x") for i in range(40)] + [(100 + i, f"http://b{i}.com/", page(i), "x") for i in range(3)] + [(200, None, None, "x"), (200, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(df).collect()}
    assert got[5] == "Story 5 first\nand second 35"
    assert got[101].startswith("Welcome") and got[200] == ""
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_tree_alone_removes_chrome_and_no_article(spark):
    """On whole pages and without the prior: menus that recur go, every line of an article stays."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").select(F.concat(F.lit("http://one.com/"), "page_id").alias("url"), "page_id", "html")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    fewer = 0
    for r in html_extraction.extract(pages, prior=False).collect():
        article = re.search("<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<p>|</p>|<h1>|</h1>|<br>", article))
        assert "\n".join(b for b in blocks if b) in r["text"]
        fewer += len(r["text"]) < len(html_extraction.page_text(source[r["page_id"]], prior=False))
    assert fewer > 0.9 * len(source)


def test_deep_pages_and_low_nodes(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    df = spark.createDataFrame([(i, f"http://a.com/{i}", f"<div class=top>same</div>{deep if i == 3 else f'<main>own {i}</main>'}") for i in range(9)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(df).collect()}
    assert got[3] == "deep text" and got[4] == "own 4"


def test_copies_of_a_host_keep_their_article(spark):
    """Hosts of copies only, of one article and of two, keep all texts; copies beside varied pages hide no boilerplate."""
    page = lambda i: f"<div class=top>Welcome to the site</div><div class=body><p>Story {i} first</p><p>and second {i * 7}</p></div>"
    rows = [(i, f"http://one.com/{i}", page(1)) for i in range(12)] + [(100 + i, f"http://two.com/{i}", page(i % 2)) for i in range(12)]
    rows += [(200 + i, f"http://mixed.com/{i}", page(max(i, 20))) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].endswith("Story 1 first\nand second 7") for i in range(12))
    assert all(f"Story {i % 2} first" in got[100 + i] for i in range(12))
    assert all(got[200 + i] == f"Story {max(i, 20)} first\nand second {max(i, 20) * 7}" for i in range(40))


def brute_lines(rows, ratio, least):
    pages, having = Counter(), Counter()
    for _, source, text in rows:
        if source is not None:
            pages[source] += 1
            having.update({(source, x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for doc, source, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if source is None or not x.strip(" ") or having[source, x.strip(" ")] < least or having[source, x.strip(" ")] <= ratio * pages[source]]
        out.append(str((doc, "\n".join(kept) if text is not None else None, len(lines), len(lines) - len(kept))))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", -1)
    r = random.Random(7)
    line = lambda: r.choice(["menu", " menu ", "", "footer", "  "] + [f"line {k}" for k in range(60)])
    rows = [(i, r.choice(["hot", "hot", "a", "b", None]), "\n".join(line() for _ in range(r.randint(0, 6)))) for i in range(300)]
    rows += [(900, "hot", None), (901, "a", ""), (902, "lone", "menu"), (902, "lone", "menu"), (903, "hot", "menu\n" * 3000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, source string, text string, n int").repartition(3)
    got = line_dedup.drop_boilerplate(df).collect()
    assert sorted(str((g["doc_id"], g["text"], g["n_lines"], g["n_dropped"])) for g in got) == brute_lines(rows, line_dedup.BOILERPLATE_RATIO, line_dedup.MIN_PAGES)
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_lines_equal_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = sorted(map(str, con.execute(f"select doc_id, text, n_lines, n_dropped from ({line_dedup.ORACLE_SQL})").fetchall()))
    got = line_dedup.drop_boilerplate(table(spark, small, "documents")).select("doc_id", "text", "n_lines", "n_dropped")
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_urls_equal_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    want = sorted(map(str, con.execute(f"select page_id, host, path, rule, verdict, listed from ({url_filters.ORACLE_SQL})").fetchall()))
    got = url_filters.filter_urls(table(spark, small, "pages"), url_filters.block_list(spark))
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_url_edge_cases(spark):
    urls = [None, "", "no scheme/x", "http://EXAMPLE.com/en/a?b#c", "http://www.example.com/en/", "x://a.net/fr/y#z", "http://net/es/", "http://org?x/y", "http://a.b.spam-farm.example.org", "http://xspam-farm.example.org/", "http://com", "http://xexample.com/en/", "a://b://c/d", "http://éÀ.org/p"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(df, url_filters.block_list(spark)).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "/en/a", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("a.net", "/fr/y", "net/fr/", "block"), ("net", "/es/", "net/es/", "block"), ("org", "", None, "allow"), ("a.b.spam-farm.example.org", "", None, "block"), ("xspam-farm.example.org", "/", None, "allow"),
        ("com", "", None, "allow"), ("xexample.com", "/en/", "com/", "allow"), ("b:", "//c/d", None, "allow"), ("éÀ.org", "/p", None, "allow"),
    ]
    assert url_filters.filter_urls(df.limit(0), url_filters.block_list(spark)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 40_000, 37).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filters.BloomCascade(universe, listed)
    assert len(cascade.levels) > 1
    got = universe.where(cascade.has(F.col("key"))).count()
    right = universe.join(listed, "key", "left_semi").where(cascade.has(F.col("key"))).count()
    assert got == right == math.ceil(20_000 / 37)
    assert url_filters.BloomCascade(universe, listed.limit(0)).levels == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><div class="site no-sidebar"><article><p>A</p></article></div>', "A"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p><div class="alert">Warning: hot.</div></article>', "Title\nBody\nWarning: hot."),
        ('<div class="sidebar-layout"><p>x</p><main><p>M</p><div class="share">s</div></main><p>y</p></div>', "M"),
        ('<div class="menu-open"><nav>n</nav><main>M</main></div>', "M"),
        ('<div id="comments"><article class="comment"><p>c</p></article></div><article><p>A</p></article><div class="site-header">no</div>', "A"),
        ('<div class="related-posts"><article><p>teaser</p></article></div><article>A</article>', "A"),
        ('<div class="side-bar">s</div><div class="has-menu">kept</div><p class="cookie-notice">n', "kept"),
        ("<p>a<b>c<p>d</b>e", "ac\nde"),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>x", "a\nb\nc\nd\nx"),
    ],
)
def test_names_of_layouts_and_of_parts_of_an_article_drop_nothing(page, text):
    assert html_extraction.page_text(page) == text


@pytest.mark.parametrize("unit", ["<b>x", "<div>x", "<h1><b>x</i>", "<li><b>x</i></em>", "<p><b>x</div>"])
def test_parsing_is_linear_in_nesting(unit):
    import time

    began = time.process_time()
    found = html_extraction.page_text(unit * 100_000)
    assert found.count("x") == 100_000 and time.process_time() - began < 20
