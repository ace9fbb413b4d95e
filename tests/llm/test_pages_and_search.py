"""Archives, extraction, quotation links and the exact search."""

import base64
import gzip
import hashlib
import html
import re
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.llm import extraction, quotes, topk, warc
from strandline.llm.queries import ORACLE_SQL, QUERIES
from strandline.session import new_path

SF = "/root/testdata/sf0.01"


def sql(name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db.execute(ORACLE_SQL[name])


def test_queries_equal_sql(spark):
    for name in ORACLE_SQL:
        cursor = sql(name)
        columns = [c[0] for c in cursor.description]
        found = QUERIES[name](spark, SF).select(columns).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, cursor.fetchall())), name


TRAP = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [(1, "http://a", "same é"), (2, "http://b\r\nX: y", "same é"), (7, None, "same é"), (3, "u", None), (4, "u", ""),
         (5, "u", TRAP), (6, "u", TRAP + "x"), (None, "n", "same é"), (7, None, "same é"), (None, "n", "only"), (8, "u", "\r\n\r\n")]


def test_archives_give_back_every_page(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    rows = warc.archived(pages).collect()
    payload = {}
    for i, _, text in PAGES:
        payload.setdefault(i, []).append((text or "").encode())
    assert len(rows) == len(PAGES)
    kinds = {}
    for r in rows:
        assert any(r["payload_bytes"] == len(p) and r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
                   for p in payload[r["page_id"]])
        kinds.setdefault((r["page_id"], r["payload_digest"]), []).append((r["record_type"], r["refers_to"]))
    same = base64.b32encode(hashlib.sha1("same é".encode()).digest()).decode()
    assert kinds[1, same] == kinds[2, same] == kinds[None, same] == [("revisit", 7)]
    assert kinds[7, same] == [("response", None)] * 2
    empty = base64.b32encode(hashlib.sha1(b"").digest()).decode()
    assert kinds[3, empty] == [("revisit", 4)] and kinds[4, empty] == [("response", None)]
    assert sum(v == [("response", None)] for v in kinds.values()) == 5
    assert warc.archived(pages.limit(0)).count() == 0


def test_payloads_survive_and_small_ones_are_not_linked(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for compression in ("none", "gzip"):
        path = new_path(spark, "archive")
        warc.write_archives(pages, path, min_bytes=100, records_per_file=3, compression=compression)
        records = warc.read_archives(spark, path).collect()
        assert all(r["sound"] for r in records if r["record_type"] == "response")
        assert sorted(bytes(r["payload"]) for r in records) == sorted((t or "").encode() for _, _, t in PAGES)
        assert {r["url"] for r in records} == {"http://a", "http://b X: y", None, "u", "n"}


def test_archives_are_bounded_by_bytes(spark):
    # 100 pages of 1 MB, one of 70 MB, and many short ones, all in one task.
    size = F.when(F.col("id") == 7, 70 << 20).when(F.col("id") < 101, 1 << 20).otherwise(10)
    pages = spark.range(0, 5000, 1, 1).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat("id", F.lit("y")).alias("tag"), size.alias("n"))
    pages = pages.select("page_id", "url", F.concat("tag", F.expr("repeat('z', n)")).alias("html"))
    path = new_path(spark, "archive")
    warc.write_archives(pages, path)
    counts = []
    for r in spark.read.format("binaryFile").load(path).select("content").toLocalIterator():
        content = gzip.decompress(r["content"])
        counts.append(content.count(b"WARC-Record-ID"))
        assert len(content) <= 64 << 20 or counts[-1] == 1
    assert sum(counts) == 5000 and max(counts) <= 4000 and len(counts) < 12
    records = warc.read_archives(spark, path, payloads=False)
    assert records.where("sound").count() == 5000
    assert records.agg(F.sum("payload_bytes")).first()[0] == pages.agg(F.sum(F.length("html"))).first()[0]


def test_archives_are_read_in_pieces(monkeypatch):
    records = [(f"WARC/1.1\r\nContent-Type: application/http\r\nContent-Length: {n + 19}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"
                + "\r\n\r\nabc"[:n].ljust(n, "x")).encode() for n in (0, 1, 4, 7, 50)]
    for archive in (b"\r\n\r\n".join(records), gzip.compress(b"\r\n\r\n".join(records))):
        for piece in (1, 3, 20, 1000):
            monkeypatch.setattr(warc, "PIECE", piece)
            found = list(warc.parse_archive(archive))
            assert [(n, len(payload)) for _, n, _, payload in found] == [(n, n) for n in (0, 1, 4, 7, 50)]
            assert all(hashlib.sha1(payload).digest() == sha for _, _, sha, payload in found)
    assert len(list(warc.parse_archive(b"\r\n\r\n".join(records)[:-1]))) == 4


def test_extraction_finds_the_article(spark):
    found = {r["page_id"]: r for r in QUERIES["op9_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        body = p["html"][p["html"].index("<article>"):p["html"].index("</article>")]
        text = " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert found[p["page_id"]]["text"] == text and found[p["page_id"]]["n_chars"] == len(text)


SOUP = """<!doctype html><head><title>T &amp; x</title><body class="has-sidebar"><div id="topNav"><a href=/>Home</a>
<a href=/b>Long menu of many words that looks like running text at first sight really</a></div><div class="wrapper">
<div class="cookie-notice">We use cookies to give you the best experience on our pages and elsewhere.</div>
<div class="story"><h2>A  title</h2><p>First para<b>graph</b> with&nbsp;some &lt;words&gt;,<br>and <a href="x>y">a link</a>.
<p>Second one with a good number of words in it.<div class=ad>Buy now great products cheap</div><ul><li>one item<li>two
items</ul><script>if (a < b) document.write("<p>no</p>")</script><!-- <p>no</p> --><p>End.</div>
<aside><p>Something else entirely that is quite long but beside the story of this page.</aside>
<form><label>Name of the reader</label><textarea>draft <b>text</textarea></form>
<section id="comments"><p>Nice story I liked it very much indeed thank you for sharing it with all of us</section></div>
<footer>The foot of the page</footer>"""


def test_extraction_without_labels():
    for weights in (extraction.Weights(), extraction.learn([]), extraction.learn(
            ["<nav><a>x</a></nav><main><p>" + "words and more words " * 9 + "</p></main><footer>f</footer>"] * 12)):
        assert extraction.extract(SOUP, weights) == (
            "A title First paragraph with some <words>, and a link. Second one with a good number of words in it. "
            "one item two items End.")


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain & simple"), (None, "u", "<p>a<p"), (5, "u", "<" * 5000),
            (6, "u", "<p>" + "long " * 100_000), (7, "u", "<nav>menu<article><p>text after an open menu</article>"), (6, "u", "<a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text_", F.lit(1))
    found = extraction.extracted(pages, extraction.fit(pages)).collect()
    assert [r["text"] for r in found][:3] == ["", "", "plain & simple"] and found[5]["n_chars"] == 499_999
    assert found[6]["text"] == "text after an open menu"
    assert extraction.extracted(pages.limit(0), extraction.Weights()).count() == 0


def test_extraction_goes_on_after_an_icon():
    for icon in ('<svg class="i"/>', "<svg/>", '<svg class="i"><path d="M0"/><title/><text>no</text></svg>', '<svg><use href="#x">',
                 "<noscript><img src=x>no</noscript>", "<noscript><img src=x>", "<template><p>no</template>", "<template>", "<svg><g><svg/>"):
        for page in (f"<article><p>a</p>{icon}<p>rest of the article</p></article>", f"<div><p>a {icon}</p><p>rest of the article</p></div>",
                     f"<nav>menu {icon}</nav><main><p>a <p>rest of the article</main>"):
            assert extraction.extract(page, extraction.Weights()) == "a rest of the article", page
    page = "<p>one <svg><foreignObject><p>no</p></foreignObject><style/></svg> and two</p>"
    assert extraction.extract(page, extraction.Weights()) == "one and two"


def test_extraction_learns_from_as_many_labelled_pages_at_any_size(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(extraction, "learn", lambda pages: seen.append(pages))
    labelled = F.concat(F.lit("<article>"), F.col("id"), F.lit("</article>"))
    for n, every, expected in ((3_000, 60, 50), (60_000, 1_200, 50), (60_000, 20, 100)):
        html_ = F.when(F.col("id") % every == 0, labelled).otherwise(F.lit("<p>none</p>"))
        extraction.fit(spark.range(n).select(F.col("id").alias("page_id"), html_.alias("html")), fit_pages=100)
        assert len(set(seen[-1])) == expected and all("article" in page for page in seen[-1])
    # Not the first rows: the sample is spread over the table.
    numbers = [int(re.sub(r"\D", "", page)) for page in seen[-1]]
    assert 20_000 < np.mean(numbers) < 40_000


def test_extraction_keeps_articles_that_hints_describe():
    words = "some words of the story that anyone would like to read "
    menu, foot = "<nav><a href=/>Home</a></nav>", "<footer>The foot</footer>"
    plain = extraction.Weights()
    for page in (
            f'{menu}<article class="post category-social"><p>{words * 3}</p></article>{foot}',
            f'{menu}<div class="right-sidebar"><p>{words * 3}</p></div>{foot}',
            f'<form id="page"><div>{menu}<p>{words * 3}</p>{foot}</div></form>',
            f'<div hidden><article class="post"><p>{words * 3}</p></article></div>',
            f'{menu}<div data-class="ad" title="a hidden gem" data-style="display:none"><p>{words * 3}</p></div>{foot}',
            f'{menu}<article><div class="social-body"><p>{words * 3}</p></div></article><div class="comments">{words * 9}</div>'):
        assert extraction.extract(page, plain) == (words * 3).strip(), page
    assert extraction.extract(f'<p>{words}<h2 class="section-header">Part two</h2><p>{words}', plain) == f"{words}Part two {words}".strip()
    assert extraction.extract(f'<p>{words}<p style="display: none">{words}<p hidden>{words}', plain) == words.strip()


def test_extraction_lets_labelled_pages_overrule_hints():
    words = "some words of the story that anyone would like to read "

    def page(article, after="<div class='share'>Share this page with all of your friends</div>"):
        return f"<header>Site name</header><nav><a>Home</a></nav>{article}{after}<footer>The foot</footer>"

    def article(k=""):
        return f"<header><h1>Title {k}</h1></header><p>{words}</p><div class='notice'>Take note {k}</div><p>{words}</p>"

    weights = extraction.learn([page(f"<article>{article(k)}</article>") for k in range(20)])
    whole = f"Title {words}Take note {words}".strip()
    assert extraction.extract(page(f"<article>{article()}</article>"), weights) == whole
    assert extraction.extract(page(f"<main><article>{article()}</article></main>"), weights) == whole
    assert "Take note" in extraction.extract(page(f"<div>{article()}</div>"), weights)
    assert "Share" not in extraction.extract(page(f"<div>{article()}</div>"), weights)


MESSAGES = [
    ("a", 0, "user", "Hello there\nhow are you?"), ("a", 1, "assistant", "I am fine.\n\nWhat about you?"),
    ("a", 2, "user", "On Monday, X wrote:\n> Hello there\n> how are you?\nI reply to the first."),
    ("a", 3, "assistant", "> I am   FINE.\nGood.\n> What about you?\nBad"), ("a", 4, "user", ">> I am fine.\n> Good.\nSo what"),
    (None, 0, "x", "> hmm"), (None, 1, None, "y"), (None, None, "r", None), ("b", 0, "user", "> unknown\n\n own  "),
    ("a", 1, "assistant", "I am fine.\n\nWhat about you?")]


def test_quotes_are_linked_and_taken_out(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id string, turn long, role string, text string").withColumn("root", F.lit(9))
    rows = quotes.threaded(df).orderBy("conv_id", "position").collect()
    got = [(r["conv_id"], r["turn"], r["reply_to"], r["root"], r["depth"], r["position"], r["text"]) for r in rows]
    assert got == [
        (None, 0, None, 0, 0, 0, ""), (None, 1, None, 1, 0, 1, "y"), (None, None, None, None, 0, 2, None),
        ("a", 0, None, 0, 0, 0, "Hello there\nhow are you?"), ("a", 2, 0, 0, 1, 1, "I reply to the first."),
        ("a", 1, None, 1, 0, 2, "I am fine.\n\nWhat about you?"), ("a", 1, None, 1, 0, 3, "I am fine.\n\nWhat about you?"),
        ("a", 3, 1, 1, 1, 4, "Good.\nBad"), ("a", 4, 3, 1, 2, 5, "So what"), ("b", 0, None, 0, 0, 0, "own")]
    assert quotes.threaded(df.limit(0)).count() == 0


def test_quotes_are_linked_as_the_sql_says(spark, tmp_path):
    rows = [m for m in MESSAGES if m[0] == "a"][:5] + [("b", t, "user", f"> line {t - 1}\n> > line {t - 2}\nline {t}") for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = db.execute(ORACLE_SQL["op5_quotes"])
    columns = [c[0] for c in cursor.description]
    found = QUERIES["op5_quotes"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, cursor.fetchall()))
    assert max(r["depth"] for r in found) == 39


def test_conversations_that_quote_give_back_their_texts(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    text = {(r["conv_id"], r["turn"]): r["text"] for r in rows}
    quoting = []
    for r in rows:
        # Each message quotes the one before it, which quotes the one before that.
        lines = []
        for depth in (2, 1):
            earlier = text.get((r["conv_id"], r["turn"] - depth))
            if earlier:
                lines += ["> " * depth + line for line in earlier.split("\n")]
        quoting.append((r["conv_id"], r["turn"], r["role"], "\n".join([*lines, r["text"]])))
    df = spark.createDataFrame(quoting, "conv_id long, turn long, role string, text string")
    found = quotes.threaded(df).collect()
    assert len(found) == len(rows)
    first = {}
    for (conv, turn), value in sorted(text.items()):
        first.setdefault((conv, " ".join(value.lower().split())), turn)
    for r in found:
        assert r["text"] == text[r["conv_id"], r["turn"]].strip()
        before = text.get((r["conv_id"], r["turn"] - 1))
        assert r["reply_to"] == (first[r["conv_id"], " ".join(before.lower().split())] if before else None)
    by_conv = {}
    for r in found:
        by_conv.setdefault(r["conv_id"], {})[r["turn"]] = r["position"]
    assert all(sorted(places.values()) == list(range(len(places))) for places in by_conv.values())


def test_quotes_are_linked_at_size(spark):
    # From the table: turn t quotes turn t - 1; and one conversation holds as many messages as all others together.
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("text").limit(500)
    n = table.count()
    texts = table.select(F.row_number().over(Window.orderBy("text")).alias("i"), F.regexp_replace("text", r"\s+", " ").alias("line"))
    base = spark.range(20_000).select("id", F.when(F.col("id") < 10_000, -1).otherwise(F.floor(F.col("id") / 10)).cast("long").alias("conv_id"))
    base = base.withColumn("turn", F.when(F.col("conv_id") < 0, F.col("id")).otherwise(F.col("id") % 10))
    said = base.join(F.broadcast(texts), F.col("i") == F.col("id") % n + 1).select(
        "conv_id", "turn", F.concat_ws(" ", F.lit("m"), "conv_id", "turn", F.substring("line", 1, 200)).alias("own"))
    before = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat(F.lit("> "), "own", F.lit("\n")).alias("quoted"))
    df = said.join(before, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.lit("user").alias("role"), F.concat(F.coalesce("quoted", F.lit("")), "own").alias("text"), "own")
    found = quotes.threaded(df.drop("own")).join(said, ["conv_id", "turn"])
    wrong = (~F.col("reply_to").eqNullSafe(F.when(F.col("turn") > 0, F.col("turn") - 1)) | (F.col("root") != 0)
             | (F.col("depth") != F.col("turn")) | (F.col("position") != F.col("turn")) | (F.col("text") != F.trim("own")))
    assert tuple(found.agg(F.count(F.lit(1)), F.count_if(wrong), F.max("depth")).first()) == (20_000, 0, 9_999)


@pytest.mark.parametrize("conversation", [1, None])
def test_crowded_passages_and_threads_are_spread(spark, conversation):
    """Hundreds of messages quote one line, hundreds answer one thread: divided or not, the links are the same."""
    rows = [(conversation, 0, "u", "the shared line")] + [(conversation, t, "u", f"> the shared line\nanswer {t}") for t in range(1, 300)]
    rows += [(conversation, 300 + t, "u", f"> answer {299 if t == 0 else f'next {t - 1}'}\nnext {t}") for t in range(20)]
    rows += [(2, 0, "u", "> the shared line\nnot said before"), (2, None, "u", "> not said before")]
    rows = [(c, t, r, x.replace("> answer next", "> next")) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.xxhash64("text"))
    runs = quotes.parse_levels(df)
    own = runs.where("level = 0").select("conv_id", "turn", F.col("content").alias("own_text"))
    want_links = {(conversation, t): 0 for t in range(1, 300)} | {(conversation, 300 + t): 299 + t for t in range(20)}
    want_roots = {(conversation, t): (0, 1) for t in range(1, 300)} | {(conversation, 300 + t): (0, t + 2) for t in range(20)}
    for options in ({"rows_together": 16}, {}):
        links = quotes.reply_links(runs, own, **options)
        assert {(r["conv_id"], r["turn"]): r["reply_to"] for r in links.collect()} == want_links
        roots = quotes.thread_roots(links, **options).collect()
        assert len(roots) == len(want_roots)
        assert {(r["conv_id"], r["turn"]): (r["root"], r["depth"]) for r in roots} == want_roots


def plain_top(vectors, k, is_query):
    out = []
    for q, v in vectors:
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    spread = np.concatenate([rng.normal(c, 0.05, (60, 3)) for c in (-2, 0.1, 1, 4)] + [np.tile([[0.5, 0.5, 0.25]], (90, 1))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(spread)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows]
    for settings in ({}, {"pivots": 9, "query_block": 4, "data_block": 50}, {"pivots": 1}, {"k": 400}):
        found = topk.top_k(df, F.col("vec_id") % 6 == 0, **{"k": 7, **settings}).collect()
        assert sorted(map(tuple, found)) == plain_top(whole, settings.get("k", 7), lambda i: i % 6 == 0), settings


def test_search_divides_copies_of_a_row(spark, monkeypatch, tmp_path):
    # One row makes up most of the table; its copies all count, and no block holds all of them.
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)] + [(3, [3.0, 5.0])] * 400
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    folder, plain = str(tmp_path), topk._solve

    def watched(queries, data, k, width):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(str(data.num_rows))
        return plain(queries, data, k, width)

    monkeypatch.setattr(topk, "_solve", watched)
    found = topk.top_k(df, F.col("vec_id") % 20 == 0, data_block=50).collect()
    whole = [(i, [int(64 * x) for x in v]) for i, v in rows]
    assert sorted(map(tuple, found)) == plain_top(whole, 20, lambda i: i % 20 == 0)
    sizes = [int(path.read_text()) for path in tmp_path.iterdir()]
    assert sum(sizes) >= 400 and max(sizes) < 120


def test_blocks_of_long_vectors_are_smaller():
    assert topk.block_rows(0) == topk.block_rows(64) == 8192 and topk.block_rows(4096) == 512
    assert topk.block_rows(10**7) == 1


def test_search_merges_queries_that_share_an_id(spark, tmp_path):
    rng = np.random.default_rng(5)
    spread = np.concatenate([rng.normal(c, 0.05, (60, 3)) for c in (-2, 0.1, 1, 4)])
    # Id 0 has three vectors far from each other, id 20 two, and 7 is no query.
    rows = [({61: 0, 130: 0, 131: 20, 200: 7}.get(i, i), [float(x) for x in v]) for i, v in enumerate(spread)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = sorted(db.execute(ORACLE_SQL["op10_topk"]).fetchall())
    assert {row[0] for row in expected} >= {0, 20}
    found = QUERIES["op10_topk"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == expected
    for settings in ({"pivots": 9, "query_block": 4, "data_block": 50}, {"pivots": 200, "query_block": 1}):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, **settings).collect())) == expected, settings


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf]), (5, []), (None, [9.0, 9.0]),
            (6, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [1e4, -1e4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect()))
    a, b = [64, 128], [64, 0]
    assert found == sorted([
        (0, 1, 6, 64 * 64 + 128 * 128), (0, 2, 20, 64 * 64), (0, 3, 5, 0), (0, 4, 7, 640_000 * (64 - 128)),
        (20, 1, 7, 640_000 * 64), (20, 2, 0, 64 * 64), (20, 3, 0, 64 * 64), (20, 4, 6, 64 * 64), (20, 5, 5, 0)])
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") == 99).count() == 0
