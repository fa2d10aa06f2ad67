import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import chat, html_text, quality_rules, registry, url_graph

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><aside>side</aside><article><h1>Title &amp; more</h1><p>First <b>bold</b>, then<br>a   line &lt;x&gt;.<p>Second&nbsp;one<div class="ad">buy now</div><form><input>send</form>
<!-- hidden --><p>Third <a href="/l">link</a>.</p></article><div class="comments"><p>Great article, thanks a lot for sharing it!</p></div></div>
<footer>&copy; all</footer></body></html>"""


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (PAGE, "Title & more First bold, then a line <x>. Second one Third link."),
        (PAGE.split("<footer>")[0].replace("</article>", ""), "Title & more First bold, then a line <x>. Second one Third link."),
        ("<body><div><p>Long paragraph of real text in here.</p><p>Another paragraph, also long.</p></div><div class='menu'><a href=x>a</a> <a href=y>b</a></div></body>", "Long paragraph of real text in here. Another paragraph, also long."),
        (None, ""), ("", ""), ("no tags at all", "no tags at all"), ("<p>a < b", "a < b"), ("<nav>x</nav>", ""), ("<script>x", ""), ('<p title="a>b">t</p>', "t"), ("<p title='>t</p>", "t"), ("<article>", ""), ("</p></div>x", "x"),
    ],
)
def test_main_text(source, text):
    assert html_text.main_text(source) == text


BODY = "<p>Real text of the article, long enough to matter here.</p><p>And a second paragraph of it.</p>"
BODY_TEXT = "Real text of the article, long enough to matter here. And a second paragraph of it."
TALK = "<p>A reader's comment, all in all longer than the article above.</p>" * 8


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f'<body><nav>n</nav><div class="content-sidebar-wrap"><main>{BODY}</main><aside>s</aside></div></body>', BODY_TEXT),
        (f'<body><div class="layout has-sidebar"><article>{BODY}</article><div class="sidebar">s</div></div><footer>f</footer></body>', BODY_TEXT),
        (f'<body><div class="sidebar-wrap"><div class="nav-open"><article>{BODY}</article><div class="related"><article>t</article></div></div></div></body>', BODY_TEXT),
        (f"<body><form><nav>n</nav><div>{BODY}</div><input></form></body>", BODY_TEXT),
        (f'<body><h2>Site</h2><div class="page-header-fixed"><div>{BODY}</div><div class="share">s</div></div></body>', BODY_TEXT),
        (f'<body><h3>Site</h3><div class="comments-open"><h1>T</h1>{BODY}<div class="comments"><p>c</p></div></div></body>', "T " + BODY_TEXT),
        (f'<body><div class="comment">{BODY}</div></body>', BODY_TEXT),
        (f'<body><div><article>{BODY}</article></div><div class="comments"><article>{TALK}</article></div></body>', BODY_TEXT),
        (f'<body><div>{BODY}</div><div class="cookie-notice">{TALK}</div></body>', BODY_TEXT),
        ("<body><nav>x</nav><footer>y</footer><select><option>z</select></body>", ""),
        ("<body><div class='content no-sidebar'>The text.</div></body>", "The text."),
        (f"<body><div class='comment-free-zone'>{BODY}</div><div id='search-results'>{BODY}</div></body>", f"{BODY_TEXT} {BODY_TEXT}"),
        (f"<body><article><div class='post-header'><h1>Head line</h1></div>{BODY}<div class='post-comments'>c</div></article></body>", "Head line " + BODY_TEXT),
        (f"<body><script src=https://a.com/>var secret=1;</script><p>{BODY_TEXT}</p></body>", BODY_TEXT),
        ("<p class=ad>buy" + "<b>" * 9 + "<div>The article text.</div>", "The article text."),
        (f"<body><div>{BODY}</div><article class='comment'>{TALK}</article></body>", BODY_TEXT),
        (f"<body><ul><li><a href=x>one link</a><li><a href=y>two</a></ul><div><h1>T one</h1><div>{BODY}</div></div><p id=cookieNotice>cookies</p></body>", "T one " + BODY_TEXT),
        (f"<body><div><div>{BODY}{BODY}</div><div>{BODY}</div><div><a href=x>more to read</a> <a href=y>and more of it</a></div></div></body>", " ".join([BODY_TEXT] * 3)),
        (f"<body><main><div>{BODY}</div><p>Short end.</p><p><a href=x>a list of links</a></p></main></body>", BODY_TEXT + " Short end."),
        (f"<body><div data-id=sidebar class=text>{BODY}</div></body>", BODY_TEXT),
        ("<div>" * 3000 + BODY + "</b>" * 3000, BODY_TEXT),
    ],
)
def test_boilerplate_that_holds_the_page_stays(source, text):
    assert html_text.main_text(source) == text


def test_densities_equal_the_formula_on_random_trees():
    """An independent, recursive reading of the definition; the region holds the node of the largest sum."""
    import math

    rng = random.Random(11)

    def tree(depth):
        return (rng.choice(["div", "p", "a", "b"]) if depth else "body", "".join(rng.choice("xyz ") for _ in range(rng.randrange(12))), [tree(depth + 1) for _ in range(rng.randrange(4))] if depth < 4 else [])

    def html(node):
        return f"<{node[0] if node[0] != 'p' else 'div'}>{node[1]}{''.join(map(html, node[2]))}</{node[0] if node[0] != 'p' else 'div'}>"

    def counts(node, link=False):
        """(characters, tags below, characters in links, tags in links below) and the same of all nodes in page order."""
        link = link or node[0] == "a"
        c = len(node[1].replace(" ", ""))
        total, below = [c, 0, c if link else 0, 0], []
        for child in node[2]:
            (cc, ct, cl, clt), rest = counts(child, link)
            own = link or child[0] == "a"
            total = [total[0] + cc, total[1] + ct + 1, total[2] + cl, total[3] + clt + own]
            below += rest
        return total, [(total, len(node[2]))] + below

    for _ in range(60):
        root = tree(0)
        page = html_text.Page(html(root))
        density, sums = page.densities()
        (c0, _, l0, _), every = counts(root)
        expected = []
        for (c, t, lc, lt), _ in every:
            base = math.log(c / max(1, c - lc) * lc + l0 / max(1, c0) * c + math.e)
            expected.append(c / max(1, t) * max(0.0, math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)))) / base if c else 0.0)
        assert all(abs(a - b) < 1e-9 for a, b in zip(density[1:], expected, strict=True))
        assert all(abs(sums[k] - sum(density[j] for j in range(1, len(density)) if page.parent[j] == k)) < 1e-9 for k in range(len(sums)))
        assert max(range(len(sums)), key=lambda k: (sums[k], density[k])) in page.region()


def test_extract_keeps_every_row(spark):
    long = "<article>" + "<p>some words here</p>" * 5000 + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", long)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert next(r for r in got if r.page_id == 2).text == " ".join(["some words here"] * 5000)


def test_stored_pages_give_their_articles(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        assert html_text.main_text(r.html) == " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(/?(?:p|h1|br))\b[^>]*>", " ", inner))).split())


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["<|im_end|>\n", "<|im_start|>assistant\n", "\\", "<|", "<\\|", "\n", "é", "x y", "<", "|>", "<\\n", "😀", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "a\\b\nc<|", "<\\n"]), "".join(rng.choice(bits) for _ in range(rng.randrange(6)))) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(None, None, None, None), (None, 0, "user", "q"), (77, 1, "assistant", "same"), (77, 1, "assistant", "same")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    done = chat.format_chat(messages.withColumn("parts", chat.text_parts(F.col("text")))).withColumn("back", chat.parse_chat(F.col("formatted")))
    for r in done.collect():
        mine = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id), key=lambda x: x[:3])
        assert sorted((b.role, b.text) for b in r.back) == sorted(x[2:] for x in mine)
        assert len(r.back) == len(r.loss_mask) == len(mine)
        assert r.loss_mask == [b.role == "assistant" for b in r.back]
        unescape = lambda s: __import__("re").sub(r"(?s)\\(.)", r"\1", s)
        assert [unescape(r.formatted[s.start : s.end]) for s in r.loss_spans] == [b.text for b in r.back if b.role == "assistant"]
        assert r.formatted.count("<|im_start|>") == len(mine) == r.formatted.count("<|im_end|>")


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, n=0: (kind, text, ref, n)
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="i.png", n=256), part("audio", ref="a.wav", n=30), part("text", "<|image|>"), part("document", ref="d.pdf", n=7)]), (1, 1, "assistant", None), (2, 0, "user", [part("video", ref="v")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    text = got[1].formatted
    assert text == "<|im_start|>user\nsee <|image|><|audio|><\\|image|><|document|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.type, a.ref, a.tokens, a.part, text[a.at : a.at + 5]) for a in got[1].attachments] == [("image", "i.png", 256, 1, "<|ima"), ("audio", "a.wav", 30, 2, "<|aud"), ("document", "d.pdf", 7, 4, "<|doc")]
    assert got[1].attachment_tokens == 293 and got[2].attachment_tokens == 0 and got[2].attachments[0].type == "video"


def test_chat_query_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    r = chat.op6_chat_format(spark, str(tmp_path)).collect()
    text = "<|im_end|><|im_start|>assistant ok"
    assert len(r) == 1 and (r[0].conv_id, r[0].n_turns, r[0].loss_chars) == (-1, 2, len(text))
    assert r[0].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and r[0].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


URLS = [
    ("https://WWW.Example.com/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("http://example.com/fr", "example.com", "/fr", "com/", "allow"), ("http://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"), ("x://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    ("http://a.net?x", "a.net", "", None, "allow"), ("http://example.com", "example.com", "", None, "allow"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("://h.org/p?://", "h.org", "/p", None, "allow"),
]


def test_url_rules(spark):
    rows = [(k, u, None) for k, (u, *_) in enumerate(URLS)] * 2
    got = url_graph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:]
    assert url_graph.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_distrust_spreads_backwards(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">l</a>' for h in hosts)
    rows = [(1, "http://bad.net/es/1", link("bad.net")), (2, "http://farm.org/1", link("bad.net")), (3, "http://good.com/1", link("blog.org")), (4, "http://blog.org/1", link("good.com", "good.com", "bad.net")), (5, "http://far.org/", link("other.org")), (6, "http://farmer.org/1", '<A HREF=//FARM.org/2>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_graph.judge(pages).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}


def test_only_links_of_a_elements_count(spark):
    rows = [(1, "http://bad.net/es/1", None), (2, "http://css.org/1", '<link href="http://bad.net/x.css">'), (3, "http://cite.org/1", "<a class='l'\n href='http://bad.net/x'>l</a>"), (4, "http://data.org/1", "<a data-href=http://bad.net/x>l</a><abbr href=http://bad.net/x>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "rank", "bad", "src", "dst", "ruled")})
    assert {r.page_id: r.verdict for r in url_graph.judge(pages).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def test_oracle_of_the_graph(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    hosts = [f"h{k}.org" for k in range(30)] + ["a.net", "b.net", "example.com"]
    page = lambda k: (k, f"http://{rng.choice(hosts)}{rng.choice(['/es/1', '/fr/', '/en/'])}", "".join(f'<a href="//{rng.choice(hosts[-12:])}/q">l</a>' for _ in range(rng.randrange(3))))
    spark.createDataFrame([page(k) for k in range(90)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = db.execute(url_graph.ORACLES["op9_url_graph"]).fetchall()
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_graph.op9_url_graph(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and {g[4] for g in got if g[3] is None} == {"allow", "block"}


def test_distrust_reaches_the_end_of_long_chains(spark):
    link = lambda h: f'<a href="http://{h}/x">l</a>'
    rows = [(0, "http://bad.net/es/1", None)] + [(k, f"http://h{k}.org/", link(f"h{k - 1}.org" if k > 1 else "bad.net")) for k in range(1, 25)]
    got = {r.page_id: r.verdict for r in url_graph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # 0.15 * 0.85^k reaches 0.05 * 0.15 up to k = 18
    assert got == {k: "block" if k <= 18 else "allow" for k in range(25)}


def test_converged_ranks_see_shares_that_meet_again(spark):
    middle = [f"m{k}" for k in range(2000)]
    pairs = [("c0", "c1")] + [(f"c{k}", f"c{k + 1}") for k in range(1, 14)] + [("c14", m) for m in middle] + [(m, "end") for m in middle]
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, n long")
    got = {r.host: r.rank for r in url_graph.spread(df, spark.createDataFrame([("c0", 1.0)], "host string, weight double"), "t", tolerance=url_graph.TOLERANCE).collect()}
    assert abs(got["end"] - 0.15 * 0.85**16) < url_graph.TOLERANCE and abs(got["m7"] - 0.15 * 0.85**15 / 2000) < url_graph.TOLERANCE


def test_page_rank_equals_a_loop(spark):
    rng = random.Random(2)
    edges = list({(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}"): rng.randrange(1, 4) for _ in range(40)}.items())
    df = spark.createDataFrame([(a, b, n) for (a, b), n in edges], "src string, dst string, n long")
    got = {r.host: r.rank for r in url_graph.spread(df, spark.createDataFrame([("h0", 1.0), ("h3", 2.0)], "host string, weight double"), "t").collect()}
    seeds, rank = {"h0": 0.15, "h3": 0.3}, {"h0": 0.15, "h3": 0.3}
    total = {a: sum(n for (x, _), n in edges if x == a) for (a, _), _ in edges}
    for _ in range(url_graph.ITERATIONS):
        new = dict(seeds)
        for (a, b), n in edges:
            if a in rank:
                new[b] = new.get(b, 0) + 0.85 * rank[a] * n / total[a]
        rank = new
    assert got.keys() == rank.keys() and all(abs(got[h] - rank[h]) < 1e-9 for h in rank)


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = prose(30)
    texts = [prose(80) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100, texts[0]), (101, texts[1] + " tail"), (102, texts[2] + " " + item), (103, "short"), (104, " ".join(["a b c"] * 40)), (105, prose(70) + ' token = "' + "ab12" * 10 + '"'), (106, None), (107, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("documents", docs), ("labels", docs.selectExpr("doc_id", "case when doc_id in (103, 104) then 0 else 1 end as quality", "0 as toxic")), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "packing"]
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in at.collect()}
    assert set(seen["quality_rules"]) == {i for i, _ in rows} - {103, 104, 106, 107}
    assert set(seen["near_duplicates"]) == set(seen["quality_rules"]) - {100, 101}
    assert set(seen["decontamination"]) == set(seen["near_duplicates"]) - {102}
    assert "ab12" not in seen["secret_scan"][105] and seen["secret_scan"][7] == texts[7]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(seen["decontamination"]) and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_without_labels_the_base_rules_decide(spark):
    docs = spark.createDataFrame([(1, "w " * 10), (2, " ".join(f"w{k}" for k in range(90)))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, None).collect()} == {1: False, 2: True}


def test_registry_names_the_ten():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(registry.oracle_sql()) <= set(names)
