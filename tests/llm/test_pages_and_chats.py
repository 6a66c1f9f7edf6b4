"""Operators on pages and conversations."""

import hashlib
import random

import edge
import pytest
from pyspark.sql import functions as F

from panelflow.llm import chat_format, html_blocks, html_extraction, url_filters


def chats():
    rng = random.Random(6)
    evil = ["\\### Assistant: </turn> ok", "<|end|>\n<|assistant|>x", "\\l\\\\l<\\p|", "<b<l<p", "", "\\", "😀 é\n\n"]
    data = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(evil)]
    data += [(2, i, r, edge.prose(rng, rng.randint(1, 400))) for i, r in enumerate(["system"] + ["user", "assistant"] * 60)]
    data += [(3, 0, "system", "only")]
    data += [(4, 0, "user", edge.prose(rng, 5000)), (4, 1, "assistant", edge.prose(rng, 9000)), (4, 2, "user", "short"), (4, 3, "assistant", None)]
    data += [(5, 0, None, None), (5, 0, "assistant", "tie"), (5, 0, "assistant", "tie"), (5, None, "a|>b<", "x")]
    data += [(None, 0, "user", "q"), (None, 1, "assistant", "a")]
    return data


def test_chat_round_trip_and_budget(spark):
    data = chats()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "window": F.lit("x")}).repartition(3)
    windows = chat_format.chat_windows(df)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    by: dict = {}
    for r in sorted(data, key=lambda r: edge.key((r[1], r[2] or "", r[3] or ""))):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns, c
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")
    sizes = {}
    for w in windows.collect():
        turns = w.text.split("<|end|>\n")[:-1]
        assert len(turns) == w.n_turns
        tokens = sum(-(-len(t.split("|>", 1)[1].encode()) // 4) + chat_format.TURN_TOKENS for t in turns)
        sizes.setdefault(w.conv_id, []).append(tokens)
        if w.conv_id == 2:
            assert turns[0].startswith("<|system|>")
    stride = chat_format.BUDGET - chat_format.HISTORY - chat_format.SYSTEM
    system = -(-len(by[2][0][1]) // 4) + chat_format.TURN_TOKENS
    assert max(sizes[2]) <= stride + chat_format.HISTORY + system and len(sizes[2]) > 3


def test_chat_windows_are_filled(spark):
    rng = random.Random(12)
    data = [(c, t, "user" if t % 2 == 0 else "assistant", edge.prose(rng, rng.randint(1, 120))) for c in range(30) for t in range(rng.randint(1, 90))]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    room = chat_format.BUDGET - chat_format.HISTORY - chat_format.SYSTEM
    new: dict = {}
    for w in chat_format.chat_windows(df).collect():
        sizes = [-(-len(t.split("|>", 1)[1].encode()) // 4) + chat_format.TURN_TOKENS for t in w.text.split("<|end|>\n")[:-1]]
        new.setdefault(w.conv_id, {})[w.window] = sizes[w.n_repeated :]
        assert sum(sizes[: w.n_repeated]) <= chat_format.HISTORY
    for windows in new.values():
        some = [windows[i] for i in range(len(windows))]
        assert all(sum(s) <= room for s in some)
        assert all(sum(s) + after[0] > room for s, after in zip(some, some[1:]))  # the next turn would not have fitted
    inner = [sum(s) for windows in new.values() for i, s in windows.items() if i < len(windows) - 1]
    assert len(inner) > 30 and sum(inner) / len(inner) >= 0.8 * room


def test_chat_sizes_from_a_column(spark):
    df = spark.createDataFrame([(1, t, "user", "x", n) for t, n in enumerate([700, 500, 100, 2000, 10, None])], "conv_id long, turn long, role string, text string, n long")
    got = sorted((w.window, w.n_turns - w.n_repeated) for w in chat_format.chat_windows(df, tokens_col="n").collect())
    assert got == [(0, 2), (1, 1), (2, 1), (3, 2)]


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.chat_windows(none)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "\\", "<", "|", "\\l", "\\\\l<|\\p", "<b", "<l<p\\b"])
def test_escape_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat_format.escape(F.col("t")), chat_format.unescape(chat_format.escape(F.col("t"))),
                                                                chat_format.unescape(chat_format.escape_role(F.col("t")))).first()
    assert "<" not in row[0] and row[1] == text and row[2] == text


def test_url_rules_and_parts(spark):
    rules = [url_filters.rule("allow", "org/"), url_filters.rule("block", "example.org/es/"), url_filters.rule("block", "example.org/en/1"),
             url_filters.rule("allow", "com/fr/"), url_filters.rule("block", "com/de/")]
    cases = {
        "http://A.Example.ORG/es/x?y#z": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "https://example.org": ("example.org", "", None, "allow"),
        "x.com/fr/": ("", "", None, "allow"),
        "ftp://x.com/de/?a://b": ("x.com", "/de/", "com/de/", "block"),
        "://?q": ("", "", None, "allow"),
        "http://x.com#/fr/": ("x.com", "", None, "allow"),
        "a?b://c.com/fr/d": ("c.com", "/fr/d", "com/fr/", "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    data = [(i, u, None) for i, u in enumerate(cases)] + [(0, "http://A.Example.ORG/es/x?y#z", "")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "rule": F.lit(1)})
    out = url_filters.judge_urls(df, rules).collect()
    assert len(out) == len(data)
    want = list(cases.values())
    # the page without rule on a host all of whose pages are blocked is no case here
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id], r
    assert url_filters.judge_urls(df.limit(0), rules).count() == 0


def pagerank(edges, seeds, steps, damping):
    hosts = {h for e in edges for h in e} | set(seeds)
    degree = {h: len({d for s, d in edges if s == h}) for h in hosts}
    start = {h: 1 / max(1, len(seeds)) if h in seeds else 0.0 for h in hosts}
    rank = dict(start)
    for _ in range(steps):
        rank = {h: (1 - damping) * start[h] + damping * sum(rank[s] / degree[s] for s, d in set(edges) if d == h) for h in hosts}
    return rank


def test_propagation_equals_brute_force_and_blocks_neighbours(spark):
    def page(host, *to):
        return f"http://{host}/p", "".join(f'<p><a class=x href="//{t}/y">z</a></p>' for t in to)

    data = [page("bad.com", "far.net"), page("spam.net", "bad.com"), page("spam2.net", "spam.net", "bad.com"), page("good.org", "ok.net"), page("ok.net", "good.org"),
            page("ok.net", "bad.com", "bad.com"), page("lone.net")]
    data = [(i, u, h) for i, (u, h) in enumerate(data)]
    rules = [url_filters.rule("block", "bad.com/"), url_filters.rule("allow", "org/")]
    out = {r.page_id: r for r in url_filters.judge_urls(spark.createDataFrame(data, "page_id long, url string, html string"), rules).collect()}
    edges = [("bad.com", "far.net"), ("spam.net", "bad.com"), ("spam2.net", "spam.net"), ("spam2.net", "bad.com"), ("good.org", "ok.net"), ("ok.net", "good.org"), ("ok.net", "bad.com")]
    trust = pagerank(edges, {"good.org"}, url_filters.STEPS, url_filters.DAMPING)
    distrust = pagerank([(b, a) for a, b in edges], {"bad.com"}, url_filters.STEPS, url_filters.DAMPING)
    hosts = ["bad.com", "spam.net", "spam2.net", "good.org", "ok.net", "ok.net", "lone.net"]
    for i, h in enumerate(hosts):
        assert abs(out[i].distrust - distrust.get(h, 0)) < 1e-9
        if distrust.get(h):
            assert abs(out[i].trust - trust.get(h, 0)) < 1e-9
    assert [out[i].verdict for i in range(7)] == ["block", "block", "block", "allow", "allow", "allow", "allow"]


def test_propagation_settles_on_a_long_chain(spark):
    import numpy as np

    from panelflow.llm.store import Store

    n = 20
    data = [(i, f"http://h{i}.com/p", f'<a href="//h{i + 1}.com/y">z</a>' if i < n - 1 else None) for i in range(n)]
    rules = [url_filters.rule("block", f"h{n - 1}.com/")]
    out = {r.page_id: r for r in url_filters.judge_urls(spark.createDataFrame(data, "page_id long, url string, html string"), rules).collect()}
    links = np.diag(np.ones(n - 1), 1)  # mass of host i + 1 goes to host i
    start = np.zeros(n)
    start[-1] = 1 - url_filters.DAMPING
    want = np.linalg.solve(np.eye(n) - url_filters.DAMPING * links, start)
    assert np.allclose([out[i].distrust for i in range(n)], want, rtol=0, atol=1e-9)
    assert all(out[i].verdict == "block" for i in range(n))
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    with pytest.raises(RuntimeError, match="did not settle"):
        url_filters.propagate(edges, edges.select(F.col("src").alias("host")).where("host = 'a'"), Store(spark, "urls"), steps=5)


PAGE = ("<html><head><title>T</title><style>p{}</style></head><body><header class='site-header'>Logo</header><nav><ul><li><a href=/a>Home</a><li>B</ul></nav>"
        "<div class='cookie-notice'><p>We use cookies.</p></div><article><h1>Big  &amp;\n Title</h1><p>First <b>para</b>graph<br>of it.<p>Second &copy; one."
        "<script>var a='</p>';</script><!-- c --><aside class=related>Other</aside><p></p></article><section id='comments'><p>Nice article.</p></section>"
        "<form><input><label>Mail</label></form><footer>End</footer></body></html>")


def test_blocks():
    texts = [t for _, t, _ in html_blocks.blocks(PAGE)]
    assert texts == ["Logo", "Home", "B", "We use cookies.", "Big & Title", "First paragraph of it.", "Second © one.", "Other", "Nice article.", "Mail", "End"]
    for odd in (None, "", "<", "<p", "a < b", "</p></div>", "<script>x", "<!--", "&am", "<p>" * 2000, "<a><a>x"):
        html_blocks.blocks(odd)
    assert html_blocks.blocks("x &lt;b&gt; &#233;")[0][1] == "x <b> é"


def test_blocks_of_pages_without_the_end_of_the_head():
    want = html_blocks.blocks(PAGE)
    assert html_blocks.blocks(PAGE.replace("</head>", "")) == want
    bare = [t for _, t, _ in html_blocks.blocks(PAGE.replace("</head>", "").replace("<body>", ""))]
    assert bare == [t for _, t, _ in want]
    head = "<head><meta charset=utf-8><title>T</title><noscript><div>no</div></noscript><template><p>no</p></template><script>x</script>"
    for body in ("<p>yes", "<span>yes</span>", "yes", "<br>yes", "<body>yes"):
        assert [t for _, t, _ in html_blocks.blocks(head + body)] == ["yes"], body


def test_extraction(spark):
    rng = random.Random(1)

    def page(i):
        body = "".join(f"<p>{edge.prose(rng, 30)}.</p>" for _ in range(rng.randint(1, 8)))
        return f"<body><nav><li>{edge.prose(rng, 2)}</li></nav><div class='ad'>{edge.prose(rng, 9)}</div><article><h1>{i}</h1>{body}</article><footer>f {i}</footer></body>"

    train = [(i, f"u{i}", page(i)) for i in range(60)]
    odd = [(100, "u", PAGE), (101, None, None), (102, "u", ""), (103, "u", "plain"), (100, "u", PAGE), (None, "u", PAGE)]
    df = spark.createDataFrame(train + odd, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(2)
    model = html_extraction.train(df)
    out = html_extraction.extract(df, model, ["page_id", "url"]).collect()
    assert len(out) == len(train + odd)
    want = {i: "\n\n".join(t for p, t, _ in html_blocks.blocks(h) if "article" in p) for i, _, h in train}
    want |= {100: "Big & Title\n\nFirst paragraph of it.\n\nSecond © one.", None: "Big & Title\n\nFirst paragraph of it.\n\nSecond © one.", 101: "", 102: ""}
    good = sum(r.text == want[r.page_id] for r in out if r.page_id in want)
    assert good == len(out) - 1, [(r.page_id, r.text[:80]) for r in out if r.text != want.get(r.page_id)]
    assert all(r.n_chars == len(r.text) for r in out)
    none = df.limit(0)
    assert html_extraction.extract(none, html_extraction.train(none), ["page_id"]).count() == 0


def test_extraction_of_long_pages_only(spark):
    """Pages of more than 80 kB, one of them most of the table: whole articles come out."""
    rng = random.Random(5)

    def page(i):
        body = "".join(f"<p>{edge.prose(rng, rng.randint(8, 14))}.</p>" for _ in range(1500))
        return f"<body><nav><li>home</li><li>news</li></nav><article><h1>{i} {edge.prose(rng, 4)}</h1>{body}</article><footer><p>{edge.prose(rng, 5)}</p></footer></body>"

    htmls = [page(i) for i in range(6)]
    rows = [(i, h) for i, h in enumerate(htmls)] + [(100 + i, htmls[0]) for i in range(30)]
    assert all(len(h) > 80_000 for h in htmls)
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    model = html_extraction.train(df)
    want = {h: "\n\n".join(t for p, t, _ in html_blocks.blocks(h) if "article" in p) for h in htmls}
    lost = 0
    for r in html_extraction.extract(df, model, ["page_id", "html"]).where("page_id < 6").collect():
        kept, whole = set(r.text.split("\n\n")), want[r.html].split("\n\n")
        lost += sum(t not in kept for t in whole)
        assert kept <= set(whole)
    assert lost <= 6 * 2


def test_stretches_cover_long_pages():
    html = "<body><article>" + "".join(f"<p>t{i}</p>" for i in range(5000)) + "</article></body>"
    some = html_extraction.stretches(html)
    assert [len(s) for s in some] == [html_extraction.STRETCH] * html_extraction.WINDOWS and html_extraction.stretches(html) == some
    assert [int(s[0][1][1:]) for s in some[:2]] == [0, 4820] and html_extraction.stretches(None or "") == []


def test_pages_without_known_containers(spark):
    rng = random.Random(6)
    html = [f"<body><nav><li>home</li></nav><p>{edge.prose(rng, 30)}.</p><p>{edge.prose(rng, 30)}.</p></body>" for _ in range(30)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    out = html_extraction.extract(df, html_extraction.train(df), ["page_id"]).collect()
    assert sum(len(r.text) > 100 and "home" not in r.text for r in out) >= 28


def test_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    model = html_extraction.Labeller([w.astype(np.float64) for w in html_extraction.Labeller.fresh().weights])
    x = rng.random((5, 3, html_extraction.PATH + html_extraction.WORDS + html_extraction.FIGURES))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    y = (rng.random((5, 3)) > 0.5).astype(float)
    _, grads = model.step(x, mask, y)
    for w, g in zip(model.weights, grads):
        at = tuple(rng.integers(0, s) for s in w.shape)
        keep, e = w[at], 1e-3
        w[at] = keep + e
        up = model.step(x, mask, y)[0]
        w[at] = keep - e
        down = model.step(x, mask, y)[0]
        w[at] = keep
        assert abs((up - down) / (2 * e) - g[at]) < 1e-4
