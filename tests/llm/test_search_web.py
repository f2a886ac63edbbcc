import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm.common import table
from tallyframe.llm.html_pages import labelled_page
from tallyframe.llm.html_text import extract, main_text, marginals, parse, train
from tallyframe.llm.queries import QUERIES
from tallyframe.llm.topk import best, scores_by_term, top_k
from tallyframe.llm.warc import canonical_url, resolve_revisits

SF2 = "/root/testdata/sf0.01"
MODEL = train(map(labelled_page, range(400)))


def brute_top(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append([int(np.floor(256 * x)) for x in v])
    out = []
    for i, vs in ok.items():
        if i % 50:
            continue
        for v in vs[:1]:
            found = [(-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, ws in ok.items() for w in ws if j != i]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k(spark, block):
    r = random.Random(2)
    rows = [(i, [r.choice((0.0, 0.0, r.uniform(-1, 1))) for _ in range(6)]) for i in range(230)]
    rows += [(300, [0.5] * 6), (301, [0.5] * 6), (301, [0.5] * 6), (350, [0.0] * 6), (302, None), (303, [1.0, None]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (None, [1.0] * 6), (306, []), (307, [0.9, 0.9])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, `rank` string")
    got = top_k(df, F.col("vec_id") % 50 == 0, 5, candidate_block=block, query_block=3)
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()) == brute_top(rows)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 128)]


def test_scores_and_selection():
    r = np.random.default_rng(0)
    q, c = r.integers(-3, 4, (70, 9)), r.integers(-3, 4, (50, 9)) * (r.random((50, 9)) < 0.3)
    got = np.concatenate([s for _, s in scores_by_term(q, c, tile=16)])
    assert (got == q @ c.T).all()
    big = np.array([[2**40]]), np.array([[3], [-3]])
    assert next(iter(scores_by_term(*big)))[1].tolist() == [[3 * 2**40, -3 * 2**40]]
    for row in got:
        assert best(row, 7).tolist() == sorted(range(50), key=lambda i: (-row[i], i))[:7]


def expected_text(page):
    """The marked elements' text, by the marks alone."""
    return [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", x))).strip() for x in re.findall(r"<p data-content>(.*?)</p>", page)]


def test_generated_pages_held_out():
    wrong = total = 0
    for seed in range(5000, 5100):
        page = labelled_page(seed)
        nodes = parse(page)
        clean = re.sub(" data-content", "", page)
        p = marginals(parse(clean), MODEL)
        wrong += sum((q >= 0.5) != x.marked for q, x in zip(p, nodes, strict=True))
        total += len(nodes)
        text = main_text(clean, MODEL)
        assert sum(x in text for x in expected_text(page)) >= len(expected_text(page)) - 1
    assert wrong / total < 0.01


def test_marginals_equal_enumeration():
    nodes = parse('<div class="content"><p>some words here</p><div class="ad">buy</div></div>')
    n = len(nodes)
    own, pair = [MODEL.own(x, nodes[0]) for x in nodes], [MODEL.between(x, nodes[x.parent]) for x in nodes]
    own[0] = (1 - 1e-6, 1e-6)
    total, on = 0.0, np.zeros(n)
    for state in np.ndindex(*[2] * n):
        p = np.prod([own[i][s] for i, s in enumerate(state)]) * np.prod([pair[i][state[nodes[i].parent]][state[i]] for i in range(1, n)])
        total += p
        on += p * np.array(state)
    assert np.allclose(marginals(nodes, MODEL), on / total)


def test_query_html_text_on_all_pages(spark):
    """The pages' own structure says what the text is: the article element, which none of them lacks."""
    right = 0
    pages = {x.page_id: x.html for x in table(spark, SF2, "pages").collect()}
    for x in QUERIES["op2_html_text"](spark, SF2).collect():
        article = re.search(r"<article>(.*?)</article>", pages[x.page_id], re.S)[1]
        article = re.sub(r"<(script|style|form|aside|nav)\b.*?</\1>", "\n", article, flags=re.S)
        blocks = [re.sub(r"[ \t\r\n]+", " ", html.unescape(re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>|<br>|<!--.*?-->", lambda m: " " if m[0] == "<br>" else "", b, flags=re.S))).strip() for b in re.split(r"</?(?:p|h\d|div|ul|li|section|blockquote)\b[^>]*>", article)]
        right += x.text == "\n".join(b for b in blocks if b)
        assert x.n_chars == len(x.text)
    assert right == len(pages)


def test_references_are_decoded_in_their_own_text():
    page = "<article><p>a &am<b>p;</b> c<img src=x>d &lt; e < f</p></article>"
    assert main_text(page, MODEL) == "a &amp; cd < e < f".replace("&amp;", "&amp;")


LONG = "plain words of an article that goes on for a while, " * 6


@pytest.mark.parametrize(
    "body,text",
    [
        (f"<p>{LONG}</p><p>{LONG}</p>", [LONG, LONG]),
        (f'<div class="nav"><ul><li><a href="/x">menu</a></li></ul></div><div class="lower"><p>{LONG}</p><p>{LONG}</p></div><div>c 2020</div>', [LONG, LONG]),
        (f'<div class="content-header main"><h1>Title here</h1><p>{LONG}</p></div>', ["Title here", LONG]),
        (f"<article><header><h1>My title</h1></header><p>{LONG}</p></article><footer>foot</footer>", ["My title", LONG]),
        (f'<header><h1>Site</h1></header><article><p>{LONG}</p><p hidden>{LONG}secret</p><div style="display: none">{LONG}none</div></article>', [LONG]),
        (f'<div class="sidebar"><p>{LONG}</p></div><div class="widget"><p>short</p></div>', [LONG]),
        (f'<table><tr><td><a href="/">home</a></td><td><p>{LONG}</p><p>{LONG}</p></td></tr></table>', [LONG, LONG]),
    ],
)
def test_articles_without_hints_or_with_several(body, text):
    page = f"<html><head><title>t</title></head><body>{body}</body></html>"
    assert main_text(page, MODEL) == "\n".join(t.strip() for t in text)


def test_a_page_with_a_paragraph_has_a_text():
    for seed in range(6000, 6150):
        page = re.sub(" data-content", "", labelled_page(seed))
        page = re.sub(r"</?(?:article|main)\b[^>]*>", "", page)
        assert main_text(page, MODEL)


def test_page_details(spark):
    page = "<html><head><title>t</title><style>x</style></head><body><nav><a href=/>menu</a></nav><article><h1>A &amp; B</h1><p>one\n  <b>two</b><p>three &lt;b&gt;<script>no()</script><p> </p></article><footer>f</footer></body>"
    rows = [(1, page), (2, None), (3, ""), (4, "<"), (None, page), (5, "<article>" + "<div>" * 5000 + "deep"), (6, "&#xD800;<p>" * 10)]
    df = spark.createDataFrame([(i, h, "u", "t") for i, h in rows], "page_id long, html string, url string, text string")
    got = {x.page_id: x.text for x in extract(df, keep=("url",)).collect()}
    assert got[1] == got[None] == "A & B\none two\nthree <b>" and got[2] == got[3] == got[4] == ""
    assert extract(df.limit(0)).collect() == []


def test_canonical_urls(spark):
    same = ["http://www.A.com:80/x/?b=2&a=1&utm_source=z#f", "https://a.com/x?a=1&b=2", "HTTPS://user:pw@A.com:443/x/?a=1&b=2"]
    own = ["http://a.com:443/", "https://a.com:80/", "http://a.com/?ref=alpha", "http://a.com/?ref=beta"]
    df = spark.createDataFrame([(x,) for x in [*same, *own, "not a url", None, "http://a.com"]], "u string")
    got = [x[0] for x in df.select(canonical_url(F.col("u"))).collect()]
    assert got == ["a.com/x?a=1&b=2"] * 3 + ["a.com:443", "a.com:80", "a.com?ref=alpha", "a.com?ref=beta", "not a url", None, "a.com"]


RECORDS = "record_id long, url string, date long, kind string, status int, headers map<string,string>, payload_digest string, outcome string, span int"


def test_revisits(spark):
    day = 86_400
    r = lambda i, u, d, kind, status, h, digest=None: (i, u, d, kind, status, h, digest, "x", 0)
    rows = [
        r(1, "http://a.com/p", 10, "response", 200, {"etag": '"1"', "content-length": "5", "age": "1"}, "d1"),
        r(2, "http://a.com/p", 3 * day, "response", 200, {"etag": '"2"'}, "d2"),
        r(3, "http://a.com/p", 4 * day, "response", 404, {"etag": '"3"'}, "d3"),
        r(10, "https://www.a.com/p#x", 11, "revisit", 304, {"etag": 'W/"1"', "content-length": "0", "age": "7"}),
        r(11, "http://a.com/p", 2 * day, "revisit", 304, {"etag": '"1"'}),
        r(12, "http://a.com/p", 5 * day, "revisit", 304, {"etag": '"1"'}),
        r(13, "http://a.com/p", 10, "revisit", 304, {}),
        r(14, "http://a.com/p", 9 * day, "revisit", 304, {}, None),
        r(15, "http://a.com/p", 9 * day, "revisit", 304, {}, "d2"),
        r(16, None, 9 * day, "revisit", 304, {}),
        r(17, "http://a.com/p", None, "revisit", 304, None),
        r(18, "http://b.com", 5, "revisit", 304, {"etag": '"1"'}),
    ]
    got = {x.record_id: x for x in resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    said = {i: (x.refers_to, x.outcome) for i, x in got.items()}
    assert said == {10: (1, "resolved"), 11: (1, "resolved"), 12: (2, "changed"), 13: (None, "missing"), 14: (2, "unchecked"), 15: (2, "resolved"), 16: (None, "missing"), 17: (None, "missing"), 18: (None, "missing")}
    assert got[10].headers == {"etag": 'W/"1"', "content-length": "5", "age": "7"} and got[10].payload_digest == "d1" and got[10].status == 200
    assert got[12].status == 304 and got[12].payload_digest is None
    assert resolve_revisits(spark.createDataFrame([], RECORDS)).collect() == []


def test_revisits_whose_ids_repeat(spark):
    r = lambda i, u, d, kind, h, digest=None: (i, u, d, kind, 200 if kind == "response" else 304, h, digest, "x", 0)
    rows = [
        r(1, "http://a.com/", 1, "response", {"etag": '"a"'}, "da"), r(1, "http://b.com/", 1, "response", {"etag": '"b"'}, "db"),
        r(2, "http://a.com/", 5, "revisit", {"etag": '"a"'}), r(2, "http://b.com/", 5, "revisit", {"etag": '"b"'}), r(2, "http://b.com/", 5, "revisit", {"etag": '"b"'}),
        r(3, "http://a.com/", 2, "response", {"etag": '"a"'}, "x1"), r(3, "http://a.com/", 2, "response", {"etag": '"a"'}, "x2"),
    ]
    got = sorted((x.canonical_url, x.refers_to, x.outcome, x.payload_digest) for x in resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect())
    assert got == [("a.com", 3, "resolved", "x2"), ("b.com", 1, "resolved", "db"), ("b.com", 1, "resolved", "db")]


def test_revisits_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        kind = r.choice(("response", "revisit"))
        rows.append((i, f"http://h.com/{r.randint(0, 6)}", r.randint(0, 400_000), kind, r.choice((200, 200, 500)) if kind == "response" else 304, {}, None, "x", 0))
    got = {x.record_id: x.refers_to for x in resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    full = [x for x in rows if x[3] == "response" and x[4] == 200]
    for x in rows:
        if x[3] == "revisit":
            before = [(f[2], f[0]) for f in full if f[1] == x[1] and f[2] < x[2]]
            assert got[x[0]] == (max(before)[1] if before else None)
