from __future__ import annotations

import html
import re

from roadledger.llm import base, htmltext


def test_articles_of_the_test_tables(spark):
    pages = base.table(spark, "/root/testdata/sf0.01", "pages")
    out = {r["page_id"]: r for r in htmltext.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert out[r["page_id"]]["method"] == "consensus" and " ".join(out[r["page_id"]]["text"].split()) == want


def test_the_host_outvotes_a_page(spark):
    body = "<p>A paragraph of text, long enough to be scored, and then some.</p>"
    usual = f"<body><div class='story-12'>{body * 3}</div><div class='talk'>{body}</div></body>"
    noisy = f"<body><div class='story-7'>{body}</div><div class='talk'>{body * 9}</div></body>"
    rows = [(k, f"https://u@Site.example:80/{k}", usual if k < 5 else noisy) for k in range(6)] + [(9, "https://other.example/", noisy)]
    out = {r["page_id"]: r for r in htmltext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out[5]["path"] == "body>div.story-#" and out[5]["text"].count("paragraph") == 1 and out[5]["host"] == "site.example"
    assert out[9]["path"] == "body>div.talk" and out[9]["text"].count("paragraph") == 9


def test_markup():
    page = htmltext.Page("<DIV Class=\"a 1\" title='x > y'><p>one<p>two<ul><li>three<li>four</ul><!-- no --><script>var a='</p>'</script><br>five &amp; six<table><tr><td>7<td>8</table></div>")
    assert page.text([0]) == "one\ntwo\nthree\nfour\nfive & six\n7\n8"
    assert [page.tag[k] for k in range(len(page.tag))].count("p") == 2 and page.path(1) == "div.#.a"
    assert page.on("div.#.a") == [1]


def test_votes_are_brute_force_sums(spark):
    pages = base.table(spark, "/root/testdata/sf0.001", "pages").selectExpr("split_part(url, '/', 3) AS host", "html")
    sums = {}
    for r in pages.collect():
        for path, share, first in htmltext.votes(r["html"]):
            s = sums.setdefault(r["host"], {}).setdefault(path, [0.0, 0])
            s[0] += share
            s[1] += first
    want = {h: min(p, key=lambda x: (-round(p[x][0], 4), -p[x][1], x)) for h, p in sums.items()}
    assert dict(tuple(r) for r in htmltext.winning_paths(pages).collect()) == want


def test_a_path_has_one_vote_of_a_page_and_all_containers_vote(spark):
    """An article that comes fifth on some pages still adds its shares up, and many small boxes don't outvote it."""
    line = "<p>A paragraph of text, long enough to be scored, and then some.</p>"
    box = lambda name, n: f"<section class='around-{name}'><div class='{name}'>{line * n}</div></section>"
    boxes = lambda names, n: "".join(box(x, n) for x in names)
    a = f"<body>{box('piece', 6)}{boxes('pqrs', 1)}{boxes('z' * 9, 2)}</body>"
    b = f"<body>{boxes('jklm', 4)}{box('piece', 3)}</body>"
    c = f"<body>{boxes('tuvw', 4)}{box('piece', 3)}</body>"
    rows = [(k, f"https://h.example/{k}", page) for k, page in enumerate((a, b, c))]
    paths = {path: share for path, share, _ in htmltext.votes(a)}
    assert paths["body>section.around-piece>div.piece"] == 1_000_000 and 0 < paths["body>section.around-z>div.z"] < 500_000
    assert [p for p, _, _ in htmltext.votes(b)].index("body>section.around-piece>div.piece") == 4
    out = htmltext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["path"] for r in out} == {"body>section.around-piece>div.piece"}
