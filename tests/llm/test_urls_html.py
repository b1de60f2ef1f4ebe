"""URL rules against a loop over all rules, and page texts against planted articles."""

import random

from tests.compare import connect, differences
from tidemark.llm import html, urls


def test_query_agrees_with_sql(spark, folder):
    assert differences(spark, connect(folder), "op2_url_filters", folder) == []


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_rules_against_a_loop(spark):
    rng = random.Random(3)
    labels, steps = ["a", "b", "com", "c-d"], ["", "/", "/x", "/x/", "/x/y", "/xy", "/é"]
    rules = {(".".join(rng.choices(labels, k=rng.randint(1, 4))), rng.choice(steps)): rng.choice(["allow", "block"])
             for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    rows = [(None, "n"), ("", "n"), ("no scheme", "n"), ("http://", "n"), ("x://A.COM?q#f", "n")]
    rows += [("h://" + ".".join(rng.choices(labels + ["B"], k=rng.randint(1, 6))) + rng.choice(steps) +
              rng.choice(["", "z", "?q=://", "#/x"]), "n") for _ in range(500)]
    frame = spark.createDataFrame(rows, "url string, host string")
    out = urls.judge_urls(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules), r.url


def test_no_rules_and_no_urls(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    odd = spark.createDataFrame([(None, None, "block"), ("a", "b", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([("http://b.a/x",)] * 3, "url string")
    for rules in (none, odd):
        assert [r.verdict for r in urls.judge_urls(pages, rules).collect()] == ["allow"] * 3
    assert urls.judge_urls(pages.limit(0), odd).count() == 0


PAGE = """<html><head><title>T</title><style>p{x}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>%s
<aside>Also read</aside><section id="comments"><p>First comment, quite long, with, many, commas, and so on and on.</p>
</section><form>Name <input></form><footer>&copy; me</footer></body></html>"""


def test_articles_in_usual_layouts():
    body = "<h1>A&amp;B</h1><p>One,\n  two <b>three</b>.</p><p>Four <i>five<br>six</i><p>Seven &lt; 8"
    want = "A&B\nOne, two three.\nFour five six\nSeven < 8"
    for layout in ("<article>%s</article>", "<main><article>%s</article></main>", "<div class='with-sidebar'>%s</div>",
                   "<div id=content><div class=ad>Buy, now, and, save, a, lot, today</div>%s</div>"):
        assert html.main_text(PAGE % (layout % body)) == want, layout


def test_siblings_tables_and_broken_pages():
    parts = "".join(f"<div><p>{'word, ' * 20}{i}</p></div>" for i in range(3))
    assert html.main_text(f"<body><div class=x>{parts}</div></body>").count("\n") == 2
    assert html.main_text("<article><table><tr><td>a<td>b<tr><td>c</table></article>") == "a\nb\nc"
    assert html.main_text("<article><ul><li>a<li>b</ul>tail &am") == "a\nb\ntail &am"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> </p>") == ""
    assert html.main_text("plain text") == "plain text"
    deep = "<div>" * 3000 + "<p>deep</p>"
    assert html.main_text(deep) == "deep"


def test_wrappers_and_class_words_around_the_whole_page():
    body = "<h1>Title</h1><p>One, two, three and some more words of it.</p><p>Four, five.</p>"
    want = "Title\nOne, two, three and some more words of it.\nFour, five."
    site = "<nav><a href=x>Home</a> <a href=y>News</a></nav>%s<div class='comments'><p>I like it, a lot.</p></div><footer>me</footer>"
    for wrapper in ("<form action=x>%s</form>", "<div class='social-science'>%s</div>", "<div class='login-required'>%s</div>",
                    "<div class='job-search-results'>%s</div>", "<form><div id=related-work>%s</div></form>"):
        for inner in (body, f"<article>{body}</article>", f"<div><div class=promo><p>Buy now</p></div>{body}</div>"):
            assert html.main_text("<body>" + site % (wrapper % inner)) == want, (wrapper, inner)
            assert html.main_text("<body>" + wrapper % (site % inner)) == want, (wrapper, inner)
    assert html.main_text("<body><nav><a href=x>Home</a></nav><div class=menu>a b</div><footer>c</footer>") == ""


def test_short_sections_beside_a_long_one():
    long = "".join(f"<p>{'many words, ' * 30}{i}</p>" for i in range(9))
    page = f"<body><section class=s>{long}</section><section class=s><p>Short end.</p></section></body>"
    assert html.main_text(page).endswith("\nShort end.")
    assert html.main_text("<body><div><p>One.</p></div><div><p>Two.</p></div></body>") == "One.\nTwo."


def test_deep_pages_take_linear_time():
    import time

    begun = time.process_time()
    deep = "".join(f"<div>text {i}, " for i in range(50_000)) + "</p>" * 20_000
    assert html.main_text(deep)
    assert time.process_time() - begun < 4


def test_pages_keep_their_rows_and_columns(spark):
    rows = [(1, "u", "<p>a</p>", "old"), (1, "u", "<p>a</p>", "old"), (None, None, None, None)]
    out = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(out.columns) == ["html", "page_id", "text", "url"]
    assert sorted(r.text for r in out.collect()) == ["", "a", "a"]


def test_articles_of_the_pages_are_whole(spark, folder):
    import re
    from html import unescape

    for r in html.extract_text(spark.read.parquet(f"{folder}/pages.parquet")).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in want if b)
