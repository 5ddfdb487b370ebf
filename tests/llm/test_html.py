import re
from html import unescape

from quarry.llm.html_blocks import blocks_of, parse
from quarry.llm.html_text import main_text, op1_template_free_text
from tests.conftest import SF


def brute(html):
    """The article of a page of the test tables, by its known form."""
    art = re.search(r"<article>(.*)</article>", html or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", art[1])) if art else []
    return "\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)


def test_pages_match_their_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op1_template_free_text(spark, SF).collect()
    assert len(got) == len(pages)
    whole = 0
    for r in got:
        if "</article>" in pages[r.page_id].html:
            whole += 1
            assert r.text == brute(pages[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
    assert whole > 10


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="menu">
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div id="side-bar">side</div><div class='cookie-notice'>We use cookies</div>
<main><article class=post><header><h1>Title &amp; more</h1><p>by someone</p></header><p>First   para<br>goes &lt;on&gt;<p>Second <b>bold</i> text</b>
<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><div class="advert">Buy</div><form>in</form><script>var x="</p>"</script>5 < 6 &copy 2024</article>
<section id=comments><p>Nice post!</p></section></main><footer>foot</footer></body></html>"""


def test_one_page(spark):
    rows = [(1, "http://u:p@A.example:80/x", PAGE), (2, None, None), (3, "http://b.example/", ""), (4, "nonsense", "<p>plain <a href=x>mostly</a> text here</p><ul><li><a href=1>link one</a></li></ul>"), (4, "nonsense", "<p>x</p>"), (None, "x", "<p>y" + " long" * 50_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = main_text(df).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.n_chars): r for r in got}
    one = next(r for r in got if r.page_id == 1)
    assert one.text == "Title & more\nFirst para goes <on>\nSecond bold text\none\ntwo\na b\n5 < 6 © 2024" and one.host == "a.example"
    assert (2, 0) in by and (3, 0) in by
    assert {r.text for r in got if r.page_id == 4} == {"plain mostly text here", "x"}
    assert next(r for r in got if r.page_id is None).n_chars == 1 + 5 * 50_000
    assert main_text(df.limit(0)).count() == 0


def test_templates_go(spark):
    rows = [(i, "http://t.example/" + str(i), f"<div>Welcome to our site</div><div><p>Body {i} of this page.</p><p>Shared line</p></div><div>All about us</div>") for i in range(8)]
    rows += [(100 + i, f"http://n{i}.example/", "<div>Welcome to our site</div><p>Own</p>") for i in range(8)]
    rows += [(200 + i, "http://s.example/", f"<article><div>Share this</div><p>Passage in common.</p><p>Own {i}</p></article>") for i in range(8)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Body 3 of this page."
    assert got[103] == "Welcome to our site\nOwn"
    assert got[203] == "Passage in common.\nOwn 3"


def test_broken_pages():
    for t in ("<", "<a", "<p", "<!--", "<div class='x", "</p></p>", "<![CDATA[ x ]]>", "<script>", "<p/>x", "a<b>c" * 2000 + "</b>" * 50, "<div>" * 3000 + "x"):
        blocks_of(t)
    assert blocks_of("<p>a<div>b</p>c</div>d") == ["a", "b", "c", "d"]


def texts(spark, rows):
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_boxes_in_articles_go_and_shared_passages_stay(spark):
    legal = "<p>" + "Legal words that stand on all pages of this site. " * 9 + "</p>"
    page = lambda i: f"<article><p>Own {i}</p><div class=x>{legal}</div>" + "".join(f"<p>Line {i}, {k} of the text itself, which is longer than the box above.</p>" for k in range(12))
    quote = "<blockquote><p>A passage that some pages quote.</p></blockquote>"
    rows = [(i, f"http://box.example/{i}", page(i) + "<p>before</p>" * i + (quote if i % 5 == 0 else "") + "<p>after</p>" * i + "</article>") for i in range(40)]
    got = texts(spark, rows)
    assert all("Legal words" not in t and f"Own {i}" in t and f"Line {i}, 11" in t for i, t in got.items())
    assert all("some pages quote" in got[i] for i in range(0, 40, 5))


def test_copies_and_hosts_of_any_size(spark):
    copy = "<div><p>First paragraph of the page.</p><p>Second paragraph of the page.</p></div>"
    rows = [(i, f"http://copy.example/{i}", copy) for i in range(5)]
    same = lambda i: f"<p>{i}</p><div>{''.join(f'<p>Paragraph {k} of a page with near copies.</p>' for k in range(5))}</div><div>Foot</div>"
    rows += [(100 + i, f"http://near.example/{i}", same(i) if i < 8 else f"<p>Text {i} of a page of its own.</p><div>Foot</div>") for i in range(60)]
    rows += [(1000 + i, f"http://big.example/{i}", f"<p>Text {i} of a page of its own.</p>" + ("<div>Rare promotion</div>" if i < 40 else "")) for i in range(1200)]
    got = texts(spark, rows)
    assert all(got[i] == "First paragraph of the page.\nSecond paragraph of the page." for i in range(5))
    assert all("Paragraph 4" in got[100 + i] and "Foot" not in got[100 + i] for i in range(8))
    assert got[150] == "Text 50 of a page of its own." and got[1003] == "Text 3 of a page of its own."


def test_names_alone_kill_no_article(spark):
    bodies = [
        "<div class='site has-sidebar'><article><p>Body text.</p></article></div>", "<div class='elementor-widget widget'><p>Body text.</p></div><p>x</p>", "<article class='post no-comments'><p>Body text.</p></article>",
        "<div class='page header'><main><p>Body text.</p></main></div>", "<article><p>Body text.</p></article><div class=comments><article><p>Nice!</p></article></div>",
    ]
    got = texts(spark, [(i, f"http://n{i}.example/", b) for i, b in enumerate(bodies)])
    assert [got[i].replace("\nx", "") for i in range(5)] == ["Body text."] * 5


def test_templates_go_where_names_say_nothing(spark):
    menu, foot = "<div class=q1><span>Start</span> <span>Wares</span></div>", "<div class=q2><p>Street 5, Town. All prices with tax.</p></div>"
    rows = [(i, f"http://plain.example/{i}", f"{menu}<div class=q3><p>Text {i} of the page, in words of its own.</p></div>{foot}") for i in range(9)]
    rows += [(100 + i, "http://tags.example/", f"<nav>Menu</nav><p>Text {i}.</p>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (1 << 20, 0):  # templates by broadcast, and by join
        got = {r.page_id: r for r in main_text(df, most_templates=most).collect()}
        assert all((got[i].text, got[i].n_template, got[i].n_rules) == (f"Text {i} of the page, in words of its own.", 2, 0) for i in range(9))
        assert all((got[100 + i].text, got[100 + i].n_template, got[100 + i].n_rules) == (f"Text {i}.", 0, 1) for i in range(2))


def test_deep_pages_take_linear_time():
    import time

    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        page = parse("<div class=menu-x>x<b>" * n + "</i>" * n)
        page.judge_names()
        keys, _ = page.keys(b"h")
        took.append(time.process_time() - began)
        assert len(keys) == n and sum(map(len, keys.values())) == n
    assert took[1] < 8 * 4 * took[0] + 1
