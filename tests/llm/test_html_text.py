import random

import pytest

from evalgrid.llm import html_text as H

SCHEMA = "page_id long, url string, html string"
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- ad --><div class='ad'>Buy</div>"
    "<article><h1>Head {0}</h1><p><b>First&nbsp;line {0}<br>goes on<p>Second &amp; last</p></article>"
    "<section class='comments'><p>Reader says</p></section><footer>&copy; x</footer></body></html>"
)


def _text(html):
    return H.main_text(html, frozenset())


@pytest.mark.parametrize("html, text", [
    (PAGE.format(1), "Head 1\nFirst line 1 goes on\nSecond & last"),
    ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<div>a <i>b</i>\n c<div>d</div>e</div>", "a b c\nd\ne"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<main><aside>x</aside><header><h1>t</h1></header>y</main>z", "t\ny"),
    ("<header>x</header><p>y</p><form>q</form>", "y"), ("<p>1 < 2 & 3 &lt; 4</p>", "1 < 2 & 3 < 4"),
    ("<article>a</article><p>x</p><article>b</article>", "a\nb"), ("<p>cut <b", "cut"), ("<script>never ends <p>x", ""),
    ("<p title='a > b'>t</p>", "t"), ("<p class='x>lost quote</p><p>u</p>", "lost quote\nu"), ("<div hidden>h</div><div role=navigation>n</div>t", "t"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<div class='page with-sidebar'><article>k</article></div>", "k"),
    ("<div style='overflow: hidden'><p>Body</p></div><p title='hidden gems'>u</p><p data-x='id=notice'>v</p>", "Body\nu\nv"),
    ("<p hidden='until-found'>x</p><p HIDDEN>y</p><p class=a class=ad>z</p><p data-hidden=1>t</p>", "z\nt"),
    ("<article><section id='related-work'>r</section><p class='share-price'>s</p><div class='share-buttons x'>b</div><p class='ad'>c</p></article>", "r\ns"),
    ("<main><section class='comment-list'>c</section><div id='cookie-notice-2'>n</div><p class='header'>h</p></main>", "h"),
    ("<pre>a\n  b</pre>", "a b"), ("</div></p>x</b>", "x"), ("<p>a</p>" * 3000, "\n".join(["a"] * 3000)),
])
def test_text_of_a_page(html, text):
    assert _text(html) == text


def test_deep_markup():
    assert _text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"


def _pages():
    rows = []
    for i in range(12):
        # no article element: what recurs on the host's pages is its template
        html = f"<body><div class='top'>Site name</div><div><h2>Title {i}</h2><p>Story {i}</p><p>Shared by two {i // 2}</p></div><div>Bottom links</div>"
        rows.append((i, f"http://One.example.org/{i}", html))
    rows += [(100 + i, "https://two.example.org/x", PAGE.format("same")) for i in range(8)]
    rows += [(200, None, None), (201, "", ""), (202, "http://three.example.org", "<div class='top'>Site name</div><p>Only page</p>")]
    return rows


def test_templates_are_counted_per_host(spark):
    pages = spark.createDataFrame([(*r, "t") for r in _pages()], SCHEMA + ", text string")
    found = {r.page_id: r for r in H.extract_text(pages).collect()}
    assert len(found) == len(_pages())
    for i in range(12):
        assert found[i].text == f"Title {i}\nStory {i}\nShared by two {i // 2}"
    for i in range(8):
        assert found[100 + i].text == "Head same\nFirst line same goes on\nSecond & last"
    assert found[200].text == found[201].text == "" and found[200].n_chars == 0
    assert found[202].text == "Site name\nOnly page" and found[202].n_chars == len("Site name\nOnly page")
    assert H.extract_text(pages.limit(0)).count() == 0


def test_table_keeps_whole_articles(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = H.op4_html_text(spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text.count("\n") + 1 >= article.count("<p>") / 2 and "<" not in r.text and "\xa9" not in r.text


def test_templates_in_articles_and_text_outside_of_teasers(spark):
    rows = [(i, "http://a.org", f"<article><p>Story {i}</p><div class='x'>Tell friends</div></article>") for i in range(8)]
    rows += [(10 + i, "http://a.org", f"<p>Date {i}</p><article><p>Copied</p><div class='x'>Tell friends</div></article>") for i in range(8)]
    rows.append((30, "http://b.org", "<div>Long story</div><div class='related'><article>A teaser</article></div>"))
    found = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: f"Story {i}" for i in range(8)} | {10 + i: "Copied" for i in range(8)} | {30: "Long story"}


def test_templates_of_one_section_of_a_large_host(spark):
    # 6 of 60 pages: too few to be a share of the host, and enough pages
    rows = [(i, "http://a.org/x", f"<div><p>Story {i}</p></div>" + ("<div>Section links</div>" if i < 6 else "")) for i in range(60)]
    # what articles quote of each other is text until it stands in a share of the host's pages
    rows += [(100 + i, "http://a.org/y", f"<article><p>Own {i}</p><p>Quoted by six</p></article>") for i in range(6)]
    found = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: f"Story {i}" for i in range(60)} | {100 + i: f"Own {i}\nQuoted by six" for i in range(6)}


def test_templates_against_brute_force(spark):
    """Pages of random parts: the templates of each page as counted in plain Python from the parts they were made of."""
    rng = random.Random(7)
    rows, made = [], []
    for i in range(300):
        host = rng.choice("aaab")
        parts = [f"part {int(rng.expovariate(0.15))}" for _ in range(rng.randint(1, 6))]
        marked = rng.random() < 0.5
        made.append((host, parts, marked))
        body = "".join(f"<div>{p}</div>" for p in parts)
        rows.append((i, f"http://{host}.org/{i}", f"<article>{body}</article>" if marked else body))
    pages, stands = {}, {}
    for host, parts, marked in made:
        pages.setdefault(host, set()).add((marked, tuple(parts)))
        for p in parts:
            stands.setdefault((host, marked, p), set()).add(tuple(parts))
    expected, decided = {}, 0
    for i, (host, parts, marked) in enumerate(made):
        least = max(H.LEAST_PAGES, H.SHARE * len(pages[host]) if marked else 0)
        expected[i] = "\n".join(p for p in parts if len(stands[host, marked, p]) < least)
        decided += expected[i] != "\n".join(parts)
    found = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == expected and decided > 50
