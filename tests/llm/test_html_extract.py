import html
import random
import re

import numpy as np

from weftline.llm import html_extract
from weftline.llm.html_extract import extract_pages, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy &amp; save</div>{}<aside>Related</aside><div id="comments"><p>A reader says hello at some length here.</p></div>
<form><label>Mail</label><input></form><footer>&copy; x</footer></body></html>"""


def page(inner):
    return PAGE.replace("{}", inner)


def test_article():
    inner = "<article><header><h1>Head &lt;1&gt;</h1><p>by someone</p></header><p>One  <b>two</b>\n three&nbsp;&eacute;.<p>Short.<br>next<ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><pre>a\n b</pre><script>no()</script><div class='share'>Share</div></article>"
    assert main_text(page(inner)) == "Head <1>\nOne two three é.\nShort. next\nx\ny\nc1\nc2\na b"


def test_heads_and_layouts():
    assert main_text(page("<article><div class='entry-header'><h1>Head</h1><span>by me</span></div><p>Body.</p></article>")) == "Head\nBody."
    assert main_text(page("<div class='layout has-sidebar'><main><p>Body.</p></main></div>")) == "Body."
    assert main_text(page("<main><p>Body text here.</p><div class='comments'><article><p>A comment.</p></article></div></main>")) == "Body text here."


def test_without_semantic_container():
    body = "".join(f"<p>{'Long sentence of the text number %d. ' % i * 6}</p>" for i in range(5))
    assert main_text(page(f"<div><div id='content'>{body}<p>Ok.</p></div></div>")).split("\n")[-1] == "Ok."
    bare = main_text(f"<html><body><nav>m</nav>{body}<footer>f</footer>")
    assert bare.count("\n") == 4 and "f" != bare.split("\n")[-1]


def test_content_region_holds_the_whole_vote():
    long, short = "word " * 100, "Eight short words that end the whole text."
    assert main_text(f"<html><body><div><h1>Title</h1><p>{long}</p><p>{short}</p></div></body></html>") == f"Title\n{long.strip()}\n{short}"
    # a sibling container with a tenth of the text
    assert main_text(page(f"<div><div><p>{long}</p><p>{long}</p></div><div><p>{short}</p></div></div>")).endswith(f"\n{short}")
    assert main_text(page(f"<ul><li>{long}</li><li>{short}</li></ul>")) == f"{long.strip()}\n{short}"
    assert main_text(f"<div><h1>T</h1><p>{long}</p></div>") == f"T\n{long.strip()}"


def test_several_semantic_containers():
    long, teaser = "word " * 100, "A teaser of some words."
    assert main_text(page(f"<main><p>{long}</p><article><p>{teaser}</p></article></main>")) == f"{long.strip()}\n{teaser}"
    assert main_text(page(f"<main><article><p>{long}</p></article><article><p>{teaser}</p></article></main>")) == f"{long.strip()}\n{teaser}"
    assert main_text(page(f"<article><h1>Head</h1><main><p>{long}</p></main></article>")) == f"Head\n{long.strip()}"
    assert long.strip() in main_text(page(f"<div><p>{long}</p></div><article><p>{teaser}</p></article>"))
    # what stands beside an article that holds the content stays out
    assert main_text(page(f"<div>More</div><article><p>{long}</p></article>")) == long.strip()


def test_broken_and_empty_pages(spark):
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    assert main_text("just text &amp; more") == "just text & more"
    assert main_text("<article><p>cut off <b>in the mid") == "cut off in the mid"
    assert main_text("<article><p>x</p><!-- c --></div></article></article>") == "x"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    rows = [(1, "u", None, 1), (1, "u", "<p>a</p>", 2), (None, None, "<p>a</p>", 3), (1, "u", "<p>a</p>", 2)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", "", 0), (1, "u", "a", 1), (None, None, "a", 1), (1, "u", "a", 1)], key=str)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_table_keeps_the_whole_article(spark, sf_dir):
    """On these pages the article's text is known: its tags stripped by a plain pattern."""
    for r in extract_pages(d := spark.read.parquet(f"{sf_dir}/pages.parquet")).join(d.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?(b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in blocks if x)
        assert r.n_chars == len(r.text)


def test_names_are_matched_whole():
    long = "word " * 60
    for name in ("social-science", "form-factor", "share-price", "long-form", "uncommented", "information", "adventure", "search-results"):
        assert main_text(page(f'<div class="{name}"><p>{long}</p></div>')) == long.strip(), name
    for name in ("comment", "reader-comments", "ad-box", "siteFooter", "nav_list", "social-icons", "cookie-notice", "sidebar-left"):
        assert main_text(page(f'<div><p>{long}</p><div class="{name}"><p>out</p></div></div>')) == long.strip(), name


def test_articles_of_comments_are_left_out():
    long = "word " * 60
    assert main_text(page(f'<main><p>{long}</p><article class="comment"><p>{long} mine</p></article></main>')) == long.strip()
    assert main_text(page(f'<article class="post has-comments"><p>{long}</p></article>')) == long.strip()
    assert main_text(page('<article class="ad"><p>buy</p></article>')) == ""


def test_parts_left_out_of_a_line_do_not_end_it():
    long = "word " * 60
    assert main_text(page(f"<article><p>One <script>no()</script>two <button>Go</button>three.</p><p>{long}</p></article>")).startswith("One two three.\n")
    assert main_text(page(f'<article><p>a <span class="ad">x<div>y</div></span>b</p><p>{long}</p></article>')).startswith("a b\n")
    assert main_text(page(f'<article><p>a <span class="ad">x</p><p>{long}</p></article>')) == f"a\n{long.strip()}"
    assert main_text(page(f"<article><p>a<svg><text>x</text></svg>b<br/>c</p><p>{long}</p></article>")).startswith("ab c\n")


def test_main_with_text_and_articles():
    long = "word " * 60
    got = main_text(page(f"<main><p>Intro {long}</p><article><p>One {long}</p></article><article><p>Two {long}</p></article></main>"))
    assert [x.split()[0] for x in got.split("\n")] == ["Intro", "One", "Two"]


LABELS = "".join(f"<div><b>{x}</b> <i>now</i></div>" for x in "Home News Sport Money Travel Weather Video Radio Shop About".split())


def test_smoothing_and_threshold_choose_the_region(monkeypatch):
    """Unmarked labels stay out and a short line between long ones stays in; with a constant or with no smoothing they don't."""
    long = "".join(f"<p>{'Long sentence of the text number %d. ' % i * 6}</p>" for i in range(4))
    tree = f"<div><div>{LABELS}</div><div>{long}<div><p>Short.</p></div>{long}</div></div>"
    want = main_text(page(tree))
    assert want.split("\n")[4] == "Short." and len(want.split("\n")) == 9
    monkeypatch.setattr(html_extract, "smooth", lambda x: np.ones(len(x)))
    assert "Weather" in main_text(page(tree))
    monkeypatch.undo()
    # two columns of content, of which one has short lines only beside the long ones
    apart = f"<div><div>{LABELS}</div><section>{long}</section><section><p>Last words.</p></section></div>"
    assert main_text(page(apart)).endswith("\nLast words.")
    monkeypatch.setattr(html_extract, "smooth", lambda x: x)
    assert not main_text(page(apart)).endswith("\nLast words.")


def test_menus_are_links_with_a_low_ratio():
    long = "".join(f"<p>{'Long sentence of the text number %d. ' % i * 6}</p>" for i in range(5))
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(12)) + "</ul>"
    facts = "<ul><li>first fact</li><li>second fact</li></ul>"
    got = main_text(f"<html><body><div>{menu}<h1>Head</h1>{long}{facts}{menu}</div></body></html>")
    assert got.startswith("Head\n") and got.endswith("\nfirst fact\nsecond fact")
    assert main_text(page(f"<article>{long}{menu}</article>")).endswith("Section 11")


def generated(rng):
    """A page of nested, named or unnamed boilerplate around known main text."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    want, inner = [], []
    for i in range(rng.randint(3, 12)):
        text = line(40, 120) if i % 3 < 2 else line(1, 6)
        want.append(text)
        marked = text.replace(" ", rng.choice([" ", "\n ", " <!-- x -->", "&#32;"]), 1)
        if rng.random() < 0.3:
            marked = f"<b>{marked}</b>" + rng.choice(["", "<script>f(1<2)</script>", '<span class="ad">no</span>', "<button>Go</button>"])
        inner.append(rng.choice(["<p>{}</p>", "<div><p>{}</p></div>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<p>{}"]).format(marked))
    body = "".join(inner)
    body = rng.choice(['<article class="post">{}</article>', "<main><article>{}</article></main>", '<div class="content">{}</div>', "<section>{}</section>", '<main><div id="social-science">{}</div></main>']).format(body)
    links = lambda n: "".join(f'<li><a href="#">{line(1, 2)}</a></li>' for _ in range(n))
    before = [f"<nav><ul>{links(6)}</ul></nav>", f'<div class="menu-list">{line(4, 30)}</div>', f"<header><h1>{line(2, 4)}</h1></header>", f'<div role="banner">{line(9, 40)}</div>', f"<form>{line(2, 9)}</form>"]
    after = [f"<aside>{line(9, 60)}</aside>", f'<div id="comments"><article class="comment">{line(20, 90)}</article></div>', f"<footer>{line(5, 30)}</footer>", f'<div class="newsletter-box">{line(5, 40)}</div>', f'<section class="related">{links(4)}</section>']
    page = "".join(rng.sample(before, 3)) + body + "".join(rng.sample(after, 3))
    return f"<!DOCTYPE html><html><head><title>{line(2, 5)}</title></head><body><div class='page'>{page}</div></body></html>", "\n".join(want)


def test_generated_pages():
    rng = random.Random(8)
    for _ in range(400):
        source, want = generated(rng)
        assert main_text(source) == want, source


def test_very_long_page(spark):
    paragraph = "<p>" + "many words in a row " * 50 + "</p>"
    source = f"<body><nav>menu</nav><article>{paragraph * 5000}</article><footer>f</footer></body>"
    (r,) = extract_pages(spark.createDataFrame([(1, "u", source)], "page_id long, url string, html string")).collect()
    assert r.text.count("\n") == 4999 and r.n_chars == 5000 * 999 + 4999
