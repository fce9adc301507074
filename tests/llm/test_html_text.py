import html as h
import random
import re

import tarn.llm.html_text as html_text_module
from tarn.llm.html_text import extract, html_text

LONG = "This is the first paragraph of the story and it has a lot of words that are in the list of common ones."


def text(page):
    return extract(page)[0]


def test_plain_article():
    page = f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=\"ad\">Buy {LONG}</div><article><h1>Head &amp; tail</h1><p><b>One.<br><p>{LONG}</p><p>Be.</p></article><footer>&copy; {LONG}</footer>"
    assert text(page) == f"Head & tail\nOne.\n{LONG}\nBe."


def test_set_aside():
    page = f"""<body><header><h1>Site</h1></header><main><div class=cookie-notice>{LONG}</div><h2>Name</h2><p>{LONG} 1 &lt; 2</p>
    <aside>{LONG}</aside><form><p>{LONG}</p></form><p>x&nbsp;&nbsp; y</p><section id="comments"><article class="comment"><p>{LONG}</p></article></section></main></body>"""
    assert text(page) == f"Name\n{LONG} 1 < 2\nx y"


def test_without_article_tag():
    page = f"<body><ul><li><a href=1>One link of the menu and</a><li><a href=2>Another link in the menu</a></ul><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>All rights reserved 2020</p><div class=footer>{LONG}</div>"
    assert text(page).startswith(f"Title\n{LONG}\nShort.\n{LONG}")


def test_names_inside_an_article():
    page = f"""<body><article><p>{LONG}</p><p class="notice-board-story">A notice on the board.</p><div class="related-work"><p>Related work is here.</p></div>
    <div class="related-posts"><p>{LONG}</p></div><div class="ad-slot-3"><p>{LONG}</p></div><p class="advert">Buy.</p><p>{LONG} End.</p></article></body>"""
    assert text(page) == f"{LONG}\nA notice on the board.\nRelated work is here.\n{LONG} End."


def test_links_inside_an_article():
    """Short linked items take their neighbours' label: good beside the story, bad beside a run of link text."""
    menu = "<p><a href=x>Products Prices Downloads Company Careers Press Partners Investors Locations Imprint</a></p>"
    page = f"<body><article><p>{LONG}</p><ul><li><a href=1>First source</a></li><li>And <a href=2>second source</a></li></ul><p>{LONG} 2</p>{menu}<p><a href=3>More</a></p>{menu}</article></body>"
    assert text(page) == f"{LONG}\nFirst source\nAnd second source\n{LONG} 2"
    # with one decided block of each kind the nearer one counts
    page = f"<body><main><p>{LONG}</p><p>Near the story.</p><p>Also near.</p><p>Far.</p><p>Far as well.</p>{menu}</main></body>"
    assert text(page) == f"{LONG}\nNear the story.\nAlso near."


def test_neighbours_outside_an_article():
    menu = "<p><a href=x>Products</a> <a href=y>Prices</a></p>"
    page = f"<body>{menu}<p>Loose words</p>{menu}<h2>A title</h2><p>{LONG}</p><p>Between.</p><p>{LONG} 2</p><p>After.</p>{menu}</body>"
    assert text(page) == f"A title\n{LONG}\nBetween.\n{LONG} 2"


def test_stop_words_decide():
    """A long block without common words is open; beside nothing good it goes, with common words it stays."""
    plain = "Zinc copper nickel cobalt chrome titanium vanadium iridium osmium rhodium palladium silver."
    assert text(f"<body><div><p>{LONG}</p></div><p><a href=1>Menu</a></p><p>{plain}</p><p><a href=1>Menu</a></p></body>") == LONG
    assert text(f"<body><div><p>{LONG}</p></div><p>{plain}</p><p>{LONG} 2</p></body>") == f"{LONG}\n{plain}\n{LONG} 2"


def test_long_page_and_repeated_rows(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", "")]
    got = sorted((r.page_id or 0, r.n_chars) for r in html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(0, 0), (1, 20_000 * (len(LONG) + 1) - 1), (1, 20_000 * (len(LONG) + 1) - 1), (2, 0)]


def test_hidden_is_an_attribute():
    page = f"""<article><p title="the hidden cost of x">{LONG}</p><p hidden>{LONG} no</p><p HIDDEN="">{LONG} no</p><p data-x=1 style="Display: none">{LONG} no</p>
    <p class="hidden cost">{LONG} 2</p><p title='a "hidden" b' data-hidden>{LONG} 3</p></article>"""
    assert text(page) == f"{LONG}\n{LONG} 2\n{LONG} 3"


def test_words_inside_a_paragraph_stay():
    page = f"""<article><p>{LONG}</p><p>The <span class="alert">fire</span> and the <em class="related">kin</em> of a <a class="tag" href=x>tagged</a> one,
    <span hidden>not this</span><b class="comment" id="ad">which</b> <i style="display:none">nor</i><i aria-hidden="true">this</i> stays.</p></article>"""
    assert text(page) == f"{LONG}\nThe fire and the kin of a tagged one, which stays."


def test_beside_an_article():
    """Good text that joins the article stays; what is apart, short, linked or set aside goes."""
    menu = "<p><a href=x>Products Prices Downloads Company Careers</a></p>"
    page = f"<body><p>{LONG} 0</p>{menu}<h1>Site</h1><p>{LONG} 1</p><article><h2>T</h2><p>{LONG} 2</p></article><div><p>{LONG} 3</p></div><p>Short.</p><p>{LONG} 4</p></body>"
    assert text(page) == f"{LONG} 1\nT\n{LONG} 2\n{LONG} 3"
    page = f'<body><div class="ad">{LONG}</div><article><p>{LONG} 2</p></article><aside>{LONG}</aside><p>{LONG} 3</p></body>'
    assert text(page) == f"{LONG} 2"


def test_containers_without_an_article():
    """A short last paragraph belongs to the container of the good text before it, a short footer does not."""
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div>Buy now.</div><div><h1>T</h1><p>{LONG}</p><p>The end.</p></div><div>&copy; 2020 a.example.com</div></body>"
    assert text(page) == f"T\n{LONG}\nThe end."


def test_pages_without_an_article(spark):
    """With the article and the menu as plain containers the two passes find the same text on all given pages.

    (An advert or a footer of plain sentences can only be told by its tag or class.)
    """
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    same = decided = 0
    for page in pages:
        bare = re.sub(r"<(/?)(?:nav|article)\b[^>]*>", r"<\1div>", page)
        same += text(bare) == text(page)
        decided += sum(not b.dropped for b in html_text_module.blocks_of(bare))
    assert decided > 4000 and same == len(pages), (same, decided, len(pages))


def brute_labels(kinds):
    """The second pass on a page without an article, by looking outwards from every block: kinds are (label, parent)."""
    out = []
    for i, (label, parent) in enumerate(kinds):
        if label:
            out.append(label)
            continue
        left = next((k for k in kinds[:i][::-1] if k[0]), (-1, -1))
        right = next((k for k in kinds[i + 1 :] if k[0]), (-1, -1))
        if left[0] == right[0] == 1:
            out.append(1)
            continue
        good, bad = (left, right) if left[0] == 1 else (right, left)
        out.append(1 if good[0] == 1 and good[1] == parent != bad[1] else -1)
    return out


def test_second_pass_by_brute_force():
    r = random.Random(3)
    for _ in range(500):
        kinds = [(r.choice((-1, 0, 0, 1)), r.randrange(3)) for _ in range(r.randrange(1, 12))]
        if 1 not in brute_labels(kinds):
            continue
        blocks = [html_text_module.Block(parent=p) for _, p in kinds]
        assert html_text_module._outside(blocks, [x for x, _ in kinds]) == brute_labels(kinds)


def test_broken():
    assert text(None) == text("") == text("<") .replace("<", "") == ""
    assert text("<p>a < b <!-- never ends <p>c") == "a < b"
    assert text("<p>a<script>x") == "a"
    assert text("just text") == "just text"
    assert text("<div" * 50) is not None
    assert text('<p title="a>b">hello</p>') == "hello"


def test_pages(spark):
    """On the given pages the result equals the article element with its tags taken away."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in df.select("page_id", "html").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want[r.page_id] = "\n".join(x for x in parts if x)
    rows = html_text(df.withColumn("text", df.url).withColumn("n_chars", df.url)).collect()
    bad = [r.page_id for r in rows if r.text != want[r.page_id] or r.n_chars != len(r.text)]
    assert len(rows) == len(want) and not bad, bad[:5]
    assert html_text(df.limit(0)).count() == 0
