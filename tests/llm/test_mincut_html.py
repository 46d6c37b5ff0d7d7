import random
import time
from itertools import product

from quorumlake.llm import mincut_html as mh
from quorumlake.llm.queries import page_digest

SCHEMA = "page_id bigint, url string, html string, text int, n_chars string"
LOREM = "The people of the old town, who had lived there for long, went down to the river. They said that it was cold, and so it was."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- c -->
<div class="cookie-notice">We use cookies, and you agree.</div><article><h1>Head &amp; line</h1>
<p><b>First   one.<br><p>{LOREM} caf&eacute; &#8364;<br/>next</p><div class="ad">Buy now, it is cheap.</div><ul><li>Short</li><li>List</li></ul>
<aside>Side note of the page.</aside><section id="comments"><p>I liked it, great text!</p></section></article>
<form><p>Your mail, please.</p><input><button>Send</button></form><footer>&copy; 2020</footer></body></html>"""


def test_article_without_the_rest():
    text = [b.text for b, _, keep in mh.labelled(PAGE, mh.Classifier()) if keep]
    assert text == ["Head & line", "First one.", f"{LOREM} café € next", "Short", "List"]


def test_page_without_telling_markup(spark):
    plain = "<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>About us</a></div><div><h1>Title here</h1>" + f"<p>{LOREM}</p>" * 4 + "<p>Yes.</p>" + f"<p>{LOREM}</p></div><div><a href=4>Terms</a> | <a href=5>Privacy</a></div></body>"
    docs = spark.createDataFrame([(1, "u", PAGE, 1, "x"), (2, "u", plain, 1, "x")], SCHEMA)
    out = {r.page_id: r.text for r in mh.main_text(docs).collect()}
    assert out[2].split("\n") == ["Title here", *[LOREM] * 4, "Yes.", LOREM]


def test_cut_as_brute_force():
    r = random.Random(1)
    for _ in range(200):
        n = r.randrange(1, 8)
        content, boiler = [r.choice([0, 1, 2.5, 3]) for _ in range(n)], [r.choice([0, 1, 2, 3.5]) for _ in range(n)]
        edges = [(i, j, r.choice([0.3, 1, 2])) for i in range(n) for j in range(i) if r.random() < 0.5]

        def cost(keep, content=content, boiler=boiler, edges=edges):
            return sum(b if k else c for k, c, b in zip(keep, content, boiler, strict=True)) + sum(c for i, j, c in edges if keep[i] != keep[j])

        assert abs(cost(mh.minimum_cut(content, boiler, edges)) - min(map(cost, product([False, True], repeat=n)))) < 1e-6


def test_odd_pages(spark):
    rows = [(1, None, None, 1, "x"), (2, "u", "", 1, "x"), (None, "u", PAGE, 1, "x"), (4, "u", "<p>" * 3000 + LOREM, 1, "x"), (5, "u", "<article>" + f"<p>{LOREM}" * 3000, None, None), (5, "u", "<article>" + f"<p>{LOREM}" * 3000, None, None), (6, "u", "<article>a<<b & c</x></article><!--", 1, "x")]
    out = page_digest(mh.main_text(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[1].text == "" == by[2].text and by[1].n_chars == 0
    assert by[5].text == "\n".join([LOREM] * 3000) and by[5].n_chars == len(by[5].text)
    assert mh.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def kept(html):
    return [b.text for b, _, keep in mh.labelled(html, mh.Classifier()) if keep]


def test_wrappers_and_heads_that_say_nothing_of_the_article():
    want = kept(PAGE)
    assert kept(PAGE.replace("<body>", "<body><form action=a>").replace("</body>", "</form></body>")) == want
    for names in ("wrapper has-sidebar", "site with-header", "content social"):
        assert kept(PAGE.replace("<body>", f'<body class="{names}"><div class="{names}" id=page>')) == want
    assert kept(PAGE.replace("</head>", "")) == want
    neutral = f"<form><div><h1>How they lived in the old town by the river</h1><p>{LOREM}</p><p>{LOREM}</p><p>{LOREM}</p></div></form>"
    assert kept(f"<html><head><title>x</title>{neutral}") == ["How they lived in the old town by the river", LOREM, LOREM, LOREM]


def test_markup_can_lose():
    """Six long paragraphs in a part named by chance are kept; short linked ones there are not."""
    page = f'<div class="story-widget">{f"<p>{LOREM} {LOREM}</p>" * 6}</div>'
    assert len(kept(page)) == 6
    assert kept('<div class="story-widget">' + "<p><a href=x>Buy</a></p>" * 6 + "</div>") == []


def test_surroundings_change_labels():
    found = mh.labelled(f"<div><p>{LOREM}</p><p>{LOREM}</p><p>Yes</p><p>{LOREM}</p></div>", mh.Classifier())
    assert [k for _, _, k in found] == [True] * 4 and [c > 0 for _, c, _ in found] == [True, True, False, True]


def test_query_as_brute_force(spark):
    """On small pages of all kinds of parts, the text is that of a labelling of least cost among all."""
    r = random.Random(3)
    parts = [f"<p>{LOREM}</p>", "<p>Short</p>", "<li>One, two.", '<div class="ad">Buy it now, it is cheap.</div>', "<nav><a href=1>Go</a></nav>", f"<div class=related-items><p>{LOREM}</p></div>", "<h2>A title</h2>", "<div><a href=2>A link</a> and words.</div>"]
    rows = [(i, "u", r.choice(("<body>", "<article>", "<form>")) + "".join(r.choices(parts, k=r.randrange(1, 9))), 1, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    classify = mh.fit(docs)
    flips = 0
    for row in mh.main_text(docs).collect():
        page = mh.blocks(rows[row.page_id][2])
        cost = [classify(x) for x in mh._seen(page)]
        joined = mh.edges(page)

        def total(keep, cost=cost, joined=joined):
            return sum(-c if k else 0 for k, c in zip(keep, cost, strict=True)) + sum(c for i, j, c in joined if keep[i] != keep[j])

        best = min(product([False, True], repeat=len(page)), key=total)
        flips += sum(k != (c > 0) for k, c in zip(best, cost, strict=True))
        got = [k for _, _, k in mh.labelled(rows[row.page_id][2], classify)]
        assert abs(total(got) - total(best)) < 1e-6
        assert row.text == "\n".join(b.text for b, k in zip(page, got, strict=True) if k)
    assert flips > 0


def test_deep_pages_take_time_in_proportion():
    began = time.perf_counter()
    for html in ("<div>" * 100_000 + LOREM, "<div>a" * 30_000 + "</span>" * 30_000, f"<p>{LOREM}<p>x" * 10_000):
        mh.labelled(html, mh.Classifier())
    assert time.perf_counter() - began < 30
