"""Main text of planted pages, broken markup and edges; the DOM sums against a plain recursive count."""

import html
import math
import random

import pytest

from assayloom.llm.extraction import Page, _densities, extract, main_text

SCHEMA = "page_id long, url string, html string, tag string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def planted(seed):
    """A page with every kind of boilerplate around an article, and the article's blocks."""
    rng = random.Random(seed)
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{k}'>{rng.choice(WORDS)} {k}</a>" for k in range(n)) + "</ul>"
    blocks = [sentence(rng, 6) + " & <more>"] + [sentence(rng, rng.randrange(3, 80)) for _ in range(rng.randrange(3, 9))]
    body = f"<h1>{html.escape(blocks[0])}</h1>"
    for k, b in enumerate(blocks[1:]):
        body += rng.choice(["<p>{}</p>", "<p>\n  {}", "<p><em>{}</em><br></p>", "<div>{}</div>"]).format(b.replace(" ", rng.choice([" ", "\n ", "&nbsp;", " <b></b>"]), 1))
        if rng.random() < .3:
            body += rng.choice(['<div class="ad-slot">Buy this now, it is a very good thing to buy indeed.</div>', "<script>if (a < b) { '</p>' }</script>", "<!-- <p>no</p> -->"])
    wrap = rng.choice(["<article>{}</article>", '<main><div class="post">{}</div></main>', '<div id="content"><div class="entry">{}</div></div>',
                       '<div class="layout with-sidebar"><section>{}</section></div>'])
    around = ["<nav>" + links(7) + "</nav>", "<header><a href='/'>Site</a><p>Our motto is that all is well today.</p></header>",
              "<aside><p>" + sentence(rng, 30) + "</p></aside>", '<div class="cookie-notice"><p>' + sentence(rng, 20) + "</p></div>",
              '<form><p>' + sentence(rng, 9) + "</p><input name=q><button>Go</button></form>", '<div class="relatedPosts">' + links(5) + "</div>",
              "<style>p { margin: 0 }</style>", '<div role="complementary">' + sentence(rng, 12) + "</div>", "<div hidden>" + sentence(rng, 40) + "</div>"]
    rng.shuffle(around)
    after = ['<section id="comments">' + "".join(f'<article class="comment"><p>{sentence(rng, 25)}</p></article>' for _ in range(rng.randrange(1, 9))) + "</section>",
             "<footer>&copy; Site " + sentence(rng, 6) + "</footer>"]
    page = "<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8></head><body class='home has-sidebar'>" + "".join(around[:5]) + wrap.format(body) + "".join(around[5:] + after)
    return page + ("</body></html>" if rng.random() < .7 else ""), [" ".join(b.split()) for b in blocks]


@pytest.mark.parametrize("seed", range(60))
def test_planted_articles_are_found_whole(seed):
    page, blocks = planted(seed)
    assert main_text(page) == "\n\n".join(blocks)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<nav><a href=x>only a menu</a></nav>", ""), ("plain words only", "plain words only"),
    ("<p>one<p>two &amp; &#51;&nbsp;&nbsp;x<br>y", "one\n\ntwo & 3 x y"), ("<p>a &lt;b&gt; &amp;lt; c", "a <b> &lt; c"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<p>open <b>bold<p>next</b> word</i></p></div>", "open bold\n\nnext word"),
    ("<ul><li>one<li>two</ul>", "one\n\ntwo"), ("<p>x</p><script>never ends <p>y", "x"), ("<p>x<!-- never ends <p>y", "x"), ("<p title='a > b' class=\"q\">kept", "kept"),
    ("<P>Big <SPAN>case</SPAN></P>", "Big case"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<p>t<wbr>ail</p>", "tail"), ("<p>end <", "end <"),
])
def test_markup(page, text):
    assert main_text(page) == text


def test_densities_against_a_recursive_count():
    page = Page("<div><p>abc <a href=x>de</a></p><p>fgh ij</p><ul><li><a>k</a><li>lm</ul></div><div class=ad>no</div><p>z")

    def below(k):
        kids = [j for j in range(len(page.tag)) if page.parent[j] == k and not page.drop[j]]
        own = sum(len("".join(t.split())) for n, t in page.pieces if n == k and t)
        link = lambda j: j > 0 and (page.tag[j] == "a" or link(page.parent[j]))
        c, lc, t, lt = own, own if link(k) else 0, 0, 0
        for j in kids:
            a, b, d, e = below(j)
            c, lc, t, lt = c + a, lc + b, t + d + 1, lt + e + (page.tag[j] == "a")
        return c, lc, t, lt

    density, sums, _ = _densities(page)
    total, linked, _, _ = below(0)
    for k in range(len(page.tag)):
        if page.drop[k]:
            assert density[k] == 0
            continue
        c, lc, t, lt = below(k)
        t, lt = max(t, 1), max(lt, 1)
        want = c / t * math.log(c / max(lc, 1) * t / lt) / max(math.log(math.log(c / max(c - lc, 1) * lc + linked / total * c + math.e)), 0.05) if c else 0
        assert density[k] == pytest.approx(want)
        assert sums[k] == pytest.approx(sum(density[j] for j in range(len(page.tag)) if page.parent[j] == k))


def test_long_and_deep_pages_take_linear_time():
    words = "word " * 200_000
    assert main_text(f"<article><p>{words}</p></article>") == " ".join(words.split())
    assert main_text("<div>" * 30_000 + "<p>deep text here</p>") == "deep text here"
    assert main_text("<p>text</p>" + "<x " * 50_000).startswith("text")
    assert main_text("<b>" * 30_000 + "bold" + "</i>" * 30_000) == "bold"


def test_rows_are_kept_as_they_are(spark):
    rows = [(1, "u", "<p>one</p>", "x"), (1, "u", "<p>one</p>", "x"), (None, None, None, None), (2, None, "", "y"), (3, "w", "<p>\U0001F600 é</p>", None)]
    got = extract(spark.createDataFrame(rows, SCHEMA), ["page_id", "url", "tag"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "x", "one", 3)] * 2 + [(None, None, None, "", 0), (2, None, "y", "", 0), (3, "w", None, "\U0001F600 é", 3)], key=repr)
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        extract(spark.createDataFrame([], SCHEMA + ", text string"), ["text"])
