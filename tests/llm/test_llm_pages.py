"""Page text: hostile markup, and generated hosts whose article text is known."""

import html
import random
import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from attestor.llm import templates

NONE = frozenset()
PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p class=it's>Hello</p>", "Hello"),
        ('<p title="5" tall">Hello</p>', "Hello"),
        ('<p title="a > b" data-x=\'c > d\'>A</p><a href=x>y</a', "A\n\ny"),
        ('<p>A</p><p title="never closed>B</p>', "A\n\nB"),
        ("<p>1 < 2 and <3 <- </p><!-- x > <p>no</p> --><!-->yes<!doctype x>", "1 < 2 and <3 <-\n\nyes"),
        ("<article><video>no video</video><p>a <audio>x</audio>b <object data=x><p>fall</p></object></p><canvas>c", "a b\n\nc"),
        ("<main><p>Story</p><section id='comments' class='comments'><p>Reader 21 writes</p></section></main>", "Story"),
        ("<article><p>Story</p><div class=sidebar>Side 9</div><div class='ad'>Buy</div></article><article class=comment><p>hm</p></article>", "Story"),
        ("<article><p>Story</p><section class='user-comments'><article><p>hm</p></article></section><div class='ad-300x250 top'>Buy</div></article>", "Story"),
        ("<article><h2 class='related-work'>Related work</h2><p class='share-price'>It fell</p><p class='no-comments'>x</p></article>", "Related work\n\nIt fell\n\nx"),
        ("<article><h1>T</h1><div class='promo content'><p>All there is</p></div></article>", "T\n\nAll there is"),
        ("<article class='comments'><p>All there is</p></article>", "All there is"),
        ("<main><header><h1>T</h1></header><blockquote>Q<footer>Who</footer></blockquote><footer>F</footer></main>", "T\n\nQ\n\nWho"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul><dl><dt>x<dd>y<dt>z</dl>", "a\n\nb\n\nc\n\nx\n\ny\n\nz"),
    ],
)
def test_markup_by_the_rules(page, text):
    assert templates.main_text(page, NONE, NONE, NONE) == text


HOSTILE = ['<p a="', "<p a='x>", '<p a=">"', "<", "</", "<!", "<![CDATA[>", "<svg>", "<div>x", "<ul><li>x", "<div class=notice>x", "<p " + "= " * 50, "&amp", "<b><table>x"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_linear_time(piece):
    def seconds(size):
        begun = time.process_time()
        templates.main_text(piece * (size // len(piece)), frozenset([1]), frozenset([2]), NONE)
        return time.process_time() - begun

    small = min(seconds(60_000) for _ in range(2))
    assert seconds(600_000) < max(0.4, 25 * small)


def test_unclosed_elements_take_little_memory():
    tracemalloc.start()
    templates.main_text("<div>" * 100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000


def test_headings_that_all_pages_share_stay_with_their_text(spark):
    def page(i):
        return (
            f"<html><body><article><h1>Dish {i}</h1><p>Story {i}</p><h2>Ingredients</h2><ul><li>{i} eggs</li><li>{i} g of x</li></ul>"
            f"<h2>Method</h2><h3>First</h3><p>Stir {i} times</p><table><tr><th>Energy</th><th>Fat</th></tr><tr><td>{i} kJ</td><td>{i} mg</td></tr></table>"
            f"<h2>Share this</h2><p>Tell your friends</p><h2>About us</h2></article></body></html>"
        )

    pages = spark.createDataFrame([(i, f"http://a.org/{i}", page(i)) for i in range(10, 22)], PAGES)
    want = "Dish {0}|Story {0}|Ingredients|{0} eggs|{0} g of x|Method|First|Stir {0} times|Energy|Fat|{0} kJ|{0} mg"
    assert {r.page_id: r.text for r in templates.extract(pages).collect()} == {i: want.format(i).replace("|", "\n\n") for i in range(10, 22)}


class _Plain(HTMLParser):
    """Block texts outside of left-out elements, by the parser of the standard library; for well-formed pages only."""

    def __init__(self, left_out):
        super().__init__(convert_charrefs=True)
        self.left_out, self.open, self.blocks = left_out, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "meta", "img"):
            self.blocks[-1] += " " if tag == "br" else ""
            return
        self.open.append((tag, tag in ("head", "script", "style", "nav", "form", "aside", "footer") or dict(attrs).get("class") in self.left_out))
        if tag in templates.BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag
        if tag in templates.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if not any(out for _, out in self.open):
            self.blocks[-1] += data

    def text(self):
        return "\n\n".join(b for b in (" ".join(b.split()) for b in self.blocks) if b)


def made_host(rng, articles, n):
    """Pages of one host, each with its article's blocks; whatever else stands there differs from page to page or not."""
    wrap = rng.choice(["article", "main"]) if articles else None
    shared = [f"Shared line {rng.randrange(10**6)} of the host" for _ in range(3)]
    noise = rng.sample(["comments", "ad", "sidebar", "related", "newsletter", "share", "cookie"], 4)
    rows = []
    for i in range(n):
        word = lambda k=6, i=i: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}x{i}" for _ in range(k))
        blocks, parts = [f"{word(4)} & Co"], []
        parts.append(f"<h1>{html.escape(blocks[0])}</h1>")
        for _ in range(rng.randrange(2, 7)):
            form = rng.choice(["<p>{}</p>", "<p><b>{}</b><br></p>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<div>{}</div>", "<p class=lead title='a > b'>{}</p>"])
            blocks.append(word(rng.randrange(8, 30)))
            parts.append(form.format(blocks[-1]))
        if articles:
            for name in noise:
                parts.insert(rng.randrange(1, len(parts) + 1), f'<div class="{name}"><p>{rng.choice([word(5), shared[2]])}</p></div>')
        body = f"<{wrap}>{''.join(parts)}</{wrap}>" if articles else f"<div><div>{''.join(parts)}</div></div>"
        menu = "".join(f"<li><a href=/{k}>{shared[0]} {k}</a></li>" for k in range(3))
        rest = f"<div class='comments'><p>{word(12)}</p></div>" if rng.random() < 0.5 else ""
        rows.append((f"<!doctype html><html><head><title>{word(3)}</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav>{body}{rest}<footer><p>{shared[1]}</p></footer></body></html>", blocks, noise))
    return rows


@pytest.mark.parametrize("articles", [True, False])
def test_generated_hosts(spark, articles):
    rng = random.Random(17 + articles)
    rows, want = [], {}
    for host in range(60):
        for i, (page, blocks, noise) in enumerate(made_host(rng, articles, rng.choice([1, 2, 3, 6, 12]) if articles else rng.choice([6, 12]))):
            number = host * 100 + i
            rows.append((number, f"http://h{host}.org/{i}", page))
            want[number] = "\n\n".join(blocks)
            parser = _Plain({*noise, "comments"})
            parser.feed(page)
            assert parser.text() == want[number]  # another reader finds the same blocks, told which names are noise
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, PAGES)).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, (len(wrong), len(want), got[wrong[0]], want[wrong[0]])


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "http://a.org", ""), (2, "http://a.org/x", "<article><p>A</p></article>"), (2, "http://a.org/x", "<article><p>A</p></article>"), (3, "x", "<p>" + "long " * 200_000)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'h' AS host", "1 AS frame", "2 AS texts", "3 AS marks", "4 AS n_chars")
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in templates.extract(pages).collect()), key=str)
    long = ("long " * 200_000).strip()
    assert got == sorted([(1, "", "", 0), (0, "http://a.org", "", 0), (2, "http://a.org/x", "A", 1), (2, "http://a.org/x", "A", 1), (3, "x", long, len(long))], key=str)
    assert templates.extract(pages.limit(0)).count() == 0
