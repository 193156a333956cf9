"""Language, page text, quality, mixing and the pipeline."""

import hashlib
import html
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from attestor.llm import language, mixing, quality, templates
from attestor.llm.frames import crc_mod
from attestor.llm.queries import QUERIES
from attestor.llm.words import Slice

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op2_language_id"](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 150
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def small_model(spark):
    rows = [(1, "the house and the garden", "en", None, 0), (2, "das haus und der garten", "de", None, 0), (3, "nothing", None, None, 0)]
    return language.fit(spark.createDataFrame(rows, DOCS), least=1)


def test_words_come_before_grams(spark):
    model = small_model(spark)
    scorer = language.Scorer(model)
    assert model.languages == ["de", "en"] and "nothing" not in model.words
    assert scorer.text("House")[0] == "en" and scorer.text("HAUS")[0] == "de"
    # Unseen words go by the longest known grams: "<gart" is German, "<garde" English.
    assert scorer.text("gartenzwerg")[0] == "de" and scorer.text("gardening")[0] == "en"
    longest = [model.scores[model.grams[g]] for g in language.grams("gardening", 5) if g in model.grams]
    assert longest and np.allclose(scorer.backoff("gardening"), np.mean(longest, axis=0) * language.BACKOFF)
    shorter = [model.scores[model.grams[g]] for g in language.grams("xgx", 1) if g in model.grams]
    assert not any(g in model.grams for size in (2, 3, 4, 5) for g in language.grams("xgx", size)[1:-1])
    assert shorter and len(scorer.backoff("xgx")) == 2
    assert not scorer.backoff("日").any() or len(language.grams("日", 1)) == 3


def test_language_of_odd_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", None, None, 0), (3, " 12 !? ", None, None, 0), (None, "the the", None, None, 0), (4, "the " * 50_000, "xx", None, 0), (4, "haus", "de", None, 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS held", "2 AS score")
    model = small_model(spark)
    got = [(r.doc_id, r.lang_pred) for r in language.predict(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en"), (4, "de")], key=str)
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_scores_as_plain_loops_and_numbers_are_no_letters(spark):
    rows = [(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, "la casa grande", "es"), (4, "le jardin et la maison", "fr")]
    model = language.fit(spark.createDataFrame([(*r, None, 0) for r in rows], DOCS), least=1)

    def plain(text):
        words, word = [], ""
        for c in (text or "").lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                words, word = [*words, word], ""
        if not words:
            return "und", 0.0
        total = [float(p) for p in model.prior]
        for w in words:
            of = [model.scores[model.words[w]]] if w in model.words else []
            for size in range(5, 0, -1):
                marked = f"<{w}>"
                of = of or [model.scores[model.grams[marked[i : i + size]]] * language.BACKOFF for i in range(len(marked) - size + 1) if marked[i : i + size] in model.grams]
            for k in range(len(total)):
                total[k] += float(sum(s[k] for s in of)) / len(of) if of else 0.0
        odds = [np.exp(t - max(total)) for t in total]
        best = max(range(len(odds)), key=lambda k: (odds[k], -k))
        return model.languages[best], odds[best] / sum(odds)

    texts = ["½ ② ① Ⅷ ³", "²x", "The HAUS of 3 gardens", "xyzzy qqq", "日本", "la", "la la le", "Été ½ jardin", None, "garten-garden " * 3000, "a_b", "٣ 一"]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)] + [(1, texts[1], None, None, 0)], DOCS)
    got = language.predict(docs, model).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        lang, score = plain(texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3), texts[r.doc_id]
    assert {r.lang_pred for r in got if r.doc_id in (0, 8)} == {"und"}


def test_short_texts_of_known_letters_are_accepted(spark):
    rows = [(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, "la casa grande", "es"), (4, "le jardin et la maison", "fr")]
    model = language.fit(spark.createDataFrame([(*r, None, 0) for r in rows], DOCS), least=1)
    texts = ["Re.", "De.", "Erö.", "a", "日本", "12", "日本 the"]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    assert min(r.score for r in language.predict(docs, model).collect() if r.doc_id < 4) < 0.5
    assert {r.text for r in language.accepted(docs, model).collect()} == {"Re.", "De.", "Erö.", "a", "日本 the"}


def test_text_of_the_small_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = QUERIES["op3_page_text"](spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt; only", "plain <text> only"),
        ("<p>One<p>Two &amp; three&nbsp;four<br>five", "One\n\nTwo & three four five"),
        ("<div>a<script>var x='</p>'</script>b<style>p{}</style> c</div>", "a b c"),
        ("<nav>Menu</nav><main><h1>T</h1><header>By</header><p>x <b>y</b>z</p></main><footer>F</footer>", "T\n\nBy\n\nx yz"),
        ("<header>H</header><article><p>A</p><form><p>Send</p></form><div class='comments'><p>First!</p></div></article><aside>S</aside>", "A"),
        ("<article><p title='a > b'>A</p><!-- <p>no</p> --><div id=\"cookie-notice\">C</div></article><article><p>B</p></article>", "A\n\nB"),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>", "x\n\ny\n\n1\n\n2"),
        ("<article><p>unclosed <b>tags <i>here", "unclosed tags here"),
    ],
)
def test_main_text_of_one_page(page, text):
    assert templates.main_text(page or "") == text


def host_page(i):
    return (
        f"<html><body><div><p>Welcome to our site</p><p>Read us daily</p></div><div><ul><li>a{i}</li><li>b</li></ul></div>"
        f"<div><p>Story {i} begins here and goes on</p><p>and ends as number {i * 7}</p></div><div><p>Copyright</p></div></body></html>"
    )


def test_template_of_a_host_without_article_elements(spark):
    rows = [(i, f"http://Host.org:80/{i}", host_page(i), "x") for i in range(12)] + [(50, None, host_page(50), "x"), (51, "nonsense", None, "x"), (0, "http://Host.org:80/0", host_page(0), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = templates.templates(pages).where("host = 'host.org'").first()
    assert found.pages == 13 and len(found.frame) >= 6
    texts = {templates.token_id(templates.Token("t", "/html/body/div/p", t, False, False)) for t in ("Welcome to our site", "Read us daily", "Copyright")}
    assert texts <= set(found.texts)
    got = [(r.page_id, r.text, r.n_chars) for r in templates.extract(pages).collect()]
    want = {i: f"Story {i} begins here and goes on\n\nand ends as number {i * 7}" for i in range(12)}
    assert len(got) == len(rows) and all(t == want[i] and n == len(t) for i, t, n in got if i in want)
    assert ("", 0) in [(t, n) for i, t, n in got if i == 51]
    assert templates.extract(pages.limit(0)).count() == 0


def test_template_decides_inside_article_elements(spark):
    end = "<div><p>Read this free story every day</p></div>"
    page = lambda i: f"<html><body><article><h1>Title {i}</h1>{end if i % 2 else ''}<p>Story {i} goes on</p>{'' if i % 2 else end}</article></body></html>"
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in templates.extract(pages).collect()} == {i: f"Title {i}\n\nStory {i} goes on" for i in range(12)}


def test_classes_keep_one_order_and_nest(spark):
    quote, table = "<blockquote>q</blockquote>", "<table>t</table>"
    page = lambda i: f"<html><body><h1>T</h1>{(quote + table) if i % 2 else (table + quote)}<ul>{'<dl>x</dl>' if i else ''}</ul><p>{i}</p></body></html>"
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    frame = set(templates.templates(pages).first().frame)
    ids = {name: templates.token_id(templates.Token("<", f"/html/body/{name}", "", False, False)) for name in ("h1", "ul", "ul/dl", "blockquote", "table")}
    assert {n for n, i in ids.items() if i in frame} == {"h1", "ul", "ul/dl"}


@pytest.mark.parametrize("long", ["p", "ul", "blockquote", "table", "section"])
def test_nested_parts_of_an_article_without_article_elements(spark, long):
    def page(i):
        size = lambda name: " words" * (40 if name == long else 4)
        parts = {"p": "<p>{}</p>", "ul": "<ul><li>{}</li></ul>", "blockquote": "<blockquote><p>{}</p></blockquote>", "table": "<table><tr><td>{}</td></tr></table>", "section": "<section><p>{}</p></section>"}
        texts = [f"{name} {i}{size(name)}" for name in parts] + [f"end {i}"]
        story = "".join(form.format(text) for form, text in zip(parts.values(), texts, strict=False))
        return f"<html><body><div><p>Site</p><dl><dd>Tip {i}</dd></dl></div><div>{story}<p>{texts[-1]}</p></div><div><p>Seen {i} times</p></div></body></html>", "\n\n".join(texts)

    pages = spark.createDataFrame([(i, f"http://a.org/{i}", page(i)[0]) for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in templates.extract(pages).collect()} == {i: page(i)[1] for i in range(8)}


@pytest.mark.parametrize("copies", [1, 4, 5, 20])
def test_copies_of_a_page_are_no_template(spark, copies):
    rows = [(i, f"http://a.org/{i % 2}", "<html><body><div><p>The story</p><p>goes on</p></div></body></html>") for i in range(copies)]
    rows += [(100 + i, f"http://a.org/{i}", host_page(1)) for i in range(copies > 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in templates.extract(pages).where("page_id < 100").collect()} == {"The story\n\ngoes on"}


def test_pages_that_are_all_there_twice(spark):
    once = [(i, f"http://a.org/{i}", host_page(i).replace("<ul>", "<ul>" if i else "<ol>")) for i in range(12)]
    schema = "page_id long, url string, html string"
    one, two = (templates.templates(spark.createDataFrame(rows, schema)).first() for rows in (once, once + once))
    assert (one.frame, one.texts) == (two.frame, two.texts) and (one.pages, two.pages) == (12, 24)


def test_marks_inside_articles_need_the_host(spark):
    def page(i, more=""):
        head = f'<header class="entry-header"><h1>Title {i}</h1></header>'
        return f'<html><body><article>{head}<div class="long-form"><p>Story {i} goes on</p></div><div id="related"><p>Teaser {i % 2}</p></div>{more}</article></body></html>'

    rows = [(i, f"http://a.org/{i}", page(i, '<div class="notice">Corrected on 1 May</div>' if i == 3 else "")) for i in range(12)] + [(50, "http://b.org/", page(50))]
    got = {r.page_id: r.text.split("\n\n") for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: [f"Title {i}", f"Story {i} goes on", *(["Corrected on 1 May"] if i == 3 else [])] for i in range(12)} | {50: ["Title 50", "Story 50 goes on"]}


def test_marked_wrappers_and_embedded_markup():
    none = frozenset()
    assert templates.main_text('<div class="long-form"><p>A</p><p>B</p></div><nav>N</nav>', none, none, none) == "A\n\nB"
    assert templates.main_text('<div class="share-page"><main><p>A</p></main></div>', none, none, none) == "A"
    assert templates.main_text("<article><p>A <svg/> B</p><p>C <svg width='1' /> D <svg><text>x</text></svg> E</p></article>") == "A B\n\nC D E"
    assert templates.main_text("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> then <math/> end</p><svg><p>F</p></article>") == "If x=2 then end\n\nF"


def test_quality_of_held_out_documents(spark):
    rows = QUERIES["op10_quality"](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    values = rng.random((4000, 3))
    labels = ((values[:, 0] > 0.5) ^ (values[:, 1] > 0.5)).astype(float)
    model = quality.train(values, labels)
    assert (0, 1) in model.pairs
    assert np.mean((quality.score(values, model) > 0.5) == labels) > 0.95
    assert quality.score(values[:0], model).shape == (0,)
    assert np.allclose(quality.score(values, quality.train(values, np.ones(4000))), 4000.5 / 4001)
    total = np.full(10, model.start)
    for row in range(10):  # a score is the sum of its table entries
        for j, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
            total[row] += table[int((edges <= values[row, j]).sum())]
        for (x, y), table in zip(model.pairs, model.pair_tables, strict=True):
            total[row] += table[int((model.pair_edges[x] <= values[row, x]).sum()), int((model.pair_edges[y] <= values[row, y]).sum())]
    assert np.allclose(1 / (1 + np.exp(-total)), quality.score(values[:10], model))


def test_quality_of_odd_rows(spark):
    rows = [(1, None, None, None, 0), (None, "", None, None, 0), (2, "word " * 100_000, None, None, 0), (2, "a", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS held", "5 AS score")
    model = quality.fit(docs.limit(0).selectExpr("doc_id", "text", "1 AS quality"), "quality")
    found = quality.predict(docs, model).collect()
    assert len(found) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in found)
    assert quality.predict(docs.limit(0), model).count() == 0


def test_features_by_hand():
    data = np.frombuffer("Ab ab! ab\nAb ab! ab\n12 zz".encode(), np.uint8)
    got = dict(zip(quality.FEATURES, quality.measure(Slice(0, data, np.array([0, len(data)])))[0], strict=True))
    assert got["words"] == pytest.approx(np.log1p(8)) and got["capitals"] == pytest.approx(2 / 14) and got["digits"] == pytest.approx(2 / 8)
    assert got["distinct_words"] == pytest.approx(4 / 8) and got["top_word"] == pytest.approx(4 / 8) and got["repeated_lines"] == pytest.approx(1 / 3)
    assert got["exclamations"] == pytest.approx(2 / 8) and got["distinct_triples"] == pytest.approx(5 / 6)


def brute_targets(sources):
    """Share by weight, stop at three times the size, share the excess again until nothing is above."""
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, total = {}, sum(sources.values())
    while True:
        free = [s for s in order if s not in target]
        left = total - sum(target.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if shares[s] > 3 * sources[s]]
        if not above:
            return target | shares
        target |= {s: float(3 * sources[s]) for s in above}


def mix_rows():
    rng = np.random.default_rng(9)
    rows, i = [], 0
    for source, n, longest in (("a", 300, 60), ("B", 20, 40), ("é", 5, 30), (None, 40, 300), ("hot", 900, 80), ("blank", 3, 0), ("z", 1, 5000)):
        for _ in range(n):
            words = rng.integers(0, 9, rng.integers(0, longest + 1) if longest < 5000 else 5000)
            rows.append((i if i % 50 else None, " ".join(f"w{w}" for w in words) or (None if i % 2 else " \t"), "en", source, 0))
            i += 1
    return rows


def test_mix_comes_near_its_targets(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "2 AS place", "3 AS shard")
    taken = mixing.mix(docs, shard_words=2000).collect()
    assert len(taken) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want, by_target = brute_targets(sizes), defaultdict(list)
    for r in taken:
        assert 0 <= r.taken <= 3 * r.size
        by_target[r.source_size, round(r.target, 6)].append(r.taken)
    for source, size in sizes.items():
        assert abs(sum(by_target[size, round(want[source], 6)]) - want[source]) <= 3 * mixing.BLOCK_WORDS * (1 + size / 2000)
    again = mixing.mix(docs.repartition(5), shard_words=2000).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in taken)
    assert mixing.mix(docs.limit(0)).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and set(whole.select("text").distinct().toPandas().text) <= {r[1] for r in rows}


def assert_shards_hit(docs, whole, **options):
    """Each shard of each source gives the words that the mix takes of it, but for less than one document."""
    keys = ["weight_rank", "shard"]
    taken = mixing._taken(docs, **options).where("size > 0").toPandas()
    shard_of = {(r.place, r.source): (r.weight_rank, r.shard) for r in taken.itertuples()}
    got = Counter()
    for r in mixing.sizes(whole).collect():
        got[shard_of[r.place, r.source]] += r.size
    for key, rows in taken.groupby(keys):
        assert abs(got[key] - rows.taken.sum()) < max(rows["size"].max(), 1), key
    return len(taken.groupby(keys))


def test_whole_documents_hit_the_words_of_every_shard(spark):
    long = [(9000 + i, f"l{i} " * 700, "en", "long", 0) for i in range(25)]
    equal = [(None, "again " * 30, f"x{i % 3}", "equal", i) for i in range(150)]
    rows = mix_rows() + long + equal + [(None, "again " * 30, "en", "other", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for options in ({}, {"shard_words": 2000}):
        whole = mixing.mixed_documents(docs, **options)
        assert whole.columns == docs.columns and set(whole.collect()) <= set(docs.collect())
        assert assert_shards_hit(docs, whole, **options) > (20 if options else 7)
        again = mixing.mixed_documents(docs.repartition(5), **options)
        assert Counter(again.collect()) == Counter(whole.collect())
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mix_as_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert Counter(connection.execute(mixing.SQL).fetchall()) == Counter(tuple(r) for r in QUERIES["op9_source_mix"](spark, SMALL).collect())


def test_seats_go_to_the_highest_quotients(spark):
    rng = np.random.default_rng(2)
    rows = [(g, p, int(w), int(s)) for g, s in ((1, 0), (2, 7), (3, 100), (4, 1)) for p, w in enumerate(rng.integers(0, 50, 6) ** 2)] + [(5, 0, 0, 3)]
    given = mixing.apportion(spark.createDataFrame(rows, "g long, p long, w long, s long"), ["g"], "p", "w", "s", "won").collect()
    won = {(r.g, r.p): r.won for r in given}
    for g in (1, 2, 3, 4):
        parties = {p: w for gg, p, w, _ in rows if gg == g}
        seats = next(s for gg, _, _, s in rows if gg == g)
        held = dict.fromkeys(parties, 0)
        for _ in range(seats):
            best = max(parties, key=lambda p: (parties[p] / (2 * held[p] + 1), -p))
            held[best] += 1
        assert {p: won[g, p] for p in parties} == held


def test_pipeline_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "bpe"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(None, "the and of the house", None, None, 0), (900_001, None, None, None, None), (900_002, "", "en", None, 0), (900_003, "12 345", "en", "src0", 6), (900_004, "the " * 9000, None, "src0", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, DOCS)).unionByName(docs.where("doc_id < 3"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        after = docs.collect()
        if name == "language":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {900_001, 900_002, 900_003}
            assert Counter(after) == Counter(r for r in before if r.doc_id not in (900_001, 900_002, 900_003))
        elif name == "exact_dedup":
            lowered = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
            largest = defaultdict(lambda: -1)
            for r in before:
                largest[lowered(r.text)] = max(largest[lowered(r.text)], -1 if r.doc_id is None else r.doc_id)
            assert Counter(lowered(r.text) for r in after) == Counter(dict.fromkeys(largest, 1))
            assert all(largest[lowered(r.text)] == (-1 if r.doc_id is None else r.doc_id) for r in after)
        elif name == "near_dedup":
            assert set(after) <= set(before) and len(after) < len(before)
        elif name == "mix":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 4
        if name != "bpe":
            assert docs.columns == columns
    assert docs.columns[:3] == ["doc_id", "n_tokens", "ids"] and all(len(r.ids) == 4 * r.n_tokens for r in docs.collect())
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_run_of_the_pipeline_stage_by_stage(spark):
    from test_llm_dedup import brute_components
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, SMALL).checkpoint()
        if name == "near_dedup":
            texts = {r.doc_id: r.text for r in before.collect()}
            kept = {i for i, (_, _, stays) in brute_components(texts).items() if stays}
            assert Counter(docs.collect()) == Counter(r for r in before.collect() if r.doc_id in kept)
        elif name == "mix":
            assert assert_shards_hit(before, docs)
    library = Tokenizer.from_file(corpus_pipeline.WORD_BPE)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        decoded = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want[r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), decoded] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()) == want


def test_crc_of_ids(spark):
    import zlib

    rows = spark.range(50).selectExpr("id", "id AS doc_id").withColumn("m", crc_mod("doc_id", 4)).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_acceptance_scores_every_text(spark, monkeypatch):
    model, scored = small_model(spark), []
    of = language.Scorer.text
    monkeypatch.setattr(language.Scorer, "text", lambda self, t: scored.append(t) or of(self, t))
    texts = pa.array(["the house", None, "12", "haus und"])
    shared = type("Shared", (), {"value": model})
    kept = [b.column(0).to_pylist() for b in language._accept(shared, 0)(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))]
    assert scored == ["the house", "", "12", "haus und"] and kept == [["the house", "haus und"]]
