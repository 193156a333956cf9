"""Benchmark decontamination by a positional inverted index, DataFrame functions only.

The index is a table of postings: one row ``term, doc, print, pos`` per token of the training texts (on
request only of given terms, so that a search for a test set stores no other lists). A test item is cut
into phrases, its windows of consecutive words. For an exact match the phrase's terms are put in order of
how often they occur; the rarest term's list gives candidate starts (position less the term's offset),
the next-rarest list is intersected with them at its own offset, and so on. When only the ``LISTS``
rarest are through, few candidates are left: then all other lists are intersected at once, from the
postings of the documents that are left. For proximity, the rarest term's occurrences are met with the
other terms' within a span.

Lists meet on (term, document, position), so a frequent term or a long document is spread over all
tasks. Terms are words themselves, not hashes, and matches are exact. A document is known by its
``doc_id`` and a hash of id and text, so repeated ids do not mix. Phrases, items and their terms are
tables; Spark broadcasts one only where it finds it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from attestor.llm.frames import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: So many lists are intersected one by one, the rarest first; the rest together.
LISTS = 2

_DOC = ("doc", "print")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column | str = "text") -> Column:
    """The text with A-Z lower-cased; NULL is empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _UPPER, _LOWER)


def words(text: Column | str = "text") -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def named(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``doc, print``: the id (0 for NULL) and a hash of id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.withColumns({"doc": F.coalesce("doc_id", F.lit(0).cast("long")), "print": F.xxhash64("doc_id", "text")})


def index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings ``term, doc, print, pos`` of the words of all whole texts, stored in the shared folder.

    ``terms`` (one column ``term``) restricts the index to these words. Positions count all words from 0.
    Repeated rows give repeated postings, which searches count once.
    """
    tokens = named(docs).select(*_DOC, F.posexplode(words()).alias("pos", "term"))
    if terms is not None:
        tokens = tokens.join(terms.select("term").distinct(), "term", "left_semi")
    return stored(tokens.select("term", *_DOC, "pos"), "postings")


def phrases(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of ``items`` (``item_id``, ``text``) and which items they are from.

    First ``phrase, terms`` (a number, its words in order), then ``phrase, item`` (the id as text, empty for
    NULL). An item of fewer words is one window, one without words has none.
    """
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))), lambda i: F.slice("w", i, window))
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words().alias("w")).where("size(w) > 0")
    rows = stored(rows.select("item", F.explode(cut).alias("terms")).distinct(), "windows")
    # Numbers of a written table stay the same however often it is read.
    all_phrases = stored(rows.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    return all_phrases.select("phrase", "terms"), rows.join(all_phrases, "terms").select("phrase", "item")


def by_rarity(postings: DataFrame, all_phrases: DataFrame) -> DataFrame:
    """``phrase, rank, term, offset, n_terms``: a phrase's terms, the rarest in the index first.

    Phrases with a word that occurs nowhere are left out, as they cannot match.
    """
    # Lists, as tables, have a known size: small ones are sent to all tasks, and the postings stay where they are.
    met = stored(postings.groupBy("term").agg(F.count(F.lit(1)).alias("met")), "frequencies")
    at = all_phrases.select("phrase", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("offset", "term")).join(met, "term")
    inside = Wd.partitionBy("phrase")  # as many rows as a phrase has words
    at = at.withColumn("rank", F.row_number().over(inside.orderBy("met", "offset")) - 1).withColumn("found", F.count(F.lit(1)).over(inside))
    return stored(at.where("found = n_terms").select("phrase", "rank", "term", "offset", "n_terms"), "rarity")


def _list(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of some terms."""
    return postings.join(terms.select("term").distinct(), "term", "left_semi")


def exact_matches(postings: DataFrame, all_phrases: DataFrame, lists: int = LISTS) -> DataFrame:
    """``doc, print, phrase, start, n_terms``: every place where a phrase's words stand one after the other.

    ``postings`` must hold all terms of the phrases. One row per distinct document, phrase and start.
    """
    asked = by_rarity(postings, all_phrases)
    start = (F.col("pos") - F.col("offset")).alias("start")
    left = postings.join(asked.where("rank = 0"), "term").select(*_DOC, "phrase", start, "n_terms").where("start >= 0").distinct()
    for rank in range(1, lists):
        nth = asked.where(F.col("rank") == rank).drop("n_terms", "rank")
        wanted = left.join(nth, "phrase").withColumn("pos", F.col("start") + F.col("offset"))
        met = wanted.join(_list(postings, nth), [*_DOC, "term", "pos"], "left_semi").select(*left.columns)
        left = met.unionByName(left.where(F.col("n_terms") <= rank))
    left = stored(left, "candidates")
    rest = asked.where(F.col("rank") >= lists).drop("n_terms", "rank")
    wanted = left.join(rest, "phrase").withColumn("pos", F.col("start") + F.col("offset"))
    # Only documents with candidates are looked at again.
    there = postings.join(stored(left.select(*_DOC).distinct(), "left"), list(_DOC), "left_semi")
    met = wanted.join(there, [*_DOC, "term", "pos"], "left_semi").groupBy(*left.columns).agg(F.count(F.lit(1)).alias("met"))
    whole = met.where(F.col("met") == F.col("n_terms") - lists).select(*left.columns)
    return whole.unionByName(left.where(F.col("n_terms") <= lists))


def proximity_matches(postings: DataFrame, all_phrases: DataFrame, slop: int) -> DataFrame:
    """``doc, print, phrase, start, end``: stretches of at most ``n_terms + slop`` words with all words of a phrase.

    Words may come in any order with others between; a word that a phrase has twice need stand there once.
    A stretch begins and ends with a word of the phrase, and is the shortest one from its start. Every stretch
    holds the phrase's rarest word, so only what is near its occurrences is looked at.
    """
    asked = by_rarity(postings, all_phrases)
    width = (F.col("n_terms") + F.lit(slop)).alias("width")
    rarest = postings.join(asked.where("rank = 0"), "term").select(*_DOC, "phrase", F.col("pos").alias("anchor"), width).distinct()
    # Positions are cut into blocks as wide as a stretch, so what is near lies in the own or a next block.
    near = rarest.withColumn("block", F.explode(F.array(*[F.expr(f"anchor div width + {d}") for d in (-1, 0, 1)])))
    terms = asked.select("phrase", "term", width).distinct()
    sizes = terms.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_distinct"))
    widths = terms.select("term", "width").distinct()
    places = postings.join(widths, "term").distinct().withColumn("block", F.expr("pos div width"))
    around = near.join(terms, ["phrase", "width"]).join(places, [*_DOC, "term", "width", "block"])
    around = around.where("abs(pos - anchor) < width").select(*_DOC, "phrase", "width", "pos", "term", "block").distinct()
    # From each place, where each term stands next: the farthest of these ends the shortest stretch.
    ahead = around.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1)))
    later = ahead.alias("a").join(around.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*_DOC, "phrase", "block")])
    later = later.where("b.pos >= a.pos and b.pos < a.pos + a.width")
    nearest = later.groupBy("a.doc", "a.print", "a.phrase", "a.pos", "b.term").agg(F.min("b.pos").alias("at"))
    found = nearest.groupBy(*_DOC, "phrase", "pos").agg(F.count(F.lit(1)).alias("met"), F.max("at").alias("last"))
    found = found.join(sizes, "phrase").where("met = n_distinct")
    return found.select(*_DOC, "phrase", F.col("pos").alias("start"), (F.col("last") + 1).alias("end"))


def _covered(spans: Column) -> Column:
    """How many words sorted spans ``(start, end)`` cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def more(done: Column, span: Column) -> Column:
        fresh = F.greatest(span["end"] - F.greatest(span["start"], done["upto"]), F.lit(0).cast("long"))
        return F.struct((done["n"] + fresh).alias("n"), F.greatest(done["upto"], span["end"]).alias("upto"))

    return F.aggregate(spans, start, more)["n"]


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """Which words of ``docs`` (``doc_id``, ``text``) lie in a window of ``items`` (``item_id``, ``text``).

    Returns one row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words inside any match), ``spans``
    (matches as ``start, end`` in words, in order), ``items`` (ids as text, in order, each once) and
    ``contaminated``. Words are runs of letters, digits and non-ASCII signs, A-Z lower-cased. NULL, empty
    and wordless texts match nothing (0 words, empty lists), as do items without words. Rows with one
    ``item_id`` are one item; items without id are one with an empty name. Repeated rows of ``docs`` each get
    their own result; a row without ``doc_id`` is a document like any other. Other columns are ignored; an
    empty table of documents gives an empty result, one of items no matches. A document's spans and items
    are gathered in one row: as many as its own words allow for each window length.
    """
    all_phrases, of_items = phrases(items, window)
    vocabulary = stored(all_phrases.select(F.explode("terms").alias("term")).distinct(), "terms")
    postings = index(docs, vocabulary)
    matches = stored(exact_matches(postings, all_phrases, lists), "matches")
    ends = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n_terms")).cast("long").alias("end"))
    spans = matches.select(*_DOC, ends.alias("span")).distinct().groupBy(*_DOC).agg(F.sort_array(F.collect_list("span")).alias("spans"))
    met = matches.select(*_DOC, "phrase").distinct().join(of_items, "phrase").select(*_DOC, "item").distinct()
    met = met.groupBy(*_DOC).agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = named(docs).select("doc_id", *_DOC, F.regexp_count(lowered(), F.lit(WORD)).cast("long").alias("n_words"))
    found = rows.join(spans.join(met, list(_DOC)), list(_DOC), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = found.withColumns({"spans": F.coalesce("spans", none), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return found.select("doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents
), b AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM benchmark
), p AS (
    SELECT DISTINCT item, w[i:i + {WINDOW - 1}] AS phrase
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)
), starts AS (
    SELECT r, unnest(range(1, len(w) - n + 2)) AS i, n, w FROM d, (SELECT DISTINCT len(phrase) AS n FROM p) WHERE len(w) >= n
), g AS (
    SELECT DISTINCT r, i, n, item FROM (SELECT r, i, n, w[i:i + n - 1] AS phrase FROM starts) JOIN p USING (phrase)
), h AS (
    SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM g) GROUP BY r
), t AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM g) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
