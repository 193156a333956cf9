"""Language of whole texts by known words first, then by ever shorter character n-grams.

A model holds log frequencies per language of words and of character n-grams of words. A known word is
scored by its own frequencies; a word never seen by the n-grams of the longest length of which the
model knows any; a word without known n-grams says nothing. A text's language has the highest sum.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.bpe import _pieces
from attestor.llm.frames import arrow_schema, batch

UNDETERMINED = "und"
#: Labelled texts the model is fitted on, about; the bound on the model's size.
SAMPLE_TEXTS = 5000
#: Words and n-grams met fewer times in the sample count as unseen.
LEAST_COUNT = 2
LONGEST_GRAM = 5
#: Added to each count, so that no language is impossible.
SMOOTHING = 0.1
#: An unseen word says this part of what a known one does.
BACKOFF = 0.7
#: Words a worker remembers the scores of; when full it starts anew.
KNOWN_WORDS = 100_000

#: Signs of words that are neither letters nor digits of a decimal number: fractions, circled and Roman numbers.
_NUMBERS = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_WORD = re.compile(rf"[^\W\d_{re.escape(_NUMBERS)}]+")
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters; the few that hold other numbers are cut at these."""
    runs = _RUN.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [word for run in runs for word in ((run,) if run.isalpha() else _WORD.findall(run))]


class Model(NamedTuple):
    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]  # row of scores
    grams: dict[str, int]
    scores: np.ndarray


def _marked(word: str) -> str:
    return f"<{word}>"


def grams(word: str, size: int) -> list[str]:
    marked = _marked(word)
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


_COUNTS = "kind int, lang string, key string, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) and of their n-grams (kind 1) per language, summed in each batch before they leave the task."""
    schema = arrow_schema(_COUNTS)
    for b in batches:
        words: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            for word, n in Counter(words_of((text.as_py() or "").lower())).items():
                words[lang, word] += n
        pieces: Counter = Counter()
        for (lang, word), n in words.items():
            for size in range(1, LONGEST_GRAM + 1):
                for gram in grams(word, size):
                    pieces[lang, gram] += n
        for kind, counts in enumerate((words, pieces)):
            if counts:
                langs, keys = zip(*counts, strict=True)
                yield batch(schema, [np.full(len(keys), kind, np.int32), list(langs), list(keys), list(counts.values())])


def fit(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, smoothing: float = SMOOTHING, least: int = LEAST_COUNT) -> Model:
    """A model of ``labelled`` (``doc_id``, ``text``, ``lang``), fitted on about ``sample_texts`` whole texts.

    The sample is drawn by a hash of ``doc_id``, so reruns agree; rows without ``lang`` are left out. Words
    and n-grams met fewer than ``least`` times count as unseen. The driver receives the sample's counts,
    bounded by the sample.
    """
    labelled = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    rows = labelled.agg(F.count(F.lit(1))).first()[0]
    share = min(1.0, sample_texts / rows) if rows else 0.0
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))
    counts = labelled.where(chosen).select("lang", "text").mapInArrow(_count, _COUNTS).groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    met = counts.groupBy("kind", "key").agg(F.collect_list(F.struct("lang", "n")).alias("by_lang"), F.sum("n").alias("n")).where(F.col("n") >= least)
    table = met.select("kind", "key", F.explode("by_lang").alias("c")).select("kind", "key", "c.lang", "c.n").toArrow()
    table = table.sort_by([("kind", "ascending"), ("key", "ascending"), ("lang", "ascending")])
    kinds, n = table["kind"].to_numpy(), table["n"].to_numpy()
    languages = sorted(table["lang"].unique().to_pylist())
    place = {lang: i for i, lang in enumerate(languages)}
    column = np.array([place[x] for x in table["lang"].to_pylist()], np.int64)
    index: list[dict[str, int]] = []
    parts = []
    for kind in (0, 1):
        keys = table["key"].filter(pa.array(kinds == kind)).to_pylist()
        numbered: dict[str, int] = {}
        row = np.array([numbered.setdefault(k, len(numbered)) for k in keys], np.int64)
        sums = np.zeros((len(numbered), len(languages)))
        np.add.at(sums, (row, column[kinds == kind]), n[kinds == kind])
        if len(numbered):
            rate = np.log((sums + smoothing) / (sums.sum(axis=0) + smoothing * len(numbered)))
            sums = rate - rate.mean(axis=1, keepdims=True)
        index.append(numbered)
        parts.append(sums)
    totals = np.bincount(column[kinds == 0], n[kinds == 0], len(languages)) + 1.0
    offset = len(parts[0])
    pieces = {g: i + offset for g, i in index[1].items()}
    return Model(languages, np.log(totals / totals.sum()), index[0], pieces, np.concatenate(parts).astype(np.float32))


class Scorer:
    """Scores words by a model, remembering those it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.fresh()

    def fresh(self) -> None:
        self.known = dict(self.model.words)
        self.base = len(self.model.scores)
        self.rows = np.empty((1 << 12, len(self.model.languages)), np.float32)
        self.used = 0

    def backoff(self, word: str) -> np.ndarray:
        pieces, scores = self.model.grams, self.model.scores
        for size in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            found = [pieces[g] for g in grams(word, size) if g in pieces]
            if found:
                return scores[found].mean(axis=0) * BACKOFF
        return np.zeros(len(self.model.languages), np.float32)

    def places(self, words: list[str]) -> list[int]:
        known = self.known
        out = []
        for word in words:
            place = known.get(word)
            if place is None:
                if self.used == len(self.rows):
                    self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
                self.rows[self.used] = self.backoff(word)
                place = known[word] = self.base + self.used
                self.used += 1
            out.append(place)
        return out

    def evidence(self, text: str) -> bool:
        """Whether the model knows a word of the text, or a letter of one."""
        words, pieces = self.model.words, self.model.grams
        return any(word in words or any(letter in pieces for letter in word) for word in words_of(text.lower()))

    def text(self, text: str) -> tuple[str, float]:
        words = words_of(text.lower())
        if not words or not self.model.languages:
            return (UNDETERMINED, 0.0)
        if len(self.known) > KNOWN_WORDS + len(self.model.words):
            self.fresh()
        places = np.array(self.places(words))
        old = places < self.base
        total = self.model.prior + self.model.scores[places[old]].sum(axis=0) + self.rows[places[~old] - self.base].sum(axis=0)
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())


def _predict(shared):
    schema = arrow_schema("doc_id long, held string, lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for row, texts in _pieces(b.column("text")):
                found = [scorer.text(t) for t in texts]
                n = len(found)
                yield batch(schema, [b.column("doc_id").slice(row, n), b.column("held").slice(row, n), [f[0] for f in found], [f[1] for f in found]])

    return run


def predict(docs: DataFrame, model: Model, carry: Column | None = None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) of every whole text, and ``held``: what ``carry`` says of its row.

    NULL, empty and letterless texts are ``und`` with score 0; so is every text if the model knows no
    language. Ties go to the first language in order. One row per input row, repeats and NULL ``doc_id``
    included; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = (F.lit(None) if carry is None else carry).cast("string").alias("held")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held)
    return rows.mapInArrow(_predict(shared), "doc_id long, held string, lang_pred string, score double")


def _accept(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for row, texts in _pieces(b.column(text_at)):
                yes = [scorer.text(t)[0] != UNDETERMINED and scorer.evidence(t) for t in texts]
                yield b.slice(row, len(yes)).filter(pa.array(yes, pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``text`` has a language by :func:`predict`, however low its score.

    Every whole text is scored by its words and, where these are unknown, their n-grams. Rejected are NULL, empty
    and letterless texts and those of which the model knows no word and no letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_accept(shared, docs.columns.index("text")), docs.schema)
