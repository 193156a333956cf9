"""BPE as a deterministic automaton over tokens, compiled from the merge list gadget by gadget.

The automaton starts with one state and a loop for every base symbol. Each merge ``(u, v) -> w``, in
order of priority, adds its gadget: the arcs labelled ``u`` get a state of their own that is a copy of
the old one without its ``v`` arcs, and an arc ``w`` leads where ``u`` and then ``v`` led. What remains
accepts exactly the token sequences that merging makes, one for every word. States differ from those
they were copied from only in the arcs they have lost, so a state keeps the loss and a link to its
origin, and a row of the transition table is filled the first time it is used.

A word is encoded by following the only accepted path whose labels spell it; a position that proves
a dead end is never entered again, so the steps grow with the word's length alone. Decoding emits
the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.frames import arrow_schema, batch

#: Words, stretches between white space and transitions a worker remembers.
KNOWN_WORDS = 250_000
KNOWN_STEPS = 200_000
_END = "\0"
#: White space as the tokenizer's pattern engine knows it. Fixed values.
_SPACES = "\t-\r \x85\xa0  -     　"

#: Code points that the splitting pattern's engine takes for letters or digits though the tokenizer,
#: whose tables are those of Unicode 16, does not. First and last of each range. Fixed values.
_NEWER_SIGNS = """
558 558, 58b 58c, 88f 88f, c5c c5c, cdc cdc, 208f 208f, 209d 209f, a7ce a7cf, a7d2 a7d2, a7d4 a7d4, a7dd a7dd,
a7e2 a7e2, a7f1 a7f1, ab6c ab6d, 107bb 107bf, 10940 10959, 10ec5 10ec7, 10ed9 10eee, 11b0a 11b0a, 11db0 11ddb,
11de0 11de9, 11df1 11df1, 1246f 1246f, 12475 1247f, 12550 12686, 16ea0 16eb8, 16ebb 16ed3, 16ff2 16ff6,
187f8 187ff, 18cd6 18cda, 18d09 18d20, 18d80 18df2, 18e00 19191, 191a0 191d2, 1b123 1b128, 1b168 1b168,
1d6a6 1d6a6, 1df1f 1df24, 1df2b 1df81, 1df90 1df96, 1dfcd 1dfff, 1e6c0 1e6de, 1e6e0 1e6e2, 1e6e4 1e6e5,
1e6e7 1e6ed, 1e6f0 1e6f4, 1e6fe 1e6ff, 2b73a 2b73f, 2b81e 2b81e, 2cea2 2cead, 323b0 33479, 3d000 3fc3f
"""

#: Capital letters that Python's tables lack: first, last, and the small letter of the first. Fixed values.
_NEWER_CAPITALS = "1c89 1c89 1c8a, a7cb a7cb 264, a7cc a7cc a7cd, a7ce a7ce a7cf, a7d2 a7d2 a7d3, a7d4 a7d4 a7d5, a7da a7da a7db, a7dc a7dc 19b, 10d50 10d65 10d70, 16ea0 16eb8 16ebb"


def _small_letters() -> dict[int, int]:
    out = {}
    for first, last, small in (map(lambda x: int(x, 16), part.split()) for part in _NEWER_CAPITALS.split(",")):
        out.update((c, small + c - first) for c in range(first, last + 1) if chr(c).lower() == chr(c))
    return out


def _newer_signs() -> str:
    """The ranges as the inside of a character class."""
    pairs = (pair.split() for pair in _NEWER_SIGNS.split(","))
    return "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in pairs)
#: What Python splits at, but the tokenizer doesn't. Fixed values.
_NOT_SPACES = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: visible Latin-1 as itself, others from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Memory:
    """Ids of texts met before: when the younger half is full it becomes the older one, which is then forgotten."""

    def __init__(self, most: int):
        self.half = most // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, key: str) -> bytes | None:
        ids = self.young.get(key)
        if ids is None:
            ids = self.old.get(key)
            if ids is not None:
                self.keep(key, ids)
        return ids

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(key) <= 64:
            if len(self.young) >= self.half:
                self.old, self.young = self.young, {}
            self.young[key] = ids
        return ids


class TokenAutomaton:
    """Encoder and decoder for one tokenizer file with word ends (see the module's description)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.labels = {i: label for label, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels.update({i: label for label, i in self.special.items()})
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        splitter = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = splitter["pattern"]["Regex"].replace(r"\s", _SPACES)
        self._words = regex.compile(pattern)
        # The pattern for texts with signs that are newer than the tokenizer's tables.
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{_newer_signs()}]]")
        self._newer = re.compile(f"[{_newer_signs()}]")
        self._strict_words = regex.compile(pattern, regex.V1)
        self._small = _small_letters()
        self._capitals = re.compile(f"[{''.join(map(chr, self._small)) or chr(0)}]")
        self._letters = dict(enumerate(_byte_letters()))
        self._compile(model["vocab"], model["merges"])
        self._label_of = np.array([self.labels.get(i, "") for i in range(max(self.labels) + 1)], object)
        self._solid = re.compile(f"[^{_SPACES}]+")
        self.known = Memory(KNOWN_WORDS)  # words, and stretches between white space that are several words

    def _key(self, label: str) -> str:
        """A label as spelled in a word: the word end is one sign."""
        return label[: -len(self.suffix)] + _END if label.endswith(self.suffix) else label

    def _compile(self, vocab: dict[str, int], merges: list) -> None:
        size = max(vocab.values()) + 1
        self.left, self.right = [-1] * size, [-1] * size
        self.made = [-1] * size  # the merge whose gadget added the token's arcs
        self.lost: dict[int, int] = {}  # left token, right token -> the gadget that cut the arc
        self.steps: dict[int, bool] = {}
        unused: set[int] = set()  # tokens without any arc
        for order, merge in enumerate(merges):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            first, second, whole = vocab[u], vocab[v], vocab[u + v]
            if first in unused or second in unused or not self._arc(first, second):
                unused.add(whole)  # no accepted path has this pair any more
                continue
            self.left[whole], self.right[whole], self.made[whole] = first, second, order
            self.lost[first << 20 | second] = order
        self.spelled = {self._key(label): i for label, i in vocab.items() if i not in unused}
        #: The longest token by its first two signs: no longer one needs to be looked up.
        self.reach: dict[str, int] = {}
        for label in self.spelled:
            self.reach[label[:2]] = max(self.reach.get(label[:2], 0), len(label))
        self.steps.clear()

    def _cut(self, token: int, following: int) -> int | None:
        """The gadget that first cut ``following`` from the state that ``token`` leads to."""
        lost, cut, before = self.lost, None, 1 << 60
        while True:
            order = lost.get(token << 20 | following)
            if order is not None and order < before:
                cut = order
            if self.made[token] < 0:
                return cut
            before, token = self.made[token], self.right[token]

    def _arc(self, token: int, following: int) -> bool:
        """Whether the state that ``token`` leads to has an arc ``following``.

        A merged token's arc was added where its left part's arc was at that time.
        """
        until = 1 << 60
        while True:
            cut = self._cut(token, following)
            if cut is not None and cut <= until:
                return False
            if self.made[following] < 0:
                return True
            until, following = self.made[following], self.left[following]

    def path(self, spelled: str) -> tuple[int, ...]:
        """The labels of the accepted path that spells a word (in byte letters, with its end sign)."""
        tokens, steps = self.spelled, self.steps
        whole = tokens.get(spelled)
        if whole is not None:
            return (whole,)
        n, reach, get = len(spelled), self.reach.get, tokens.get
        out: list[int] = []
        begins: list[int] = []
        dead: set[int] = set()
        at, last = 0, -1
        while at < n:
            to = min(n, at + reach(spelled[at : at + 2], 1))
            while to > at:
                token = get(spelled[at:to])
                if token is not None and to not in dead:
                    if last < 0:
                        break
                    # The transition table: rows are filled on first use.
                    step = last << 20 | token
                    go = steps.get(step)
                    if go is None:
                        if len(steps) >= KNOWN_STEPS:
                            steps.clear()
                        go = steps[step] = self._arc(last, token)
                    if go:
                        break
                to -= 1
            if to > at:
                out.append(token)
                begins.append(at)
                at, last = to, token
            else:
                dead.add(at)
                if not out:
                    raise ValueError("a symbol is not in the vocabulary")
                out.pop()
                at = begins.pop()
                last = out[-1] if out else -1
        return tuple(out)

    def encode_word(self, word: str) -> tuple[int, ...]:
        if word.isascii() and word.isprintable():
            return self.path(word + _END)  # these letters stand for themselves
        return self.path(word.encode().decode("latin-1").translate(self._letters) + _END)

    def _word(self, word: str) -> bytes:
        ids = self.known.find(word)
        return self.known.keep(word, np.array(self.encode_word(word), "<u4").tobytes()) if ids is None else ids

    def _stretch(self, stretch: str) -> bytes:
        """Ids of a lower-case stretch: its words by the splitting pattern, one after the other."""
        ids = self.known.find(stretch)
        if ids is not None:
            return ids
        text = stretch if self._capitals.search(stretch) is None else stretch.translate(self._small)
        pattern = self._words if self._newer.search(text) is None else self._strict_words
        words = pattern.findall(text)
        if words == [stretch]:
            return self._word(stretch)
        return self.known.keep(stretch, b"".join(map(self._word, words)))

    def _plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if not text.isascii():
            text = text.replace("Σ", "σ")  # lower-cased letter by letter: no final form
        text = text.lower()
        # No word has white space in it, so what stands between white space is looked up as a whole.
        if any(sign in text for sign in _NOT_SPACES):
            stretches = self._solid.findall(text)
        else:
            stretches = text.split()
        found = list(map(self.known.young.get, stretches))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                found[at] = self._stretch(stretches[at])
        except ValueError:
            return b"".join(found)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self._special is None or self._special.search(text) is None:
            return self._plain(text)
        out, at = [], 0
        for hit in self._special.finditer(text):
            out += [self._plain(text[at : hit.start()]), np.array([self.special[hit.group()]], "<u4").tobytes()]
            at = hit.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The labels of the arcs, joined as the tokenizer joins them."""
        return " ".join(self._label_of[np.asarray(ids, np.int64)].tolist())


@lru_cache(maxsize=2)
def automaton(path: str) -> TokenAutomaton:
    """One compiled automaton per worker and file."""
    return TokenAutomaton(path)


_IDS = "doc_id long, n_tokens long, ids binary"


def _pieces(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column as Python strings, a bounded number of characters at a time."""
    row, held, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= limit:
            yield row, held
            row, held, size = i + 1, [], 0
    if held:
        yield row, held


def _encode(path: str, decoded: bool):
    schema = arrow_schema(_IDS + (", decoded string" if decoded else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for b in batches:
            for row, texts in _pieces(b.column("text")):
                n, ids, back = [], [], []
                for text in texts:
                    ids.append(machine.encode_bytes(text))
                    n.append(len(ids[-1]) // 4)
                    if decoded:
                        back.append(machine.decode(np.frombuffer(ids[-1], "<u4")))
                yield batch(schema, [b.column("doc_id").slice(row, len(n)), n, ids, *([back] if decoded else [])])

    return run


def encode(docs: DataFrame, path: str, *, decoded: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) of every whole text.

    With ``decoded``, also the text that the ids decode to. NULL and empty texts have no ids and decode
    to the empty text; special tokens spelled out in a text become their ids. Every input row gives one
    row, repeated rows and NULL ``doc_id`` included; other columns are ignored. ``path`` names the
    tokenizer file, which every executor must have at that place.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(path, decoded), _IDS + (", decoded string" if decoded else ""))


def _decode(path: str):
    schema = arrow_schema("doc_id long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for b in batches:
            texts = [machine.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in b.column("ids")]
            yield batch(schema, [b.column("doc_id"), texts])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``text`` that ``ids`` stand for; NULL ids give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")
