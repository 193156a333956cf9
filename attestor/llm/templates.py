"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

A page is a row of tokens: tags, told apart by their path of open elements, and blocks of text. Tokens
that occur equally often in every page of a host have one occurrence vector and form an equivalence
class. Classes that are large and frequent enough, keep one order in all pages and nest are the host's
template: the classes that occur once in a page frame it, and what lies between two of their tags is
a slot; classes inside a slot repeat there. Text that is itself a template token is the same in all
pages, inside of article elements as elsewhere. What the slots hold besides is the pages' own text.

The occurrence vector of a token over all pages of its host is kept as one number, the exclusive or
of a hash per different page and count. So it is summed up in tasks and by Spark like a count, and only
copies of one page meet.
"""

from __future__ import annotations

import html
import re
import struct
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.bpe import _pieces
from attestor.llm.frames import arrow_schema, batch, stored, written

#: A class must occur in this part of a host's different pages and in this many of them, and have this many tokens.
SUPPORT = 0.8
LEAST_PAGES = 3
LEAST_TOKENS = 2

#: Elements whose content is never article text; header only outside of an article, footer only outside of a quote. Fixed values.
ASIDE = frozenset("head nav aside form menu dialog".split())
OUTER = frozenset("header footer".split())
#: Elements whose content is left out as it stands: scripts, controls, and what is shown where media cannot be played.
RAW = frozenset(
    "script style textarea title xmp iframe noscript template svg annotation annotation-xml select button option datalist video audio canvas object".split()
)
#: Those that hold markup: one that is never closed ends with its tag; of the rest all text to the end belongs to it.
MARKUP = frozenset("noscript template svg annotation annotation-xml select button option datalist video audio canvas object".split())
#: Those that are empty if they end with a slash.
EMPTY = frozenset("svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul caption title".split()
)
#: Elements that hold a text as a whole; all others are parts of one. Fixed values.
CONTAINERS = frozenset("html body main article section div td fieldset details".split())
#: Elements that name what follows them, with their level; those of level 7 name the next cell or part. Fixed values.
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6, "th": 7, "td": 7, "dt": 7, "caption": 7, "summary": 7}
#: An element marked by its class, id or role is left out of article and main elements if it repeats over the host's
#: pages like a template and this part of its text, at most, stands on one page only.
OWN_TEXT = 0.1
#: Words in a class, id or role that mark an element as no part of the article. Fixed values.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner banners sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe signup sidebar side nav navbar navigation menu breadcrumb breadcrumbs toolbar pagination pager footer header masthead comment comments "
    "disqus reply replies respond share sharing social related recommended recommendations widget login search form complementary contentinfo dialog".split()
)
#: Of these, the words that name parts whose text differs from page to page, so no host can tell: they mark an
#: element of an article by themselves, if nothing but they and the words below make up a class, id or role. Fixed values.
STRONG = frozenset(
    "ad ads advert advertisement adverts banner banners sponsor sponsored promo promotion cookie cookies consent popup newsletter subscribe signup sidebar nav navbar "
    "navigation breadcrumb breadcrumbs toolbar pagination pager comment comments disqus reply replies respond share sharing social related recommended "
    "recommendations login".split()
)
PARTS = frozenset(
    "area article articles author bar block body bottom box button buttons center column container content contents count footer group header heading holder icon "
    "icons inline inner item items label left link links list main meta notice outer panel post posts right row section side slot site story stories text thread title "
    "top unit user reader widget wrap wrapper".split()
)

#: A tag: quotes count only at the start of a value; every character is read once, as nothing is taken back.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_MARK = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
_SPLIT = re.compile(r"[^a-z0-9]+")
_SIZE = re.compile(r"[0-9x]+|[a-z]")
#: Open elements of the same kind that a new one ends, up to their container. Fixed values.
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}
#: Of marked elements inside one another, this many count by themselves; those further in belong to the last.
_NESTED_MARKS = 8


class Token(NamedTuple):
    """A tag with its path (``kind`` "<" or "/"), or a block of text ("t") with the path it stands in."""

    kind: str
    path: int | str  # the names of the open elements, or the number of this path
    text: str
    aside: bool  # inside an element that is no article text
    article: bool  # inside article or main
    marks: tuple = ()  # the marked elements it is inside of, as ids of their path and marks
    strong: bool = False  # inside an element that its marks alone leave out
    name: str = ""  # of the element, or the one a text stands in


def path_number(path: str, parent: int = 0) -> int:
    """A path as one number, which follows from its parent's and the last name."""
    for name in path.split("/"):
        if name:
            parent = ((parent ^ crc32(name.encode("utf-8", "surrogatepass"))) * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF
            parent ^= parent >> 29
    return parent


def _marked(attributes: str) -> tuple[str, bool]:
    """The words of ``MARKS`` in an element's class, id and role, and whether one of these names is a strong mark."""
    values = " ".join(hit[1] or hit[2] or hit[3] or "" for hit in _MARK.finditer(attributes)).lower()
    if not values:
        return "", False
    found = " ".join(sorted(MARKS.intersection(_SPLIT.split(values))))
    return found, bool(found) and any(_strong(name) for name in values.split())


def _strong(name: str) -> bool:
    parts = {w for w in _SPLIT.split(name) if w}
    return not STRONG.isdisjoint(parts) and all(w in STRONG or w in PARTS or _SIZE.fullmatch(w) for w in parts)


class _Open(NamedTuple):
    """An open element."""

    name: str
    path: int
    aside: bool
    article: bool
    marks: tuple
    strong: bool


_OUTSIDE = _Open("", 0, False, False, (), False)


def tokens(page: str) -> list[Token]:
    """The tokens of a page. Character references are decoded, white space in a block is one space.

    The page is read once from start to end, whatever is left open or unfinished in it. A ``>`` ends a tag
    outside of quoted values; a tag that never ends so ends at its first ``>``, the second such one, or one without
    any, with the page.
    """
    out: list[Token] = []
    open_: list[_Open] = []
    depths: dict[str, list[int]] = defaultdict(list)  # where elements of a name are open
    text: list[str] = []
    unclosed: set = set()  # names of raw elements that no end tag follows any more
    ended = False

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                name, path, aside, article, marks, strong = open_[-1] if open_ else _OUTSIDE
                out.append(Token("t", path, block, aside, article, marks, strong, name))

    def close(depth: int) -> None:
        flush()
        while len(open_) > depth:
            name, path, aside, article, marks, strong = open_.pop()
            depths[name].pop()
            out.append(Token("/", path, "", aside, article, marks, strong, name))

    def last(*names: str) -> int:
        return max((depths[n][-1] for n in names if depths[n]), default=-1)

    at = 0
    while True:
        mark = _OPEN.search(page, at)
        if mark is None:
            text.append(page[at:])
            break
        begin = mark.start()
        text.append(page[at:begin])
        sign = page[begin + 1]
        if sign in "!?":
            if page.startswith("!--", begin + 1):
                end, size = page.find("-->", begin + 2), 3
            elif page.startswith("![CDATA[", begin + 1) and "]]>" not in unclosed:
                end, size = page.find("]]>", begin), 3
                if end < 0:
                    unclosed.add("]]>")
                    end, size = page.find(">", begin), 1
            else:
                end, size = page.find(">", begin), 1
            if end < 0:
                break
            at = end + size
            continue
        if sign == "/" and not page[begin + 2 : begin + 3].isalpha():
            end = page.find(">", begin)
            if end < 0:
                break
            at = end + 1
            continue
        hit = _TAG.match(page, begin)
        if hit is None:
            end = page.find(">", begin)
            if ended or end < 0:
                break
            ended = True
            hit = _TAG.match(page[begin : end + 1].replace('"', " ").replace("'", " "))
            if hit is None:
                at = end + 1
                continue
            at = end + 1
        else:
            at = hit.end()
        name, ending, attributes = hit[2].lower(), hit[1] == "/", hit[3]
        if not ending and name in RAW:
            text.append(" ")
            if name in EMPTY and attributes.endswith("/"):
                continue
            close_at = None if name in unclosed else _CLOSE[name].search(page, at)
            if close_at is None:
                unclosed.add(name)
            at = close_at.end() if close_at else at if name in MARKUP else len(page)
            continue
        if name not in BLOCKS:
            if name == "br":
                text.append(" ")
            continue
        if ending:
            if depths[name]:
                close(depths[name][-1])
            else:
                flush()
            continue
        flush()
        if depths["p"] and last("table", "td", "th", "caption") < depths["p"][-1]:
            # A block ends the paragraph before it.
            close(depths["p"][-1])
        if name in _ENDS:
            same, bound = _ENDS[name]
            floor = last(*bound)
            inner = [d[bisect(d, floor)] for n in same.split() if (d := depths[n]) and d[-1] > floor]
            if inner:
                close(min(inner))
        if name == "body" and depths["head"]:
            close(depths["head"][0])
        around, path, aside, article, marks, strong = open_[-1] if open_ else _OUTSIDE
        inside = article or name in ("article", "main")
        aside = aside or name in ASIDE or (name == "header" and not article) or (name == "footer" and not depths["blockquote"])
        own = path_number(name, path)
        if attributes and name not in ("html", "body"):
            words, sure = _marked(attributes)
            strong = strong or sure
            if words and name not in ("article", "main") and len(marks) < _NESTED_MARKS:
                marks = (*marks, _hash("mark", str(own), words))
        if name in VOID:
            continue
        depths[name].append(len(open_))
        open_.append(_Open(name, own, aside, inside, marks, strong))
        out.append(Token("<", own, "", aside, inside, marks, strong, name))
    close(0)
    return out


def _hash(*values: str) -> int:
    return struct.unpack("<q", blake2b("\0".join(values).encode("utf-8", "surrogatepass"), digest_size=8).digest())[0]


@lru_cache(maxsize=1 << 15)
def _tag_id(kind: str, path: int) -> int:
    return _hash(kind, str(path), "") | 1


def token_id(token: Token) -> int:
    """A hash of kind, path and text; the last bit tells a tag (1) from text (0)."""
    path = token.path if isinstance(token.path, int) else path_number(token.path)
    return _hash("t", str(path), token.text) & ~1 if token.kind == "t" else _tag_id(token.kind, path)


_SEQUENCES = "host string, name binary, ids array<long>, marked array<struct<mark: long, block: long, size: long>>"
_MARKED = pa.list_(pa.struct([("mark", pa.int64()), ("block", pa.int64()), ("size", pa.int64())]))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's tokens in order, as their ids, and a digest of them; the blocks in marked elements of its articles."""
    schema = pa.schema([("host", pa.string()), ("name", pa.binary()), ("ids", pa.list_(pa.int64())), ("marked", _MARKED)])
    for b in batches:
        for row, pages in _pieces(b.column("html")):
            ids, marked = [], []
            for page in pages:
                found = tokens(page)
                ids.append(np.array([token_id(t) for t in found], np.int64))
                blocks = {(m, int(i)): len(t.text) for t, i in zip(found, ids[-1], strict=True) if t.marks and t.kind == "t" and t.article and not t.aside for m in t.marks}
                marked.append([(m, i, size) for (m, i), size in blocks.items()] + [(m, None, 0) for m in {m for m, _ in blocks}])
            names = [blake2b(i.tobytes(), digest_size=16).digest() for i in ids]
            marked = pa.array([[dict(zip(("mark", "block", "size"), m, strict=True)) for m in page] for page in marked], _MARKED)
            yield batch(schema, [b.column("host").slice(row, len(pages)), names, ids, marked])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


_VECTORS = "host string, token long, vector long, pages long, most long, copies long"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token of a batch: the hashed occurrence vector and counts, summed before they leave the task."""
    schema = arrow_schema(_VECTORS)
    for b in batches:
        sums: dict = defaultdict(lambda: [0, 0, 0, 0])
        columns = [b.column(c).to_pylist() for c in ("host", "name", "copies")]
        for host, name, copies, ids in zip(*columns, _lists(b.column("ids")), strict=True):
            found, counts = np.unique(ids, return_counts=True)
            with np.errstate(over="ignore"):
                marks = (counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(int.from_bytes(name[:8]))) * np.uint64(0xBF58476D1CE4E5B9)
                marks = ((marks ^ (marks >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)).view(np.int64)
            for i, n, mark in zip(found.tolist(), counts.tolist(), marks.tolist(), strict=True):
                held = sums[host, i]
                held[0] ^= mark
                held[1] += 1
                held[2] = max(held[2], n)
            sums[host, None][1] += 1  # the host's different pages, and its rows
            sums[host, None][3] += copies
        keys = list(sums)
        yield batch(schema, [[k[0] for k in keys], [k[1] for k in keys], *([v[j] for v in sums.values()] for j in range(4))])


_ORDERS = "host string, token long, class long, first_rank long, last_rank long, first_gap long, last_gap long"


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and tag of a class: the range of its ranks in its class, and of the gaps of class 0 it stands in."""
    schema = arrow_schema(_ORDERS)
    for b in batches:
        hosts: dict = {}
        columns = [_lists(b.column(c)) for c in ("ids", "members", "classes")]
        for host, ids, members, classes in zip(b.column("host").to_pylist(), *columns, strict=True):
            if host not in hosts:
                least = np.full((2, len(members)), np.iinfo(np.int64).max)
                hosts[host] = (members, classes, least, np.full((2, len(members)), -1))
            _, _, least, most = hosts[host]
            at = np.searchsorted(members, ids)
            at[at == len(members)] = 0
            at = at[members[at] == ids]
            of = classes[at]
            order = np.argsort(of, kind="stable")
            rank = np.empty(len(at), np.int64)
            rank[order] = np.arange(len(at)) - np.searchsorted(of[order], of[order])
            gap = np.cumsum(of == 0)
            for k, places in enumerate((rank, gap)):
                least[k, at] = np.minimum(least[k, at], places)
                most[k, at] = np.maximum(most[k, at], places)
        for host, (members, classes, least, most) in hosts.items():
            met = most[0] >= 0
            yield batch(schema, [[host] * int(met.sum()), members[met], classes[met], least[0, met], most[0, met], least[1, met], most[1, met]])


def host_of(url_column: str = "url"):
    """The host of a URL, lower-cased; the blank host where there is none."""
    host = F.regexp_extract(F.coalesce(url_column, F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def templates(pages: DataFrame, support: float = SUPPORT, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``host, pages, frame, texts, marks``: the deduced template of every host.

    ``frame`` are the tags of valid classes that occur once in all of the host's pages they are in. The most
    frequent of these classes is the root. A tag whose rank in its class changes from page to page is broken
    out of it, and a class is nested where its tags stand in one and the same gap of the root in all pages;
    others divide nothing. ``texts`` are text tokens of any class: the same text is no page's own,
    wherever it stands. Pages with equal tokens in equal order are one page, so copies are no evidence; ``pages``
    counts rows. Classes rarer than ``support`` or with fewer than ``least_tokens`` tokens are no part of
    the template, so its size follows the template, not the pages. ``marks`` are marked elements in articles that
    are as frequent, with little text (``OWN_TEXT``) that stands on one page only.
    """
    rows = pages.select(host_of().alias("host"), "html").mapInArrow(_sequences, _SEQUENCES).groupBy("host", "name")
    rows = written(rows.agg(F.first("ids").alias("ids"), F.first("marked").alias("marked"), F.count(F.lit(1)).alias("copies")))
    sums = rows.drop("marked").mapInArrow(_vectors, _VECTORS).groupBy("host", "token")
    sums = written(sums.agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.max("most").alias("most"), F.sum("copies").alias("copies")))
    hosts = sums.where("token IS NULL").select("host", F.col("pages").alias("host_pages"), F.col("copies").alias("host_rows"))
    frequent = sums.where("token IS NOT NULL").join(hosts, "host").where(F.col("pages") >= F.greatest(F.lit(support) * F.col("host_pages"), F.lit(LEAST_PAGES)))
    classes = frequent.groupBy("host", "vector", "pages", "most").agg(F.sort_array(F.collect_list("token")).alias("members"))
    classes = classes.where(F.size("members") >= least_tokens)
    is_tag = F.col("token").bitwiseAND(F.lit(1)) == 1
    # A class is known by a number of its own, the root by 0; roots are found by an aggregation, so no host is put in order.
    classes = classes.withColumn("class", F.xxhash64("vector", "pages", "most").bitwiseOR(F.lit(1)))
    first = F.struct((F.col("most") == 1).alias("once"), "pages", F.size("members").alias("size"), (-F.col("vector")).alias("vector"))
    roots = stored(classes.groupBy("host").agg(F.max_by("class", first).alias("root")), "roots")
    member = classes.select("host", "class", "most", F.explode("members").alias("token")).join(roots, "host")
    member = written(member.select("host", F.when(F.col("class") == F.col("root"), 0).otherwise(F.col("class")).alias("class"), "most", "token"))

    tags = member.where(is_tag & (F.col("most") == 1)).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "class"))).alias("m"))
    tags = stored(tags.select("host", F.col("m.token").alias("members"), F.col("m.class").alias("classes")), "classes")
    places = rows.join(tags, "host").select("host", "ids", "members", "classes").mapInArrow(_orders, _ORDERS).groupBy("host", "class", "token")
    places = places.agg(*(F.min(f"first_{c}").alias(f"first_{c}") for c in ("rank", "gap")), *(F.max(f"last_{c}").alias(f"last_{c}") for c in ("rank", "gap")))
    ordered = places.where("first_rank = last_rank AND first_gap = last_gap").groupBy("host", "class")
    ordered = ordered.agg(F.collect_list("token").alias("tokens"), F.min("first_gap").alias("first"), F.max("first_gap").alias("last"))
    nested = ordered.where((F.col("class") == 0) | ((F.col("first") == F.col("last")) & (F.size("tokens") >= least_tokens)))
    frames = nested.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("frame"))

    texts = F.sort_array(F.collect_list(F.when(~is_tag, F.col("token")))).alias("texts")
    found = member.groupBy("host").agg(texts).join(frames, "host", "full").join(marks(rows, hosts, support), "host", "full")
    lists = [F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("frame", "texts", "marks")]
    return found.join(hosts, "host").select("host", F.col("host_rows").alias("pages"), *lists)


def marks(rows: DataFrame, hosts: DataFrame, support: float) -> DataFrame:
    """``host, marks``: marked elements in articles for which the host's different pages speak."""
    blocks = rows.select("host", F.explode("marked").alias("m")).groupBy("host", "m.mark", "m.block").agg(F.count(F.lit(1)).alias("n"), F.max("m.size").alias("size"))
    alone = F.sum(F.when(F.col("n") == 1, F.col("size")).otherwise(0))
    found = blocks.groupBy("host", "mark").agg(F.max(F.when(F.col("block").isNull(), F.col("n"))).alias("pages"), F.sum(F.col("n") * F.col("size")).alias("all"), alone.alias("alone"))
    found = found.join(hosts, "host").where(F.col("pages") >= F.greatest(F.lit(support) * F.col("host_pages"), F.lit(LEAST_PAGES)))
    return found.where(F.col("alone") <= OWN_TEXT * F.col("all")).groupBy("host").agg(F.sort_array(F.collect_list("mark")).alias("marks"))


class Block(NamedTuple):
    """A block of text, its slot, and the number of the element it stands in."""

    token: Token
    slot: int
    element: int


def slots(page: list[Token], frame: frozenset) -> tuple[list[Block], list[tuple[str, int]]]:
    """The blocks of a page in their slots, and its elements by number: name and parent. Element 0 is the page."""
    out: list[Block] = []
    elements, at, slot = [("", 0)], 0, 0
    for token in page:
        if token.kind == "t":
            out.append(Block(token, slot, at))
            continue
        slot += bool(frame) and token_id(token) in frame
        if token.kind == "<":
            elements.append((token.name, at))
            at = len(elements) - 1
        else:
            at = elements[at][1]
    return out, elements


def container(blocks: list[Block], elements: list[tuple[str, int]]) -> list[bool]:
    """Which elements are in the nearest container of the largest slot: lists, quotes, tables and sections in it included.

    Lists, quotes, tables and the like are parts of a text, so the nearest element of ``CONTAINERS`` around all of
    the slot counts; and the one around that, if it has text of its own beside it. Only a ``div`` in ``body`` is
    told apart from text beside it.
    """
    holder = [0] * len(elements)
    for i, (name, parent) in enumerate(elements):
        holder[i] = i if name in CONTAINERS else holder[parent]
    sizes: dict = defaultdict(int)
    for block in blocks:
        sizes[block.slot] += len(block.token.text)
    largest = max(sizes, key=sizes.get)
    around = {b.element for b in blocks if b.slot == largest}
    top, seen = max(around), set()
    for element in around:
        while element != top and element not in seen:  # a parent has a smaller number
            if element > top:
                seen.add(element)
                element = elements[element][1]
            else:
                seen.add(top)
                top = elements[top][1]
    top, holders = holder[top], {holder[b.element] for b in blocks}
    while top and (outer := holder[elements[top][1]]) in holders and (elements[top][0] != "div" or elements[outer][0] not in ("body", "html", "")):
        top = outer
    inside = [False] * len(elements)
    for i, (_, parent) in enumerate(elements):
        inside[i] = i == top or inside[parent]
    return inside


def own_blocks(blocks: list[Block], texts: frozenset) -> list[Block]:
    """The blocks without those of the template.

    A heading stays if text of the page's own follows before the next heading of its level: all recipes
    of a host may have a heading "Ingredients". Names of cells and terms stay before such text likewise.
    """
    stay, below = [], [False] * 8
    for block in reversed(blocks):
        level = HEADINGS.get(block.token.name, 0)
        own = token_id(block.token) not in texts
        if own or (level and below[level]):
            stay.append(block)
        if own and (level == 0 or level == 7):
            below = [True] * 8
        elif level and level < 7:
            below[level:] = [False] * (8 - level)
            if own:
                below[:level] = [True] * level
        elif not level:
            below[7] = False
    return stay[::-1]


def _without_strong(blocks: list[Block]) -> list[Block]:
    """The blocks outside of strongly marked elements; if these hold all but headings, the marks say nothing."""
    left = [b for b in blocks if not b.token.strong]
    return left if any(not 0 < HEADINGS.get(b.token.name, 0) < 7 for b in left) else blocks


def main_text(page: str, frame: frozenset = frozenset(), texts: frozenset = frozenset(), marks: frozenset | None = None) -> str:
    """The blocks of a page's article, joined by blank lines.

    Blocks inside menus, forms and the like never count. Those that a class, id or role marks as advert, comments and
    so on do not either. Inside article and main a name that consists of such a word and words for parts decides
    by itself (``STRONG``), unless nothing but headings is left; other words need the host's pages (``marks``; None: no
    pages are known and all marks decide). Elsewhere all marks decide if the page has other text. Of the rest
    those inside article or main elements are the article where there are any; else all in the nearest container
    of the slot with most text. Text of the template is left out (:func:`own_blocks`), inside of article and main
    too; only where such elements hold nothing else they keep it, as the pages then share their article.
    """
    found, elements = slots(tokens(page), frame)
    found = [b for b in found if not b.token.aside and (marks is None or marks.isdisjoint(b.token.marks))]
    unmarked = [b for b in found if not b.token.marks]
    inside = [b for b in (unmarked if marks is None else found) if b.token.article]
    if inside:
        inside = _without_strong(inside)
        inside = own_blocks(inside, texts) or inside
    else:
        named = [own_blocks(b, texts) for b in (_without_strong(unmarked), _without_strong(found))]
        kept = named[0] or named[1]
        if kept:
            there = container([b for b in kept if token_id(b.token) not in texts], elements)
            inside = [b for b in kept if there[b.element]]
    return "\n\n".join(b.token.text for b in inside)


_TEXT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_TEXT)
    for b in batches:
        held, sets = None, (frozenset(),) * 3
        for row, pages in _pieces(b.column("html")):
            texts = []
            for i, page in enumerate(pages, row):
                host = b.column("host")[i].as_py()
                if host != held or held is None:
                    held = host
                    sets = tuple(frozenset(b.column(c)[i].as_py() or ()) for c in ("frame", "texts", "marks"))
                texts.append(main_text(page, *sets))
            n = len(texts)
            yield batch(schema, [b.column("page_id").slice(row, n), b.column("url").slice(row, n), texts, [len(t) for t in texts]])


def extract(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    NULL and empty pages have the empty text; a NULL or hostless URL belongs to the blank host. Repeated
    rows are rows of their own. Other columns are ignored; an empty table gives an empty result.
    """
    # As a table its size is known: Spark sends it to all tasks where it is small, else it shuffles.
    found = stored(templates(pages, support).select("host", "frame", "texts", "marks"), "templates")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    return rows.join(found, "host", "left").select("page_id", "url", "html", "host", "frame", "texts", "marks").mapInArrow(_extract, _TEXT)
