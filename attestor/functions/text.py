"""Scalar text expressions. All are native Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from attestor import presets


def text(value) -> Column:
    """A column as a non-null string; names are accepted like everywhere in Spark."""
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(c.cast("string"), F.lit(""))


def blank_to_null(value) -> Column:
    return F.nullif(F.trim(text(value)), F.lit(""))


def first_text(*values) -> Column:
    """The first non-blank of several columns, trimmed; ``""`` when all are blank."""
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(""))


def collapse(value) -> Column:
    """Runs of (Unicode) whitespace become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text(value), r"(?U)\s+", " "))


# Well-formed tags, comments and declarations. A bare "<" in running text ("p < 0.05") is no tag.
_MARKUP = (
    r"""</?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*/?>"""
    r"|<!--(?s:.*?)-->|<[!?][^<>]*>"
)


def flatten_markup(value) -> Column:
    """Element text in document order: tags dropped, whitespace collapsed."""
    return collapse(F.regexp_replace(text(value), _MARKUP, ""))


def normalise(value) -> Column:
    """Collapsed text in which ``none`` and ``nan`` mean blank."""
    c = collapse(value)
    return F.when(F.lower(c).isin("none", "nan"), F.lit("")).otherwise(c)


def split_candidates(value) -> Column:
    """The pipe-separated parts of a text, or the whole text when no part remains."""
    whole = normalise(value)
    parts = F.filter(F.transform(F.split(whole, r"\|"), normalise), lambda p: p != "")
    return (
        F.when(whole == "", F.array().cast("array<string>"))
        .when(F.size(parts) == 0, F.array(whole))
        .otherwise(parts)
    )


def title_tokens(value) -> Column:
    """The set of lower-case alphabetic words of two letters or more."""
    words = F.regexp_extract_all(text(value), F.lit("[a-zA-Z]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 1), F.lower))


def jaccard(tokens_a: Column, tokens_b: Column) -> Column:
    """Set overlap of two distinct-token arrays, 4 decimals; 0 when either is empty."""
    shared = F.size(F.array_intersect(tokens_a, tokens_b))
    union = F.size(tokens_a) + F.size(tokens_b) - shared
    return F.when((F.size(tokens_a) == 0) | (F.size(tokens_b) == 0), F.lit(0.0)).otherwise(
        F.round(shared / union, 4)
    )


def title_key_words(value, limit: int | None = None) -> Column:
    """Title words longer than two characters, in order; the first ``limit`` of them where one is given."""
    cleaned = F.trim(F.regexp_replace(text(value), r"(?U)[^\w\s]", " "))
    words = F.filter(F.split(cleaned, r"(?U)\s+"), lambda w: F.length(w) > 2)
    return words if limit is None else F.slice(words, 1, limit)


def year_in(value) -> Column:
    """The first 19xx or 20xx in a text, as a string; NULL when there is none."""
    return F.nullif(F.regexp_extract(text(value), r"\b(?:19|20)\d{2}\b", 0), F.lit(""))


def years_agree(year_a: Column, year_b: Column, window: int = presets.YEAR_WINDOW) -> Column:
    """Both years known and at most ``window`` apart."""
    gap = F.abs(year_a.try_cast("int") - year_b.try_cast("int"))
    return F.coalesce(gap <= window, F.lit(False))


def iso_date(value) -> Column:
    """Full ISO dates (dash or slash), alone or followed by a time; partial dates and other text become NULL."""
    c = F.replace(F.trim(text(value)), F.lit("/"), F.lit("-"))
    # The shape is tested first: failing date parses are slow.
    whole = c.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(whole, F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def truthy(value) -> Column:
    return F.lower(F.trim(text(value))).isin(*presets.TRUE_WORDS)


def safe_text(value, fallback: str = "Not available.") -> Column:
    return F.coalesce(blank_to_null(value), F.lit(fallback))


def number(value) -> Column:
    return text(value).try_cast("double")


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals; exact ties go to the even digit."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def fmt_num(value, digits: int = 2, fallback: str = "-") -> Column:
    n = number(value)
    return F.when(n.isNull() | F.isnan(n), F.lit(fallback)).otherwise(fixed(n, digits))


def fmt_pct(part: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit("0.0%")).otherwise(F.concat(fixed(part / total * 100, 1), F.lit("%")))


def percent(part: Column, total: Column, digits: int = 1) -> Column:
    """``part`` as a share of ``total`` in percent, the total counted as at least one."""
    return F.round(part / F.greatest(total, F.lit(1)) * 100, digits)


def decimal(value: Column) -> Column:
    """A decimal text with a point or a comma."""
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def pair_key(nct_id, pmid) -> Column:
    return F.concat_ws("_", text(nct_id), text(pmid))


def pair_nct(pair_id) -> Column:
    return F.split(text(pair_id), "_", 2)[0]


def pair_pmid(pair_id) -> Column:
    return F.coalesce(F.get(F.split(text(pair_id), "_", 2), 1), F.lit(""))


def stable_rank(value) -> Column:
    """First 16 hex digits of SHA-256; fixed-width hex sorts as the unsigned number does."""
    return F.substring(F.sha2(text(value), 256), 1, 16)


def labels(value, names: dict[str, str]) -> Column:
    """Readable names for coded values; unknown values stay as they are."""
    c = F.col(value) if isinstance(value, str) else value
    out = F.when(F.lit(False), c)
    for code, name in names.items():
        out = out.when(c == code, F.lit(name))
    return out.otherwise(c)


def matching_texts(cases: Sequence[tuple[Column, Column | str]]) -> Column:
    """The texts whose condition holds, in order."""
    texts = [F.when(cond, F.lit(t) if isinstance(t, str) else t) for cond, t in cases]
    return F.filter(F.array(*texts), lambda t: t.isNotNull())


def fill_template(template: str, **values: Column) -> Column:
    """A text template with ``{name}`` slots, as one concatenation."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), values[name]]
    return F.concat(*pieces, F.lit(rest))
