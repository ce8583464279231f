"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ANY_BLANK = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    """Text without white space of any script at its ends (``trim`` only takes plain blanks)."""
    return F.regexp_replace(text, ANY_BLANK, "")


def approx_tokens(text: Column) -> Column:
    """One token for each four code points, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def marker_count(text: Column, marker: str = "<<") -> Column:
    """How often ``marker`` stands in the text, closed or not."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def span_texts(text: Column) -> Column:
    """Contents of the closed ``<<...>>`` spans, without blanks at their ends."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<<\s*(.*?)\s*>>"), F.lit(1))


def span_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?s)<<.*?>>"), F.lit(0)))


def last_part(name: Column, separator: str = "_") -> Column:
    return F.substring_index(name, separator, -1)


def one_spelling(name: Column) -> Column:
    """A key in one spelling: lower case, its parts joined by ``_``."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[-\s]+", "_")


def study_of(experiment: Column) -> Column:
    """The study of origin of an experiment key: its name and year, without the arm or visit behind them."""
    key = one_spelling(experiment)
    study = F.regexp_extract(key, r"^((?:igt_)?[a-z]+[0-9]{4})", 1)
    return F.when(study != "", study).otherwise(key)


def slug(name: Column) -> Column:
    """A name that is safe in paths: lower case, other characters than letters, digits, ``.`` and ``-`` as ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9.\-]+", "_"), "^_+|_+$", "")


def p_label(p: Column) -> Column:
    return F.when(p < 0.001, "< ,001").otherwise(F.format_string("%.4f", p))


def sentences(text: Column) -> Column:
    return F.split(stripped(text), r"(?<=[.!?])\s+")


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """The first phrase of the list that stands anywhere in the lowered text, else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(p.lower())), p) for p in phrases])


def first_word(text: Column, terms: list[str]) -> Column:
    """The term that stands first in the text as a whole word, in any case; null if there is none."""
    import re

    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(" + "|".join(re.escape(t) for t in terms) + r")\b", 1)
    return F.when(found != "", F.lower(found))


def choice_in(value: Column) -> Column:
    """The choice that a free answer names, by rules tried in this order.

    Text before a closing marker at the start; text behind the last opening marker, up to a
    closing marker, line end or punctuation; the content of the first closed span; the answer
    itself. Null and blank answers give an empty string.
    """
    text = F.coalesce(value, F.lit(""))
    closing = F.regexp_extract(text, r"^\s*([^<>»]+?)\s*(?:>>|Â»|»)", 1)
    tail = F.regexp_extract(text, r"(?s)^.*<<(.*)$", 1)
    tail = F.element_at(F.split(F.trim(tail), r">>|Â»|»|\n| Trial|\.\s|,|;|:", 2), 1)
    tail = F.trim(F.regexp_replace(F.trim(tail), r"^[<>\"'\s]+|[<>\"'\s]+$", ""))
    inner = F.regexp_extract(text, r"<<\s*(.*?)\s*>>", 1)
    return F.when(closing != "", F.trim(closing)).when(F.contains(text, F.lit("<<")) & (tail != ""), tail).when(inner != "", inner).otherwise(stripped(text))
