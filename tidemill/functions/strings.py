"""Search and display strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search ignores.
STOP_WORDS = ("a", "an", "and", "by", "in", "of", "on", "or", "the", "to", "will")
#: Short names and what a search also tries for them.
SYNONYMS = {"btc": "bitcoin", "eth": "ethereum", "fed": "federal reserve"}


def tokens(text: Column) -> Column:
    """Distinct lower-case words without stop words, in order of appearance."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS)))


def expanded(text: Column) -> Column:
    """Short names written out, at word borders only."""
    for short, long in SYNONYMS.items():
        text = F.regexp_replace(text, rf"(?i)\b{short}\b", long)
    return text


def matches(title: Column, search: Column) -> Column:
    """Every token of the search is one of the title."""
    return F.size(F.array_except(tokens(search), tokens(title))) == 0


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def clamped(text: Column, n: int) -> Column:
    """At most n characters, cut at a word and marked by an ellipsis."""
    head = F.substring(text, 1, n - 1)
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.rtrim(F.regexp_replace(head, r"\s\S*$", "")), F.lit("…")))


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"^(?s)(.*?[.!?])(?=\s|$)", 1)


def humanized(name: Column) -> Column:
    """snake_case or kebab-case as words, each with a capital."""
    return F.initcap(F.regexp_replace(name, "[_-]+", " "))
