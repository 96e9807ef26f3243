"""Sentences of an answer and tests on them, as column expressions: normal form, phrases, negation, excerpts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that negate a sentence, each standing alone in its normal form.
NEGATION = (
    "not", "no", "never", "none", "nor", "cannot", "can t", "cant", "won t", "wont", "don t", "dont", "doesn t", "doesnt", "isn t", "isnt",
    "aren t", "arent", "hasn t", "hasnt", "haven t", "havent", "unable", "unpublished", "undisclosed", "without",
)
SPACE = r"[ \t-\r]"


def plain(phrase: str) -> str:
    """The normal form of a phrase known beforehand."""
    return re.sub("[^a-z0-9]+", " ", phrase.lower()).strip()


def norm(c: Column) -> Column:
    """Lower case, all but a-z and 0-9 as single spaces, none at the ends; '' for null."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def padded(c: Column) -> Column:
    """The normal form between two spaces, so that whole words can be sought in it."""
    return F.concat(F.lit(" "), norm(c), F.lit(" "))


def sentences(c: Column) -> Column:
    """Spans of a text that end in .!?;: before white space, or at a line's end; trimmed, none blank."""
    lines = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), rf"([.!?;:]){SPACE}+", "$1\n"), "\n")
    trimmed = F.transform(lines, lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def any_of(pad: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a padded text holds one of the phrases as whole words."""
    return pad.rlike(f" (?:{'|'.join(dict.fromkeys(map(plain, phrases)))}) ")


def first_of(pad: Column, phrases: tuple[str, ...]) -> Column:
    """The first phrase, in the order of the list, that a padded text holds; null if none."""
    every = F.array(*[F.lit(p) for p in phrases])
    has = F.filter(every, lambda p: F.contains(pad, padded(p)))
    return F.when(any_of(pad, phrases), F.get(has, F.lit(0)))


def holds(pad: Column, phrase: Column) -> Column:
    """Whether a padded text holds a phrase from a column; a phrase without words is nowhere."""
    return (norm(phrase) != "") & F.contains(pad, padded(phrase))


def negated(pad: Column) -> Column:
    return any_of(pad, NEGATION)


def excerpt(c: Column, limit: int = 160) -> Column:
    """A text in one line, cut to `limit` characters with an ellipsis."""
    one = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{SPACE}+", " "))
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.substring(one, 1, limit - 1), F.lit("…")))


def parsed(c: Column) -> Column:
    """Structs of every sentence: its text, padded normal form, and whether it is negated."""
    padded_too = F.transform(sentences(c), lambda s: F.struct(s.alias("text"), padded(s).alias("pad")))
    return F.transform(padded_too, lambda s: F.struct(s["text"].alias("text"), s["pad"].alias("pad"), negated(s["pad"]).alias("neg")))
