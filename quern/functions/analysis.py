"""What a question asks for, as column expressions: weighted terms, hints of a record's type, and a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text as tx

# Words about asking, general business nouns, words that name a type of record, and those that are content too.
INTENT_FILLER = (
    "am attend attending build building connect connecting explore exploring find finding hello help hey hi hope hoping interest interested "
    "look looking meet meeting need needing recommend search searching see seek seeking speak speaking talking thanks try trying visit want "
    "wanting work working happening presenting"
).split()
GENERIC_BUSINESS = "anyone business companie company enterprise firm folk guy org organisation organization people someone startup team vendor".split()
TYPE_WORDS = {
    "partner": "partner partnership sponsor exhibitor exhibiting booth stall networking",
    "speaker": "speaker panelist panellist presenter founder ceo",
    "session": "session talk panel keynote workshop masterclass roundtable fireside agenda schedule",
}
CONTENTFUL = "keynote workshop masterclass roundtable fireside panel founder ceo".split()
NUMBER_WORDS = {"one": "1", "first": "1", "two": "2", "second": "2", "three": "3", "third": "3", "last": "3", "final": "3"}
DEMOTED = 0.3
MONTH, MONTH_WORD = "2026-09", "sep(?:t|tember)?"


def _type_of(term: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, words in TYPE_WORDS.items():
        found = F.when(term.isin(*words.split()), kind).otherwise(found)
    return found


def analyse(c: str | Column, keep_filler: bool = False) -> Column:
    """A struct of `terms` (term and weight, in order), `dropped`, `hints` (types, in order of first mention) and `day`.

    A question of filler alone keeps its filler at the weight DEMOTED. Null and empty texts give empty arrays.
    """
    weighted = lambda t, w: F.struct(t.alias("term"), F.lit(w).cast("double").alias("weight"))
    typed = F.transform(tx.tokens(c), lambda t: F.struct(t.alias("t"), _type_of(t).alias("kind"), t.isin(*INTENT_FILLER, *GENERIC_BUSINESS).alias("filler")))
    kept = lambda x: F.when(x["kind"].isNotNull(), x["t"].isin(*CONTENTFUL)).otherwise(~x["filler"])
    if keep_filler:
        stays = lambda x: F.when(x["kind"].isNotNull(), x["t"].isin(*CONTENTFUL)).otherwise(True)
        terms = F.transform(F.filter(typed, stays), lambda x: weighted(x["t"], F.when(x["kind"].isNull() & x["filler"], DEMOTED).otherwise(1.0)))
        dropped = F.transform(F.filter(typed, lambda x: ~stays(x)), lambda x: x["t"])
    else:
        good = F.transform(F.filter(typed, kept), lambda x: weighted(x["t"], 1.0))
        gone = F.transform(F.filter(typed, lambda x: ~kept(x)), lambda x: x["t"])
        terms = F.when(F.size(good) > 0, good).otherwise(F.transform(gone, lambda t: weighted(t, DEMOTED)))
        dropped = F.when(F.size(good) > 0, gone).otherwise(F.slice(gone, 1, 0))
    hints = F.array_distinct(F.transform(F.filter(typed, lambda x: x["kind"].isNotNull()), lambda x: x["kind"]))
    return F.struct(terms.alias("terms"), dropped.alias("dropped"), hints.alias("hints"), infer_day(c).alias("day"))


def infer_day(c: str | Column) -> Column:
    """A day that a text names: an ISO date, the number of a day, or a date within MONTH; null if none."""
    low = F.lower(tx.col(c))
    part = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))

    def number(word: Column) -> Column:
        found = F.lit(None).cast("string")
        for w, n in NUMBER_WORDS.items():
            found = F.when(word == w, n).otherwise(found)
        return found

    dated = lambda day: F.concat(F.lit(f"{MONTH}-"), F.lpad(day.cast("int").cast("string"), 2, "0"))
    return F.coalesce(
        part(r"\b(20\d{2}-\d{2}-\d{2})\b"),
        part(r"\bday\s*([123])\b"),
        number(part(r"\b(first|second|third|last|final)\s+day\b")),
        number(part(r"\bday\s+(one|two|three)\b")),
        dated(part(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{MONTH_WORD}\b")),
        dated(part(rf"\b{MONTH_WORD}\s+(\d{{1,2}})(?:st|nd|rd|th)?\b")),
    )
