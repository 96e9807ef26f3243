"""Text normalisation as column expressions: folding, tokens, plural stems, person and company names, text checks."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters whose decomposition is one ASCII letter and marks, and those letters."""
    pairs = [(c, unicodedata.normalize("NFKD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFKD", c)) == 2 and unicodedata.normalize("NFKD", c)[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
# Punctuation of scraped text and its plain forms, stopwords, titles and suffixes, words that names of companies share,
# placeholders, and patterns of places.
CURLY, STRAIGHT = "‘’‚‛′“”„‟″‐‑‒–—―−    　…", "'''''\"\"\"\"\"-------     ."
STOPWORDS = (
    "a about after all also am an and any anyone are as at be been being before but by can could did do does doing for from get give going "
    "had has have he her here hers him his how i if in into is it its just know like list looking me more much my need no not of on one or "
    "other our out over please she should show so some such tell than that the their them then there these they this those to up us want "
    "was we were what when where which while who whom why will with would you your yes"
).split()
WEB_STOPWORDS = (
    "the and for are who what where when which with does did can you your about any all how that this from have has was were will would there "
    "their them they its just give tell show please list some into out get got partner partners booth stall number me my is it at of to in on or "
    "a an do be session sessions"
).split()
SALUTATIONS = (
    "hon'ble justice|hon'ble dr|hon'ble mr|hon'ble ms|air marshal|lt gen|maj gen|hon'ble|honble|honourable|honorable|justice|professor|"
    "ambassador|shrimati|advocate|kumari|prof|adv|gen|col|capt|cmde|amb|smt|shri|sri|miss|mrs|mx|sir|cma|dr|mr|ms|sh|ca|cs|kum"
)
NAME_SUFFIXES = "jr|sr|ii|iii|iv|phd|ph d|md|cfa|frm"
COMPANY_SUFFIXES = (
    "pvt|private|ltd|limited|llp|llc|inc|incorporated|corp|corporation|co|company|plc|gmbh|sa|nv|bv|holdings|group|technologies|technology|"
    "tech|labs|lab|solutions|systems|services|software|ventures|international|global|india|and"
)
COMPANY_NOISE = (
    r"\b(pvt|private|ltd|limited|llp|llc|inc|incorporated|corp|corporation|co|company|plc|gmbh|ag|nv|bv|sa|holdings?|group|india|indian|bharat|"
    "technologies|technology|tech|solutions|solution|services|service|systems|system|labs|lab|software|global|international|worldwide|"
    "enterprises?|ventures?|analytics|analytic|ai|bank|banking|payments?|payment|financial|finance|fintech|digital|data|network|networks|the|and)\\b"
)
PLACEHOLDERS = ("as attached", "n/a", "na", "tbd", "tba", "-", "--", ".")
CONTAMINATION = {
    "booth identifier": r"(?i)\b(booth|stall|kiosk|pavilion)\b\s*(no\.?|number|#)?\s*[:#-]?\s*[A-Za-z]{0,3}-?\d+[A-Za-z]?\b",
    "hall identifier": r"(?i)\b(hall|pavilion|zone|wing|level)\s+[A-Za-z]{0,3}-?\d+\b",
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: str | Column) -> Column:
    """Lower case without accents, plain punctuation, `&` as a word, single spaces. Null stays null."""
    plain = F.translate(F.translate(col(c), CURLY, STRAIGHT), ACCENTED, PLAIN)
    return F.btrim(F.regexp_replace(F.lower(F.replace(plain, F.lit("&"), F.lit(" and "))), r"[ \t-\r]+", " "))


def strip_possessive(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), "'s$", ""), "s'$", "s"), "'$", "")


def stem_plural(c: str | Column) -> Column:
    """A cautious plural stem: berries, lashes and oars lose their ending; glass, cactus and iris don't."""
    t = col(c)
    cut = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    return (
        F.when((F.length(t) <= 3) | ~F.endswith(t, F.lit("s")), t)  # most words end here, before any pattern
        .when(t.rlike("[^aeiou]ies$"), F.concat(cut(3), F.lit("y")))
        .when(t.rlike("(ch|sh|ss|x|z)es$"), cut(2))
        .when(t.rlike("(ss|us|is|as|os)$"), t)
        .otherwise(cut(1))
    )


def _chunk_terms(chunk: Column) -> Column:
    """The glued form of a chunk, and its parts if punctuation divides it."""
    bare = strip_possessive(chunk)
    glued = F.regexp_replace(bare, "[^a-z0-9]+", "")
    parts = F.filter(F.split(bare, "[^a-z0-9]+"), lambda x: x != "")
    return F.when(F.size(parts) <= 1, F.array(glued)).otherwise(F.concat(F.array(glued), parts))


def tokens(c: str | Column, keep_stopwords: bool = False) -> Column:
    """Stemmed terms of a text in order, repeats included; none for null."""
    terms = F.flatten(F.transform(F.split(F.coalesce(fold(c), F.lit("")), " "), _chunk_terms))
    paired = F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.struct(t.alias("t"), stem_plural(t).alias("s")))
    if not keep_stopwords:
        stop = lambda x: x.isin(*STOPWORDS)
        paired = F.filter(paired, lambda p: ~stop(p["t"]) & ~stop(p["s"]) & ((F.length(p["s"]) >= 2) | p["s"].rlike("^[0-9]$")))
    return F.transform(paired, lambda p: p["s"])


_FOLDED = str.maketrans(CURLY + ACCENTED, STRAIGHT + PLAIN)
_END = "(?=[\x85\u2028\u2029]?\\Z)"  # where a `$` of Java matches in a text without white space
_POSSESSIVE = [(re.compile(p + _END), by) for p, by in (("'s", ""), ("s'", "s"), ("'", ""))]


def stem_of(t: str) -> str:
    """`stem_plural` of one term of ASCII letters and digits."""
    if len(t) <= 3 or t[-1] != "s":
        return t
    if t.endswith("ies") and t[-4] not in "aeiou":
        return t[:-3] + "y"
    if t.endswith(("ches", "shes", "sses", "xes", "zes")):
        return t[:-2]
    return t if t.endswith(("ss", "us", "is", "as", "os")) else t[:-1]


def folded(text: str) -> str:
    """A text in lower case without accents and with plain punctuation, in plain Python; `&` and white space stay."""
    return text.translate(_FOLDED).lower()


def terms_of_chunk(chunk: str) -> list[tuple[str, str]]:
    """What `tokens` makes of a chunk between white space, stop words included: each term and its stem."""
    found = []
    for bare in folded(chunk).replace("&", " and ").split(" "):
        for pattern, by in _POSSESSIVE:
            bare = pattern.sub(by, bare)
        parts = re.findall("[a-z0-9]+", bare)
        found += parts if len(parts) <= 1 else ["".join(parts), *parts]
    return [(t, stem_of(t)) for t in found]


def term_rows(rows: DataFrame, text: str, *keep: str, keep_stopwords: bool = False, placed: bool = False) -> DataFrame:
    """The columns to keep and `term`: what `tokens` gives, one row a term. Chunks are told apart row by row, in generated code.

    With `placed` there is `at` too, a number that grows with the term's place in the text; it has gaps.
    """
    chunks = rows.select(*keep, F.posexplode(F.split(fold(text), " ")).alias("nth", "chunk")).where("chunk <> ''")
    terms = F.when(F.col("chunk").rlike("^[a-z0-9]+$"), F.array("chunk")).otherwise(_chunk_terms(F.col("chunk")))
    found = chunks.select(*keep, "nth", F.posexplode(terms).alias("part", "t")).where("t <> ''")
    at = [(F.shiftleft(F.col("nth").cast("long"), 24) + F.col("part")).alias("at")] if placed else []
    found = found.select(*keep, *at, "t", stem_plural("t").alias("term"))
    if not keep_stopwords:
        found = found.where(~F.col("t").isin(*STOPWORDS) & ~F.col("term").isin(*STOPWORDS) & ((F.length("term") >= 2) | F.col("term").rlike("^[0-9]$")))
    return found.drop("t")


def spread(rows: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores at least; a table in more of them stays where it lies."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def words(c: str | Column) -> Column:
    """Plain lower-case ASCII terms, for indexes over large texts."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def normalise_name(c: str | Column) -> Column:
    """An entity name folded, punctuation glued, each word stemmed: 'J.P. Morgan' and 'JP Morgan' agree."""
    glued = F.transform(F.split(fold(c), " "), lambda x: F.regexp_replace(strip_possessive(x), "[^a-z0-9]+", ""))
    return F.array_join(F.transform(F.filter(glued, lambda x: x != ""), stem_plural), " ")


def person_key(c: str | Column) -> Column:
    """A person's name for joins: before the first comma, without titles, suffixes, accents and punctuation; '' for null."""
    head = F.split_part(F.coalesce(col(c), F.lit("")), F.lit(","), F.lit(1))
    plain = F.btrim(F.regexp_replace(F.regexp_replace(F.replace(fold(head), F.lit("'"), F.lit("")), r"[.,;:()\[\]\"`]", " "), " +", " "))
    bare = F.btrim(F.regexp_replace(plain, f"^(?:(?:{SALUTATIONS.replace(chr(39), '')})(?: |$))+", ""))
    return F.regexp_replace(bare, f"(?: (?:{NAME_SUFFIXES}))+$", "")


def split_speaker(c: str | Column) -> Column:
    """A struct of name, designation and organisation from 'name, designation, organisation ...'; blank gives nulls."""
    parts = F.transform(F.split(col(c), ","), lambda x: F.btrim(x))
    blank = lambda x: F.nullif(x, F.lit(""))
    org = F.array_join(F.filter(F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1))), lambda x: x != ""), ", ")
    return F.struct(blank(F.get(parts, F.lit(0))).alias("name"), blank(F.get(parts, F.lit(1))).alias("designation"), blank(org).alias("org"))


def company_keys(c: str | Column) -> Column:
    """Identity keys of a company: the squashed name, and that without noise words. Any shared key means the same company."""
    s = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\([^)]*\)", " ")
    s = F.regexp_replace(F.replace(s, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    stripped = F.replace(F.regexp_replace(s, COMPANY_NOISE, " "), F.lit(" "), F.lit(""))
    return F.filter(F.array_distinct(F.array(F.replace(s, F.lit(" "), F.lit("")), stripped)), lambda k: k != "")


def company_aliases(c: str | Column) -> Column:
    """The normalised name, its glued form, and both without trailing corporate suffixes; sorted, two letters at least."""
    name = normalise_name(c)
    head = F.regexp_replace(name, f"(?: (?:{COMPANY_SUFFIXES}))+$", "")
    every = F.array(name, F.replace(name, F.lit(" "), F.lit("")), head, F.replace(head, F.lit(" "), F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(every, lambda a: F.length(a) >= 2)))


def clean(c: str | Column) -> Column:
    """White space collapsed; blank becomes null."""
    return F.nullif(F.btrim(F.regexp_replace(col(c), r"[ \t-\r]+", " ")), F.lit(""))


def junk_reason(c: str | Column) -> Column:
    """Why a text isn't prose, or null."""
    t = F.btrim(col(c), F.lit(" \t\n\x0b\f\r"))
    return (
        F.when(t.rlike(r"^\$[0-9A-Za-z]{1,6}$"), "unresolved-placeholder-token")
        .when(F.lower(t).isin(*PLACEHOLDERS), "placeholder-value")
        .when(t.rlike(r"^https?://[^ \t-\r]+$"), "link-only-no-prose")
    )


def contamination(c: str | Column, event: str | None = None, year: int | None = None, venues: tuple[str, ...] = ()) -> Column:
    """Reasons to withhold a whole text, in order; none for null. With an event and its year, copy of another edition is one; with venues, their names."""
    reasons = [F.when(col(c).rlike(p), F.lit(reason)) for reason, p in CONTAMINATION.items()]
    if event and year:
        edition = F.regexp_extract(col(c), rf"(?i)\b{event}[ \t-\r]*(20[0-9]{{2}})\b", 1)
        reasons.append(F.when((edition != "") & (edition != str(year)), F.concat(F.lit(f"{event} "), edition, F.lit(" content"))))
    if venues:
        reasons.append(F.when(col(c).rlike(r"(?i)\b(?:" + "|".join(venues) + r")\b"), F.lit("venue/location text")))
    return F.array_compact(F.array(*reasons))


def web_tokens(c: str | Column) -> Column:
    """Terms of the plain tokeniser: lower-case runs of ASCII letters and digits of three or more that are no stopwords, each once."""
    runs = F.split(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(runs, lambda w: (F.length(w) > 2) & ~w.isin(*WEB_STOPWORDS)))


def slug(c: str | Column) -> Column:
    return F.btrim(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), F.lit("-"))


def to_minutes(c: str | Column) -> Column:
    """Minutes of 'H:MM'; 0 for anything else."""
    t = col(c)
    return F.when(t.rlike("^[0-9]{1,2}:[0-9]{2}$"), F.split_part(t, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(t, F.lit(":"), F.lit(2)).cast("int")).otherwise(0)


def hhmm(minutes: str | Column) -> Column:
    m = col(minutes).cast("int")
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), m % 60)


def fnv1a(c: str | Column) -> Column:
    """32-bit FNV-1a of an ASCII text."""
    chars = F.filter(F.split(col(c), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))
