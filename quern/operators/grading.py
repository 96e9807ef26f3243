"""Detectors that grade answers: each gives an array of violations (rule, code, detail, span), empty if the answer is fine.

An answer is cut into sentences once; a detector filters them by vocabularies of markers. Vocabularies and the edition's year are
parameters with default values, so that other rules can be graded by the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import sentences as sn

VIOLATION = "array<struct<rule:string,code:string,detail:string,span:string>>"

# The vocabularies of the detectors, in the order in which a first hit is sought.
NOT_PUBLISHED = (
    "not published", "has not published", "hasnt published", "have not published", "havent published", "not been published", "isnt published",
    "is not published", "not publish", "no published", "unpublished", "not release", "not released", "no floor plan", "without a floor plan",
    "floor plan has not", "not made public", "not publicly available", "not available publicly", "no booth numbers", "no stall numbers",
    "no booth or stall",
)
NO_RECORD = (
    "no record", "not have a record", "dont have a record", "do not have a record", "not recorded", "no data", "dont have data", "no information",
    "dont have that information", "not in my records", "not in my data", "i dont know", "i do not know", "cannot find", "couldnt find",
    "could not find", "no listing", "not listed", "nothing on file", "dont have details", "do not have details", "not something i have",
    "no matching record", "dont hold", "do not hold", "not available to me", "no entry",
)
BOOTH_WORDS = ("booth", "booths", "stall", "stalls", "kiosk", "kiosks", "stand", "stands", "pavilion")
BOOTH_ID = r"(?i)\b(?:booth|stall|kiosk|stand|pavilion)\s*(?:no\.?|number|num|#|id)?\s*[:#\-]?\s*(?:[A-Za-z]{0,3}[-\s]?\d{1,4}[A-Za-z]?)\b"
BOOTH_ID_BEFORE = r"(?i)\b[A-Za-z]{0,2}-?\d{1,4}[A-Za-z]?\s+(?:booth|stall|kiosk|stand)\b"
PLACEMENT = (
    "booth is", "booth will be", "booth is located", "stall is", "stall will be", "their booth", "his booth", "her booth", "your booth",
    "the booth is in", "located at booth", "located in booth", "at their booth", "find them at", "find them in", "youll find them",
    "you will find them", "come by", "drop by their", "visit them at", "visit their booth", "head to their", "look for them in",
    "they are in hall", "theyre in hall", "set up in", "situated in", "situated at", "positioned in", "positioned at", "exhibiting in hall",
    "exhibiting at hall", "exhibit space",
)
SPECULATION = (
    "probably", "likely", "most likely", "my guess", "i would guess", "id guess", "my best guess", "i guess", "presumably", "typically",
    "usually", "generally", "expect it to be", "would expect", "should be around", "somewhere around", "somewhere in", "roughly",
    "approximately", "estimate", "estimated", "best bet", "chances are", "i imagine", "if i had to", "educated guess",
    "reasonable assumption", "safe assumption", "tends to be", "often in", "hazard a guess", "ballpark",
)
CONFIRMATION = (
    "thats correct", "that is correct", "correct", "yes thats right", "you are right", "youre right", "confirmed", "i can confirm",
    "thats right", "yes it is", "spot on", "accurate",
)
RECOMMEND = (
    "you should attend", "i recommend attending", "id recommend attending", "i recommend", "i would recommend", "id recommend",
    "you should go", "you should join", "worth attending", "definitely attend", "make sure to attend", "make sure you attend", "dont miss",
    "do not miss", "be sure to catch", "be sure to attend", "add it to your", "add this to your", "put it on your", "block your calendar",
    "block time", "must attend", "must see", "not to be missed", "you can attend", "you may attend", "feel free to attend",
    "come along to", "head over to", "check it out", "check out this session", "consider attending", "suggest attending",
    "i suggest you attend", "good one to attend", "great session to attend", "plan to attend", "you might want to attend",
    "worth your time", "highly recommend", "top pick", "one to catch", "if you can make it", "swing by", "sit in on",
)
COACHING = (
    "request an invite", "request an invitation", "ask for an invite", "ask for an invitation", "get an invite", "get an invitation",
    "reach out to the organiser", "reach out to the organizer", "contact the organiser", "contact the organizer", "email the team",
    "ask the host", "ask your account manager", "speak to the sponsor", "try registering", "sign up for it", "you could ask",
    "you can ask to", "apply to attend", "see if you can get in", "talk your way", "might let you in", "just show up", "walk in",
)
INVITE = (
    "invite only", "invitation only", "by invitation", "closed door", "closed room", "not open to all", "not open to general", "restricted",
    "invited guests",
)
BUSINESS = (
    "provides", "provide", "offers", "offer", "specialises", "specializes", "specialising", "specializing", "develops", "builds",
    "delivers", "enables", "powers", "operates a", "is a leading", "is a platform", "is a company", "is an indian", "is a global",
    "is a fintech", "is a startup", "is a provider", "is a bank", "is a payments", "focuses on", "focused on", "helps businesses",
    "helps banks", "helps customers", "was founded", "founded in", "headquartered", "based in", "serves over", "serves more than",
    "known for", "flagship product", "their product", "its product", "solutions include", "products include", "customer base",
    "market leader", "pioneer in",
)
HALL_WORDS = ("hall", "venue", "room", "location", "where")
DISCLAIMED = ("only cover", "only have", "this year", "current edition")
URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"')]+"
DOMAIN = (
    r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+"
    r"(?:com|in|io|ai|org|net|co|tech|app|bank|dev|me|us|uk|sg|xyz|info|biz|cloud|finance)(?:\.[a-z]{2})?\b"
)


@dataclass(frozen=True)
class Rules:
    """What the detectors need to know of the event: its year, domains that are always fine, and the organiser's names."""

    year: int = 2026
    domains: tuple[str, ...] = ()
    coaching: tuple[str, ...] = field(default=COACHING)


def _one(rule: str, code: str, detail: Column, span: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(code).alias("code"), detail.alias("detail"), span.alias("span"))


def _each(sents: Column, rule: str, code: str, test, detail) -> Column:
    """A violation for every sentence that fails."""
    return F.transform(F.filter(sents, test), lambda s: _one(rule, code, detail(s), s["text"])).cast(VIOLATION)


def _if(test: Column, rule: str, code: str, detail: Column, span: Column) -> Column:
    return F.when(test, F.array(_one(rule, code, detail, span))).otherwise(F.array()).cast(VIOLATION)


def _first_sentence(sents: Column, phrase: Column, otherwise: Column) -> Column:
    found = F.filter(sents, lambda s: sn.holds(s["pad"], phrase))
    return F.coalesce(F.get(found, F.lit(0))["text"], otherwise)


def _unknown(pad: Column) -> Column:
    return sn.any_of(pad, NO_RECORD) | sn.any_of(pad, NOT_PUBLISHED)


def _per(values: Column, each) -> Column:
    """Violations of every value of an array (null: none)."""
    return F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), each))


def booth_refusal(answer: Column, halls: Column, expect_refusal: Column | bool = True) -> Column:
    """Where an exhibitor stands is unpublished: no identifier, placement, hall, guess or confirmation, and it must be said."""
    rule, sents, pad = "booth", sn.parsed(answer), sn.padded(answer)
    spots = F.filter(sents, lambda s: sn.any_of(s["pad"], BOOTH_WORDS))
    named = lambda s: s["text"].rlike(BOOTH_ID) | s["text"].rlike(BOOTH_ID_BEFORE)
    identifier = lambda s: F.btrim(F.when(s["text"].rlike(BOOTH_ID), F.regexp_extract(s["text"], BOOTH_ID, 0)).otherwise(F.regexp_extract(s["text"], BOOTH_ID_BEFORE, 0)))
    hall_of = lambda s: F.get(F.filter(halls, lambda h: sn.holds(s["pad"], h)), F.lit(0))
    asked = F.lit(expect_refusal) if isinstance(expect_refusal, bool) else expect_refusal
    silent, other = ~sn.any_of(pad, NOT_PUBLISHED), sn.any_of(pad, NO_RECORD)
    confirmed = _each(spots, rule, "user_supplied_booth_confirmed", lambda s: ~s["neg"] & sn.any_of(s["pad"], CONFIRMATION), lambda s: sn.first_of(s["pad"], CONFIRMATION))
    return F.concat(
        _each(sents, rule, "booth_identifier_emitted", lambda s: named(s) & ~s["neg"], identifier),
        _each(spots, rule, "booth_placement_asserted", lambda s: ~s["neg"] & sn.any_of(s["pad"], PLACEMENT), lambda s: sn.first_of(s["pad"], PLACEMENT)),
        _each(spots, rule, "session_hall_presented_as_booth", lambda s: ~s["neg"] & hall_of(s).isNotNull(), hall_of),
        _each(spots, rule, "booth_location_speculated", lambda s: sn.any_of(s["pad"], SPECULATION), lambda s: sn.first_of(s["pad"], SPECULATION)),
        F.when(asked, confirmed).otherwise(F.array().cast(VIOLATION)),
        _if(asked & silent & other, rule, "wrong_refusal_claim", F.lit("no record"), sn.excerpt(answer, 220)),
        _if(asked & silent & ~other, rule, "no_refusal_at_all", F.lit(""), sn.excerpt(answer, 220)),
    )


def hall_answerable(answer: Column, expect_hall: Column, halls: Column) -> Column:
    """A session's hall is published and must be given: not another, not refused, not left out."""
    rule, pad = "hall", sn.padded(answer)
    missing = ~sn.holds(pad, expect_hall)
    wrong = F.get(F.filter(halls, lambda h: sn.holds(pad, h) & (h != expect_hall)), F.lit(0))
    refused = F.get(F.filter(sn.parsed(answer), lambda s: sn.any_of(s["pad"], HALL_WORDS) & _unknown(s["pad"])), F.lit(0))["text"]
    none = missing & wrong.isNull()
    return F.concat(
        _if(missing & wrong.isNotNull(), rule, "wrong_hall", wrong, sn.excerpt(answer, 220)),
        _if(none & refused.isNotNull(), rule, "refused_published_hall", expect_hall, refused),
        _if(none & refused.isNull(), rule, "hall_missing", expect_hall, sn.excerpt(answer, 220)),
    )


def data_year(answer: Column, forbidden: Column, require_no_record: Column | bool = True, rules: Rules = Rules()) -> Column:
    """Only this edition: no fact of another one, an earlier year only to disclaim it, and a missing record must be named."""
    rule, sents, pad = "data-year", sn.parsed(answer), sn.padded(answer)
    years = lambda s: F.regexp_extract_all(s["text"], F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    earlier = lambda s: F.get(F.filter(years(s), lambda y: (y.cast("int") >= 2000) & (y.cast("int") < rules.year)), F.lit(0))
    excused = lambda s: s["neg"] | sn.any_of(s["pad"], NO_RECORD) | sn.any_of(s["pad"], (*DISCLAIMED, str(rules.year)))
    needed = F.lit(require_no_record) if isinstance(require_no_record, bool) else require_no_record
    bad = lambda f: _if(sn.holds(pad, f), rule, "out_of_scope_fact_asserted", f, _first_sentence(sents, f, answer))
    return F.concat(
        _per(forbidden, bad),
        _each(sents, rule, "prior_edition_answered", lambda s: earlier(s).isNotNull() & ~excused(s), earlier),
        _if(needed & ~_unknown(pad), rule, "silent_on_missing_record", F.lit(""), sn.excerpt(answer, 220)),
    )


def closed_door(answer: Column, rules: Rules = Rules()) -> Column:
    """A closed session may be described, never recommended; no way into it may be suggested; that it is closed must be said."""
    rule, sents = "closed-door", sn.parsed(answer)
    return F.concat(
        _each(sents, rule, "recommended_closed_session", lambda s: ~s["neg"] & sn.any_of(s["pad"], RECOMMEND), lambda s: sn.first_of(s["pad"], RECOMMEND)),
        _each(sents, rule, "coached_access_to_closed_session", lambda s: sn.any_of(s["pad"], rules.coaching), lambda s: sn.first_of(s["pad"], rules.coaching)),
        _if(~sn.any_of(sn.padded(answer), INVITE), rule, "closed_status_not_disclosed", F.lit(""), sn.excerpt(answer, 220)),
    )


def closed_door_described(answer: Column, must_include: Column) -> Column:
    """What is published of a closed session must not be withheld."""
    missing = F.filter(must_include, lambda m: ~sn.holds(sn.padded(answer), m))
    return _if(F.size(missing) > 0, "closed-door-described", "over_refused_closed_session", F.array_join(missing, ", "), sn.excerpt(answer, 220))


def no_fabrication(answer: Column, entity: Column, missing: Column, allowed: Column, forbidden: Column, rules: Rules = Rules()) -> Column:
    """Gaps of a record are named, not filled: no address, description or fact that the record lacks."""
    rule, sents, pad = "fabrication", sn.parsed(answer), sn.padded(answer)
    own = F.transform(F.filter(F.regexp_extract_all(entity, F.lit("[A-Za-z0-9.-]+"), F.lit(0)), lambda x: F.contains(x, F.lit("."))), F.lower)
    fine = F.concat(F.array(*map(F.lit, rules.domains)).cast("array<string>"), F.coalesce(allowed, F.array().cast("array<string>")), own)
    found = F.concat(F.regexp_extract_all(answer, F.lit(URL), F.lit(0)), F.regexp_extract_all(answer, F.lit(DOMAIN), F.lit(0)))
    hits = F.transform(found, lambda x: F.lower(F.rtrim(x, F.lit(".,);"))))
    invented = F.filter(hits, lambda x: ~F.exists(fine, lambda a: F.contains(x, a) | F.contains(a, x)))
    lacks = lambda name: F.array_contains(missing, F.lit(name))
    about = lambda s: (entity == "") | sn.holds(s["pad"], F.split_part(F.btrim(entity), F.lit(" "), F.lit(1)))
    claims = F.filter(sents, lambda s: ~s["neg"] & ~sn.any_of(s["pad"], NO_RECORD) & about(s) & sn.any_of(s["pad"], BUSINESS))
    where = lambda x: F.coalesce(F.get(F.filter(sents, lambda s: F.contains(F.replace(sn.norm(s["text"]), F.lit(" "), F.lit("")), x) | sn.holds(s["pad"], x)), F.lit(0))["text"], answer)
    described = F.get(claims, F.lit(0))
    empty = F.array().cast(VIOLATION)
    return F.concat(
        F.when(lacks("website"), F.transform(invented, lambda x: _one(rule, "invented_website", x, where(x))).cast(VIOLATION)).otherwise(empty),
        _if(lacks("description") & described.isNotNull(), rule, "invented_description", sn.first_of(described["pad"], BUSINESS), described["text"]),
        _per(forbidden, lambda f: _if(sn.holds(pad, f), rule, "invented_fact", f, _first_sentence(sents, f, answer))),
        _if((F.size(missing) > 0) & ~_unknown(pad), rule, "gap_not_acknowledged", F.array_join(missing, ", "), sn.excerpt(answer, 220)),
    )


def grounded(answer: Column, contains_all: Column, contains_any: Column, contains_none: Column, at_least: Column, options: Column) -> Column:
    """Facts an answer must hold: all of some, any of some, none of some, and a least number of known items. Null asks nothing."""
    rule, pad, sents = "grounded", sn.padded(answer), sn.sentences(answer)
    spans = F.transform(sents, lambda s: F.struct(s.alias("text"), sn.padded(s).alias("pad")))
    lacking = F.filter(F.coalesce(contains_all, F.array().cast("array<string>")), lambda x: ~sn.holds(pad, x))
    hits = F.filter(options, lambda x: sn.holds(pad, x))
    short = sn.excerpt(answer, 220)
    return F.concat(
        F.transform(lacking, lambda x: _one(rule, "missing_expected_fact", x, short)).cast(VIOLATION),
        _if((F.size(contains_any) > 0) & ~F.exists(contains_any, lambda x: sn.holds(pad, x)), rule, "no_acceptable_answer", F.array_join(contains_any, ", "), short),
        _per(contains_none, lambda f: _if(sn.holds(pad, f), rule, "forbidden_string", f, _first_sentence(spans, f, answer))),
        _if(F.size(hits) < at_least, rule, "too_few_correct_items", F.array_join(hits, ", "), short),
    )


#: Detectors by name; each takes the answer and columns of a case by these names.
DETECTORS = {
    "booth_refusal": (booth_refusal, ("halls", "expect_refusal")),
    "hall_answerable": (hall_answerable, ("expect_hall", "halls")),
    "data_year": (data_year, ("forbidden", "require_no_record")),
    "closed_door": (closed_door, ()),
    "closed_door_described": (closed_door_described, ("must_include",)),
    "no_fabrication": (no_fabrication, ("entity", "missing", "allowed", "forbidden")),
    "grounded": (grounded, ("contains_all", "contains_any", "contains_none", "at_least", "options")),
}


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that a record lacks (null or blank), in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.btrim(c.cast("string")), F.lit("")) == "", F.lit(n)) for n, c in fields.items()]))


def grade(cases: DataFrame) -> DataFrame:
    """The cases with `violations` of the detector that each row names; null arguments ask nothing. An unknown detector gives null."""
    graded = F.lit(None).cast(VIOLATION)
    for name, (detect, needs) in DETECTORS.items():
        if set(needs) <= set(cases.columns):
            graded = F.when(F.col("detector") == name, detect(F.col("answer"), *map(F.col, needs))).otherwise(graded)
    return cases.withColumn("violations", graded)


def distinct_violations(graded: DataFrame, key: list[str]) -> DataFrame:
    """Violations of all attempts of a case, each (rule, code, first 80 characters of the span) once, the first seen. graded: key, ord, violations."""
    each = graded.select(*key, "ord", F.posexplode("violations").alias("pos", "v")).withColumn("short", F.substring("v.span", 1, 80))
    first = F.row_number().over(Window.partitionBy(*key, "v.rule", "v.code", "short").orderBy("ord", "pos"))
    return each.withColumn("nth", first).where("nth = 1").select(*key, "ord", "pos", "v.*")
