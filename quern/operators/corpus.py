"""Chunks of a corpus: texts of partners, speakers and sessions with what enriches them, checks observed while a corpus is written, and
where a chunk's body stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import agenda, partners
from quern.storage import stored

# Tiers by group, and the sentences that mark sessions that are not open.
HEADLINE = ("Brought To You By", "Co-Powered By")
SPONSORS = ("Diamond Partner", "Platinum Partner", "Gold Partner", "Silver Partner", "Bronze Partner", "Associate Partner")
CLOSED_NOTE = "ACCESS: closed-door / invite-only. This session is NOT open to general attendees and must not be recommended as attendable."
OPEN_NOTE = "Access: open to attendees."
CLOSED_TALK = " This session is closed-door / invite-only and is not open to general attendees."
#: Of a chunk, beside id, type, title and text: its record's key, the body it carries and the source it comes from, and what checks need.
COLUMNS = ("id", "type", "title", "text", "key", "body", "raw", "year", "closed", "attendable", "access", "closed_codes", "flagged", "hall")


def group_of(tier: Column) -> Column:
    """The coarse group of a tier."""
    return (
        F.when(F.coalesce(tier, F.lit("")) == "", "unclassified").when(tier == "Organiser", "organiser").when(tier.isin(*HEADLINE), "headline").when(tier.isin(*SPONSORS), "sponsor")
        .when(tier.isin("Exhibitor", "Ecosystem", "Supporter"), F.lower(tier)).otherwise("category-partner")
    )


def reject_rules(event: str, year: int) -> tuple[tuple[str, str], ...]:
    """Reasons to reject scraped copy: those of partners, and copy of the event's earlier editions."""
    before = "|".join(str(y) for y in range(2010, year))
    return (partners.REJECTED[0], ("prior-year event copy", rf"(?i){event}[ \t-\r]+({before})\b"), *partners.REJECTED[1:])


def _line(*parts: Column | str) -> Column:
    """The parts as one text, null if one of them is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _listed(label: str, items: Column, between: str = "; ") -> Column:
    return F.when(F.size(items) > 0, _line(label, F.array_join(items, between), "."))


def _text(*lines: Column) -> Column:
    """The lines that are not null, and the body last."""
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _chunks(rows: DataFrame, kind: str, key: Column, title: Column, text: Column, **columns: Column) -> DataFrame:
    empty = {"body": "string", "raw": "string", "closed": "boolean", "attendable": "boolean", "access": "string", "closed_codes": "array<string>", "flagged": "boolean", "hall": "string"}
    given = {c: columns.get(c, F.lit(None)).cast(t) for c, t in empty.items()}
    return rows.select(_line(f"{kind}:", key).alias("id"), F.lit(kind).alias("type"), title.alias("title"), F.btrim(text).alias("text"), key.alias("key"), columns["year"].cast("int").alias("year"), *[x.alias(c) for c, x in given.items()]).select(*COLUMNS)


def partner_chunks(rows: DataFrame, event: str, year: int) -> DataFrame:
    """rows: name, slug, tier, category, website, text, uses (array). A rejected text and rejected uses are left out."""
    rules = reject_rules(event, year)
    cleaned = rows.select(*[tx.clean(c).alias(c) for c in ("name", "slug", "tier", "category", "website")], tx.clean("text").alias("raw"), F.filter(F.transform("uses", tx.clean), lambda u: u.isNotNull() & partners.reject_reason(u, rules).isNull()).alias("uses")).where("name IS NOT NULL")
    cleaned = cleaned.withColumn("body", F.when(partners.reject_reason(F.col("raw"), rules).isNull(), F.col("raw")))
    head = _line(F.col("name"), " — ", F.coalesce(F.col("tier"), F.lit("partner")), f" at {event}.")
    sector = F.when(F.col("category") != "other", _line("Sector: ", F.col("category"), "."))
    whole = _text(head, sector, _listed("Use cases: ", F.col("uses")), _line("Website: ", F.col("website")), F.col("body"))
    return _chunks(cleaned, "partner", F.coalesce("slug", tx.slug("name")), F.col("name"), whole, body=F.col("body"), raw=F.col("raw"), year=F.lit(year))


def _when(label: str, start: str = "start", end: str = "end") -> Column:
    span = F.when(F.col(start).isNotNull() & F.col(end).isNotNull(), _line(F.col(start), "–", F.col(end)))
    return F.concat_ws(", ", label, span)


def speaker_chunks(directory: DataFrame, sessions: DataFrame, event: str, year: int) -> DataFrame:
    """directory: key, name, designation, company, country, bio, session_title, codes. sessions: code, title, format, label (of its day), start,
    end, closed, one row a code. A line for each code in its order; halls are not named here."""
    talk = F.concat_ws(", ", "format", _when("label"))
    known = _line('Speaking in "', F.col("title"), '" (', F.col("code"), ") — ", talk, ".", F.when(F.col("closed"), CLOSED_TALK).otherwise(""))
    each = directory.select("key", F.posexplode("codes").alias("pos", "code")).where("code IS NOT NULL").join(sessions, "code", "left")
    line = F.coalesce(known, _line("Speaking in session ", F.col("code"), "."))
    found = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), F.when(F.col("closed"), F.col("code")).alias("shut"))))
    rows = directory.join(each.groupBy("key").agg(found.alias("talks")), "key", "left").where("name IS NOT NULL")
    rows = rows.withColumn("raw", tx.clean("bio")).withColumn("body", F.when(tx.junk_reason("raw").isNull(), F.col("raw")))
    role = F.nullif(F.concat_ws(", ", "designation", "company"), F.lit(""))
    alone = F.when(F.col("talks").isNull(), _line('Speaking in "', tx.clean("session_title"), '".'))
    talks = F.array_join(F.transform("talks", lambda x: x["line"]), "\n")
    whole = _text(F.coalesce(_line(F.col("name"), " — ", role, "."), _line(F.col("name"), ".")), F.lit(f"Speaker at {event}."), _line("Based in: ", F.col("country"), "."), talks, alone, F.col("body"))
    shut = F.coalesce(F.array_compact(F.transform("talks", lambda x: x["shut"])), F.array().cast("array<string>"))
    return _chunks(rows, "speaker", F.regexp_replace("key", " ", "-"), F.col("name"), whole, body=F.col("body"), raw=F.col("raw"), year=F.lit(year), closed_codes=shut, flagged=F.size(shut) > 0)


def people(raw: Column) -> Column:
    """People of raw strings 'name, designation, organisation': the name, and the rest in brackets; entries without a name are left out."""
    split = F.filter(F.transform(raw, tx.split_speaker), lambda p: p["name"].isNotNull())
    bits = lambda p: F.nullif(F.concat_ws(", ", p["designation"], p["org"]), F.lit(""))
    return F.transform(split, lambda p: F.coalesce(F.concat(p["name"], F.lit(" ("), bits(p), F.lit(")")), p["name"]))


def with_directory(sessions: DataFrame, names: str, directory: DataFrame) -> DataFrame:
    """code and `known`: the people of bare names in order, with what the directory has of them (the first row of a key)."""
    first = directory.groupBy("key").agg(F.min_by(F.nullif(F.concat_ws(", ", "designation", "company"), F.lit("")), F.struct("designation", "company")).alias("bits"))
    each = sessions.select("code", F.posexplode(names).alias("pos", "name")).withColumn("key", tx.person_key("name")).join(first, "key", "left")
    line = F.coalesce(F.concat("name", F.lit(" ("), "bits", F.lit(")")), F.col("name"))
    return each.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]).alias("known"))


def session_chunks(sessions: DataFrame, directory: DataFrame, event: str, year: int) -> DataFrame:
    """sessions: code, title, description, format, label, start, end, hall, topics, track, closed, access, speakers_raw, hosts_raw, and names, used where
    both raw lists are empty."""
    rows = sessions.withColumn("raw", tx.clean("description")).withColumn("body", F.when(tx.junk_reason("raw").isNull(), F.col("raw")))
    rows = rows.withColumn("speakers", people(F.col("speakers_raw"))).withColumn("hosts", people(F.col("hosts_raw")))
    bare = rows.where("code IS NOT NULL AND size(names) > 0 AND size(speakers) <= 0 AND size(hosts) <= 0")  # the cheap tests first
    rows = rows.join(with_directory(bare, "names", directory), "code", "left")
    who = F.when(F.size("speakers") > 0, F.col("speakers")).otherwise(F.col("known"))
    topics = F.coalesce(_listed("Topics: ", F.col("topics"), ", "), _line("Track: ", F.col("track"), "."))
    head = F.coalesce(_line(F.col("title"), " (", F.col("code"), f") — {event}."), _line(F.col("title"), f" — {event}."))
    facts = F.concat(F.concat_ws(" · ", "format", F.nullif(_when("label"), F.lit("")), "hall"), F.lit("."))
    whole = _text(head, facts, topics, F.when(F.col("closed"), CLOSED_NOTE).otherwise(OPEN_NOTE), _listed("Speakers: ", who), _listed("Hosts / moderators: ", F.col("hosts")), F.col("body"))
    return _chunks(rows, "session", F.coalesce("code", tx.slug("title")), F.col("title"), whole, body=F.col("body"), raw=F.col("raw"), year=F.lit(year), closed=F.col("closed"), attendable=~F.col("closed"), access=F.col("access"), hall=F.col("hall"))


def fallback_text(kind: str, name: Column, **fields: Column) -> Column:
    """A record's text straight from a feed: type and name, then 'field: value' for what is filled, one line each."""
    return _text(_line(f"{kind}: ", name), *[_line(f"{label.replace('_', ' ')}: ", tx.clean(c)) for label, c in fields.items()])


def observed(chunks: DataFrame, path: str, expected: dict[str, int], year: int) -> tuple[DataFrame, dict[str, tuple[bool, int]]]:
    """Write the chunks and check them on the way: the stored chunks, and by name of a check whether it holds and a number, the rows against
    it (or, for counts, the rows). One pass: the checks are aggregates that the write observes.

    expected: rows by type ('partner', 'speaker', 'session', 'closed'). chunks: COLUMNS and `again`, whether an id stood before.
    """
    of = lambda kind: F.col("type") == kind
    norm = lambda c: F.btrim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[ \t-\r]+", " "))
    stand = r"(?i)booth\s*(no\.?|number|#|[a-z]{0,3}-?\d)|stall\s*(no\.?|number|#)"
    bad = {
        "ids-unique": F.col("again"),
        "columns-filled": F.col("id").isNull() | F.col("type").isNull() | F.col("key").isNull(),
        "text-and-title": (norm("text") == "") | (norm("title") == ""),
        "body-verbatim": F.col("body").isNotNull() & ~F.contains(norm("text"), norm("body")),
        "body-last": F.col("body").isNotNull() & ~F.endswith(F.col("text"), F.col("body")),
        "dropped-absent": F.col("body").isNull() & F.col("raw").isNotNull() & F.contains(norm("text"), norm("raw")),
        "five-words": F.size(F.split(norm("text"), " ")) < 5,
        "no-stand-on-partners": of("partner") & F.col("text").rlike(stand),
        "no-hall-elsewhere": ~of("session") & (F.col("hall").isNotNull() | F.col("text").rlike(r"\b[Hh]all [0-9]")),
        "year": F.coalesce(F.col("year") != year, F.lit(True)),
        "closed-not-attendable": of("session") & F.col("closed") & F.col("attendable"),
        "closed-stated": of("session") & F.col("closed") & ~F.contains("text", F.lit("NOT open to general attendees")),
        "closed-by-invitation": of("session") & F.col("closed") & (F.lower(F.coalesce("access", F.lit(""))) != "invite-only"),
        "open-attendable": of("session") & ~F.col("closed") & ~F.col("attendable"),
        "open-stated": of("session") & ~F.col("closed") & F.contains("text", F.lit("NOT open to general attendees")),
        "speakers-flagged": of("speaker") & (F.size("closed_codes") > 0) & ~F.col("flagged"),
        "speakers-told": of("speaker") & (F.size("closed_codes") > 0) & ~F.contains("text", F.lit(CLOSED_TALK)),
        "sessions-have-access": of("session") & F.col("closed").isNull(),
    }
    counts = {"partner": of("partner"), "speaker": of("speaker"), "session": of("session"), "closed": of("session") & F.col("closed")}
    seen = Observation("corpus")
    watched = chunks.observe(seen, F.count("*").alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"bad:{n}") for n, c in bad.items()], *[F.count_if(c).alias(f"n:{n}") for n, c in counts.items()])
    written = stored(watched, path)
    got = seen.get
    total = sum(expected[k] for k in ("partner", "speaker", "session"))
    said = {"rows": (got["rows"] == total, got["rows"])} | {n: (got[f"n:{n}"] == expected[n], got[f"n:{n}"]) for n in counts}
    return written, said | {n: (got[f"bad:{n}"] == 0, got[f"bad:{n}"]) for n in bad}


def placed(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """id, at and ok: where a chunk's body begins (from 0), and whether what stands there is its source's text, blanks collapsed.

    The body is a chunk's last part, so its place is known and nothing is searched. chunks: id, key, type, text, body. sources: type, key, source.
    """
    at = F.length("text") - F.length("body")
    there = chunks.where("body IS NOT NULL").join(sources, ["type", "key"], "left")
    return there.select("id", at.alias("at"), F.coalesce(F.substring("text", at + 1, F.length("body")) == tx.clean("source"), F.lit(False)).alias("ok"))
