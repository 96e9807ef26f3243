"""Sessions, speakers and partners of an event: extraction from raw records, typed records, and the joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx

# Categories of a name by pattern, the first that matches wins.
CATEGORY_RULES = (
    ("payments", r"\b(pay|payment|payments|upi|card|cards|pos|checkout|remit|remittance|acquir|merchant)\b|pay$"),
    ("banking", r"\bbank|banking|sbi\b|nbfc\b|co-?operative\b|bank of\b"),
    ("lending", r"\blend|lending|loan|loans|credit|bnpl|financ(e|ing)|capital\b|microfinance\b"),
    ("insurtech", r"\binsur|insurance|assurance|policy|policies\b"),
    ("wealthtech", r"\bwealth|invest|investment|broking|broker|mutual fund|amc\b|securities|trading|portfolio|advisor"),
    ("crypto", r"\bcrypto|blockchain|web3|token|digital asset|defi\b|ledger\b"),
    ("regtech", r"\bkyc|aml|compliance|regtech|fraud|risk|identity|verif|onboarding|audit|govern"),
    ("ai", r"\bai\b|artificial intelligence|\bml\b|genai|intelligence\b|analytics|data\b"),
    ("infra", r"\bcloud|infra|api|apis|platform|saas|core banking|switch|tech|technolog|software|systems|solutions|network|host|server|security|cyber|comm"),
)
SPEAKER_COLUMNS = tuple(f"session_speakers_{i:02d}" for i in range(1, 16))
HOST_COLUMNS = tuple(f"session_host_{i:02d}" for i in range(1, 6))


def categorise(name: str | Column) -> Column:
    """The category of a name; 'other' where no rule matches."""
    low, found = F.lower(F.coalesce(tx.col(name), F.lit(""))), F.lit("other")
    for category, pattern in reversed(CATEGORY_RULES):
        found = F.when(low.rlike(pattern), category).otherwise(found)
    return found


def folded(columns: tuple[str, ...]) -> Column:
    """Numbered columns as one array, in order, blank ones left out."""
    return F.array_compact(F.array(*[tx.clean(c) for c in columns]))


def people(raw: Column) -> Column:
    """The names of 'name, role, organisation' lines; lines without a name are left out."""
    return F.array_compact(F.transform(raw, lambda p: F.nullif(F.btrim(F.substring_index(p, ",", 1)), F.lit(""))))


def is_closed(access: Column) -> Column:
    """Whatever has an access type other than public is closed."""
    return F.coalesce(F.lower(access) != "public", F.lit(False))


def sessions(raw: DataFrame) -> DataFrame:
    """Sessions of raw agenda rows with numbered speaker and host columns; rows without a title are left out.

    raw: agenda_code, session_name, session_desc, session_format, session_date, session_start_time, session_end_time, session_hall,
    session_access_type, session_topics (array of structs with a name), and the columns of SPEAKER_COLUMNS and HOST_COLUMNS.
    """
    topics = F.array_compact(F.transform(F.coalesce("session_topics", F.array().cast("array<struct<name:string>>")), lambda x: tx.clean(x["name"])))
    lines = raw.withColumn("speakers_raw", folded(SPEAKER_COLUMNS)).withColumn("hosts_raw", folded(HOST_COLUMNS)).withColumn("topics", topics)
    renamed = {
        "agenda_code": "code", "session_name": "title", "session_desc": "description", "session_format": "format", "session_date": "day",
        "session_start_time": "start", "session_end_time": "end", "session_hall": "hall", "session_access_type": "access",
    }
    cleaned = lines.select(*[tx.clean(a).alias(b) for a, b in renamed.items()], "topics", "speakers_raw", "hosts_raw").where("title is not null")
    return cleaned.select(
        "*",
        F.when(F.size("topics") > 0, F.array_join("topics", ", ")).alias("track"),
        is_closed(F.col("access")).alias("closed"),
        people(F.col("speakers_raw")).alias("speakers"),
        people(F.col("hosts_raw")).alias("hosts"),
    )


def agenda_order() -> list[Column]:
    """The order of sessions: day, start, hall, title, null as blank."""
    return [F.coalesce(c, F.lit("")) for c in ("day", "start", "hall", "title")]


def speakers(raw: DataFrame, held: DataFrame) -> DataFrame:
    """One row for each name key, the richest (of equals the first) with the title of its first session and all its codes.

    raw: ord, full_name, salutation, designation, company, bio, photo, linkedin. held: sessions, as `sessions` gives them.
    """
    named = held.select("code", "title", "day", "start", "hall", F.explode(F.concat("speakers", "hosts")).alias("name"))
    place = F.struct(*agenda_order(), "code")
    each = named.groupBy("name").agg(F.min_by("title", place).alias("title"), F.min(place).alias("place"), F.collect_set("code").alias("codes")).withColumn("key", tx.person_key("name"))  # a key for a name, not for each mention
    mine = each.groupBy("key").agg(F.min_by("title", "place").alias("session_title"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
    rows = raw.select("ord", *[tx.clean(c).alias(c) for c in ("full_name", "salutation", "designation", "company", "bio", "photo", "linkedin")])
    rows = rows.where("full_name is not null").withColumn("key", tx.person_key("full_name")).join(mine, "key", "left")
    score = sum(F.col(c).isNotNull().cast("int") for c in ("bio", "photo", "linkedin", "session_title"))
    rows = rows.withColumn("richness", score).withColumn("name", F.concat_ws(" ", "salutation", "full_name"))
    kept = ("name", "designation", "company", "bio", "photo", "linkedin", "session_title", "codes", "richness")
    best = rows.groupBy("key").agg(F.max_by(F.struct(*kept), F.struct("richness", -F.col("ord"))).alias("r"))
    return best.select("key", "r.*").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def partners(payloads: DataFrame, base_url: str) -> DataFrame:
    """Partners of payloads, the first of each name whatever its case. payloads: ord, groups (array of group and items, in order)."""
    items = payloads.select("ord", F.posexplode("groups").alias("g", "group")).select("ord", "g", "group.name", F.posexplode("group.items").alias("i", "item"))
    rows = items.select("ord", "g", "i", F.col("name").alias("source_group"), tx.clean("item.altText").alias("name"), tx.clean("item.webLink").alias("website"), tx.clean("item.title").alias("title"), tx.clean("item.imageUrl").alias("image"))
    first = Window.partitionBy(F.lower("name")).orderBy("ord", "g", "i")
    kept = rows.where("name is not null").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    logo = F.when(F.startswith("image", F.lit("/")), F.concat(F.lit(base_url), "image")).otherwise(F.col("image"))
    tier = F.coalesce("title", F.regexp_replace("source_group", "s+$", ""))
    return kept.select("name", tx.slug("name").alias("slug"), "website", logo.alias("logo"), tier.alias("tier"), "source_group", categorise("name").alias("category"))


def typed(kind: str, rows: DataFrame, key: Column, **columns: Column) -> DataFrame:
    """Records of one type with minted ids ('<kind>:<key>'); rows without a key are left out."""
    return rows.select(F.concat(F.lit(f"{kind}:"), F.nullif(key, F.lit(""))).alias("id"), F.lit(kind).alias("type"), *[c.alias(n) for n, c in columns.items()]).where("id is not null")


def corpus(*streams: DataFrame) -> DataFrame:
    """The streams as one corpus with their order; columns that a stream lacks are null."""
    numbered = [s.withColumn("stream", F.lit(i)) for i, s in enumerate(streams)]
    whole = numbered[0]
    for s in numbered[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    return whole


def day_numbers(records: DataFrame, day: str = "day") -> DataFrame:
    """Each distinct day with its number, ascending from 1."""
    days = records.where(F.col(day).isNotNull()).select(day).distinct()
    return days.withColumn("day_number", F.row_number().over(Window.orderBy(day)))  # one row a day


def speakers_of(held: DataFrame, directory: DataFrame) -> DataFrame:
    """code and key of every speaker of a session: by the codes that the directory lists, or by name whatever its case; once each,
    those by code first. directory: key, codes. held: code, speakers."""
    by_code = directory.select(F.explode("codes").alias("code"), "key").join(held.select("code").distinct(), "code").withColumn("via", F.lit(0))
    names = held.select("code", F.explode("speakers").alias("name")).select("code", F.lower(F.btrim("name")).alias("fold"))
    by_name = names.join(directory.select("key", F.lower(F.btrim("key")).alias("fold")), "fold").select("code", "key").withColumn("via", F.lit(1))
    return by_code.unionByName(by_name).groupBy("code", "key").agg(F.min("via").alias("via"))


def sessions_of(held: DataFrame, directory: DataFrame) -> DataFrame:
    """key and the codes of a speaker's sessions, sorted: the same links, seen from the other side."""
    return speakers_of(held, directory).groupBy("key").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def with_sessions(directory: DataFrame, held: DataFrame) -> DataFrame:
    """The directory with `sessions`: a struct for each code in its order, code, title and day, those of unknown codes with nulls."""
    each = directory.select("key", F.posexplode_outer("codes").alias("pos", "code"))
    found = each.join(held.groupBy("code").agg(F.min("title").alias("title"), F.min("day").alias("day")), "code", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("pos", "code", "title", "day"))))
    return found.groupBy("key").agg(ordered.alias("sessions"))


def people_lines(held: DataFrame, names: str, directory: DataFrame) -> DataFrame:
    """code and the session's people as lines in order: the directory's name and company where a key is known, else the name as given."""
    first = directory.groupBy("key").agg(F.min_by(F.struct("name", "company"), F.struct("name", "company")).alias("d"))
    each = held.select("code", F.posexplode(names).alias("pos", "given")).withColumn("key", tx.person_key("given")).join(first, "key", "left")
    line = F.when(F.col("d").isNotNull(), F.concat_ws(", ", "d.name", "d.company")).otherwise(F.col("given"))
    return each.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]).alias("lines"))


def lineup(speakers_: Column, hosts: Column, merged: Column) -> Column:
    """Speakers and hosts in order; the merged list where both are empty."""
    both = F.concat(F.coalesce(speakers_, F.array().cast("array<string>")), F.coalesce(hosts, F.array().cast("array<string>")))
    return F.when(F.size(both) > 0, both).otherwise(F.coalesce(merged, F.array().cast("array<string>")))


def advisory(kind: Column, closed: Column, access: Column) -> Column:
    """For sessions whether one may be recommended and why not; null for other records."""
    note = F.when(closed, F.concat(F.lit("closed: "), F.coalesce(access, F.lit("by invitation"))))
    return F.when(kind == "session", F.struct((~closed).alias("recommendable"), note.alias("note")))


def plannable(closed: Column, access: Column) -> Column:
    """Neither closed nor by invitation only."""
    return ~F.coalesce(closed, F.lit(False)) & ~F.coalesce(F.lower(access), F.lit("")).eqNullSafe("invite-only")


def full_day_label(number: Column, day: Column) -> Column:
    """'Day 2 (Thursday 10 September 2026)'; the text itself if it is no date, null for null."""
    date = F.try_to_date(day, "yyyy-MM-dd")
    return F.when(date.isNotNull(), F.concat(F.lit("Day "), number.cast("string"), F.lit(" ("), F.date_format(date, "EEEE d MMMM yyyy"), F.lit(")"))).otherwise(day)


def short_day_label(day: Column) -> Column:
    """'Thu 10 Sep'; a text that is no date stays as it is."""
    date = F.try_to_date(day, "yyyy-MM-dd")
    return F.when(date.isNotNull(), F.date_format(date, "EEE d MMM")).otherwise(day)


def resolve_day(reference: Column, days: Column) -> Column:
    """A day from a reference: an ISO date, 'day 2', '2', '10 sep' or 'sept 10th', if it is one of `days` (an array, ascending); else null."""
    low = F.lower(F.btrim(reference))
    part = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))
    number = F.coalesce(part(r"^day\s*(\d+)$"), part(r"^(\d+)$")).cast("int")
    of_month = F.coalesce(part(r"^(\d{1,2})(?:st|nd|rd|th)?\s+sep(?:t|tember)?$"), part(r"^sep(?:t|tember)?\s+(\d{1,2})(?:st|nd|rd|th)?$"))
    year = F.substring(F.get(days, F.lit(0)), 1, 4)
    dated = F.when(of_month.isNotNull(), F.concat(year, F.lit("-09-"), F.lpad(of_month.cast("int").cast("string"), 2, "0")))
    named = F.coalesce(F.when(low.rlike(r"^\d{4}-\d{2}-\d{2}$"), low), dated)
    return F.coalesce(F.when(F.array_contains(days, named), named), F.when(number >= 1, F.try_element_at(days, number)))


def loose_match(value: Column, wanted: Column) -> Column:
    """Whether all words of `wanted` are words of `value`, in their normal forms; false if nothing is wanted."""
    words = lambda c: F.filter(F.split(tx.normalise_name(c), " "), lambda w: w != "")
    return F.coalesce((F.size(words(wanted)) > 0) & (F.size(F.array_except(words(wanted), words(value))) == 0), F.lit(False))


def keep(filters: dict[str, list], days: Column | None = None) -> tuple[Column, Column]:
    """Whether a record passes filters on type, day, hall, format, speaker, sector, tier, track and closed_door (exclude), and whether
    it passed all but the last. Records have type, day, hall, format, track, topics, people, name_key, sector, tier, closed.

    All filters must hold, each by any of its values. Those on sessions exclude other records, but one on speakers keeps speakers.
    """
    kind, none = F.col("type"), F.lit(False)
    has = lambda name: bool(filters.get(name))
    any_of = lambda tests: F.lit(False) if not tests else _or(tests)
    loosely = lambda c, name: any_of([loose_match(F.col(c), F.lit(v)) for v in filters[name]])
    session = F.lit(not (has("sector") or has("tier")))
    other = F.lit(not has("track"))
    if has("type"):
        session, other = (x & kind.isin(*filters["type"]) for x in (session, other))
    if has("day"):
        session = session & F.coalesce(any_of([F.col("day") == resolve_day(F.lit(str(v)), days) for v in filters["day"]]), none)
    for name in ("hall", "format"):
        if has(name):
            session = session & loosely(name, name)
    if has("track"):
        session = session & (loosely("track", "track") | any_of([_any_topic(v) for v in filters["track"]]))
    partner, speaker = other, other & F.lit(not (has("sector") or has("tier")))
    if has("sector"):
        partner = partner & F.coalesce(F.col("sector").isin(*filters["sector"]), none)
    if has("tier"):
        partner = partner & loosely("tier", "tier")
    if has("speaker"):
        wanted = F.array(*[tx.person_key(F.lit(v)) for v in filters["speaker"]])
        session = session & F.exists(F.coalesce("people", F.array().cast("array<string>")), lambda p: F.array_contains(wanted, tx.person_key(p)))
        speaker, partner = speaker & F.array_contains(wanted, F.col("name_key")), none
    elif has("day") or has("hall") or has("format"):
        speaker = partner = none
    passed = F.when(kind == "session", session).when(kind == "partner", partner).when(kind == "speaker", speaker).otherwise(none)
    passed = F.coalesce(passed, none)
    shut = (kind == "session") & F.coalesce(F.col("closed"), none) if filters.get("closed_door") else none
    return passed & ~shut, passed & shut


def _any_topic(wanted: str) -> Column:
    return F.exists(F.coalesce("topics", F.array().cast("array<string>")), lambda x: loose_match(x, F.lit(wanted)))


def _or(tests: list[Column]) -> Column:
    found = tests[0]
    for x in tests[1:]:
        found = found | x
    return found
