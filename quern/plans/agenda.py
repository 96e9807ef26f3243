"""Queries of an event's agenda: orders as sessions, suppliers as speakers, parts as partners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import agenda
from quern.plans.declare import hashed, query
from quern.storage import materialise

_HELD = """ln AS (SELECT l_orderkey AS k, l_linenumber AS n, max('Supplier ' || lpad(l_suppkey::VARCHAR, 9, '0')) AS p FROM lineitem WHERE l_linenumber <= 15 GROUP BY 1, 2),
spk AS (SELECT k, list(p ORDER BY n) FILTER (n <> 3) AS sp, count(*) AS n_raw FROM ln GROUP BY k),
held AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 <> 0 THEN 'S' || o_orderkey END AS code, o_orderpriority || ' talk ' || (o_orderkey % 50) AS title,
 CASE o_orderkey % 4 WHEN 0 THEN 'Panel' WHEN 1 THEN 'Key note' END AS format, strftime(o_orderdate, '%Y-%m-%d') AS day, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00' AS start,
 CASE WHEN o_orderkey % 3 <> 0 THEN 'Hall ' || (o_orderkey % 7) END AS hall, CASE o_orderkey % 5 WHEN 0 THEN 'Invite-Only' WHEN 1 THEN NULL ELSE 'Public' END AS access, o_orderkey % 5 = 0 AS closed,
 o_orderstatus || ', ' || (o_orderkey % 6) || ' topic' AS track, coalesce(sp, []) AS speakers, coalesce(n_raw, 0) AS n_raw, CASE WHEN o_custkey % 2 = 0 THEN ['Customer ' || o_custkey] ELSE [] END AS hosts
 FROM orders LEFT JOIN spk ON k = o_orderkey WHERE o_orderkey % 89 <> 0)"""


def raw_sessions(t):
    """Raw agenda rows: numbered speaker columns from an order's lines, a host column from its customer."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Supplier "), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lit(", Role, Org, East"))
    line = F.when(F.col("l_linenumber") == 3, F.lit(", Role")).otherwise(name)
    wide = t("lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linenumber") == i + 1, line)).alias(c) for i, c in enumerate(agenda.SPEAKER_COLUMNS)])
    topic = lambda c: F.struct(c.alias("name"))
    pad = lambda c: F.concat(F.lit("  "), c, F.lit("\t"))
    return t("orders").join(wide, k == F.col("l_orderkey"), "left").select(
        "*",
        F.when(k % 97 != 0, F.concat(F.lit("S"), k.cast("string"))).alias("agenda_code"),
        F.when(k % 89 == 0, " ").otherwise(pad(F.concat("o_orderpriority", F.lit("  talk "), (k % 50).cast("string")))).alias("session_name"),
        F.lit("").alias("session_desc"),
        F.when(k % 4 == 0, "Panel").when(k % 4 == 1, "Key\n note ").alias("session_format"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("session_date"),
        F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00")).alias("session_start_time"),
        F.lit(None).cast("string").alias("session_end_time"),
        F.when(k % 3 != 0, F.concat(F.lit("Hall "), (k % 7).cast("string"))).otherwise(" ").alias("session_hall"),
        F.when(k % 5 == 0, "Invite-Only").when(k % 5 != 1, " Public ").alias("session_access_type"),
        F.array(topic(F.col("o_orderstatus")), topic(F.lit(None).cast("string")), topic(F.concat((k % 6).cast("string"), F.lit(" topic ")))).alias("session_topics"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(", Host"))).alias("session_host_01"),
        *[F.lit(None).cast("string").alias(c) for c in agenda.HOST_COLUMNS[1:]],
    )


def held_sessions(t):
    return agenda.sessions(raw_sessions(t))


@query(f"""WITH {_HELD} SELECT code, title, format, day, start, hall, access, closed, track, array_to_string(speakers, '|') AS speakers, array_to_string(hosts, '|') AS hosts, n_raw::INT AS n_raw FROM held""")
def extract_sessions(t):
    """Sessions from raw agenda rows."""
    out = held_sessions(t).withColumn("n_raw", F.size("speakers_raw"))
    joined = [F.array_join(c, "|").alias(c) for c in ("speakers", "hosts")]
    return out.select("code", "title", "format", "day", "start", "hall", "access", "closed", "track", *joined, "n_raw")


@query(f"""WITH {_HELD} SELECT code, title, day, row_number() OVER (PARTITION BY day ORDER BY start, coalesce(hall, ''), title, coalesce(code, '')) AS place FROM held""")
def agenda_order(t):
    """Each day's sessions in their order."""
    place = F.row_number().over(Window.partitionBy("day").orderBy(*agenda.agenda_order(), F.coalesce("code", F.lit(""))))
    return held_sessions(t).select("code", "title", "day", place.alias("place"))


_DIRECTORY = """raw AS (SELECT s_suppkey * 2 AS ord, 'Supplier ' || lpad(s_suppkey::VARCHAR, 9, '0') AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'a bio' END AS bio, NULL AS photo, 'Firm ' || (s_suppkey % 3) AS company FROM supplier
UNION ALL SELECT s_suppkey * 2 + 1, 'Supplier ' || lpad(s_suppkey::VARCHAR, 9, '0'), 'another', CASE WHEN s_suppkey % 3 = 0 THEN '/p' END, 'Firm B' FROM supplier),
named AS (SELECT code, title, day, start, hall, unnest(list_concat(speakers, hosts)) AS name FROM held),
mine AS (SELECT lower(name) AS key, min_by(title, ROW(coalesce(day, ''), coalesce(start, ''), coalesce(hall, ''), title, code)) AS session_title, list_sort(list_distinct(list(code) FILTER (code IS NOT NULL))) AS codes FROM named GROUP BY lower(name)),
ranked AS (SELECT lower(name) AS key, raw.*, session_title, coalesce(codes, []) AS codes, (bio IS NOT NULL)::INT + (photo IS NOT NULL)::INT + (session_title IS NOT NULL)::INT AS richness FROM raw LEFT JOIN mine ON key = lower(name)),
directory AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY key ORDER BY richness DESC, ord) = 1)"""


def held_once(t):
    """The sessions, written once for plans that read them more than once."""
    return materialise(held_sessions(t), "held")


def directory(t, held=None):
    s = F.col("s_suppkey")
    name = F.concat(F.lit("Supplier  "), F.lpad(s.cast("string"), 9, "0"))
    none = F.lit(None).cast("string")
    rows = F.array(
        F.struct((s * 2).alias("ord"), name.alias("full_name"), F.lit(" ").alias("salutation"), none.alias("designation"), F.concat(F.lit("Firm "), (s % 3).cast("string")).alias("company"), F.when(s % 2 == 0, "a bio").alias("bio"), none.alias("photo"), none.alias("linkedin")),
        F.struct((s * 2 + 1).alias("ord"), name.alias("full_name"), F.lit("Dr.").alias("salutation"), none.alias("designation"), F.lit("Firm B").alias("company"), F.lit("another").alias("bio"), F.when(s % 3 == 0, "/p").alias("photo"), none.alias("linkedin")),
    )
    return agenda.speakers(t("supplier").select(F.inline(rows)), held_sessions(t) if held is None else held)


@query(f"WITH {_HELD}, {_DIRECTORY} SELECT key, bio, photo, company, session_title, richness, len(codes)::INT AS n_codes, md5(array_to_string(codes, ',')) AS codes FROM directory")
def extract_speakers(t):
    """The speakers' directory: the richest row of each name key, with its sessions."""
    return directory(t).select("key", "bio", "photo", "company", "session_title", "richness", F.size("codes").alias("n_codes"), F.md5(F.array_join("codes", ",")).alias("codes"))


@query(r"""WITH i AS (SELECT p_partkey // 200 AS page, p_brand || 'ss' AS grp, p_partkey, trim(p_name) || CASE WHEN p_partkey % 2 = 0 THEN ' PAY' ELSE ' Bank' END AS name, CASE WHEN p_partkey % 3 = 0 THEN '/logo/' || p_partkey WHEN p_partkey % 3 = 1 THEN 'logo' END AS logo, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS title FROM part WHERE p_partkey % 11 <> 0),
f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY page, grp, p_partkey) = 1)
SELECT name, replace(lower(name), ' ', '-') AS slug, CASE WHEN logo[1] = '/' THEN 'https://base.example' || logo ELSE logo END AS logo, coalesce(title, regexp_replace(grp, 's+$', '')) AS tier, CASE WHEN lower(name) LIKE '% pay' THEN 'payments' ELSE 'banking' END AS category FROM f""")
def extract_partners(t):
    """Partners from pages that hold lists of up to two hundred by group, the first of each name."""
    k = F.col("p_partkey")
    name = F.when(k % 11 != 0, F.concat(F.lit(" "), "p_name", F.when(k % 2 == 0, "  PAY").otherwise(" Bank"))).otherwise("")
    logo = F.when(k % 3 == 0, F.concat(F.lit("/logo/"), k.cast("string"))).when(k % 3 == 1, "logo")
    item = F.struct(k.alias("k"), name.alias("altText"), F.lit("").alias("webLink"), F.when(k % 4 == 0, F.col("p_type")).alias("title"), logo.alias("imageUrl"))
    groups = t("part").groupBy(F.floor(k / 200).alias("page"), "p_brand").agg(F.array_sort(F.collect_list(item)).alias("items"))
    pages = groups.groupBy(F.col("page").alias("ord")).agg(F.array_sort(F.collect_list(F.struct(F.concat("p_brand", F.lit("ss")).alias("name"), "items"))).alias("groups"))
    return agenda.partners(pages, "https://base.example").select("name", "slug", "logo", "tier", "category")


@query(r"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'payments' WHEN 1 THEN 'lending' WHEN 2 THEN 'regtech' WHEN 3 THEN 'infra' WHEN 4 THEN 'other' ELSE 'banking' END AS category FROM part""")
def rule_category(t):
    """The first rule of a decorated name, in the order of the rules."""
    ends = [" card loans", " loan software", " risk cloud", " host", " zzz", " bank insurance data"]
    return t("part").select("p_partkey", agenda.categorise(F.concat(F.lit("x"), F.element_at(F.array(*map(F.lit, ends)), (F.col("p_partkey") % 6 + 1).cast("int")))).alias("category"))


@query(f"""WITH {_HELD}, {_DIRECTORY}, byc AS (SELECT unnest(codes) AS code, key, 0 AS via FROM directory), byn AS (SELECT h.code, d.key, 1 AS via FROM (SELECT code, lower(unnest(speakers)) AS name FROM held) h JOIN directory d ON h.name = d.key)
SELECT code, key, min(via) AS via FROM (SELECT * FROM byc UNION ALL SELECT * FROM byn) WHERE code IS NULL OR code IN (SELECT code FROM held) GROUP BY code, key""")
def session_speakers(t):
    """Links of sessions and speakers, by code or else by name."""
    held = held_once(t)
    return agenda.speakers_of(held, directory(t, held))


@query(f"""WITH {_HELD}, {_DIRECTORY}, l AS (SELECT unnest(codes) AS code, key FROM directory UNION SELECT h.code, d.key FROM (SELECT code, lower(unnest(speakers)) AS name FROM held) h JOIN directory d ON h.name = d.key)
SELECT key, count(DISTINCT code) AS n, md5(string_agg(DISTINCT code, ',' ORDER BY code)) AS codes FROM l GROUP BY key""")
def speaker_sessions(t):
    """The sessions of each speaker, by code or by name."""
    held = held_once(t)
    found = agenda.sessions_of(held, directory(t, held))
    return found.select("key", F.size("codes").cast("long").alias("n"), F.md5(F.nullif(F.array_join("codes", ","), F.lit(""))).alias("codes"))


@query(f"""WITH {_HELD}, {_DIRECTORY}, e AS (SELECT key, unnest(list_concat(codes, ['gone'])) AS code, generate_subscripts(list_concat(codes, ['gone']), 1) AS pos FROM directory), s AS (SELECT code, min(title) AS title, min(day) AS day FROM held WHERE code IS NOT NULL GROUP BY code)
SELECT key, count(*) AS n, count(title) AS known, md5(string_agg(code || ':' || coalesce(title, '?') || ':' || coalesce(day, '?'), '|' ORDER BY pos)) AS digest FROM e LEFT JOIN s USING (code) GROUP BY key""")
def nested_sessions(t):
    """The directory with its sessions nested in order; codes that no session has are kept."""
    held = held_once(t)
    people = directory(t, held).withColumn("codes", F.array_append("codes", F.lit("gone")))
    out = agenda.with_sessions(people, held.where("code is not null"))
    line = F.transform("sessions", lambda x: F.concat_ws(":", x["code"], F.coalesce(x["title"], F.lit("?")), F.coalesce(x["day"], F.lit("?"))))
    return out.select("key", F.size("sessions").cast("long").alias("n"), F.size(F.filter("sessions", lambda x: x["title"].isNotNull())).cast("long").alias("known"), F.md5(F.array_join(line, "|")).alias("digest"))


@query(f"""WITH {_HELD}, {_DIRECTORY}, n AS (SELECT code, CASE WHEN len(speakers) + len(hosts) > 0 THEN list_concat(speakers, hosts) ELSE ['Panel'] END AS names FROM held WHERE code IS NOT NULL),
e AS (SELECT code, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM n), f AS (SELECT key, min(name || ', ' || company) AS line FROM (SELECT key, CASE WHEN ord % 2 = 1 THEN 'Dr. ' ELSE '' END || name AS name, company FROM directory) GROUP BY key)
SELECT code, md5(string_agg(coalesce(line, name), '|' ORDER BY pos)) AS people, count(*) AS n FROM e LEFT JOIN f ON key = lower(name) GROUP BY code""")
def session_people(t):
    """The people of each session in order, with their company where the directory has them; a fallback where none are named."""
    held = held_once(t)
    rows = held.where("code is not null").withColumn("names", agenda.lineup(F.col("speakers"), F.col("hosts"), F.array(F.lit("Panel"))))
    out = agenda.people_lines(rows, "names", directory(t, held))
    return out.select("code", F.md5(F.array_join("lines", "|")).alias("people"), F.size("lines").cast("long").alias("n"))


@query(f"""WITH {_HELD}, d AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM held)) SELECT day, n::INT AS day_number, 'Day ' || n || ' (' || dayname(day::DATE) || ' ' || day(day::DATE) || ' ' || monthname(day::DATE) || ' ' || year(day::DATE) || ')' AS label,
dayname(day::DATE)[:3] || ' ' || day(day::DATE) || ' ' || monthname(day::DATE)[:3] AS short FROM d""")
def day_labels(t):
    """Numbers and labels of the days that have sessions."""
    days = agenda.day_numbers(held_sessions(t))
    return days.select("day", "day_number", agenda.full_day_label(F.col("day_number"), F.col("day")).alias("label"), agenda.short_day_label(F.col("day")).alias("short"))


@query(f"""WITH {_HELD}, c AS (SELECT 'session:' || code AS id, 'session' AS type, title AS name FROM held WHERE code IS NOT NULL UNION ALL SELECT 'speaker:supplier-' || lpad(s_suppkey::VARCHAR, 9, '0'), 'speaker', s_name FROM supplier
UNION ALL SELECT 'partner:' || replace(p_name, ' ', '-'), 'partner', p_name FROM part) SELECT type, count(*) AS n, count(DISTINCT id) AS ids, sum(DISTINCT ('0x' || md5(id)[:12])::BIGINT)::BIGINT AS digest FROM c GROUP BY type""")
def typed_corpus(t):
    """Records of three types as one corpus, with minted ids; what has no key is left out."""
    held = held_sessions(t)
    people = t("supplier").withColumn("name", F.replace("s_name", F.lit("#"), F.lit(" ")))
    whole = agenda.corpus(
        agenda.typed("partner", t("part"), tx.slug("p_name"), name=F.col("p_name"), tier=F.col("p_type")),
        agenda.typed("session", held, F.col("code"), name=F.col("title"), hall=F.col("hall")),
        agenda.typed("speaker", people, tx.slug(tx.person_key("name")), name=F.col("name")),
    )
    each = whole.groupBy("type", "id").agg(F.count("*").alias("n"))
    return each.groupBy("type").agg(F.sum("n").alias("n"), F.count("id").alias("ids"), hashed("id").alias("digest"))


@query(f"""WITH {_HELD} SELECT code, title, NOT closed AS recommendable, CASE WHEN closed THEN 'closed: ' || access END AS note, NOT closed AS plannable FROM held""")
def advisories(t):
    """Which sessions may be recommended, and which can be planned."""
    advice = agenda.advisory(F.lit("session"), F.col("closed"), F.col("access"))
    return held_sessions(t).select("code", "title", advice["recommendable"].alias("recommendable"), advice["note"].alias("note"), agenda.plannable(F.col("closed"), F.col("access")).alias("plannable"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 8 AS k FROM customer) SELECT c_custkey, CASE k WHEN 0 THEN '2026-09-09' WHEN 1 THEN '2026-09-10' WHEN 2 THEN '2026-09-11' WHEN 3 THEN '2026-09-10' WHEN 4 THEN '2026-09-11' ELSE NULL END AS day FROM c""")
def day_references(t):
    """Days from references of several forms; those that no day answers give null."""
    asked = ["2026-09-09", "Day 2", "3", "10 sep", "Sept 11th", "day 4", "2026-09-12", "soon"]
    days = F.array(*map(F.lit, ["2026-09-09", "2026-09-10", "2026-09-11"]))
    pick = F.element_at(F.array(*map(F.lit, asked)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return t("customer").select("c_custkey", agenda.resolve_day(pick, days).alias("day"))


@query("""SELECT p_partkey, list_contains(string_split(p_name, ' '), 'widget') AS has_widget, list_contains(string_split(p_name, ' '), 'cold') AND list_contains(string_split(p_name, ' '), 'widget') AS both_, false AS nothing, list_contains(string_split(p_name, ' '), 'old') AS has_old FROM part""")
def loose_match(t):
    """Names that hold all words wanted, whatever their order and case, and no word within a word."""
    m = lambda w: agenda.loose_match(F.col("p_name"), F.lit(w))
    return t("part").select("p_partkey", m("Widgets").alias("has_widget"), m("widget, COLD").alias("both_"), m(" !").alias("nothing"), m("old").alias("has_old"))


_RECORDS = f"""{_HELD}, r AS (SELECT 'session' AS type, coalesce(code, 'none') AS id, day, hall, format, NULL AS sector, NULL AS tier, closed, list_concat(speakers, hosts) AS people, track FROM held
UNION ALL SELECT 'partner', 'P' || p_partkey, NULL, NULL, NULL, p_brand, p_type, false, [], NULL FROM part UNION ALL SELECT 'speaker', lower(replace(s_name, '#', ' ')), NULL, NULL, NULL, NULL, NULL, false, [], NULL FROM supplier)"""


def records(t):
    held = held_sessions(t).select(F.lit("session").alias("type"), F.coalesce("code", F.lit("none")).alias("id"), "day", "hall", "format", "track", "topics", F.concat("speakers", "hosts").alias("people"), "closed")
    parts = t("part").select(F.lit("partner").alias("type"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("sector"), F.col("p_type").alias("tier"))
    key = tx.person_key(F.replace("s_name", F.lit("#"), F.lit(" ")))
    people = t("supplier").select(F.lit("speaker").alias("type"), key.alias("id"), key.alias("name_key"))
    return agenda.corpus(held, parts, people)


@query(f"""WITH {_RECORDS} SELECT 'hall' AS filter, type, count(*) AS kept, 0::BIGINT AS shut FROM r WHERE type = 'session' AND hall IN ('Hall 2', 'Hall 4') GROUP BY type
UNION ALL SELECT 'speaker', type, count(*), 0 FROM r WHERE (type = 'session' AND list_contains(people, 'Supplier 000000003')) OR (type = 'speaker' AND id = 'supplier 000000003') GROUP BY type
UNION ALL SELECT 'sector and tier', type, count(*), 0 FROM r WHERE type = 'partner' AND sector = 'Brand#13' AND tier = 'ECONOMY' GROUP BY type
UNION ALL SELECT 'open', type, count(*) FILTER (NOT closed), count(*) FILTER (closed) FROM r GROUP BY type
UNION ALL SELECT 'track', type, count(*), 0 FROM r WHERE type = 'session' AND track LIKE '%, 4 topic' GROUP BY type
UNION ALL SELECT 'day and type', type, count(*), 0 FROM r WHERE type = 'session' AND day = '1997-01-15' GROUP BY type""")
def filter_records(t):
    """How many records of each type pass six filters; one scan judges them all."""
    days = F.array(F.lit("1997-01-15"))
    filters = {
        "hall": {"hall": ["hall 2", "4 Hall"]}, "speaker": {"speaker": ["Dr. Supplier 000000003"]}, "sector and tier": {"sector": ["Brand#13"], "tier": ["economy"]},
        "open": {"closed_door": True}, "track": {"track": ["topic 4"]}, "day and type": {"day": ["1997-01-15"], "type": ["session"]},
    }
    judged = {n: agenda.keep(f, days) for n, f in filters.items()}
    rows = F.array(*[F.struct(F.lit(n).alias("filter"), kept.alias("k"), shut.alias("s")) for n, (kept, shut) in judged.items()])
    each = records(t).select("type", F.inline(rows)).where("k or s")
    return each.groupBy("filter", "type").agg(F.count_if("k").alias("kept"), F.count_if("s").alias("shut"))


@query(f"""WITH {_HELD}, {_DIRECTORY} SELECT key, len(codes)::INT AS n, row_number() OVER (ORDER BY len(codes) DESC, key) AS place FROM directory QUALIFY place <= 50""")
def busiest_speakers(t):
    """The fifty speakers of the most sessions: a top-k report."""
    best = directory(t).select("key", F.size("codes").alias("n")).orderBy(F.desc("n"), "key").limit(50)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "key")))
