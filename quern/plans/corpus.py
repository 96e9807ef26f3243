"""Queries of a corpus of chunks: parts as partners, suppliers as speakers, orders as sessions; their texts, checks and counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import agenda, corpus, partners
from quern.plans.agenda import _DIRECTORY, _HELD, directory, held_once, held_sessions
from quern.plans.declare import query
from quern.plans.text import _q
from quern.storage import materialise, new_path

EVENT, YEAR = "Show Week", 2026
_TIERS = ["", "Organiser", "Brought To You By", "Gold Partner", "Exhibitor", "Ecosystem", "Supporter", "Voice AI Partner", "Silver Partner"]
_SQL_TIER = f"nullif([{', '.join(map(_q, _TIERS))}][(p_partkey % {len(_TIERS)} + 1)::INT], '')"
_GROUP = "CASE WHEN tier IS NULL THEN 'unclassified' WHEN tier = 'Organiser' THEN 'organiser' WHEN tier = 'Brought To You By' THEN 'headline' WHEN tier IN ('Gold Partner', 'Silver Partner') THEN 'sponsor' WHEN tier IN ('Exhibitor', 'Ecosystem', 'Supporter') THEN lower(tier) ELSE 'category-partner' END"
_TEXTS = "CASE p_partkey % 6 WHEN 0 THEN 'Makes ' || p_type || ' things' WHEN 2 THEN 'See Booth No. 12' WHEN 3 THEN 'Read more about it' WHEN 4 THEN 'Show Week 2019 recap' WHEN 5 THEN 'Sells ' || p_brand END"
_REASON = "CASE p_partkey % 6 WHEN 2 THEN 'booth/stall location' WHEN 3 THEN 'scrape artifact' WHEN 4 THEN 'prior-year event copy' END"


def partner_rows(t):
    k = F.col("p_partkey")
    text = F.when(k % 6 == 0, F.concat(F.lit("  Makes   "), "p_type", F.lit(" things"))).when(k % 6 == 2, "See Booth No. 12").when(k % 6 == 3, "Read more about it").when(k % 6 == 4, "Show Week  2019 recap").when(k % 6 == 5, F.concat(F.lit("Sells "), "p_brand"))
    return t("part").select(
        "p_partkey", F.concat_ws(" ", "p_name", k.cast("string")).alias("name"), F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), k.cast("string")).alias("slug"),
        F.element_at(F.array(*map(F.lit, _TIERS)), (k % len(_TIERS) + 1).cast("int")).alias("tier"), F.when(k % 4 == 0, "other").otherwise(F.lower("p_type")).alias("category"),
        F.when(k % 3 == 0, F.concat(F.lit("https://p"), k.cast("string"), F.lit(".example"))).alias("website"), text.alias("text"),
        F.array(F.concat(F.lit("use "), F.col("p_size").cast("string")), F.when(k % 2 == 0, "Click here").otherwise(F.col("p_brand"))).alias("uses"),
    )


@query(f"""SELECT p_partkey, {_GROUP} AS grp, {_REASON} AS reject, 1 + (p_partkey % 2) AS n_uses FROM (SELECT *, {_SQL_TIER} AS tier FROM part)""")
def partner_groups(t):
    """The coarse group of each partner's tier, why its text is rejected (of three reasons the first), and how many uses stay."""
    rules = corpus.reject_rules(EVENT, YEAR)
    fine = F.filter("uses", lambda u: partners.reject_reason(u, rules).isNull())
    return partner_rows(t).select("p_partkey", corpus.group_of(F.col("tier")).alias("grp"), partners.reject_reason(F.col("text"), rules).alias("reject"), F.size(fine).cast("long").alias("n_uses"))


def session_rows(t, held=None):
    """Sessions with a description, an end, topics or a track, and bare names for those without raw lists."""
    held = held_sessions(t) if held is None else held
    days = agenda.day_numbers(held)
    label = agenda.full_day_label(F.col("day_number"), F.col("day"))
    k = F.col("k")
    rows = held.join(F.broadcast(days), "day", "left").withColumn("label", label).withColumn("k", F.substring("code", 2, 20).cast("long"))
    bare = k % 7 == 0
    none = F.array().cast("array<string>")
    kept = lambda c: F.when(F.coalesce(bare, F.lit(False)), none).otherwise(F.col(c))
    return rows.select(
        "code", "title", "day", "format", "label", "start", F.when(k % 2 == 0, F.concat(F.substring("start", 1, 3), F.lit("45"))).alias("end"), "hall", "track", "closed", "access",
        F.when(k % 4 == 0, none).otherwise(F.col("topics")).alias("topics"), F.when(k % 3 == 0, F.concat(F.lit("About  "), "title")).when(k % 3 == 1, "$4a").alias("description"),
        kept("speakers_raw").alias("speakers_raw"), kept("hosts_raw").alias("hosts_raw"), F.when(bare, F.col("speakers")).otherwise(none).alias("names"),
    )


def chunks(t):
    """All chunks of the corpus, from one reading of each source."""
    held = held_once(t)
    sessions, people = materialise(session_rows(t, held), "sessions"), materialise(directory(t, held), "directory")
    speakers = people.withColumn("country", F.when(F.size("codes") > 3, "Land"))
    talks = sessions.where("code IS NOT NULL").select("code", "title", "format", "label", "start", "end", "closed")
    parts = corpus.partner_chunks(partner_rows(t), EVENT, YEAR), corpus.speaker_chunks(speakers, talks, EVENT, YEAR), corpus.session_chunks(sessions, people, EVENT, YEAR)
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), sessions, people


_CLEAN = lambda x: f"nullif(trim(regexp_replace({x}, '[ \\t-\\r]+', ' ', 'g')), '')"
_WHEN = """concat_ws(', ', label, start || '–' || "end")"""
_CHUNKS = f"""{_HELD}, {_DIRECTORY}, dn AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM held WHERE day IS NOT NULL)),
p0 AS (SELECT p_partkey, p_name || ' ' || p_partkey AS title, replace(p_name, ' ', '-') || '-' || p_partkey AS key, {_SQL_TIER} AS tier, CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE lower(p_type) END AS category, CASE WHEN p_partkey % 3 = 0 THEN 'https://p' || p_partkey || '.example' END AS website,
 {_TEXTS} AS raw, CASE WHEN p_partkey % 6 IN (0, 5) THEN {_TEXTS} END AS body, 'use ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '; ' || p_brand END AS uses FROM part),
pc AS (SELECT 'partner' AS type, title, key, body, raw, NULL::BOOLEAN AS closed, NULL AS access, 0 AS n_closed, NULL AS hall, concat_ws(chr(10), title || ' — ' || coalesce(tier, 'partner') || ' at {EVENT}.', CASE WHEN category <> 'other' THEN 'Sector: ' || category || '.' END, 'Use cases: ' || uses || '.', 'Website: ' || website, body) AS text FROM p0),
s0 AS (SELECT h.* EXCLUDE (k), h.k AS ok, CASE WHEN code IS NOT NULL THEN h.k END AS k, 'Day ' || n || ' (' || dayname(h.day::DATE) || ' ' || day(h.day::DATE) || ' ' || monthname(h.day::DATE) || ' ' || year(h.day::DATE) || ')' AS label FROM held h LEFT JOIN dn ON dn.day = h.day),
s1 AS MATERIALIZED (SELECT *, CASE WHEN k % 2 = 0 THEN start[:3] || '45' END AS "end", CASE k % 3 WHEN 0 THEN 'About ' || title WHEN 1 THEN '$4a' END AS raw, CASE WHEN k % 3 = 0 THEN 'About ' || title END AS body FROM s0),
known AS (SELECT code, string_agg(x.name || coalesce(' (' || company || ')', ''), '; ' ORDER BY pos) AS line FROM (SELECT code, unnest(speakers) AS name, generate_subscripts(speakers, 1) AS pos FROM s1 WHERE k % 7 = 0) x LEFT JOIN directory d ON d.key = lower(x.name) GROUP BY code),
sc AS (SELECT 'session' AS type, title, coalesce(code, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-')) AS key, body, raw, closed, access, 0 AS n_closed, hall, concat_ws(chr(10), title || coalesce(' (' || code || ')', '') || ' — {EVENT}.', concat_ws(' · ', format, nullif({_WHEN}, ''), hall) || '.',
 CASE WHEN coalesce(k % 4 <> 0, true) THEN 'Topics: ' || track || '.' ELSE 'Track: ' || track || '.' END, CASE WHEN closed THEN {_q(corpus.CLOSED_NOTE)} ELSE {_q(corpus.OPEN_NOTE)} END,
 'Speakers: ' || CASE WHEN coalesce(k % 7 = 0, false) THEN line WHEN len(speakers) > 0 THEN array_to_string(list_transform(speakers, lambda x: x || ' (Role, Org, East)'), '; ') END || '.',
 CASE WHEN coalesce(k % 7 <> 0, true) AND len(hosts) > 0 THEN 'Hosts / moderators: ' || hosts[1] || ' (Host).' END, body) AS text FROM s1 LEFT JOIN known USING (code)),
tk AS (SELECT key, string_agg('Speaking in "' || title || '" (' || code || ') — ' || concat_ws(', ', format, {_WHEN}) || '.' || CASE WHEN closed THEN {_q(corpus.CLOSED_TALK)} ELSE '' END, chr(10) ORDER BY code) AS talks, count(*) FILTER (closed) AS n_closed FROM (SELECT key, unnest(codes) AS code FROM directory) JOIN s1 USING (code) GROUP BY key),
kc AS (SELECT 'speaker' AS type, x.name AS title, replace(x.key, ' ', '-') AS key, bio AS body, bio AS raw, NULL::BOOLEAN AS closed, NULL AS access, coalesce(n_closed, 0) AS n_closed, NULL AS hall, concat_ws(chr(10), x.name || ' — ' || company || '.', 'Speaker at {EVENT}.', CASE WHEN len(codes) > 3 THEN 'Based in: Land.' END, talks,
 CASE WHEN talks IS NULL THEN 'Speaking in "' || session_title || '".' END, bio) AS text FROM (SELECT * REPLACE (CASE WHEN ord % 2 = 1 THEN 'Dr. ' ELSE '' END || name AS name) FROM directory) x LEFT JOIN tk USING (key)),
ch AS MATERIALIZED (SELECT type || ':' || key AS id, *, NOT closed AS attendable FROM (SELECT * FROM pc UNION ALL BY NAME SELECT * FROM sc UNION ALL BY NAME SELECT * FROM kc))"""


@query(f"WITH {_CHUNKS} SELECT id, type, title, md5(text) AS text, length(text)::INT AS size, body IS NOT NULL AS has_body, n_closed::INT AS n_closed FROM ch")
def chunk_texts(t):
    """The chunks' texts, by digest: partners, speakers with their sessions, and sessions with their people."""
    whole, _, _ = chunks(t)
    return whole.select("id", "type", "title", F.md5("text").alias("text"), F.length("text").alias("size"), F.col("body").isNotNull().alias("has_body"), F.coalesce(F.size("closed_codes"), F.lit(0)).alias("n_closed"))


def _check(name: str, bad: str) -> str:
    return f"SELECT {_q(name)} AS name, count(*) FILTER ({bad}) AS n, count(*) FILTER ({bad}) = 0 AS ok FROM ch"


_STAND = r"(?i)booth\s*(no\.?|number|#|[a-z]{0,3}-?\d)|stall\s*(no\.?|number|#)"
_CHECKS = {
    "columns-filled": "id IS NULL OR key IS NULL", "text-and-title": "trim(text) = '' OR trim(title) = ''", "body-verbatim": "NOT contains(text, body)", "body-last": "NOT ends_with(text, body)", "dropped-absent": "body IS NULL AND contains(text, raw)",
    "five-words": "len(string_split(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')), ' ')) < 5", "no-stand-on-partners": f"type = 'partner' AND regexp_matches(text, {_q(_STAND)})", "no-hall-elsewhere": "type <> 'session' AND (hall IS NOT NULL OR regexp_matches(text, '\\b[Hh]all [0-9]'))",
    "year": "false", "closed-not-attendable": "closed AND attendable", "closed-stated": "closed AND NOT contains(text, 'NOT open to general attendees')", "closed-by-invitation": "closed AND lower(coalesce(access, '')) <> 'invite-only'", "open-attendable": "NOT closed AND NOT attendable",
    "open-stated": "NOT closed AND contains(text, 'NOT open to general attendees')", "speakers-flagged": "false", "speakers-told": f"n_closed > 0 AND NOT contains(text, {_q(corpus.CLOSED_TALK)})", "sessions-have-access": "type = 'session' AND closed IS NULL",
}


@query(f"""WITH {_CHUNKS} SELECT name, ok, n::BIGINT AS n FROM ({' UNION ALL BY NAME '.join(_check(n, b) for n, b in _CHECKS.items())} UNION ALL BY NAME SELECT 'ids-unique' AS name, count(*) - count(DISTINCT id) AS n, count(*) = count(DISTINCT id) AS ok FROM ch
UNION ALL BY NAME SELECT 'rows' AS name, count(*) AS n, true AS ok FROM ch UNION ALL BY NAME SELECT type AS name, count(*) AS n, true AS ok FROM ch GROUP BY type UNION ALL BY NAME SELECT 'closed' AS name, count(*) FILTER (closed) AS n, true AS ok FROM ch)""")
def corpus_assertions(t):
    """Twenty-three checks of the corpus, observed while its chunks are written."""
    whole, sessions, people = chunks(t)
    again = F.row_number().over(Window.partitionBy("id").orderBy("text")) > 1
    facts = sessions.agg(F.count("*").alias("session"), F.count_if("closed").alias("closed")).first()
    expected = {"partner": t("part").count(), "speaker": people.count(), "session": facts.session, "closed": facts.closed}
    spark = whole.sparkSession
    _, said = corpus.observed(whole.withColumn("again", again), new_path(spark, "chunks"), expected, YEAR)
    return spark.createDataFrame([(name, ok, n) for name, (ok, n) in said.items()], "name string, ok boolean, n long")


@query(f"WITH {_CHUNKS} SELECT id, (length(text) - length(body))::INT AS at, substr(text, length(text) - length(body) + 1) = {_CLEAN('raw')} AS ok FROM ch WHERE body IS NOT NULL")
def chunk_verify(t):
    """Where each chunk's body stands, and that it is its source's text."""
    whole, sessions, people = chunks(t)
    sources = [
        partner_rows(t).select(F.lit("partner").alias("type"), F.col("slug").alias("key"), F.col("text").alias("source")),
        people.select(F.lit("speaker").alias("type"), F.regexp_replace("key", " ", "-").alias("key"), F.col("bio").alias("source")),
        sessions.where("code IS NOT NULL").select(F.lit("session").alias("type"), F.col("code").alias("key"), F.col("description").alias("source")),
    ]
    return corpus.placed(whole, sources[0].unionByName(sources[1]).unionByName(sources[2]))


@query(f"""SELECT p_partkey, md5(concat_ws(chr(10), 'Partner: ' || p_name || ' ' || p_partkey, 'Tier: ' || {_SQL_TIER}, 'What they do: ' || {_TEXTS}, 'Site: ' || CASE WHEN p_partkey % 3 = 0 THEN 'https://p' || p_partkey || '.example' END)) AS text FROM part""")
def fallback_corpus(t):
    """Texts straight from a feed, where there is no corpus: what is filled, a line each."""
    text = corpus.fallback_text("Partner", F.col("name"), Tier=F.col("tier"), What_they_do=F.col("text"), Site=F.col("website"))
    return partner_rows(t).select("p_partkey", F.md5(text).alias("text"))


@query(f"""WITH {_CHUNKS} SELECT (SELECT count(*) FROM p0) AS partners, (SELECT count(*) FROM p0) AS partners_with_uses, (SELECT count(raw) FROM p0) AS partners_with_text, (SELECT count(*) FILTER (category <> 'other') FROM p0) AS partners_with_sector,
(SELECT count(*) FROM s1) AS sessions, (SELECT count(raw) FROM s1) AS sessions_with_text, (SELECT count(track) FROM s1) AS sessions_with_track, (SELECT count(*) FROM directory) AS speakers, (SELECT count(bio) FROM directory) AS speakers_with_bio, (SELECT count(*) FILTER (closed) FROM s1) AS closed_left_out""")
def matcher_coverage(t):
    """What a matcher can see: ten counts, each source read once."""
    filled = lambda c: F.count_if(F.coalesce(tx.clean(c), F.lit("")) != "")
    p = partner_rows(t).agg(F.count("*").alias("partners"), F.count_if(F.size("uses") > 0).alias("partners_with_uses"), filled("text").alias("partners_with_text"), F.count_if(F.col("category") != "other").alias("partners_with_sector"))
    s = session_rows(t).agg(F.count("*").alias("sessions"), filled("description").alias("sessions_with_text"), filled("track").alias("sessions_with_track"), F.count_if(F.col("closed") | (F.lower("access") == "invite-only")).alias("closed_left_out"))
    k = directory(t).agg(F.count("*").alias("speakers"), filled("bio").alias("speakers_with_bio"))
    return p.join(F.broadcast(s)).join(F.broadcast(k))  # three single rows
