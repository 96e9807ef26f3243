"""Queries of text blocks, wide exports, repeated runs, claims about texts, and withheld descriptions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import sentences as sn
from quern.functions import text as tx
from quern.operators import blocks, claims, intervals
from quern.plans.catalogue import _SLOTS, _slots
from quern.plans.agenda import directory
from quern.plans.corpus import _CHUNKS, partner_rows, session_rows
from quern.plans.declare import query
from quern.plans.schedule import _DAY, _greedy
from quern.plans.text import _q

_SECTION = f"[{', '.join(map(_q, blocks.SECTIONS))}]"


@query(f"""WITH i AS (SELECT l_orderkey AS person, l_partkey % 3 AS sec, l_linenumber * 100000 + l_suppkey AS pos, l_partkey, l_suppkey, p_name AS label, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS detail FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 11 <> 0),
s AS (SELECT person, sec, {_SECTION}[(sec + 1)::INT] || ':' || chr(10) || string_agg(line, chr(10) ORDER BY pos, line) AS text FROM (SELECT *, '  ' || concat_ws(' | ', l_partkey, label, nullif(detail, ''), CASE WHEN l_suppkey % 5 = 0 THEN 'added by the attendee' ELSE 'added by you' END) AS line FROM i) GROUP BY person, sec),
w AS (SELECT person, string_agg(text, chr(10) ORDER BY sec) AS body FROM s GROUP BY person)
SELECT o_orderkey AS person, md5(CASE WHEN body IS NULL THEN {_q(blocks.EMPTY_PLAN)} ELSE concat_ws(chr(10), {_q(blocks.PLAN)}, CASE WHEN o_orderkey % 2 = 0 THEN 'Objective so far: ' || o_orderpriority END, body) END) AS text FROM orders LEFT JOIN w ON person = o_orderkey""")
def plan_blocks(t):
    """Every order as a person's plan in a conversation, by digest."""
    plans = t("orders").select(F.col("o_orderkey").alias("person"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("objective"))
    section = F.element_at(F.array(*map(F.lit, blocks.SECTIONS)), (F.col("l_partkey") % 3 + 1).cast("int"))
    items = t("lineitem").where("l_orderkey % 11 <> 0").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("person"), section.alias("section"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("pos"), F.col("l_partkey").alias("id"), F.col("p_name").alias("label"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("detail"), (F.col("l_suppkey") % 5 == 0).alias("manual"),
    )
    return blocks.plan_text(plans, items).select("person", F.md5("text").alias("text"))


@query(f"""WITH o AS (SELECT o_custkey, count(*) AS n, list('S' || o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 3 = 0) AS shared, list(strftime(o_orderdate, '%Y-%m-%d') || ' 10:00-11:00' ORDER BY o_orderkey) FILTER (o_orderkey % 2 = 0) AS windows FROM orders GROUP BY o_custkey)
SELECT c_custkey, md5(concat_ws(' | ', 'c-' || c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'buyer' ELSE '-' END, '-', c_mktsegment || '/x', coalesce(n, 0) || ' sessions planned', 'also in your plan: ' || array_to_string(shared, ','), 'both free: ' || array_to_string(windows[:3], '; '),
CASE WHEN c_custkey % 4 = 0 THEN 'in common: a, b, c, d' END, CASE WHEN c_custkey % 7 = 0 THEN {_q(blocks.DEMO)} END)) AS line FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def roster_blocks(t):
    """Lines of the roster of people who share their plans, by digest."""
    k = F.col("o_orderkey")
    sorted_ = lambda test, x: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(k.alias("k"), x.alias("x"))))), lambda y: y["x"])
    window = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 10:00-11:00"))
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), sorted_(k % 3 == 0, F.concat(F.lit("S"), k.cast("string"))).alias("shared"), sorted_(k % 2 == 0, window).alias("windows"))
    c = F.col("c_custkey")
    none = F.array().cast("array<string>")
    rows = t("customer").join(per, F.col("o_custkey") == c, "left").select(
        "c_custkey", F.concat(F.lit("c-"), c.cast("string")).alias("slug"), F.col("c_name").alias("name"), F.when(c % 2 == 0, "buyer").otherwise("").alias("role"), F.lit(None).cast("string").alias("org"), F.array("c_mktsegment", F.lit("x")).alias("interests"),
        F.coalesce("n", F.lit(0)).alias("n_sessions"), "shared", "windows", F.when(c % 4 == 0, F.array(*map(F.lit, "abcde"))).otherwise(none).alias("common"), (c % 7 == 0).alias("demo"),
    )
    return rows.select("c_custkey", F.md5(blocks.roster_line()).alias("line"))


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations)
SELECT conv_id, md5({_q(blocks.HISTORY)} || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'Attendee: ' ELSE 'You: ' END || coalesce(text, ''), chr(10) ORDER BY back DESC)) AS text FROM l WHERE back <= {blocks.HISTORY_TURNS} GROUP BY conv_id""")
def history_blocks(t):
    """The last turns of every conversation as text, by digest."""
    return blocks.history_text(t("conversations")).select("conv_id", F.md5("text").alias("text"))


@query(f"""WITH RECURSIVE x AS ({_SLOTS}), {_greedy(f'SELECT user_id, {_DAY}, id AS nth, id, s, e FROM x', f'SELECT user_id, {_DAY}, id AS nth, id, s, e FROM x WHERE false')},
d AS (SELECT user_id, day, id, count(*) OVER (PARTITION BY user_id, day) AS n, '• "slot ' || id || '" (day ' || day || ', ' || id || ') — it clashes with "slot ' || clash || '", which is already in your plan.' AS line FROM g WHERE i > 0 AND NOT kept)
SELECT user_id, day, any_value(n)::INT AS n, md5('I left ' || CASE WHEN any_value(n) = 1 THEN 'one session' ELSE any_value(n) || ' sessions' END || ' out to avoid double-booking you:' || chr(10) || string_agg(line, chr(10) ORDER BY id) || chr(10) || chr(10) || 'Say the word if you''d rather have ' || CASE WHEN any_value(n) = 1 THEN 'it' ELSE 'one of them' END || ' and I''ll swap out what it collides with.') AS text FROM d GROUP BY user_id, day""")
def clash_notes(t):
    """Notices of the slots that clash filters leave out, by digest."""
    slots = _slots(t).select("user_id", F.floor(F.col("s") / 1440).alias("day"), F.col("id").alias("nth"), "id", "s", "e")
    out = intervals.clash_filter(slots, ["user_id", "day"]).where("NOT kept")
    text = lambda label, c: F.concat(F.lit(label), F.col(c).cast("string"))
    dropped = out.select("user_id", F.col("day").alias("d"), F.col("id").alias("nth"), text("slot ", "id").alias("label"), text("day ", "day").alias("day"), F.col("id").cast("string").alias("time"), text("slot ", "clash").alias("other"))
    return blocks.clash_note(dropped, ["user_id", "d"]).select("user_id", F.col("d").alias("day"), "n", F.md5("text").alias("text"))


@query(f"""WITH {_CHUNKS}, l AS (SELECT length(concat_ws('|', code, day, start, coalesce(hall, ''), title, coalesce(track, ''))) + 1 AS n FROM s1 WHERE NOT closed) SELECT count(*) AS lines, (SELECT count(*) FROM s1 WHERE closed) AS left_out, sum(n)::BIGINT AS chars, round(sum(n) / {blocks.CHARS_PER_TOKEN}::DOUBLE)::BIGINT AS tokens FROM l""")
def catalogue_stats(t):
    """How large the catalogue of plannable sessions is as text: lines, characters and about how many tokens. The text is never in one place."""
    rows = session_rows(t)
    size = F.length(F.concat_ws("|", "code", "day", "start", F.coalesce("hall", F.lit("")), "title", F.coalesce("track", F.lit("")))) + 1
    chars = F.sum(F.when(~F.col("closed"), size)).cast("long")
    return rows.agg(F.count_if(~F.col("closed")).alias("lines"), F.count_if("closed").alias("left_out"), chars.alias("chars"), F.round(chars / blocks.CHARS_PER_TOKEN).cast("long").alias("tokens"))


@query(f"""SELECT p_partkey::VARCHAR AS "recordId", p_name AS name, p_type || ';' || p_brand AS aliases, CASE WHEN p_partkey % 3 = 1 THEN 'does ' || p_type END AS "whatTheyDo", CASE WHEN p_partkey % 3 > 0 THEN ['', 'traced', 'unsourced'][(p_partkey % 3 + 1)::INT] END AS "whatTheyDo_method",
CASE WHEN p_partkey % 3 = 2 THEN 'said' END AS "whatTheyDo_unsourced", CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END AS "confidenceScore", 'false' AS "isDataArtifact", {len(blocks.EXHIBITORS)} AS n FROM part""")
def wide_export(t):
    """Exhibitors as wide rows from documents of many shapes: eight of the columns, and how many there are."""
    k = F.col("p_partkey")
    method = F.when(k % 3 == 1, "traced").when(k % 3 == 2, "unsourced")
    doc = F.to_json(F.struct(
        k.alias("_id"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("aliases"), F.concat(F.lit("does "), "p_type").alias("whatTheyDo"), F.struct(F.struct(method.alias("method")).alias("whatTheyDo")).alias("provenance"),
        F.when(k % 3 == 2, F.struct(F.lit("said").alias("whatTheyDo"))).alias("unsourced"), F.when(k % 2 == 0, F.col("p_size")).alias("confidenceScore"), F.lit(False).alias("isDataArtifact"),
    ))
    rows = blocks.wide(t("part").select(F.parse_json(doc).alias("doc")), "doc", blocks.EXHIBITORS)
    return rows.select("recordId", "name", "aliases", "whatTheyDo", "whatTheyDo_method", "whatTheyDo_unsourced", "confidenceScore", "isDataArtifact", F.lit(len(rows.columns)).alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS key, 's' || (l_suppkey % 7) AS slug, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS pos FROM lineitem), f AS (SELECT key, slug, min(pos) AS pos FROM l WHERE slug IN ('s0', 's2', 's4', 's6') GROUP BY key, slug)
SELECT o_orderkey AS key, coalesce(string_agg(slug, ',' ORDER BY pos), '') AS slugs FROM (SELECT DISTINCT key AS o_orderkey FROM l) LEFT JOIN f ON key = o_orderkey GROUP BY o_orderkey""")
def roster_slugs(t):
    """Of what replies name, the people of the roster, each once."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: F.concat(F.lit("s"), (x["l_suppkey"] % 7).cast("string")))
    mentions = t("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(said.alias("slugs"))
    roster = t("supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 7).cast("string")).alias("slug")).where("slug IN ('s0', 's2', 's4', 's6')")
    return blocks.roster_gated(mentions, roster).select("key", F.array_join("slugs", ",").alias("slugs"))


@query("""WITH c AS (SELECT conv_id AS "case", min(turn) AS ord, conv_id % 2 = 0 AS safety FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id AS "case", turn, text, length(text) % 9 = 0 AS bad, length(text) % 3 = 0 AS viol, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place FROM conversations WHERE role = 'assistant'),
r AS (SELECT c.*, place, bad, viol, text FROM c LEFT JOIN a ON a."case" = c."case" AND place <= CASE WHEN safety THEN 3 ELSE 1 END)
SELECT "case", any_value(ord) AS ord, count(place) AS attempts, count(place) > 0 AND count(*) FILTER (NOT bad AND NOT viol) = count(place) AS passed, count(*) FILTER (NOT bad AND NOT viol) > 0 AND count(*) FILTER (NOT bad AND NOT viol) < count(place) AS flaky, count(*) FILTER (bad) AS errors, md5(min_by(text, place) FILTER (NOT bad AND trim(text) <> '')) AS response FROM r GROUP BY "case" """)
def suite_runs(t):
    """Cases run once, or three times where safety is at stake, from the answers that a target gave."""
    turns = t("conversations")
    cases = turns.groupBy(F.col("conv_id").alias("case")).agg(F.min("turn").alias("ord")).withColumn("safety", F.col("case") % 2 == 0)
    bad = F.length("text") % 9 == 0
    said = turns.where("role = 'assistant'").select(F.col("conv_id").alias("case"), F.struct("turn", "text").alias("nth"), F.when(~bad, F.col("text")).alias("answer"), F.when(bad, "no answer").alias("error"), F.when(F.length("text") % 3 == 0, 1).otherwise(0).alias("n_violations"))
    return blocks.attempts(cases, said, 1, 3).withColumn("response", F.md5("response"))


_PHRASE = "array_to_string(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')[:3], ' ')"


@query(f"""WITH c AS (SELECT item_id, {_PHRASE} AS want, ['present', 'absent', 'prior'][(item_id % 3 + 1)::INT] AS claim FROM benchmark), d AS (SELECT source IN ('src0', 'src1', 'src2') AS before, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS pad FROM documents),
h AS (SELECT item_id, count(*) FILTER (before) AS b, count(*) FILTER (NOT before) AS n FROM c JOIN d ON want <> '' AND contains(pad, ' ' || want || ' ') GROUP BY item_id)
SELECT item_id AS "case", claim, CASE WHEN claim = 'present' AND coalesce(n, 0) = 0 THEN want || ' does not appear' WHEN claim = 'absent' AND coalesce(n, 0) > 0 THEN want || ' does appear' WHEN claim = 'prior' AND coalesce(b, 0) = 0 THEN want || ' does not appear before' END AS error FROM c LEFT JOIN h USING (item_id)""")
def text_claims(t):
    """Claims that a passage's first words are in the present texts, in none of them, or in the earlier ones."""
    words = F.array_join(F.slice(F.split(sn.norm(F.col("text")), " "), 1, 3), " ")
    claim = F.element_at(F.array(*map(F.lit, ["present", "absent", "prior"])), (F.col("item_id") % 3 + 1).cast("int"))
    asked = t("benchmark").select(F.col("item_id").alias("case"), claim.alias("claim"), words.alias("want"))
    texts = t("documents").select(F.col("doc_id").alias("id"), "text", F.coalesce(F.col("source").isin("src0", "src1", "src2"), F.lit(False)).alias("before"))
    return claims.verify_texts(asked, texts.where("NOT before"), texts.where("before")).select("case", "claim", "error")


_VENUES = ("harbour hall", "old mill")
_PLACES = ["", " Booth No. 4", " in hall B-2", " Show Week 2019", " at the Old Mill", " Show Week 2026"]


@query(f"""WITH x AS (SELECT p_partkey, p_name || [{', '.join(map(_q, _PLACES))}][(p_partkey % {len(_PLACES)} + 1)::INT] AS text FROM part), r AS (SELECT *, CASE p_partkey % {len(_PLACES)} WHEN 1 THEN 'booth identifier' WHEN 2 THEN 'hall identifier' WHEN 3 THEN 'Show Week 2019 content' WHEN 4 THEN 'venue/location text' ELSE '' END AS reasons FROM x)
SELECT p_partkey, CASE WHEN reasons = '' THEN text END AS text, reasons FROM r""")
def suppressed_texts(t):
    """Descriptions that name a stand, a hall, an earlier edition or a venue are withheld whole, with the reasons."""
    text = F.concat("p_name", F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("p_partkey") % len(_PLACES) + 1).cast("int")))
    got = t("part").select("p_partkey", text.alias("text")).withColumn("r", tx.contamination("text", event="Show Week", year=2026, venues=_VENUES))
    return got.select("p_partkey", F.when(F.size("r") == 0, F.col("text")).alias("text"), F.array_join("r", ",").alias("reasons"))


_WEB_STOP = "(" + ", ".join(map(_q, tx.WEB_STOPWORDS)) + ")"


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w FROM documents) SELECT w AS term, count(*) AS docs FROM w WHERE length(w) > 2 AND w NOT IN {_WEB_STOP} GROUP BY w""")
def web_terms(t):
    """In how many documents each term of the plain tokeniser stands."""
    return t("documents").select(F.explode(tx.web_tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))


@query("""WITH x AS (SELECT o_custkey AS person, o_orderdate::DATE AS day, o_orderkey, o_orderpriority || ' | ' || o_orderkey AS detail FROM orders) SELECT person, day, o_orderkey, row_number() OVER (PARTITION BY person ORDER BY day, detail COLLATE en, o_orderkey) AS place, count(*) OVER (PARTITION BY person) AS n FROM x""")
def plan_pages(t):
    """The entries of every person's plan in the order of a page: by day, then by the detail shown in a language's order; with their number."""
    rows = t("orders").select(F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("day"), "o_orderkey", F.concat("o_orderpriority", F.lit(" | "), F.col("o_orderkey").cast("string")).alias("detail"))
    order = Window.partitionBy("person").orderBy("day", F.collate("detail", "UNICODE"), "o_orderkey")
    return rows.select("person", "day", "o_orderkey", F.row_number().over(order).alias("place"), F.count("*").over(Window.partitionBy("person")).alias("n"))


@query(f"""WITH {_CHUNKS} SELECT ok AS k, md5(concat_ws(chr(10), '[S] ' || title, '    date: ' || coalesce(day, 'not recorded'), '    hall: ' || coalesce(hall, 'not recorded'), '    format: ' || coalesce(format, 'not recorded'), '    track: ' || coalesce(track, 'not recorded'),
'    access: ' || CASE WHEN closed THEN 'INVITE-ONLY' ELSE 'open to attendees' END, '    booth_location: NOT PUBLISHED', '    description: ' || coalesce(raw, 'not recorded'))) AS block, md5(concat_ws(chr(32) || chr(10) || chr(32), title, format, hall, raw)) AS flat FROM s1 WHERE code IS NOT NULL""")
def record_blocks(t):
    """Every session as a block for a conversation and as the flat text of an embedding, by digest."""
    rows = session_rows(t).where("code IS NOT NULL")
    access = F.when(F.col("closed"), "INVITE-ONLY").otherwise("open to attendees")
    raw = tx.clean("description")
    block = blocks.record_block(F.concat(F.lit("[S] "), "title"), {"date": F.col("day"), "hall": F.col("hall"), "format": F.col("format"), "track": F.col("track"), "access": access, "booth_location": "NOT PUBLISHED", "description": raw})
    flat = blocks.flat_text({"title": F.col("title"), "format": F.col("format"), "hall": F.col("hall"), "description": raw})
    return rows.select(F.substring("code", 2, 20).cast("long").alias("k"), F.md5(block).alias("block"), F.md5(flat).alias("flat"))


_WAS = "SELECT o_orderkey AS k, o_orderpriority || ' ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderstatus AS v FROM orders WHERE o_orderkey % 11 <> 0"
_IS = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus || '!' ELSE o_orderstatus END AS v, o_orderpriority || ' ' || o_orderkey AS title FROM orders WHERE o_orderkey % 13 <> 0"


@query(f"""WITH w AS ({_WAS}), i AS ({_IS}), c AS (SELECT 'added' AS kind, i.k, i.title, NULL AS day, NULL AS was, NULL AS now FROM i ANTI JOIN w USING (k) UNION ALL SELECT 'disappeared', w.k, w.title, w.day, NULL, NULL FROM w ANTI JOIN i USING (k)
UNION ALL SELECT 'changed', i.k, i.title, NULL, w.v, i.v FROM i JOIN w USING (k) WHERE i.v <> w.v), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY k) AS nth, count(*) OVER (PARTITION BY kind) AS n_kind FROM c)
SELECT kind, n_kind, nth, CASE kind WHEN 'added' THEN '   + ' || title WHEN 'disappeared' THEN '   - DISAPPEARED: ' || title || coalesce(' (' || day || ' )', '') ELSE '   ~ ' || title[:48] || ': status ' || was || ' -> ' || now END AS line FROM n WHERE kind = 'disappeared' OR nth <= CASE WHEN kind = 'added' THEN 40 ELSE 60 END
UNION ALL SELECT kind, n_kind, nth, '   + ... ' || (n_kind - 40) || ' more' FROM n WHERE kind = 'added' AND nth = 41""")
def refresh_report(t):
    """The lines of a refresh: new records and changes up to a report's length, all that disappeared, and how many more are new."""
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("v"))
    was = o.where("k % 11 <> 0").withColumn("day", F.when(F.col("k") % 2 == 0, F.col("day")))
    now = o.where("k % 13 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    both = was.select("k", F.struct("title", "day", "v").alias("a")).join(now.select("k", F.struct("title", "v").alias("b")), "k", "full")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "disappeared").when(F.col("a.v") != F.col("b.v"), "changed")
    changed = kind == "changed"
    changes = both.select(kind.alias("kind"), F.col("k").alias("ord"), F.coalesce("b.title", "a.title").alias("title"), F.when(kind == "disappeared", F.col("a.day")).alias("day"), F.lit(None).cast("string").alias("start"), F.when(changed, "status").alias("field"), F.when(changed, F.col("a.v")).alias("was"), F.when(changed, F.col("b.v")).alias("now"))
    return blocks.refresh_lines(changes.where("kind IS NOT NULL"))


@query(f"""WITH {_CHUNKS}, d AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM s1)), c AS (SELECT (SELECT count(*) FROM p0) AS partner_rows, (SELECT count(*) FILTER (p_partkey % 50 <> 0) FROM p0) AS partners_real, (SELECT count(*) FILTER (p_partkey % 50 = 0) FROM p0) AS partner_artifacts, (SELECT count(*) FROM directory) AS speakers,
(SELECT count(*) FROM s1) AS sessions, (SELECT count(*) FILTER (closed) FROM s1) AS closed_door, (SELECT count(*) FILTER (NOT closed) FROM s1) AS public_sessions, (SELECT count(*) FILTER (raw IS NULL) FROM p0) AS partners_missing_description, (SELECT count(*) FILTER (website IS NULL) FROM p0) AS partners_missing_website,
(SELECT count(DISTINCT hall) FROM s1) AS halls, (SELECT count(*) FROM s1 JOIN d USING (day) WHERE n = 1) AS day1, (SELECT count(*) FROM s1 JOIN d USING (day) WHERE n = 2) AS day2, (SELECT count(*) FROM s1 JOIN d USING (day) WHERE n = 3) AS day3,
(SELECT count(*) FILTER (p_partkey % 2 = 0) FROM p0) AS partners_before, (SELECT count(*) FILTER (company = 'Firm B') FROM directory) AS speakers_before, (SELECT count(*) FILTER (k % 2 = 0) FROM s1) AS sessions_before)
UNPIVOT c ON COLUMNS(*) INTO NAME metric VALUE n""")
def corpus_counts(t):
    """Sixteen named counts of the corpus, each source read once."""
    p, k = partner_rows(t), F.col("p_partkey")
    missing = lambda c: F.count_if(F.coalesce(tx.clean(c), F.lit("")) == "")
    of = {
        "partner_rows": F.count("*"), "partners_real": F.count_if(k % 50 != 0), "partner_artifacts": F.count_if(k % 50 == 0), "partners_missing_description": missing("text"), "partners_missing_website": missing("website"), "partners_before": F.count_if(k % 2 == 0),
    }
    s = session_rows(t)
    days = s.where("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n")).orderBy("day").limit(3)  # the first three days' counts are asked for
    nth = days.withColumn("i", F.row_number().over(Window.orderBy("day")))
    by_day = nth.agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(f"day{i}") for i in (1, 2, 3)])
    code = F.substring("code", 2, 20).cast("long")
    held = s.agg(F.count("*").alias("sessions"), F.count_if("closed").alias("closed_door"), F.count_if(~F.col("closed")).alias("public_sessions"), F.count_distinct("hall").alias("halls"), F.count_if(code % 2 == 0).alias("sessions_before"))
    speakers = directory(t).agg(F.count("*").alias("speakers"), F.count_if(F.col("company") == "Firm B").alias("speakers_before"))
    row = p.agg(*[c.alias(n) for n, c in of.items()]).join(F.broadcast(held)).join(F.broadcast(by_day)).join(F.broadcast(speakers))
    names = [*of, "sessions", "closed_door", "public_sessions", "halls", "sessions_before", "day1", "day2", "day3", "speakers", "speakers_before"]
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("n")) for n in names])))
