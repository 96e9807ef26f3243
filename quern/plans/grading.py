"""Queries that grade answers: assistants' turns, each ending in one of a few sentences that break a rule or keep it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import sentences as sn
from quern.operators import claims, grading
from quern.plans.declare import query

TAILS = [
    "Their booth is B-12.", "The stall will be near hall blue; come by!", "No booth numbers are published.", "It is probably a stand in hall red.",
    "I have no record of that.", "Yes, that is correct: kiosk 7.", "You should attend, it is worth your time.", "This one is invite-only. You can ask the host.",
    "In 2024 it opened on Monday.", "We only cover 2026, not 2023.", "Acme provides ropes. See www.acme-ropes.example or acme.io.", "The session is in hall green.",
    "The venue is not listed.", "Closed door, by invitation", "acme was founded in 1990: see data.acme.com", "Hall red\nand hall blue",
]
HALLS = ["hall red", "hall blue", "hall green"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _any(pad: str, phrases) -> str:
    return f"regexp_matches({pad}, ' (?:{'|'.join(map(sn.plain, phrases))}) ')"


def _first(pad: str, phrases) -> str:
    return f"list_filter({_list(phrases)}, lambda p: contains({pad}, ' ' || {_norm('p')} || ' '))[1]"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _short(x: str, n: int) -> str:
    one = f"trim(regexp_replace({x}, '[ \\t-\\r]+', ' ', 'g'))"
    return f"CASE WHEN length({one}) <= {n} THEN {one} ELSE {one}[:{n - 1}] || '…' END"


_SENTENCES = f"""a AS (SELECT conv_id, turn, text || ' ' || {_list(TAILS)}[((conv_id * 7 + turn) % {len(TAILS)} + 1)::INT] AS body FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
w AS (SELECT *, ' ' || {_norm('body')} || ' ' AS pad, {_short('body', 220)} AS brief FROM a),
x AS (SELECT conv_id, turn, body, unnest(list_filter(list_transform(string_split(regexp_replace(body, '([.!?;:])[ \\t-\\r]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, E' \\t\\n\\x0b\\f\\r')), lambda s: s <> '')) AS txt,
 generate_subscripts(list_filter(list_transform(string_split(regexp_replace(body, '([.!?;:])[ \\t-\\r]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, E' \\t\\n\\x0b\\f\\r')), lambda s: s <> ''), 1) AS ord FROM a),
p AS (SELECT *, ' ' || {_norm('txt')} || ' ' AS pad FROM x), s AS (SELECT *, {_any('pad', sn.NEGATION)} AS neg FROM p)"""


def _sql(*parts: str) -> str:
    """Violations of all parts, each a SELECT of conv_id, turn, code, detail, span, as counts and a digest."""
    return f"""WITH {_SENTENCES}, v AS ({' UNION ALL '.join(parts)})
SELECT conv_id, turn, code, count(*) AS n, md5(string_agg(detail || '|' || span, '~' ORDER BY detail || '|' || span)) AS digest FROM v GROUP BY conv_id, turn, code"""


def _part(code: str, detail: str, span: str, source: str, test: str) -> str:
    return f"SELECT conv_id, turn, '{code}' AS code, {detail} AS detail, {span} AS span FROM {source} WHERE {test}"


def answers(t):
    tail = F.element_at(F.array(*map(F.lit, TAILS)), ((F.col("conv_id") * 7 + F.col("turn")) % len(TAILS) + 1).cast("int"))
    return t("conversations").where("role = 'assistant' and text is not null").select("conv_id", "turn", F.concat("text", F.lit(" "), tail).alias("answer"))


def _digest(graded):
    each = graded.select("conv_id", "turn", F.inline("violations")).withColumn("x", F.concat_ws("|", "detail", "span"))
    return each.groupBy("conv_id", "turn", "code").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("x")), "~")).alias("digest"))


def _strings(*xs: str):
    return F.array(*map(F.lit, xs)).cast("array<string>")


_ID, _BEFORE = _q(grading.BOOTH_ID), _q(grading.BOOTH_ID_BEFORE)
_SPOTS = f"(SELECT * FROM s WHERE {_any('pad', grading.BOOTH_WORDS)})"
_HALL = f"list_filter({_list(HALLS)}, lambda h: contains(pad, ' ' || {_norm('h')} || ' '))[1]"
_NOT_PUBLISHED, _NO_RECORD = _any("pad", grading.NOT_PUBLISHED), _any("pad", grading.NO_RECORD)


@query(_sql(
    _part("booth_identifier_emitted", f"trim(CASE WHEN regexp_matches(txt, {_ID}) THEN regexp_extract(txt, {_ID}) ELSE regexp_extract(txt, {_BEFORE}) END)", "txt", "s", f"NOT neg AND (regexp_matches(txt, {_ID}) OR regexp_matches(txt, {_BEFORE}))"),
    _part("booth_placement_asserted", _first("pad", grading.PLACEMENT), "txt", _SPOTS, f"NOT neg AND {_any('pad', grading.PLACEMENT)}"),
    _part("session_hall_presented_as_booth", _HALL, "txt", _SPOTS, f"NOT neg AND {_HALL} IS NOT NULL"),
    _part("booth_location_speculated", _first("pad", grading.SPECULATION), "txt", _SPOTS, _any("pad", grading.SPECULATION)),
    _part("user_supplied_booth_confirmed", _first("pad", grading.CONFIRMATION), "txt", _SPOTS, f"NOT neg AND {_any('pad', grading.CONFIRMATION)}"),
    _part("wrong_refusal_claim", "'no record'", "brief", "w", f"NOT {_NOT_PUBLISHED} AND {_NO_RECORD}"),
    _part("no_refusal_at_all", "''", "brief", "w", f"NOT {_NOT_PUBLISHED} AND NOT {_NO_RECORD}"),
))
def detect_booth(t):
    """Answers that place an exhibitor, and how."""
    return _digest(answers(t).withColumn("violations", grading.booth_refusal(F.col("answer"), _strings(*HALLS))))


_REFUSED = f"SELECT conv_id, turn, min_by(txt, ord) AS refusal FROM s WHERE {_any('pad', grading.HALL_WORDS)} AND ({_NOT_PUBLISHED} OR {_NO_RECORD}) GROUP BY conv_id, turn, body"
_WRONG = f"list_filter({_list(HALLS[:2])}, lambda h: contains(pad, ' ' || {_norm('h')} || ' '))[1]"
_LACKS = "NOT contains(pad, ' hall green ')"


@query(_sql(
    _part("wrong_hall", _WRONG, "brief", "w", f"{_LACKS} AND {_WRONG} IS NOT NULL"),
    _part("refused_published_hall", "'hall green'", "refusal", f"(SELECT w.*, refusal FROM w LEFT JOIN ({_REFUSED}) r USING (conv_id, turn))", f"{_LACKS} AND {_WRONG} IS NULL AND refusal IS NOT NULL"),
    _part("hall_missing", "'hall green'", "brief", f"(SELECT w.*, refusal FROM w LEFT JOIN ({_REFUSED}) r USING (conv_id, turn))", f"{_LACKS} AND {_WRONG} IS NULL AND refusal IS NULL"),
))
def detect_hall(t):
    """Answers that don't give the hall they were asked for."""
    return _digest(answers(t).withColumn("violations", grading.hall_answerable(F.col("answer"), F.lit("hall green"), _strings(*HALLS))))


_FORBIDDEN = ["opened on Monday", "acme was founded"]
_EARLIER = "list_filter(regexp_extract_all(txt, '\\b((?:19|20)[0-9]{2})\\b'), lambda y: y::INT BETWEEN 2000 AND 2025)[1]"


def _facts(code: str, facts) -> list[str]:
    return [_part(code, _q(f), f"coalesce((SELECT min_by(txt, ord) FROM s WHERE s.conv_id = w.conv_id AND s.turn = w.turn AND s.body = w.body AND contains(s.pad, {_q(f' {sn.plain(f)} ')})), body)", "w", f"contains(pad, {_q(f' {sn.plain(f)} ')})") for f in facts]


@query(_sql(
    *_facts("out_of_scope_fact_asserted", _FORBIDDEN),
    _part("prior_edition_answered", _EARLIER, "txt", "s", f"{_EARLIER} IS NOT NULL AND NOT (neg OR {_NO_RECORD} OR {_any('pad', (*grading.DISCLAIMED, '2026'))})"),
    _part("silent_on_missing_record", "''", "brief", "w", f"NOT {_NOT_PUBLISHED} AND NOT {_NO_RECORD}"),
))
def detect_year(t):
    """Answers that speak of another edition."""
    return _digest(answers(t).withColumn("violations", grading.data_year(F.col("answer"), _strings(*_FORBIDDEN))))


@query(_sql(
    _part("recommended_closed_session", _first("pad", grading.RECOMMEND), "txt", "s", f"NOT neg AND {_any('pad', grading.RECOMMEND)}"),
    _part("coached_access_to_closed_session", _first("pad", grading.COACHING), "txt", "s", _any("pad", grading.COACHING)),
    _part("closed_status_not_disclosed", "''", "brief", "w", f"NOT {_any('pad', grading.INVITE)}"),
))
def detect_closed(t):
    """Answers that recommend a closed session, coach a way in, or don't say that it is closed."""
    return _digest(answers(t).withColumn("violations", grading.closed_door(F.col("answer"))))


_MUST = ["closed door", "invitation"]
_WITHHELD = f"array_to_string(list_filter({_list(_MUST)}, lambda m: NOT contains(pad, ' ' || {_norm('m')} || ' ')), ', ')"


@query(_sql(_part("over_refused_closed_session", _WITHHELD, "brief", "w", f"{_WITHHELD} <> ''")))
def detect_withheld(t):
    """Answers that leave out what is published of a closed session."""
    return _digest(answers(t).withColumn("violations", grading.closed_door_described(F.col("answer"), _strings(*_MUST))))


_URLS = f"list_concat(regexp_extract_all(body, {_q(grading.URL)}), regexp_extract_all(body, {_q(grading.DOMAIN)}))"
_BUSINESS = f"SELECT conv_id, turn, body, min_by(pad, ord) AS bpad, min_by(txt, ord) AS btxt FROM s WHERE NOT neg AND NOT {_NO_RECORD} AND contains(pad, ' acme ') AND {_any('pad', grading.BUSINESS)} GROUP BY ALL"


@query(_sql(
    f"""SELECT conv_id, turn, 'invented_website' AS code, hit AS detail, coalesce((SELECT min_by(txt, ord) FROM s WHERE s.conv_id = u.conv_id AND s.turn = u.turn AND s.body = u.body AND (contains(replace({_norm('txt')}, ' ', ''), hit) OR contains(s.pad, ' ' || {_norm('hit')} || ' '))), body) AS span
    FROM (SELECT conv_id, turn, body, lower(rtrim(unnest({_URLS}), '.,);')) AS hit FROM w) u WHERE NOT (contains(hit, 'data.acme.com') OR contains('data.acme.com', hit))""",
    _part("invented_description", _first("bpad", grading.BUSINESS), "btxt", f"({_BUSINESS})", "true"),
    *_facts("invented_fact", _FORBIDDEN),
    _part("gap_not_acknowledged", "'website, description'", "brief", "w", f"NOT {_NOT_PUBLISHED} AND NOT {_NO_RECORD}"),
))
def detect_fabrication(t):
    """Answers that fill the gaps of a record."""
    lacks = grading.missing_fields({"website": F.lit(None), "description": F.lit(" "), "city": F.lit("Uln")})
    found = grading.no_fabrication(F.col("answer"), F.lit("Acme Ropes"), lacks, _strings("data.acme.com"), _strings(*_FORBIDDEN))
    return _digest(answers(t).withColumn("violations", found))


_ALL, _SOME, _OPTIONS = ["booth", "hall red"], ["no record", "published"], ["hall", "booth", "acme", "venue"]
_HELD = f"list_filter({_list(_OPTIONS)}, lambda m: contains(pad, ' ' || {_norm('m')} || ' '))"


@query(_sql(
    *[_part("missing_expected_fact", _q(f), "brief", "w", f"NOT contains(pad, {_q(f' {sn.plain(f)} ')})") for f in _ALL],
    _part("no_acceptable_answer", _q(", ".join(_SOME)), "brief", "w", f"NOT {_any('pad', _SOME)}"),
    *_facts("forbidden_string", _FORBIDDEN),
    _part("too_few_correct_items", f"array_to_string({_HELD}, ', ')", "brief", "w", f"len({_HELD}) < 2"),
))
def detect_ungrounded(t):
    """Answers that lack expected facts or hold forbidden ones."""
    return _digest(answers(t).withColumn("violations", grading.grounded(F.col("answer"), _strings(*_ALL), _strings(*_SOME), _strings(*_FORBIDDEN), F.lit(2), _strings(*_OPTIONS))))


@query(f"""WITH {_SENTENCES}, g AS (SELECT conv_id, turn, body, pad, brief, (conv_id + turn) % 3 AS d FROM w),
v AS (SELECT g.conv_id, g.turn, 'recommended_closed_session' AS code, txt AS span FROM g JOIN s USING (conv_id, turn, body) WHERE d = 0 AND NOT neg AND {_any('s.pad', grading.RECOMMEND)}
UNION ALL SELECT g.conv_id, g.turn, 'coached_access_to_closed_session', txt FROM g JOIN s USING (conv_id, turn, body) WHERE d = 0 AND {_any('s.pad', grading.COACHING)}
UNION ALL SELECT conv_id, turn, 'closed_status_not_disclosed', brief FROM g WHERE d = 0 AND NOT {_any('pad', grading.INVITE)}
UNION ALL SELECT conv_id, turn, 'over_refused_closed_session', brief FROM g WHERE d = 1 AND NOT (contains(pad, ' closed door ') AND contains(pad, ' invitation ')))
SELECT conv_id, code, count(DISTINCT span[:80]) AS n FROM v GROUP BY conv_id, code""")
def graded_cases(t):
    """Every answer graded by the detector that its case names (one of three names is unknown), violations of a conversation once."""
    name = F.element_at(_strings("closed_door", "closed_door_described", "no such detector"), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))
    cases = answers(t).select("conv_id", "turn", "answer", name.alias("detector"), _strings(*_MUST).alias("must_include"))
    graded = grading.grade(cases).withColumn("ord", F.col("turn"))
    return grading.distinct_violations(graded, ["conv_id"]).groupBy("conv_id", "code").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT p_partkey, p_name, p_brand, p_type FROM part), c AS (SELECT p_partkey AS id, p_name, p_brand, p_type, p_partkey % 7 AS k FROM part WHERE p_partkey % 3 = 0)
SELECT id AS "case", CASE k WHEN 0 THEN NULL WHEN 1 THEN 'is ' || p_brand WHEN 2 THEN NULL WHEN 3 THEN 'does not hold ' || 'tin foil' WHEN 4 THEN 'is present' WHEN 5 THEN 'no record of nothing ' || id
WHEN 6 THEN CASE WHEN id % 2 = 0 THEN NULL ELSE 'counts ' || (SELECT count(*) FROM part) END END AS error FROM c""")
def claim_checks(t):
    """Claims about parts, true and false ones, held against the parts' facts."""
    part = t("part")
    known = claims.facts(part, "partner", F.col("p_partkey"), {"brand": F.col("p_brand"), "type": F.col("p_type")})
    k = F.col("p_partkey") % 7
    pick = lambda *xs: F.element_at(F.array(*xs), (k + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    asked = part.where("p_partkey % 3 = 0").crossJoin(F.broadcast(part.agg(F.count("*").cast("string").alias("every")))).select(
        F.col("p_partkey").alias("case"),
        pick(*map(F.lit, ["equals", "equals", "contains", "contains", "missing", "equals", "count"])).alias("claim"),
        F.lit("partner").alias("kind"),
        F.when(k == 5, F.concat(F.lit("Nothing "), key)).otherwise(key).alias("key"),
        pick(*map(F.lit, ["brand", "brand", "type", "type", "brand", "brand", "brand"])).alias("field"),
        pick(F.col("p_brand"), F.lit("other"), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("tin foil"), F.lit(""), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("every")).otherwise("0")).alias("want"),
    )
    return claims.verify(asked, known).select("case", "error")


@query("""WITH p AS (SELECT item_id, string_agg(w, ' ' ORDER BY i) AS phrase FROM (SELECT item_id, unnest(l[:3]) AS w, generate_subscripts(l[:3], 1) AS i FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS l FROM benchmark)) GROUP BY item_id),
q AS (SELECT DISTINCT phrase FROM p WHERE phrase <> ''), d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS pad FROM documents)
SELECT phrase, count(doc_id) AS n FROM q LEFT JOIN d ON contains(pad, ' ' || phrase || ' ') GROUP BY phrase""")
def phrase_presence(t):
    """In how many documents the first three words of each benchmark passage stand together."""
    words = F.slice(F.split(sn.norm(F.col("text")), " "), 1, 3)
    phrases = t("benchmark").select(F.array_join(words, " ").alias("phrase")).where("phrase <> ''")
    return claims.appears(phrases, t("documents").select(F.col("doc_id").alias("id"), "text"))


@query("""WITH k AS (SELECT l_orderkey AS o, l_orderkey // 2 AS id, count(*) AS n, list(l_linenumber) AS ls, list(l_returnflag) AS fs, bool_or(l_linestatus = 'F') AS proven FROM lineitem GROUP BY l_orderkey)
SELECT id AS "case", 'error' AS level, 'id used twice' AS problem FROM (SELECT id FROM k GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT id, 'error', 'no checks' FROM k WHERE n > 5
UNION ALL SELECT id, 'error', 'unknown detector d' || l FROM (SELECT id, unnest(ls) AS l FROM k WHERE n <= 5) WHERE l > 2
UNION ALL SELECT id, 'warning', 'no claims' FROM k WHERE NOT proven
UNION ALL SELECT id, 'warning', 'in no record: ' || f FROM (SELECT id, unnest(fs) AS f FROM k WHERE n <= 5) WHERE f = 'R'""")
def suite_problems(t):
    """Problems of a suite of cases made of orders, whose lines are checks."""
    line = t("lineitem")
    check = F.struct(F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("detector"), F.array("l_returnflag").alias("expected"))
    per = line.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.collect_list(check).alias("all"), F.count_if(F.col("l_linestatus") == "F").alias("n_claims"))
    cases = per.select(F.floor(F.col("l_orderkey") / 2).alias("case"), F.when(F.col("n") <= 5, F.col("all")).otherwise(F.array().cast("array<struct<detector:string,expected:array<string>>>")).alias("checks"), "n_claims")
    present = t("lineitem").select(F.col("l_returnflag").alias("phrase")).distinct().withColumn("n", F.when(F.col("phrase") == "R", 0).otherwise(1))
    return claims.validate(cases, {"d1", "d2"}, present)
