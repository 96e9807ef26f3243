"""Queries of schemaless documents, merges by provenance, collated orders, fallback plans, and pages of typed results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import documents, lexical, planning, retrieval, snapshot
from quern.plans.declare import query
from quern.plans.schedule import _greedy
from quern.plans.search import _FIELDS, _INDEX, _asked, _docs
from quern.plans.text import _fold, _possessive, _q, _stem
from quern.storage import dealt

_SPEC = {
    "kind": {"$in": ["view", "click", "purchase"]}, "k": {"$type": "number", "$ne": 3, "$lt": 90}, "consent": True, "id": {"$nin": [1, 2, 3]}, "gone": None,
    "$or": [{"note": {"$exists": False}}, {"note": {"$regex": "^a"}}, {"tags": "view"}],
}


def _event_documents(t):
    """Events as documents whose shape differs from one to the next."""
    i, s = F.col("event_id"), lambda x: F.lit(x)
    k = F.get_json_object("props", "$.k")
    parts = [
        F.concat(s('{"id":'), i.cast("string"), s(',"kind":"'), "event_type", s('","at":'), F.unix_timestamp("ts").cast("string")),
        F.when(i % 6 == 0, F.concat(s(',"k":"'), k, s('"'))).otherwise(F.concat(s(',"k":'), k)),
        F.when(i % 4 == 0, "").when(i % 4 == 2, ',"consent":false').otherwise(',"consent":true'),
        F.when(i % 5 == 0, "").when(i % 5 == 1, ',"note":null').when(i % 5 == 2, ',"note":"abc"').otherwise(',"note":"xyz"'),
        F.when(i % 3 == 0, F.concat(s(',"tags":["'), "event_type", s('","x"]'))).when(i % 3 == 1, F.concat(s(',"tags":"'), "event_type", s('"'))).otherwise(',"tags":7'),
        s("}"),
    ]
    return t("events").select(F.parse_json(F.concat(*parts)).alias("doc"))


@query("""WITH e AS (SELECT event_id AS i, event_type AS kind, (props->>'$.k')::BIGINT AS k, floor(epoch(ts))::BIGINT AS s FROM events)
SELECT i AS id, kind, k::DOUBLE AS k FROM e WHERE kind IN ('view', 'click', 'purchase') AND i % 6 <> 0 AND k <> 3 AND k < 90 AND i % 2 = 1 AND i NOT IN (1, 2, 3) AND (i % 5 = 0 OR i % 5 = 2 OR (i % 3 IN (0, 1) AND kind = 'view'))
ORDER BY s DESC, id LIMIT 200""")
def document_find(t):
    """The two hundred latest documents that a filter document matches (a latest-first report), as three fields of them."""
    return documents.find(_event_documents(t), "doc", _SPEC, {"id": "long", "kind": "string", "k": "double"}, latest="at", limit=200)


_TITLE = r"nullif(trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '[ \t-\r]+', ' ', 'g')), '')"


@query(f"""WITH p AS (SELECT page_id, {_TITLE} AS t FROM pages) SELECT page_id, CASE WHEN page_id % 8 IN (5, 6) THEN NULL ELSE t END AS found, CASE WHEN t IS NULL OR page_id % 8 IN (5, 6) THEN NULL WHEN page_id % 8 = 0 THEN 'meta-description' ELSE 'json-ld' END AS variant FROM p""")
def jsonld_description(t):
    """The descriptions of pages whose metadata and linked data have eight shapes, some of wrong types."""
    title = F.btrim(F.regexp_replace(F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1), r"[ \t-\r]+", " "))
    k, text = F.col("page_id") % 8, F.to_json(F.struct(F.col("t").alias("description")))
    doc = lambda ld: F.concat(F.lit('{"metadata":{"description":""},"jsonLd":'), ld, F.lit("}"))
    wrap = lambda a, b: F.concat(F.lit(a), text, F.lit(b))
    shape = (
        F.when(k == 0, F.concat(F.lit('{"metadata":'), text, F.lit("}"))).when(k == 1, doc(text)).when(k == 2, doc(wrap('{"description":7,"sourceOrganization":', "}"))).when(k == 3, doc(wrap('{"@graph":[{"@type":"A"},', ',{"description":"later"}]}')))
        .when(k == 4, doc(wrap('{"@graph":[3,{"description":["no"],"@graph":[', "]}]}"))).when(k == 5, doc(F.lit('[1,"x"]'))).when(k == 6, doc(wrap('{"@graph":', "}"))).otherwise(doc(wrap('{"@graph":[{"@graph":[', ']},{"description":"later"}]}')))
    )
    return documents.described(t("pages").select("page_id", title.alias("t")).select(F.col("page_id").alias("key"), F.parse_json(shape).alias("doc"))).withColumnRenamed("key", "page_id")


_SOURCED = """r AS (SELECT p_brand || '/' || p_size AS entity, p_partkey AS id, p_partkey % 3 = 0 AS theirs, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END || ' co' AS name, CASE WHEN p_partkey % 5 <> 0 THEN 'text ' || p_partkey END AS text,
 CASE WHEN p_partkey % 4 = 0 THEN [] ELSE [p_type] END AS uses, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS tier, CASE WHEN p_partkey % 7 = 0 THEN 'w' || p_partkey END AS website FROM part),
tr AS (SELECT lower(p_name) || ' co' AS key, any_value(p_name) || ' Co' AS name, CASE WHEN min(p_partkey) % 2 = 0 THEN 'traced ' || any_value(p_name) END AS text, CASE WHEN min(p_partkey) % 3 = 0 THEN ['traced use'] ELSE [] END AS uses, CASE WHEN min(p_partkey) % 4 = 0 THEN 'high' END AS confidence, 'www.' || min(p_partkey) AS website FROM part WHERE p_partkey % 10 < 3 GROUP BY p_name),
g AS (SELECT entity, min(id) FILTER (NOT theirs) AS o, min(id) FILTER (theirs) AS t FROM r GROUP BY entity),
j AS (SELECT g.entity, CASE WHEN o IS NOT NULL AND t IS NOT NULL THEN 'merged' WHEN t IS NOT NULL THEN 'upgraded' ELSE 'untouched' END AS status, b.id AS id, b.name AS bname, b.text AS btext, b.uses AS buses, b.tier AS btier, b.website AS bsite, x.id AS xid, x.name AS xname, x.tier AS xtier, x.website AS xsite,
 CASE WHEN t IS NOT NULL THEN coalesce(x.text, CASE WHEN x.id IS NULL THEN b.text END) END AS utext, CASE WHEN t IS NOT NULL THEN coalesce(x.uses, CASE WHEN x.id IS NULL THEN b.uses END) END AS uuses, s.name AS sname, s.text AS stext, s.uses AS suses, s.confidence, s.website AS ssite
 FROM g JOIN r b ON b.id = coalesce(o, t) LEFT JOIN r x ON x.id = t AND o IS NOT NULL LEFT JOIN tr s ON s.key = lower(b.name) AND t IS NOT NULL)"""


@query(f"""WITH {_SOURCED} SELECT entity, status, id, coalesce(sname, bname) AS name, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN xname <> bname THEN xname END, CASE WHEN sname <> bname THEN bname END], lambda a: a IS NOT NULL))), '|') AS aliases,
coalesce(stext, utext, btext) AS text, CASE WHEN status = 'untouched' THEN NULL WHEN stext IS NOT NULL THEN 'traced' WHEN coalesce(utext, btext) IS NOT NULL THEN 'unsourced' END AS text_method, CASE WHEN status = 'untouched' THEN NULL WHEN stext IS NOT NULL THEN coalesce(confidence, 'medium') WHEN coalesce(utext, btext) IS NOT NULL THEN 'low' END AS confidence,
array_to_string(CASE WHEN len(suses) > 0 THEN suses WHEN len(uuses) > 0 THEN uuses ELSE buses END, '|') AS uses, CASE WHEN len(suses) > 0 THEN 'traced' WHEN len(uuses) > 0 THEN 'unsourced' END AS uses_method,
CASE WHEN utext IS NOT NULL OR len(uuses) > 0 THEN coalesce(utext, '') || ':' || array_to_string(coalesce(uuses, []), '|') END AS unsourced, coalesce(btier, xtier) AS tier, coalesce(bsite, xsite, ssite) AS website, xid AS deleted FROM j""")
def sourced_merge(t):
    """Records of two writers merged by entity: traced text wins, the other's is kept apart as unsourced, blanks are filled, one of two goes."""
    k = F.col("p_partkey")
    theirs = k % 3 == 0
    none = F.array().cast("array<string>")
    records = t("part").select(
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("entity"), k.alias("id"), theirs.alias("theirs"), F.concat(F.when(theirs, F.upper("p_name")).otherwise(F.col("p_name")), F.lit(" co")).alias("name"),
        F.when(k % 5 != 0, F.concat(F.lit("text "), k.cast("string"))).alias("text"), F.when(k % 4 == 0, none).otherwise(F.array("p_type")).alias("uses"), F.when(k % 2 == 0, F.col("p_type")).otherwise(" ").alias("tier"), F.when(k % 7 == 0, F.concat(F.lit("w"), k.cast("string"))).alias("website"),
    )
    by_name = t("part").where("p_partkey % 10 < 3").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    m = F.col("k")
    traced = by_name.select(
        F.concat("p_name", F.lit(" Co")).alias("name"), F.when(m % 2 == 0, F.concat(F.lit("traced "), "p_name")).alias("text"), F.when(m % 3 == 0, F.array(F.lit("traced use"))).otherwise(none).alias("uses"), F.when(m % 4 == 0, "high").alias("confidence"), F.concat(F.lit("www."), m.cast("string")).alias("website")
    )
    out = snapshot.sourced(records, traced)
    joined = lambda c: F.array_join(c, "|")
    kept = F.when(F.col("unsourced").isNotNull(), F.concat(F.coalesce("unsourced.text", F.lit("")), F.lit(":"), joined("unsourced.uses")))
    return out.select("entity", "status", "id", "name", joined("aliases").alias("aliases"), "text", "text_method", "confidence", joined("uses").alias("uses"), "uses_method", kept.alias("unsourced"), "tier", "website", "deleted")


_SPELT = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, 'e', 'é') ELSE p_name || '-' || p_brand END"


@query(f"""WITH x AS (SELECT p_partkey, p_size, {_SPELT} AS name FROM part) SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY name COLLATE en, name, p_partkey) AS place, row_number() OVER (PARTITION BY p_size ORDER BY lower(strip_accents(name)) COLLATE en, p_partkey) AS folded FROM x""")
def collated_orders(t):
    """The places of names in the order of a language's rules, and in the same without case and accents; ties by code point and key."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.upper("p_name")).when(k % 4 == 2, F.replace("p_name", F.lit("e"), F.lit("é"))).otherwise(F.concat_ws("-", "p_name", "p_brand"))
    rows = t("part").select("p_partkey", "p_size", name.alias("name"))
    place = lambda *order: F.row_number().over(Window.partitionBy("p_size").orderBy(*order))
    return rows.select("p_partkey", place(F.collate("name", "UNICODE"), "name", "p_partkey").alias("place"), place(F.collate("name", "UNICODE_CI_AI"), "p_partkey").alias("folded"))


_RECORD = "p_partkey % 10 <> 9"
_TIMES = "p_size % 3 AS day, p_partkey % 600 AS s, p_partkey % 600 + 30 AS e"


@query(f"""WITH RECURSIVE l AS (SELECT o_custkey AS person, l_partkey AS id, l_suppkey, o_orderkey * 10 + l_linenumber AS nth FROM orders JOIN lineitem ON o_orderkey = l_orderkey), known AS (SELECT DISTINCT person, id FROM l WHERE l_suppkey % 4 = 0),
k AS (SELECT person, id, min(nth) AS nth FROM l ANTI JOIN known USING (person, id) GROUP BY person, id), v AS (SELECT k.*, p_size, p_partkey FROM k JOIN part ON p_partkey = id WHERE {_RECORD}),
{_greedy(f"SELECT person AS user_id, {_TIMES}, nth, id FROM v WHERE id % 2 = 0", f"SELECT person AS user_id, {_TIMES}, id AS nth, id FROM known JOIN part ON p_partkey = id WHERE id % 2 = 0 AND {_RECORD}")}
SELECT user_id AS person, id, kept, clash FROM g WHERE i > 0 UNION ALL SELECT person, id, true, NULL FROM v WHERE id % 2 = 1""")
def fallback_plan(t):
    """What a plan takes over from matched items without a model: not what it has, only known records, and nothing that clashes."""
    rows = t("lineitem").count()
    lines = dealt(t("orders").select("o_orderkey", "o_custkey"), rows, "o_orderkey").join(dealt(t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), rows, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("person"), F.col("l_partkey").alias("id"), "l_suppkey", (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("nth"))
    k = F.col("p_partkey")
    timed = lambda x: F.when(k % 2 == 0, x.cast("long"))
    records = t("part").where(_RECORD).select(k.alias("id"), timed(F.col("p_size") % 3).alias("day"), timed(k % 600).alias("s"), timed(k % 600 + 30).alias("e"))
    return planning.fallback(lines.select("person", "id", "nth"), lines.where("l_suppkey % 4 = 0").select("person", "id"), records, rows)


@query(f"""WITH open_docs AS (SELECT * FROM documents WHERE NOT (doc_id % 3 = 1 AND doc_id % 7 = 0)), {_INDEX.replace('FROM documents', 'FROM open_docs')},
x AS (SELECT qid, id, ['partner', 'session', 'speaker'][(id % 3 + 1)::INT] AS kind, round(bm25, 6) AS bm25 FROM sc), r AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY bm25 DESC, id) AS rank FROM x)
SELECT qid, kind, id, bm25, rank - 3 AS place FROM r WHERE rank BETWEEN 4 AND 6""")
def surfaces(t):
    """For every benchmark passage the second page of three documents of each kind, closed sessions left out before anything is weighed."""
    kind = F.element_at(F.array(*map(F.lit, ["partner", "session", "speaker"])), (F.col("id") % 3 + 1).cast("int"))
    docs = _docs(t).withColumn("kind", kind).where(~((F.col("kind") == "session") & (F.col("id") % 7 == 0)))
    found = lexical.search(retrieval.questions(_asked(t)), lexical.index(docs, _FIELDS), 6, docs.select("id", "kind"))
    nth = F.row_number().over(Window.partitionBy("qid", "kind").orderBy(F.desc("bm25"), "id"))
    ranked = found.withColumn("bm25", F.round("bm25", 6)).withColumn("rank", nth).where("rank <= 6")
    seen = ranked.where("rank <= 3").select("qid", "id")
    return retrieval.next_page(ranked, seen, 3, by=["qid", "kind"]).select("qid", "kind", "id", "bm25", F.col("place"))


_ENDS = ["Pvt. Ltd.", "Technologies", "Limited.", "& Co", "Labs", ""]
_COMPANY = f"p_name || ' ' || [{', '.join(map(_q, _ENDS))}][(p_partkey % {len(_ENDS)} + 1)::INT]"
_SUFFIX = "(?: (?:" + tx.COMPANY_SUFFIXES + "))+$"


@query(f"""WITH w AS (SELECT p_partkey, unnest(string_split({_fold(_COMPANY)}, ' ')) AS x, generate_subscripts(string_split({_fold(_COMPANY)}, ' '), 1) AS i FROM part), g AS (SELECT p_partkey, i, regexp_replace({_possessive('x')}, '[^a-z0-9]+', '', 'g') AS b FROM w),
n AS (SELECT p_partkey, string_agg({_stem('b')}, ' ' ORDER BY i) AS name FROM g WHERE b <> '' GROUP BY p_partkey), h AS (SELECT *, regexp_replace(name, {_q(_SUFFIX)}, '') AS head FROM n)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([name, replace(name, ' ', ''), head, replace(head, ' ', '')], lambda a: length(a) >= 2))), '|') AS aliases FROM h""")
def company_alias_names(t):
    """The names by which a company may be asked for."""
    name = F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("p_partkey") % len(_ENDS) + 1).cast("int")))
    return t("part").select("p_partkey", F.array_join(tx.company_aliases(name), "|").alias("aliases"))


@query("""SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) AS hash FROM part""")
def name_hashes(t):
    """The 32-bit hash that seeds a name's index vector."""
    return t("part").select("p_partkey", tx.fnv1a("p_name").alias("hash"))


@query("""SELECT event_id, (hour(ts) * 60 + minute(ts))::INT AS minutes, lpad(((hour(ts) * 60 + minute(ts) + 95) // 60)::VARCHAR, 2, '0') || ':' || lpad(((minute(ts) + 95) % 60)::VARCHAR, 2, '0') AS later FROM events""")
def clock_times(t):
    """Clock texts as minutes, and the clock text of ninety-five minutes on."""
    minutes = tx.to_minutes(F.date_format("ts", "H:mm"))
    return t("events").select("event_id", minutes.alias("minutes"), tx.hhmm(minutes + 95).alias("later"))
