"""Queries of partner records: parts, suppliers and documents stand for partners, texts and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import partners
from quern.plans.declare import hashed, query

_RULES = {"thing": (r"\bthe\b",), "joined": ("and", "und"), "danish": (r"\bde[nt]\b", r"\bder\b"), "mark": (r"[!?]",), "digit": ("[0-9]",), "long": ("[a-z]{12}",), "line": (r"\n",)}


@query("""WITH h AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'thing' END, CASE WHEN regexp_matches(text, '(?i)and|und') THEN 'joined' END, CASE WHEN regexp_matches(text, '(?i)\\bde[nt]\\b|\\bder\\b') THEN 'danish' END,
CASE WHEN regexp_matches(text, '[!?]') THEN 'mark' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digit' END, CASE WHEN regexp_matches(text, '(?i)[a-z]{12}') THEN 'long' END, CASE WHEN contains(text, chr(10)) THEN 'line' END], lambda x: x IS NOT NULL)[:6] AS tags FROM documents)
SELECT doc_id, array_to_string(tags, ',') AS tags FROM h""".replace("\\\\b", "\\b"))
def phrase_tags(t):
    """The first six labels whose patterns each text holds."""
    return t("documents").select("doc_id", F.array_join(F.coalesce(partners.tags(F.col("text"), _RULES), F.array().cast("array<string>")), ",").alias("tags"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 10 >= 0.8::DOUBLE THEN 'high' WHEN l_discount * 10 >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM lineitem""")
def confidence_levels(t):
    """Numeric confidences as levels."""
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", partners.confidence(F.col("l_discount") * 10).alias("confidence"))


@query("""WITH p AS (SELECT p_partkey, p_name AS name, replace(p_name, ' ', '-') AS slug, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN ' ' END AS text, CASE WHEN p_partkey % 6 = 0 THEN 'traced' END AS method FROM part),
f AS (SELECT p_partkey, name, coalesce(nullif(trim(text), ''), CASE WHEN name LIKE 'cold %' THEN 'cold thing' WHEN slug LIKE '%-bolt' THEN 'a bolt' END) AS text, CASE WHEN nullif(trim(text), '') IS NULL AND (name LIKE 'cold %' OR slug LIKE '%-bolt') THEN 'curated' ELSE method END AS m FROM p)
SELECT p_partkey, text, CASE WHEN text IS NOT NULL THEN coalesce(m, CASE WHEN contains(name, 'gear') OR contains(name, 'small') THEN 'curated' ELSE 'fetched' END) END AS method, CASE WHEN text IS NOT NULL AND m IS NOT NULL THEN text END AS traced FROM f""")
def curated_fill(t):
    """Descriptions filled from a curated table by name or slug, methods backfilled, and the traced ones alone."""
    k = F.col("p_partkey")
    part = t("part").select("p_partkey", F.col("p_name").alias("name"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, " ").alias("text"), F.when(k % 6 == 0, "traced").alias("method"))
    names = part.select("name", "slug").distinct()
    cold = names.where("name like 'cold %'").select(F.col("name").alias("key"), F.lit("cold thing").alias("text"))
    bolt = names.where("slug like '%-bolt'").select(F.col("slug").alias("key"), F.lit("a bolt").alias("text"))
    out = partners.curated(part, cold.unionByName(bolt))
    known = partners.backfilled(F.col("name"), F.col("text"), F.col("method"), ("gear", "small"))
    return out.select("p_partkey", "text", known.alias("method"), partners.traced(F.col("text"), F.col("method")).alias("traced"))


_TAIL = "CASE doc_id % 5 WHEN 0 THEN ' Visit booth # 7, read more' WHEN 1 THEN ' Click here' WHEN 2 THEN ' stall no. 3' ELSE '' END"


@query(f"""WITH d AS (SELECT doc_id, source, text || {_TAIL} AS x FROM documents), r AS (SELECT *, CASE WHEN regexp_matches(x, '(?i)\\bbooth\\s*(no\\.?|number|#)|\\bstall\\s*(no\\.?|number|#)') THEN 'booth/stall location' WHEN regexp_matches(x, '(?i)\\bread more\\b|\\bbook a meeting\\b|\\bclick here\\b') THEN 'scrape artifact' END AS reason FROM d)
SELECT source AS kind, count(*) AS records, sum(1 + doc_id % 2)::BIGINT AS chunks, count(*) FILTER (trim(coalesce(x, '')) = '') AS poor, count(*) FILTER (doc_id % 2 = 1) AS split, count(reason) AS rejected, count(*) FILTER (reason LIKE 'booth%') AS located,
array_to_string(list_sort(list(doc_id) FILTER (reason IS NOT NULL))[:8], ',') AS examples FROM r GROUP BY source""")
def chunk_report(t):
    """Records, chunks and rejected texts of each source, with the first rejected ids."""
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, " Visit booth # 7, read more").when(k == 1, " Click here").when(k == 2, " stall no. 3").otherwise("")
    docs = t("documents").select(F.col("source").alias("kind"), F.col("doc_id").alias("id"), (1 + F.col("doc_id") % 2).alias("n_chunks"), F.concat("text", tail).alias("text"))
    docs = docs.withColumn("reject", partners.reject_reason(F.col("text")))
    located = docs.groupBy("kind").agg(F.count_if(F.startswith("reject", F.lit("booth"))).alias("located"))
    return partners.chunk_stats(docs).join(located, "kind").withColumn("examples", F.array_join("examples", ","))


@query("""SELECT p_partkey, p_partkey % 4 = 0 OR p_partkey % 4 = 1 OR p_name = 'cold widget' AS artifact FROM part""")
def artifacts(t):
    """Placeholders that are no organisation."""
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, " Logo ").when(k == 1, " LOGOS").when(k == 2, " logo co").otherwise(""))
    plain = F.col("p_name") == "cold widget"
    slug = F.when(plain, "Cold-Widget").otherwise("x")
    return t("part").select("p_partkey", partners.is_artifact(name, slug, (), ("cold-widget",)).alias("artifact"))


@query(r"""WITH l AS (SELECT page_id, trim(regexp_replace(regexp_replace(unnest(string_split(replace(replace(replace(html, '<', chr(10) || '<'), '>', '>' || chr(10)), chr(13), chr(10)), chr(10))), '[#*_>`\[\]()!]', ' ', 'g'), '[ \t-\r]+', ' ', 'g')) AS s,
generate_subscripts(string_split(replace(replace(replace(html, '<', chr(10) || '<'), '>', '>' || chr(10)), chr(13), chr(10)), chr(10)), 1) AS i FROM pages),
g AS (SELECT page_id, min_by(s, i) AS line FROM l WHERE length(s) BETWEEN 45 AND 400 AND NOT regexp_matches(lower(s), 'cookie|javascript|sign in|log in|privacy policy|terms of|all rights reserved|skip to|menu|search|@|http') AND regexp_matches(lower(s), '[a-z]{4}\s+[a-z]{3}') GROUP BY page_id)
SELECT p.page_id, md5(line) AS line FROM pages p LEFT JOIN g USING (page_id)""")
def good_lines(t):
    """The first line of each page that reads as prose, every tag on a line of its own."""
    lines = F.replace(F.replace(F.col("html"), F.lit("<"), F.lit("\n<")), F.lit(">"), F.lit(">\n"))
    return t("pages").select("page_id", F.md5(partners.first_good_line(lines)).alias("line"))


@query(r"""WITH h AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN upper(regexp_replace(url, '^https?://', '')) WHEN 1 THEN ' ' || url WHEN 2 THEN 'no host' ELSE '/' || regexp_replace(url, '^https?://', '') END AS u FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE regexp_replace(lower(regexp_extract(CASE WHEN page_id % 4 = 0 THEN 'https://' || u ELSE trim(u) END, '(?i)^https?://([^/?#]+)', 1)), '^www\.', '') END AS host FROM h""")
def url_hosts(t):
    """Hosts of URLs in several spellings; null where there is none."""
    k, bare = F.col("page_id") % 4, F.regexp_replace("url", "^https?://", "")
    u = F.when(k == 0, F.upper(bare)).when(k == 1, F.concat(F.lit(" "), "url")).when(k == 2, "no host").otherwise(F.concat(F.lit("/"), bare))
    return t("pages").select("page_id", partners.host(u).alias("host"))


_TITLE = r"trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '[ \t-\r]+', ' ', 'g'))"


@query(rf"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)), '^www\.', '') AS host, {_TITLE} AS title, trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '[ \t-\r]+', ' ', 'g')) AS h1 FROM pages),
f AS (SELECT host, min_by(CASE WHEN length(title) >= 25 THEN title ELSE h1 END[:400], page_id) AS found FROM h WHERE host <> '' AND (length(title) >= 25 OR length(h1) >= 25) GROUP BY host), hs AS (SELECT ('0x' || md5(host)[:6])::BIGINT % 40 AS n, min(host) AS host FROM h WHERE host <> '' GROUP BY 1)
SELECT s_suppkey, found FROM supplier LEFT JOIN hs ON n = s_suppkey % 40 LEFT JOIN f ON f.host = hs.host""")
def crawl_enrich(t):
    """Suppliers with the description that the first page of their host gives."""
    part = lambda p: F.regexp_extract("html", p, 1)
    pages = t("pages").select(F.col("page_id").alias("ord"), "url", F.array(part("<title[^>]*>([^<]*)</title>"), part("<h1>([^<]*)</h1>")).alias("texts"))
    hosts = pages.select(partners.host(F.col("url")).alias("h")).where("h is not null")
    hosts = hosts.groupBy((F.conv(F.substring(F.md5("h"), 1, 6), 16, 10).cast("long") % 40).alias("n")).agg(F.min("h").alias("h"))  # the first host of each of 40 hashes
    sites = t("supplier").select("s_suppkey", (F.col("s_suppkey") % 40).alias("n")).join(hosts, "n", "left").withColumn("website", F.concat(F.lit("www."), "h", F.lit("/x")))
    return partners.enriched(sites, pages).select("s_suppkey", "found")


_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_THEIRS = "p_name || ['', ' Pvt. Ltd', ', Co', ' (The)', ' Blue'][(p_partkey % 5 + 1)::INT]"
_BARE = f"trim(regexp_replace(regexp_replace({_PLAIN.format(_THEIRS)}, '\\b(pvt|ltd|co|the)\\b', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH n AS (SELECT DISTINCT {_THEIRS} AS name, {_PLAIN.format(_THEIRS)} AS k, {_BARE} AS loose FROM part), o AS (SELECT DISTINCT upper(p_name) AS name, p_name AS k FROM part WHERE p_size % 2 = 0)
SELECT n.name, o.name AS ours, CASE WHEN o.name IS NULL THEN NULL ELSE 'one name is a prefix/superset of the other' END AS reason FROM n LEFT JOIN o ON o.k = n.loose WHERE n.k NOT IN (SELECT k FROM o)""")
def near_duplicate_names(t):
    """Decorated names that no plain name equals, with the plain name that a looser key finds."""
    ends = F.array(*map(F.lit, ["", " Pvt. Ltd", ", Co", " (The)", " Blue"]))
    theirs = t("part").select(F.concat("p_name", F.element_at(ends, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("name")).distinct()
    found = partners.near_duplicates(theirs, t("part").where("p_size % 2 = 0").select(F.upper("p_name").alias("name")))
    return found.select("name", "ours", F.when(F.col("ours").isNotNull(), partners.duplicate_reason(F.col("name"), F.col("ours"))).alias("reason"))


@query("""WITH a AS (SELECT min(p_partkey) AS ord, p_name AS alias, 'Group ' || split_part(p_name, ' ', 1) AS canonical FROM part WHERE p_size < 10 GROUP BY p_name),
n AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || ' Ltd' END AS name, p_name AS base FROM part)
SELECT n.name, coalesce(min_by(canonical, ord), n.name) AS canonical FROM n LEFT JOIN a ON a.alias = n.base GROUP BY n.name, n.base""")
def canonical_names(t):
    """Canonical names of variants: by the alias itself, else by a shared company key."""
    few = t("part").where("p_size < 10").groupBy(F.col("p_name").alias("alias")).agg(F.min("p_partkey").alias("ord"))
    aliases = few.withColumn("canonical", F.concat(F.lit("Group "), F.split_part("alias", F.lit(" "), F.lit(1))))
    names = t("part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" Ltd"))).alias("name"))
    return partners.canonical(names, aliases)


_DECIDE = """d AS (SELECT 'part ' || p_partkey AS name, p_brand AS sector, CASE WHEN p_size > 25 THEN 'high' ELSE 'medium' END AS confidence, ['tier', 'text', 'uses'][(p_partkey % 3 + 1)::INT] AS basis FROM part WHERE p_partkey % 4 < 2 UNION ALL SELECT 'ghost', 'Brand#13', 'low', 'tier'),
p AS (SELECT 'part ' || p_partkey AS name, p_type AS tier, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS text, CASE WHEN p_partkey % 2 = 0 THEN ['use ' || p_size] ELSE [] END AS uses FROM part),
s AS (SELECT 'part ' || p_partkey AS name, 'too vague' AS note FROM part WHERE p_partkey % 8 = 1 OR p_partkey % 8 = 2)"""


def _decisions(t):
    k = F.col("p_partkey")
    name = F.concat(F.lit("part "), k.cast("string"))
    basis = F.element_at(F.array(*map(F.lit, ["tier", "text", "uses"])), (k % 3 + 1).cast("int"))
    part = t("part")
    spark = part.sparkSession
    d = part.where("p_partkey % 4 < 2").select(name.alias("name"), F.col("p_brand").alias("sector"), F.when(F.col("p_size") > 25, "high").otherwise("medium").alias("confidence"), basis.alias("basis"))
    d = d.unionByName(spark.createDataFrame([("ghost", "Brand#13", "low", "tier")], d.schema))
    uses = F.when(k % 2 == 0, F.array(F.concat(F.lit("use "), F.col("p_size").cast("string")))).otherwise(F.array().cast("array<string>"))
    p = part.select(name.alias("name"), F.col("p_type").alias("tier"), F.when(k % 5 != 0, F.col("p_name")).alias("text"), uses.alias("uses"))
    s = part.where("p_partkey % 8 in (1, 2)").select(name.alias("name"), F.lit("too vague").alias("note"))
    return p, d, s


_OUT = f"""WITH {_DECIDE}, o AS (SELECT p.name, coalesce(sector, 'Unknown') AS sector, coalesce(confidence, 'low') AS confidence, CASE WHEN sector IS NOT NULL THEN 'decided' WHEN note IS NOT NULL THEN 'no-usable-evidence' ELSE 'no-evidence' END AS outcome,
CASE WHEN sector IS NULL THEN CASE WHEN note IS NOT NULL THEN 'no-usable-evidence' ELSE 'no-evidence' END WHEN basis = 'text' AND len(uses) > 0 THEN 'text+uses' ELSE basis END AS method,
CASE WHEN sector IS NULL THEN CASE WHEN note IS NOT NULL THEN coalesce(text, '') END WHEN basis = 'tier' THEN 'tier: ' || tier WHEN basis = 'uses' THEN 'uses: [' || CASE WHEN len(uses) > 0 THEN '"' || uses[1] || '"' ELSE '' END || ']'
 WHEN len(uses) > 0 THEN coalesce(text, '') || '  ||  uses: ["' || uses[1] || '"]' ELSE coalesce(text, '') END AS evidence FROM p LEFT JOIN d USING (name) LEFT JOIN s USING (name))"""


@query(f"{_OUT} SELECT name, sector, confidence, outcome, method, evidence FROM o")
def sector_decisions(t):
    """Sectors of partners by a table of decisions, with method and evidence."""
    return partners.decided(*_decisions(t)).drop("note")


@query(f"""{_OUT} SELECT 'method' AS dimension, method AS value, count(*) AS n FROM o WHERE outcome = 'decided' GROUP BY method UNION ALL SELECT 'confidence', confidence, count(*) FROM o WHERE outcome = 'decided' GROUP BY confidence
UNION ALL SELECT 'sector', sector, count(*) FROM o GROUP BY sector UNION ALL SELECT 'unknown', method, count(*) FROM o WHERE outcome <> 'decided' GROUP BY method""")
def sector_coverage(t):
    """How many partners are decided by what, in which sectors, and why others are not."""
    return partners.sector_coverage(partners.decided(*_decisions(t)))


@query(f"""WITH {_DECIDE} SELECT name, 'no such partner' AS problem FROM d WHERE name NOT IN (SELECT name FROM p) UNION ALL SELECT name, 'no such sector' FROM d WHERE sector NOT IN (SELECT p_brand FROM part WHERE p_size <= 40)
UNION ALL SELECT name, 'claims evidence that is missing' FROM d JOIN p USING (name) WHERE (basis = 'text' AND text IS NULL) OR (basis = 'uses' AND len(uses) = 0) OR (basis = 'tier' AND tier IS NULL)
UNION ALL SELECT name, 'both decided and silent' FROM s WHERE name IN (SELECT name FROM d)""")
def decision_problems(t):
    """Decisions that don't agree with the partners, the taxonomy or each other."""
    return partners.decision_problems(*_decisions(t), t("part").where("p_size <= 40").select(F.col("p_brand").alias("sector")).distinct())


@query(f"WITH {_DECIDE} SELECT name FROM p WHERE (text IS NOT NULL OR len(uses) > 0) AND name NOT IN (SELECT name FROM d) AND name NOT IN (SELECT name FROM s)")
def pending_decisions(t):
    """Partners with evidence that nobody has judged."""
    return partners.pending(*_decisions(t)).select("name")


@query("""SELECT count(*) AS total, count(*) FILTER (p_partkey % 3 <> 0) AS with_text, count(*) FILTER (p_size > 10) AS with_uses, count(DISTINCT p_brand) AS sectors, (SELECT count(*) FROM orders) AS sessions, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS closed FROM part""")
def corpus_coverage(t):
    """Filled fields of partners and closed sessions, in one row."""
    k = F.col("p_partkey")
    text = F.when(k % 3 != 0, F.col("p_name")).otherwise(" ")
    uses = F.when(F.col("p_size") > 10, F.array("p_type"))
    part = t("part").agg(F.count("*").alias("total"), *partners.filled({"with_text": F.btrim(text) != "", "with_uses": F.size(uses) > 0}), F.countDistinct("p_brand").alias("sectors"))
    held = t("orders").agg(F.count("*").alias("sessions"), *partners.filled({"closed": F.col("o_orderkey") % 5 == 0}))
    return part.crossJoin(held)  # one row each


@query("""WITH d AS (SELECT event_id, user_id, event_type FROM events) SELECT field, type, count(*) AS n FROM (SELECT 'k' AS field, 'number' AS type FROM d UNION ALL SELECT 'who', CASE WHEN user_id % 3 = 0 THEN 'null' WHEN user_id % 3 = 1 THEN 'string' ELSE 'array' END FROM d UNION ALL SELECT 'ok', 'boolean' FROM d WHERE event_id % 2 = 0 UNION ALL SELECT 'in', 'object' FROM d WHERE event_id % 5 = 0) GROUP BY field, type""")
def field_types(t):
    """Which fields JSON objects have, and of what types."""
    u, e = F.col("user_id") % 3, F.col("event_id")
    who = F.when(u == 0, "null").when(u == 1, F.concat(F.lit('"u'), F.col("user_id").cast("string"), F.lit('"'))).otherwise("[1]")
    body = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "who": '), who, F.when(e % 2 == 0, ', "ok": true').otherwise(""), F.when(e % 5 == 0, ', "in": {"a": 1}').otherwise(""), F.lit("}"))
    return partners.field_types(t("events").select(body.alias("doc")), "doc")


@query("""SELECT p_name AS name, max_by(p_partkey, p_partkey) AS last, min_by(p_partkey, p_partkey) AS first FROM part GROUP BY p_name""")
def name_ids(t):
    """Ids by name, the last and the first written."""
    rows = t("part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return partners.name_ids(rows).withColumnRenamed("id", "last").join(partners.name_ids(rows, False).withColumnRenamed("id", "first"), "name")


@query("""WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' relic' END AS name FROM part), n AS (SELECT DISTINCT p_name AS name FROM part)
SELECT name, EXISTS (SELECT 1 FROM n WHERE contains(' ' || n.name || ' ', ' ' || a.name || ' ')) AS mentioned FROM a WHERE name NOT IN (SELECT name FROM n)""")
def only_in_archive(t):
    """Archived names that no current record has, and whether a current text still mentions them."""
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    archive = t("part").select(F.concat(first, F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" relic")).alias("name"))
    return partners.only_in(archive, t("part").select(F.col("p_name").alias("name"), F.lit(None).cast("string").alias("text")))


@query("""SELECT field, count(*) AS n, sum(('0x' || md5(v)[:12])::BIGINT)::BIGINT AS vals FROM (SELECT DISTINCT 'brand' AS field, p_brand AS v FROM part UNION SELECT DISTINCT 'type', p_type FROM part) GROUP BY field""")
def distinct_values(t):
    """Distinct values of two fields, by a sum of their hashes."""
    cells = t("part").select(F.inline(F.array(F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("v")), F.struct(F.lit("type").alias("field"), F.col("p_type").alias("v"))))).distinct()
    return cells.groupBy("field").agg(F.count("*").alias("n"), hashed("v").alias("vals"))
