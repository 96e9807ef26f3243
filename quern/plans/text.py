"""Queries of text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.plans.declare import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fold(x: str) -> str:
    plain = f"translate(translate({x}, {_q(tx.CURLY)}, {_q(tx.STRAIGHT)}), {_q(tx.ACCENTED)}, {_q(tx.PLAIN)})"
    return f"trim(regexp_replace(lower(replace({plain}, '&', ' and ')), '[ \\t-\\r]+', ' ', 'g'))"


def _possessive(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '''s$', ''), 's''$', 's'), '''$', '')"


def _stem(t: str) -> str:
    return (
        f"(CASE WHEN length({t}) <= 3 THEN {t} WHEN regexp_matches({t}, '[^aeiou]ies$') THEN {t}[:length({t}) - 3] || 'y' "
        f"WHEN regexp_matches({t}, '(ch|sh|ss|x|z)es$') THEN {t}[:length({t}) - 2] WHEN regexp_matches({t}, '(ss|us|is|as|os)$') THEN {t} "
        f"WHEN {t} LIKE '%s' THEN {t}[:length({t}) - 1] ELSE {t} END)"
    )


_STOP = "(" + ", ".join(_q(w) for w in tx.STOPWORDS) + ")"
_TERMS = f"""
chunks AS (SELECT id, unnest(string_split({_fold('body')}, ' ')) AS chunk FROM src),
bare AS (SELECT id, {_possessive('chunk')} AS b FROM chunks),
parts AS (SELECT id, regexp_replace(b, '[^a-z0-9]+', '', 'g') AS glued, list_filter(regexp_split_to_array(b, '[^a-z0-9]+'), lambda x: x <> '') AS p FROM bare),
terms AS (SELECT id, unnest(CASE WHEN len(p) <= 1 THEN [glued] ELSE list_concat([glued], p) END) AS t FROM parts),
stems AS (SELECT id, t, {_stem('t')} AS s FROM terms WHERE t <> '')
"""


@query(f"""WITH src AS (SELECT doc_id AS id, text AS body FROM documents), {_TERMS}
SELECT s AS term, count(*) AS n, count(DISTINCT id) AS docs FROM stems
WHERE t NOT IN {_STOP} AND s NOT IN {_STOP} AND (length(s) >= 2 OR regexp_matches(s, '^[0-9]$')) GROUP BY s""")
def tokenize_terms(t):
    """Term and document counts of the full tokeniser."""
    terms = tx.term_rows(tx.spread(t("documents").select("doc_id", "text")), "text", "doc_id")
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@query(f"""WITH src AS (SELECT p_partkey AS id, p_name || 's '' ' || p_type || 'es' AS body FROM part), {_TERMS}
SELECT id, list(s ORDER BY s)::VARCHAR AS stems FROM stems GROUP BY id""")
def stem_plural(t):
    """Every stemmed term of a part's name and type, stopwords kept."""
    body = F.concat("p_name", F.lit("s ' "), "p_type", F.lit("es"))
    found = F.array_sort(tx.tokens(body, keep_stopwords=True))
    return t("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("stems"))


_TITLES = ["Dr. ", "Smt. ", "Hon'ble Dr. ", "Prof. Ms. ", ""]
_ENDS = [" Jr.", " PhD", ", Chief Officer, Some Firm", " Árpád  Niño", ""]
_DECORATED = f"[{', '.join(map(_q, _TITLES))}][(c_custkey % 5 + 1)::INT] || replace(c_name, '#', ' ') || [{', '.join(map(_q, _ENDS))}][(c_custkey // 5 % 5 + 1)::INT]"


def _decorated():
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at % 5 + 1).cast("int"))
    return F.concat(pick(_TITLES, F.col("c_custkey")), F.replace("c_name", F.lit("#"), F.lit(" ")), pick(_ENDS, F.floor(F.col("c_custkey") / 5)))


def _person(x: str) -> str:
    plain = f"""trim(regexp_replace(regexp_replace(replace({_fold(f"split_part({x}, ',', 1)")}, '''', ''), '[.,;:()\\[\\]"`]', ' ', 'g'), ' +', ' ', 'g'))"""
    bare = f"trim(regexp_replace({plain}, '^(?:(?:{tx.SALUTATIONS.replace(chr(39), '')})(?: |$))+', ''))"
    return f"regexp_replace({bare}, '(?: (?:{tx.NAME_SUFFIXES}))+$', '')"


@query(f"SELECT c_custkey, {_person(_DECORATED)} AS name_key FROM customer")
def normalise_person(t):
    """Join keys of decorated person names."""
    return t("customer").select("c_custkey", tx.person_key(_decorated()).alias("name_key"))


@query(f"""WITH a AS (SELECT c_custkey, {_DECORATED} AS raw FROM customer), k AS (SELECT raw, {_person('raw')} AS key FROM a),
d AS (SELECT DISTINCT {_person("replace(s_name, 'Supplier', 'Customer')")} AS key, replace(replace(s_name, 'Supplier', 'Customer'), '#', ' ') AS naive FROM supplier),
per AS (SELECT key, bool_or(raw IN (SELECT naive FROM d)) AS naive, key IN (SELECT key FROM d) AS matched FROM k GROUP BY key)
SELECT count(*) AS distinct_names, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched, count(*) FILTER (naive) AS naive_matched FROM per""")
def name_join_report(t):
    """How many distinct names a directory matches by key, and how few by plain equality."""
    people = t("customer").select(_decorated().alias("raw"), tx.person_key(_decorated()).alias("key"))
    named = F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))
    directory = t("supplier").select(tx.person_key(named).alias("key"), F.replace(named, F.lit("#"), F.lit(" ")).alias("naive"))
    keys = directory.select("key").distinct().withColumn("matched", F.lit(True))
    spelled = directory.select(F.col("naive").alias("raw")).distinct().withColumn("naive", F.lit(True))
    per = people.distinct().join(spelled, "raw", "left").groupBy("key").agg(F.bool_or(F.coalesce("naive", F.lit(False))).alias("naive")).join(keys, "key", "left")
    return per.agg(F.count("*").alias("distinct_names"), F.count("matched").alias("matched"), F.count_if(F.col("matched").isNull()).alias("unmatched"), F.count_if("naive").alias("naive_matched"))


_COMPANY = "split_part(p_name, ' ', 1) || ['', ' Pvt. Ltd.', ' (India)', ' Bank & Co', ' Labs'][(p_partkey % 5 + 1)::INT]"


def _company():
    ends = F.array(*map(F.lit, ["", " Pvt. Ltd.", " (India)", " Bank & Co", " Labs"]))
    return F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.element_at(ends, (F.col("p_partkey") % 5 + 1).cast("int")))


_SPACED = f"regexp_replace(replace(regexp_replace(lower({_COMPANY}), '\\([^)]*\\)', ' ', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')"


@query(f"""SELECT p_partkey, array_to_string(list_filter(list_distinct([replace({_SPACED}, ' ', ''), replace(regexp_replace({_SPACED}, {_q(tx.COMPANY_NOISE)}, ' ', 'g'), ' ', '')]).list_sort(), lambda k: k <> ''), ',') AS keys FROM part""")
def company_keys(t):
    """Identity keys of decorated company names."""
    return t("part").select("p_partkey", F.array_join(F.array_sort(tx.company_keys(_company())), ",").alias("keys"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '^\$[0-9A-Za-z]{1,6}$') THEN 'unresolved-placeholder-token' WHEN lower(t) IN ('as attached', 'n/a', 'na', 'tbd', 'tba', '-', '--', '.') THEN 'placeholder-value'
WHEN regexp_matches(t, '^https?://[^ \t-\r]+$') THEN 'link-only-no-prose' END AS junk
FROM (SELECT doc_id, trim(CASE doc_id % 6 WHEN 0 THEN ' $4' || doc_id || ' ' WHEN 1 THEN 'As Attached' WHEN 2 THEN 'https://x.example/' || doc_id ELSE text END, E' \t\n\x0b\f\r') AS t FROM documents)""")
def junk_reason(t):
    """Why texts, half of them replaced by what scrapes leave, are no prose."""
    k, name = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit(" $4"), name, F.lit(" "))).when(k == 1, "As Attached").when(k == 2, F.concat(F.lit("https://x.example/"), name)).otherwise(F.col("text"))
    return t("documents").select("doc_id", tx.junk_reason(text).alias("junk"))


_PLACE = "p_name || [' at Booth No. 12', ' in hall B-4', ' stall #7 level 2', ''][(p_partkey % 4 + 1)::INT]"


@query(f"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(x, {_q(tx.CONTAMINATION['booth identifier'])}) THEN 'booth identifier' END,
CASE WHEN regexp_matches(x, {_q(tx.CONTAMINATION['hall identifier'])}) THEN 'hall identifier' END], lambda r: r IS NOT NULL), ',') AS reasons FROM (SELECT p_partkey, {_PLACE} AS x FROM part)""")
def contamination(t):
    """Reasons to withhold descriptions that name places."""
    ends = F.array(*map(F.lit, [" at Booth No. 12", " in hall B-4", " stall #7 level 2", ""]))
    x = F.concat("p_name", F.element_at(ends, (F.col("p_partkey") % 4 + 1).cast("int")))
    return t("part").select("p_partkey", F.array_join(tx.contamination(x), ",").alias("reasons"))


@query("""SELECT substr(sha256(sum(('0x' || substr(sha256(doc_id::VARCHAR || coalesce(text, '')), 1, 15))::BIGINT)::VARCHAR), 1, 16) AS digest, count(*) AS n FROM documents""")
def corpus_digest(t):
    """A digest of all rows in any order: row hashes are summed, so no task holds more than a number."""
    row = F.sha2(F.concat(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256)
    total = F.sum(F.conv(F.substr(row, F.lit(1), F.lit(15)), 16, 10).cast("decimal(20,0)"))
    return t("documents").agg(F.substr(F.sha2(total.cast("string"), 256), F.lit(1), F.lit(16)).alias("digest"), F.count("*").alias("n"))
