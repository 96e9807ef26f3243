"""Queries of questions, names and vectors: analysis, days, name scans, random indexing and simple search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import analysis
from quern.functions import text as tx
from quern.operators import dense, names, random_index, terms
from quern.plans.declare import query
from quern.plans.text import _STOP, _TERMS, _q

_ASKED = ["day 2", "on the second day of it", "10th September", "Sept 9", "2026-09-08 at noon", "the last day", "day three", "no day at all"]
_ASK = f"'is it ' || [{', '.join(map(_q, _ASKED))}][(c_custkey % {len(_ASKED)} + 1)::INT] || ', ' || c_name || '?'"


def _pick(choices, key):
    return F.element_at(F.array(*map(F.lit, choices)), (F.col(key) % len(choices) + 1).cast("int"))


def _numbered(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_q(w)} THEN '{n}'" for w, n in analysis.NUMBER_WORDS.items()) + " END"


def _part(pattern: str) -> str:
    return f"nullif(regexp_extract(q, {_q(pattern)}, 1), '')"


_M = analysis.MONTH_WORD


@query(f"""WITH a AS (SELECT c_custkey, lower({_ASK}) AS q FROM customer) SELECT c_custkey, coalesce({_part(r'\b(20[0-9][0-9]-[0-9][0-9]-[0-9][0-9])\b')}, {_part(r'\bday[ ]*([123])\b')},
{_numbered(_part(r'\b(first|second|third|last|final) +day\b'))}, {_numbered(_part(r'\bday +(one|two|three)\b'))},
'2026-09-' || lpad(({_part(rf'\b([0-9]{{1,2}})(?:st|nd|rd|th)? +{_M}\b')})::INT::VARCHAR, 2, '0'), '2026-09-' || lpad(({_part(rf'\b{_M} +([0-9]{{1,2}})(?:st|nd|rd|th)?\b')})::INT::VARCHAR, 2, '0')) AS day FROM a""")
def day_inference(t):
    """The day that each customer's question names."""
    return t("customer").select("c_custkey", analysis.infer_day(F.concat(F.lit("is it "), _pick(_ASKED, "c_custkey"), F.lit(", "), "c_name", F.lit("?"))).alias("day"))


_GOALS = ["looking for partners in", "which panel is on", "someone to meet", "founders and talks about", "interested in", "recommend a keynote on"]
_GOAL = f"[{', '.join(map(_q, _GOALS))}][(p_partkey % {len(_GOALS)} + 1)::INT] || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' ' || p_name END"
_KINDS = "CASE " + " ".join(f"WHEN s IN ({', '.join(map(_q, w.split()))}) THEN '{k}'" for k, w in analysis.TYPE_WORDS.items()) + " END"


@query(f"""WITH src AS (SELECT p_partkey AS id, {_GOAL} AS body FROM part), {_TERMS},
u AS (SELECT id, s, {_KINDS} AS kind, s IN ({', '.join(map(_q, analysis.INTENT_FILLER + analysis.GENERIC_BUSINESS))}) AS filler FROM stems WHERE t NOT IN {_STOP} AND s NOT IN {_STOP} AND (length(s) >= 2 OR regexp_matches(s, '^[0-9]$'))),
k AS (SELECT *, CASE WHEN kind IS NOT NULL THEN s IN ({', '.join(map(_q, analysis.CONTENTFUL))}) ELSE NOT filler END AS kept FROM u),
g AS (SELECT id, string_agg(s, ',' ORDER BY s) FILTER (kept) AS good, string_agg(s, ',' ORDER BY s) FILTER (NOT kept) AS gone, string_agg(DISTINCT kind, ',' ORDER BY kind) AS hints FROM k GROUP BY id)
SELECT p_partkey, coalesce(good, gone, '') AS terms, CASE WHEN good IS NULL AND gone IS NOT NULL THEN 0.3 ELSE 1.0 END::DOUBLE AS weight, CASE WHEN good IS NULL THEN '' ELSE coalesce(gone, '') END AS dropped, coalesce(hints, '') AS hints FROM part LEFT JOIN g ON id = p_partkey""")
def query_analysis(t):
    """Terms, their weight, what was dropped, and hinted types of each part's question."""
    body = F.concat(_pick(_GOALS, "p_partkey"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit(" "), "p_name")))
    got = t("part").select("p_partkey", analysis.analyse(body).alias("a"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    weight = F.coalesce(F.get("a.terms", F.lit(0))["weight"], F.lit(1.0))
    return got.select("p_partkey", joined(F.transform("a.terms", lambda x: x["term"])).alias("terms"), weight.alias("weight"), joined("a.dropped").alias("dropped"), joined("a.hints").alias("hints"))


def lexicon_of(t):
    """Forms from the benchmark (its items' first one to three words) and the document frequencies of the documents' terms."""
    toks = t("benchmark").select("item_id", F.slice(tx.tokens("text", keep_stopwords=True), 1, 3).alias("k")).where(F.size("k") > 0)
    forms = toks.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("k")), lambda n: F.array_join(F.slice("k", 1, n), " "))).alias("form"), F.col("item_id").alias("id"))
    kind = F.when(F.col("id") % 3 == 0, "associated").otherwise("primary")
    return names.lexicon(forms.withColumn("kind", kind), terms.frequencies(t("documents"), keep_stopwords=True))


@query()
def name_scan(t):
    """Boosts of the benchmark items whose names the documents hold."""
    texts = t("documents").select(F.col("doc_id").alias("qid"), "text")
    found = names.scan(texts, lexicon_of(t))
    return found.groupBy("qid", "id").agg(F.sum("boost").alias("boost"), F.count("*").alias("hits"))


@query()
def random_indexing(t):
    """The three nearest documents of every document whose id is divisible by 100, by random indexing of all terms of whole texts."""
    docs = t("documents").select(F.col("doc_id").alias("id"), "text").where("id IS NOT NULL")
    vectors = random_index.of_texts(docs)
    near = dense.nearest(vectors, vectors.where("id % 100 = 0").withColumnRenamed("id", "qid"), 3, 9)
    return near.select(F.col("qid").alias("doc_id"), F.col("id").alias("other"), F.col("score").alias("similarity"), "rank")


@query("""WITH w AS (SELECT p_partkey, p_name, p_type, unnest(['bolt', 'promo', 'cold']) AS term FROM part),
s AS (SELECT p_partkey, sum(CASE WHEN contains(lower(p_name), term) THEN 5 WHEN contains(lower(p_type), term) THEN 1 ELSE 0 END) AS score FROM w GROUP BY p_partkey)
SELECT p_partkey, score::BIGINT AS score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20""")
def simple_search(t):
    """Twenty best parts for three terms: five points for a hit in the name, one for a hit elsewhere (a top-k report)."""
    hit = lambda w: F.when(F.contains(F.lower("p_name"), F.lit(w)), 5).when(F.contains(F.lower("p_type"), F.lit(w)), 1).otherwise(0)
    score = (hit("bolt") + hit("promo") + hit("cold")).cast("long")
    return t("part").select("p_partkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(20)


@query("SELECT min(p_partkey) AS p_partkey, lower(p_name) AS name, count(*) AS n FROM part GROUP BY lower(p_name)")
def first_wins_distinct(t):
    """The first part of each name, whatever its case."""
    return t("part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n"))


@query("""WITH prev AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0), inc AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(p.k, i.k) AS k, CASE WHEN i.k IS NULL THEN 'withdrawn' WHEN p.k IS NULL THEN 'new' ELSE 'live' END AS status FROM prev p FULL JOIN inc i ON p.k = i.k""")
def soft_withdraw(t):
    """Rows of two snapshots with their status: what vanished is marked, not deleted."""
    o = t("orders").select(F.col("o_orderkey").alias("k"))
    prev, inc = o.where("k % 7 <> 0").withColumn("had", F.lit(True)), o.where("k % 11 <> 0").withColumn("has", F.lit(True))
    return prev.join(inc, "k", "full").select("k", F.when(F.col("has").isNull(), "withdrawn").when(F.col("had").isNull(), "new").otherwise("live").alias("status"))


@query("""WITH a AS (SELECT l_orderkey AS id, l_discount <= 0.09::DOUBLE AS ok FROM lineitem) SELECT id, count(*) AS attempts, count(*) FILTER (ok) AS passed FROM a GROUP BY id HAVING bool_or(ok) AND NOT bool_and(ok)""")
def flaky_cases(t):
    """Cases that some of their attempts pass, and some don't."""
    ok = F.col("l_discount") <= 0.09
    per = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("attempts"), F.count_if(ok).alias("passed"))
    return per.where("passed > 0 and passed < attempts")


@query("""SELECT conv_id, count(*) AS turns, md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS digest, max(turn) AS last FROM conversations GROUP BY conv_id""")
def append_turns(t):
    """Each conversation as one record read from an append-only table of turns, by digest."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    body = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|")
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(body).alias("digest"), F.max("turn").alias("last"))
