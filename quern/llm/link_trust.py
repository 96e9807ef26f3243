"""URL filters: stated rules first, then trust and distrust that spread over links between hosts.

A page whose url fits a rule has the rule's verdict, the longest rule's if it fits several. Pages under rules seed their hosts: trust goes
from hosts of allowed pages along links, distrust from hosts of blocked pages against them, since who links to a blocked host is suspect.
Both are personalised PageRanks in whole numbers, so sums do not depend on order. A host whose distrust exceeds RATIO times its trust
is blocked with all its pages that no rule fits; all other hosts are allowed.

Defined results: a null url, or one without "://", has empty host and path, fits no rule and is allowed; a null html has no links.
Links count once for each pair of hosts, not within a host. Mass that reaches a host without links on is lost. Repeated rows are judged
alike and count again as seeds. Extra columns are ignored; an empty table gives an empty result. Rules are a short list and become one
expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, new_path, remove, stored

# The stated rules: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Share of the mass that moves on, in hundredths; mass of all seeds; rounds at most; how far distrust must exceed trust.
DAMPING, MASS, ROUNDS, RATIO = 85, 10**15, 20, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""<[Aa][ \t-\r][^<>]*?[Hh][Rr][Ee][Ff][ \t-\r]*=[ \t-\r]*["']?[ \t-\r]*(?:[Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#"' \t-\r<>]+)"""


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _URL, 2)


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))


def _longest_first(rules: tuple) -> list:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, and rule and said (its verdict), null where no rule fits. Of rules of one length the smaller wins."""
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in reversed(_longest_first(rules)):
        rule, said = F.when(_fits(host, path), host + path).otherwise(rule), F.when(_fits(host, path), verdict).otherwise(said)
    return pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path")).select("*", rule.alias("rule"), said.alias("said"))


def seeds(judged: DataFrame) -> DataFrame:
    """host, trust and distrust: MASS each, shared among the hosts by their pages under rules."""
    each = judged.where("host <> '' AND said IS NOT NULL").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad"))
    sums = each.agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))  # one row
    part = lambda n, of: F.coalesce(F.expr(f"cast({MASS} as decimal(18,0)) * cast({n} as decimal(18,0)) div nullif({of}, 0)"), F.lit(0)).cast("long")
    return each.join(F.broadcast(sums)).select("host", part("good", "all_good").alias("trust"), part("bad", "all_bad").alias("distrust"))


def host_links(pages: DataFrame) -> DataFrame:
    """src and dst of all links in the pages between different hosts, each pair once, with `out` and `back`, the links of src and to dst."""
    each = pages.select(host_of("url").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("dst"))
    pairs = each.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' AND src <> dst").distinct()
    pairs = materialise(pairs, "host-links")
    return pairs.join(pairs.groupBy("src").agg(F.count("*").alias("out")), "src").join(pairs.groupBy("dst").agg(F.count("*").alias("back")), "dst")


def spread(links: DataFrame, start: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust and distrust after `rounds` rounds, or as soon as nothing changes. Each round is a table in the shared folder."""
    spark = links.sparkSession
    edges, start = materialise(links, "host-edges"), materialise(start, "host-seeds")
    stay = start.select("host", *[F.expr(f"{c} * {100 - DAMPING} div 100").alias(c) for c in ("trust", "distrust")])
    path, state = new_path(spark, "host-ranks"), None
    now = stored(stay, path)
    zero = F.lit(0).cast("long")
    for _ in range(rounds):
        along = edges.join(now.where("trust > 0"), F.col("src") == F.col("host")).select(F.col("dst").alias("host"), F.expr(f"trust * {DAMPING} div (100 * out)").alias("trust"), zero.alias("distrust"))
        against = edges.join(now.where("distrust > 0"), F.col("dst") == F.col("host")).select(F.col("src").alias("host"), zero.alias("trust"), F.expr(f"distrust * {DAMPING} div (100 * back)").alias("distrust"))
        moved = stay.unionByName(along).unionByName(against).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        before, path = path, new_path(spark, "host-ranks")
        now = stored(moved, path)
        remove(spark, before)
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("host", "trust", "distrust").cast("decimal(20,0)"))).first())
        if was == state:
            break
    return now


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    judged = ruled(pages, rules)
    ranks = spread(host_links(pages), seeds(judged))
    blocked = ranks.where(F.col("distrust") > RATIO * F.col("trust")).select("host", F.lit("block").alias("by_links"))
    return judged.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", "by_links", F.lit("allow")).alias("verdict"))


def op12(pages: DataFrame) -> DataFrame:
    return judge(pages)


def _case(value) -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    return "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in _longest_first(RULES)) + " END"


_Q = lambda x: "'" + x.replace("'", "''") + "'"
_ROUNDS = ",\n".join(
    f"""r{i} AS MATERIALIZED (SELECT host, sum(trust)::BIGINT AS trust, sum(distrust)::BIGINT AS distrust FROM (SELECT * FROM r0
UNION ALL SELECT dst, trust * {DAMPING} // (100 * o), 0 FROM e JOIN r{i - 1} ON src = host UNION ALL SELECT src, 0, distrust * {DAMPING} // (100 * b) FROM e JOIN r{i - 1} ON dst = host) GROUP BY host)"""
    for i in range(1, ROUNDS + 1)
)
ORACLE = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), {_Q(_URL)}, 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), {_Q(_URL)}, 2) AS path, html FROM pages),
j AS MATERIALIZED (SELECT page_id, host, path, html, {_case(lambda v, h, p: h + p)} AS rule, {_case(lambda v, h, p: v)} AS said FROM u),
s AS (SELECT host, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad FROM j WHERE host <> '' AND said IS NOT NULL GROUP BY host),
r0 AS MATERIALIZED (SELECT host, coalesce({MASS}::HUGEINT * good // nullif(sum(good) OVER (), 0), 0)::BIGINT * {100 - DAMPING} // 100 AS trust, coalesce({MASS}::HUGEINT * bad // nullif(sum(bad) OVER (), 0), 0)::BIGINT * {100 - DAMPING} // 100 AS distrust FROM s),
l AS (SELECT DISTINCT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), {_Q(_LINK)}, 1)), '{_UPPER}', '{_LOWER}') AS dst FROM j),
e AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS o, count(*) OVER (PARTITION BY dst) AS b FROM l WHERE src <> '' AND src <> dst),
{_ROUNDS}
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN distrust > {RATIO} * trust THEN 'block' END, 'allow') AS verdict FROM j LEFT JOIN r{ROUNDS} r ON r.host = j.host"""
