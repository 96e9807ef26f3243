"""Queries of feeds and exports: typed lines, payloads in pages, CSV read back and held against its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.declare import query
from quern.sources import exports, records


@query("""WITH k AS (SELECT o_orderkey AS k, o_orderkey % 6 AS m FROM orders) SELECT coalesce(kind, '-') AS kind, coalesce(skip, '-') AS skip, count(*) AS n FROM (
SELECT CASE m WHEN 0 THEN 'session' WHEN 1 THEN 'partner' WHEN 2 THEN 'speaker' END AS kind, CASE m WHEN 3 THEN 'unknown-type' WHEN 4 THEN 'bad-json' WHEN 5 THEN 'not-an-object' END AS skip FROM k) GROUP BY ALL""")
def typed_lines(t):
    """Lines of six shapes by inferred type, or by why they are skipped."""
    key = F.col("o_orderkey").cast("string")
    shapes = ['{"agendaCode": "%s"}', '{"type": "partner", "bio": "%s"}', '{"nameKey": "%s"}', '{"size": "%s"}', '{"slug": "%s', '["%s"]']
    pick = F.element_at(F.array(*[F.replace(F.lit(s), F.lit("%s"), key) for s in shapes]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    lines = t("orders").select(pick.alias("value"))
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return records.parse_lines(lines).groupBy(dash("kind"), dash("skip")).agg(F.count("*").alias("n"))


@query("SELECT page_id, md5(url) AS url_md5, length(html)::BIGINT AS size FROM pages")
def page_payload(t):
    """Each page's address and size, put into a payload of two pushes inside a page and read out of it again."""
    body = F.to_json(F.struct(F.struct("url", F.length("html").alias("size")).alias("page")))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    html = F.concat(F.lit('<script>self.__next_f.push([1,"0:"])</script><script>self.__next_f.push([1,'), quoted, F.lit("])</script>"))
    blob = t("pages").select("page_id", records.payload(html).alias("blob")).select("page_id", records.grab("blob", "page").alias("page"))
    return blob.select("page_id", F.md5(F.get_json_object("page", "$.url")).alias("url_md5"), F.get_json_object("page", "$.size").cast("long").alias("size"))


_CELLS = "[doc_id::VARCHAR, coalesce(text, ''), coalesce(lang, ''), coalesce(source, '')]"
_PLACEHOLDER = "(" + ", ".join(f"'{x}'" for x in exports.PLACEHOLDERS) + ")"


@query(f"""SELECT doc_id, md5(array_to_string(CASE WHEN doc_id % 5 = 3 THEN list_append({_CELLS}, 'more, of "it"') ELSE {_CELLS} END, chr(31))) AS cells,
array_to_string(list_filter([CASE WHEN doc_id % 5 = 2 THEN 'duplicate-header' END, CASE WHEN doc_id % 5 = 1 THEN 'no-bom' END, CASE WHEN len(list_filter({_CELLS}, lambda x: lower(trim(x)) IN {_PLACEHOLDER})) > 0 THEN 'placeholder' END,
CASE WHEN doc_id % 5 = 3 THEN 'ragged' END], lambda x: x IS NOT NULL), ',') AS findings FROM documents""")
def csv_roundtrip(t):
    """Every document as a CSV file of its own, parsed strictly: its cells, by digest, and what is wrong with it. Of five files one has no BOM,
    one a header twice, one a cell too many."""
    columns, kind = ["doc_id", "text", "lang", "source"], F.col("doc_id") % 5
    line = F.concat_ws(",", *[exports.cell(c) for c in columns], F.when(kind == 3, exports.cell(F.lit('more, of "it"'))))
    head = F.concat(F.when(kind == 1, "").otherwise(exports.BOM), F.lit("doc_id,text,lang,"), F.when(kind == 2, "lang").otherwise("source"), F.lit("\r\n"))
    files = t("documents").select("doc_id", F.concat(head, line, F.lit("\r\n")).alias("file"))
    got = files.withColumn("p", exports.parsed("file"))
    return got.select("doc_id", F.md5(F.array_join(F.get("p.rows", F.lit(1)), "\x1f")).alias("cells"), F.array_join(exports.findings("file", "p"), ",").alias("findings"))


@query("""SELECT count(*) FILTER (o_orderkey % 10 = 0) AS only_exported, count(*) FILTER (o_orderkey % 10 = 1) AS only_stored,
count(*) FILTER (o_orderkey % 10 > 1 AND o_orderkey % 3 = 0) AS o_orderstatus_differ, 0::BIGINT AS o_totalprice_differ FROM orders""")
def csv_cross_check(t):
    """An export with missing, extra and changed rows against its store."""
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    exported = o.where("o_orderkey % 10 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "changed").otherwise(F.col("o_orderstatus")))
    return exports.cross_check(exported, o.where("o_orderkey % 10 <> 0"), "o_orderkey", "o_orderstatus", "o_totalprice")
