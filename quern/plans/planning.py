"""Queries of plans, guards, snapshots with values, and stored indexes: orders are plans, lines their items, events busy time."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import dense, planning, snapshot
from quern.plans.declare import query
from quern.storage import new_path


def _plans(t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("person"), F.col("l_suppkey").alias("item"))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS person, l_suppkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey), c AS (SELECT c_custkey // 3 AS grp, c_custkey AS person FROM customer)
SELECT grp, item FROM c JOIN p USING (person) GROUP BY grp, item HAVING count(*) = (SELECT count(*) FROM c d WHERE d.grp = c.grp)""")
def shared_items(t):
    """Items that all three people of a group have planned."""
    return planning.in_every(_plans(t), t("customer").select(F.floor(F.col("c_custkey") / 3).alias("grp"), F.col("c_custkey").alias("person")))


_BUSY = "SELECT user_id % 20 AS grp, ts::DATE AS day, hour(ts) * 60 + minute(ts) AS s, hour(ts) * 60 + minute(ts) + 10 + event_id % 50 AS e FROM events"


@query(f"""WITH b AS ({_BUSY}), h AS (SELECT day, min(s) AS lo, max(e) AS hi FROM b GROUP BY day), g AS (SELECT grp, day, lo, hi, s, greatest(lo, max(e) OVER (PARTITION BY grp, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS f, e FROM b JOIN h USING (day))
SELECT grp, day, coalesce(f, lo) AS "from", s AS "to" FROM g WHERE s - coalesce(f, lo) >= 20 UNION ALL SELECT grp, day, greatest(any_value(lo), max(e)), any_value(hi) FROM g GROUP BY grp, day HAVING any_value(hi) - greatest(any_value(lo), max(e)) >= 20""")
def mutual_free_time(t):
    """Stretches of each day in which nobody of a group is busy, within the day's hours."""
    s = F.hour("ts") * 60 + F.minute("ts")
    busy = t("events").select((F.col("user_id") % 20).alias("grp"), F.to_date("ts").alias("day"), s.cast("long").alias("s"), (s + 10 + F.col("event_id") % 50).cast("long").alias("e"))
    bounds = busy.groupBy("day").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return planning.free_time(busy, bounds, ["grp"], 20)


@query("""WITH e AS (SELECT o_orderkey AS person, l_partkey * 2 AS id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) - 1 AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT person, pos, id, p_name AS label, p_partkey IS NOT NULL AS known, CASE WHEN id % 3 = 0 THEN 'because ' || id ELSE '' END AS why, CASE WHEN id % 5 = 0 THEN 'user' ELSE 'agent' END AS source FROM e LEFT JOIN part ON p_partkey = id""")
def plan_items(t):
    """Plans as items in their order; ids that no item has are marked."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_suppkey"))), lambda x: x["l_partkey"] * 2)
    per = t("lineitem").groupBy(F.col("l_orderkey").alias("person")).agg(ids.alias("ids")).join(t("orders").select(F.col("o_orderkey").alias("person")), "person")
    some = lambda n, v: F.map_from_entries(F.transform(F.array_distinct(F.filter("ids", lambda x: x % n == 0)), lambda x: F.struct(x, v(x))))
    plans = per.select("person", "ids", some(3, lambda x: F.concat(F.lit("because "), x.cast("string"))).alias("why"), some(5, lambda _: F.lit("user")).alias("source"))
    items = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return planning.shown(plans, items).select("person", "pos", "id", "label", "known", "why", "source")


_LINES = """SELECT o_custkey AS person, strftime(o_orderdate, '%Y-%m-%d') AS day, lpad((l_linenumber + 8)::VARCHAR, 2, '0') || ':00' AS start, lpad((l_linenumber + 9)::VARCHAR, 2, '0') || ':00' AS "end",
CASE WHEN l_suppkey % 2 = 0 THEN 'Hall ' || l_suppkey END AS hall, 'part ' || l_partkey AS label, CASE WHEN l_partkey % 4 = 0 THEN 'Good.' ELSE '' END AS why FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


@query(f"""WITH l AS ({_LINES}), x AS (SELECT *, 'At ' || start || ' to ' || "end" || CASE WHEN hall IS NULL THEN '' ELSE ', in ' || hall END || ': ' || label || '.' || CASE WHEN why = '' THEN '' ELSE ' ' || why END AS line FROM l)
SELECT person, day, count(*) AS n, min(start) AS first_start, md5(count(*) || CASE WHEN count(*) = 1 THEN ' session on ' ELSE ' sessions on ' END || day || ': ' || string_agg(line, ' ' ORDER BY start, label, line)) AS text FROM x GROUP BY person, day""")
def day_plan_text(t):
    """Each person's plan of a day as one text, by digest."""
    n = F.col("l_linenumber")
    clock = lambda x: F.concat(F.lpad(x.cast("string"), 2, "0"), F.lit(":00"))
    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("person"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), clock(n + 8).alias("start"), clock(n + 9).alias("end"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Hall "), F.col("l_suppkey").cast("string"))).alias("hall"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("label"), F.when(F.col("l_partkey") % 4 == 0, "Good.").otherwise("").alias("why"),
    )
    return planning.day_text(rows, F.col("day")).withColumn("text", F.md5("text"))


@query("""SELECT c_custkey AS person, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN c_custkey % 2 = 0 END AS visible FROM customer""")
def plan_visibility(t):
    """Visibility after requests; null for people without a plan."""
    return planning.visibility(t("orders").select(F.col("o_custkey").alias("person")), t("customer").select(F.col("c_custkey").alias("person"), (F.col("c_custkey") % 2 == 0).alias("visible")))


@query("""WITH e AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS seg FROM customer WHERE c_custkey % 5 <> 0), p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'PATCH' END AS seg FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(e.k, p.k) AS k, coalesce(p.name, e.name, 'nobody') AS name, coalesce(p.seg, e.seg, 'none') AS seg FROM e FULL JOIN p ON e.k = p.k""")
def patched_documents(t):
    """Documents after patches that keep what they don't name."""
    k = F.col("c_custkey")
    c = t("customer")
    have = c.where("c_custkey % 5 <> 0").select(k.alias("k"), F.col("c_name").alias("name"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("seg"))
    patch = c.where("c_custkey % 4 <> 0").select(k.alias("k"), F.when(k % 2 == 0, "new").alias("name"), F.when(k % 7 == 0, "PATCH").alias("seg"))
    return planning.patched(have, patch, "k", {"name": F.lit("nobody"), "seg": F.lit("none")})


_REPLY = "p_name || [' at Booth no. 12b', ' near stall A-7 and kiosk 3', ' in hall 4', ''][(p_partkey % 4 + 1)::INT]"


@query(f"""WITH r AS (SELECT p_partkey, {_REPLY} AS x FROM part) SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN regexp_replace(x, '(?i)\\b(?:booth no. 12b|stall A-7|kiosk 3)', '[not published]', 'g') || chr(10) || chr(10) || 'No plan.' ELSE x END AS reply FROM r""")
def guarded_replies(t):
    """Replies without identifiers of stands."""
    ends = F.array(*map(F.lit, [" at Booth no. 12b", " near stall A-7 and kiosk 3", " in hall 4", ""]))
    reply = F.concat("p_name", F.element_at(ends, (F.col("p_partkey") % 4 + 1).cast("int")))
    return t("part").select("p_partkey", planning.guarded(reply, "No plan.").alias("reply"))


@query("""SELECT c_custkey, c_custkey % 4 = 0 AS email, c_custkey % 4 = 1 AS phone, CASE c_custkey % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN '' ELSE 'c' END AS ids, CASE c_custkey % 3 WHEN 0 THEN 'booth,stall' WHEN 1 THEN '' ELSE 'boothsource' END AS banned, contains(lower(c_name || ' ' || c_mktsegment), 'mer#000000001') OR contains(lower(c_name || ' ' || c_mktsegment), 'mer#00000001') AS hit FROM customer""")
def input_checks(t):
    """Addresses, numbers, lists of ids, banned keys and a search, checked."""
    k = F.col("c_custkey")
    text = F.element_at(F.array(*map(F.lit, ["a.b@c.example", "+4915112345678", "a@b", "+0123"])), (k % 4 + 1).cast("int"))
    ids = F.element_at(F.array(F.array(F.lit(" a "), F.lit(""), F.lit("b")), F.array(F.lit(" "), F.lit("x" * 121)), F.array(F.lit("c"))), (k % 3 + 1).cast("int"))
    doc = F.element_at(F.array(*map(F.lit, ['{"a": {"Booth": 1}, "x": [{"Stall ": 2}]}', '{"boothless": "booth: 1"}', '{"booth_source": null}'])), (k % 3 + 1).cast("int"))
    find = lambda w: planning.needle([F.col("c_name"), F.col("c_mktsegment")], F.lit(w))
    return t("customer").select(
        "c_custkey", planning.is_email(text).alias("email"), planning.is_phone(text).alias("phone"), F.array_join(planning.clean_ids(ids), ",").alias("ids"),
        F.array_join(planning.banned_keys(doc), ",").alias("banned"), (find(" MER#000000001") | find("mer#00000001 ")).alias("hit"),
    )


@query("""WITH d AS (SELECT c_custkey, lower(replace(c_name, '#', '-')) AS slug, string_split('u' || c_custkey || '@x.example', '') AS cs FROM customer), h AS (SELECT c_custkey, slug, list_reduce(list_prepend(0::HUGEINT, list_transform(cs, lambda c: ascii(c)::HUGEINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM d)
SELECT c_custkey, slug || '-' || left(list_reduce(list_prepend('', list_transform(range(6, -1, -1), lambda i: CASE WHEN h >= (36::HUGEINT ** i)::HUGEINT THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // (36::HUGEINT ** i)::HUGEINT) % 36 + 1)::INT, 1) ELSE '' END)), lambda a, b: a || b), 4) AS slug FROM h""")
def salted_slugs(t):
    """Slugs that a hash of an address tells apart."""
    salt = F.concat(F.lit("U"), F.col("c_custkey").cast("string"), F.lit("@X.example"))
    return t("customer").select("c_custkey", planning.salted_slug(F.col("c_name"), salt).alias("slug"))


@query("""SELECT o_orderkey, 'S' || o_orderkey || ' | ' || strftime(o_orderdate, '%m-%d') || ' | ' || CASE WHEN length(o_orderpriority) <= 8 THEN o_orderpriority ELSE rtrim(o_orderpriority[:7]) || '…' END || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Hall' ELSE '' END AS line,
CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Matched “' || o_orderstatus || '” in its title, hall.' END AS why FROM orders""")
def catalogue_lines(t):
    """Lines of a catalogue, and why a record matched."""
    k = F.col("o_orderkey")
    line = planning.session_line(F.concat(F.lit("S"), k.cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"), F.when(k % 2 == 0, "Hall"), 8)
    terms = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus"))
    return t("orders").select("o_orderkey", line.alias("line"), planning.rationale(terms, F.array(F.lit("title"), F.lit("hall"))).alias("why"))


_NEW = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS hall, ['a', 'b' || o_orderkey % 3, 'b' || o_orderkey % 3] AS people FROM orders WHERE o_orderkey % 13 <> 0"
_OLD = "SELECT o_orderkey AS k, o_orderpriority AS title, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS hall, ['b1', 'a', 'b1'] AS people FROM orders WHERE o_orderkey % 17 <> 0"


def _versions(t):
    k = F.col("o_orderkey")
    b = F.concat(F.lit("b"), (k % 3).cast("string"))
    new = t("orders").where("o_orderkey % 13 <> 0").select(k.alias("k"), F.when(k % 7 == 0, F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority")).alias("title"), F.when(k % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("hall"), F.array(F.lit("a"), b, b).alias("people"))
    old = t("orders").where("o_orderkey % 17 <> 0").select(k.alias("k"), F.col("o_orderpriority").alias("title"), F.when(k % 11 != 0, F.col("o_orderstatus")).alias("hall"), F.array(F.lit("b1"), F.lit("a"), F.lit("b1")).alias("people"))
    return old, new


_DIFF = f"""o AS ({_OLD}), n AS ({_NEW}), b AS (SELECT o.k, o.title AS ot, n.title AS nt, nullif(o.hall, '') AS oh, nullif(n.hall, '') AS nh, list_filter(list_sort(n.people), lambda x: NOT list_contains(o.people, x)) AS plus, list_filter(list_sort(o.people), lambda x: NOT list_contains(n.people, x)) AS minus FROM o JOIN n ON o.k = n.k)"""


@query(f"""WITH {_DIFF} SELECT k, concat_ws(',', CASE WHEN ot <> nt THEN 'title:' || ot || '>' || nt END, CASE WHEN oh IS DISTINCT FROM nh THEN 'hall:' || coalesce(oh, '-') || '>' || coalesce(nh, '-') END) AS fields, array_to_string(plus, ',') AS plus, array_to_string(minus, ',') AS minus, oh IS DISTINCT FROM nh AS rescheduled, ot <> nt AS retitled
FROM b WHERE ot <> nt OR oh IS DISTINCT FROM nh OR len(plus) > 0""")
def snapshot_changes(t):
    """What changed between two snapshots, with old and new values."""
    out = snapshot.changes(*_versions(t), "k", ["title", "hall"], {"hall"}, "title", ("people",))
    line = F.transform("fields", lambda x: F.concat(x["field"], F.lit(":"), F.coalesce(x["old"], F.lit("-")), F.lit(">"), F.coalesce(x["new"], F.lit("-"))))
    return out.select("k", F.array_join(line, ",").alias("fields"), F.array_join("people_added", ",").alias("plus"), F.array_join("people_removed", ",").alias("minus"), "rescheduled", "retitled")


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), a AS (SELECT 'added' AS kind, k, title FROM n WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT 'disappeared', k, title FROM o WHERE k NOT IN (SELECT k FROM n)), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY k) AS nth, count(*) OVER (PARTITION BY kind) AS c FROM a)
SELECT kind, k, title, CASE WHEN kind = 'added' THEN greatest(c - 40, 0) ELSE 0 END AS more FROM r WHERE kind <> 'added' OR nth <= 40""")
def diff_report(t):
    """The first forty added rows and all that disappeared, with how many more there are."""
    old, new = _versions(t)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k", "title")
    rows = named(snapshot.insert_new(old, new, "k"), "added").unionByName(named(snapshot.insert_new(new, old, "k"), "disappeared"))
    return snapshot.report(rows, "kind", "k", {"added": 40, "disappeared": None}).select("kind", "k", "title", "more")


@query("""WITH b AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN p_name END AS logo FROM part), d AS (SELECT p_partkey AS k, 'd' || p_partkey AS logo FROM part WHERE p_partkey % 2 = 0)
SELECT b.k, CASE WHEN coalesce(trim(b.logo), '') = '' THEN d.logo ELSE b.logo END AS logo, CASE WHEN b.k % 4 = 0 THEN '~' || b.k || '|?' ELSE 'n' || b.k || '|x' END AS key, CASE WHEN b.k % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS aliases FROM b LEFT JOIN d ON b.k = d.k""")
def blank_fills(t):
    """Blank fields filled from a donor, keys with a fallback, and united aliases."""
    k = F.col("p_partkey")
    base = t("part").select(k.alias("k"), F.when(k % 3 == 0, " ").when(k % 3 == 1, F.col("p_name")).alias("logo"))
    donor = t("part").where("p_partkey % 2 = 0").select(k.alias("k"), F.concat(F.lit("d"), k.cast("string")).alias("logo"))
    out = snapshot.fill_blank(base, donor, "k", ["logo"])
    name = F.when(F.col("k") % 4 != 0, F.concat(F.lit("n"), F.col("k").cast("string")))
    key = snapshot.natural_key([name, F.lit("x")], [F.col("k"), F.lit(None)])
    both = snapshot.aliases(F.array(F.lit("b"), F.lit("a")), F.when(F.col("k") % 2 == 0, F.array(F.lit("c"), F.lit("a"))))
    return out.select("k", "logo", key.alias("key"), F.array_join(both, ",").alias("aliases"))


@query("""WITH p AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(x))))::DOUBLE / 127 AS scale FROM embeddings), q AS (SELECT vec_id, list_transform(embedding, lambda x: round_even(x::DOUBLE / scale, 0) * scale) AS v FROM embeddings, p)
SELECT vec_id AS id, round(list_sum(v) / sqrt(list_inner_product(v, v)), 6) AS total, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM q""")
def stored_index(t):
    """Vectors written as bytes with a manifest and read back, as sums."""
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    path = new_path(rows.sparkSession, "index")
    dense.write_index(rows, path, "embeddings")
    out = dense.read_index(rows.sparkSession, path)
    return out.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("""WITH c AS (SELECT l_orderkey AS c, l_discount <= 0.09::DOUBLE AS ok FROM lineitem), p AS (SELECT c, bool_and(ok) AS passed, bool_or(ok) AS any_, count(*) AS n FROM c GROUP BY c), g AS (SELECT c % 5 AS rule, count(*) FILTER (passed) AS passed, bool_and(passed) AS ok FROM p GROUP BY c % 5)
SELECT g.rule, g.passed, g.ok, p.c AS failed, CASE WHEN p.any_ AND p.n > 1 THEN p.c END AS flaky FROM g LEFT JOIN p ON p.c % 5 = g.rule AND NOT p.passed""")
def gate_lists(t):
    """Gates with the ids of all failed and flaky cases, a row for each failed case; a gate without any has one row."""
    good, rule = F.col("l_discount") <= 0.09, (F.col("l_orderkey") % 5).alias("rule")
    cases = t("lineitem").groupBy("l_orderkey").agg(F.bool_and(good).alias("p"), F.bool_or(good).alias("some"), F.count("*").alias("n"))
    gates = cases.groupBy(rule).agg(F.count_if("p").alias("passed"), F.bool_and("p").alias("ok"))
    failed = cases.where("not p").select(rule, F.col("l_orderkey").alias("failed"), F.when(F.col("some") & (F.col("n") > 1), F.col("l_orderkey")).alias("flaky"))
    alone = gates.where("ok IS DISTINCT FROM false").withColumn("failed", F.lit(None).cast("long")).withColumn("flaky", F.lit(None).cast("long"))
    return failed.join(F.broadcast(gates), "rule").unionByName(alone)
