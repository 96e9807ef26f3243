"""Order-dependent queries without folds over whole people: clash filters, the fallback plan, and rate windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import intervals
from quern.plans.catalogue import _SLOTS, _slots
from quern.plans.declare import query

_DAY = "s // 1440 AS day"


def _greedy(proposals: str, fixed: str) -> str:
    """One proposal after another, by recursion. Both: user_id, day, nth, id, s, e."""
    return f"""p AS ({proposals}), f AS ({fixed}), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY nth, id) AS i FROM p),
g AS (SELECT user_id, day, 0::BIGINT AS i, NULL::BIGINT AS id, true AS kept, NULL::BIGINT AS clash, coalesce(h, []) AS held FROM (SELECT DISTINCT user_id, day FROM o)
LEFT JOIN (SELECT user_id, day, list({{'id': id, 's': s, 'e': e}} ORDER BY nth, id) AS h FROM f GROUP BY ALL) USING (user_id, day)
UNION ALL SELECT o.user_id, o.day, o.i, o.id, hit IS NULL OR mine, CASE WHEN hit IS NOT NULL AND NOT mine THEN hit END, CASE WHEN mine OR hit IS NOT NULL THEN held ELSE list_append(held, {{'id': o.id, 's': o.s, 'e': o.e}}) END
FROM (SELECT o.*, g.held, len(list_filter(g.held, lambda y: y.id = o.id)) > 0 AS mine, list_filter(g.held, lambda y: y.id <> o.id AND y.s < o.e AND o.s < y.e)[1].id AS hit FROM g JOIN o ON o.user_id = g.user_id AND o.day = g.day AND o.i = g.i + 1) o)"""


@query(f"WITH RECURSIVE x AS ({_SLOTS}), {_greedy(f'SELECT user_id, {_DAY}, id AS nth, id, s, e FROM x', f'SELECT user_id, {_DAY}, id AS nth, id, s, e FROM x WHERE false')} SELECT user_id, day, id FROM g WHERE i > 0 AND kept")
def clash_filter(t):
    """Slots of each person and day that are kept, in order of proposal."""
    slots = _slots(t).select("user_id", F.floor(F.col("s") / 1440).alias("day"), F.col("id").alias("nth"), "id", "s", "e")
    return intervals.clash_filter(slots, ["user_id", "day"]).where("kept").select("user_id", "day", "id")


@query(f"""WITH RECURSIVE x AS ({_SLOTS}), {_greedy(f'SELECT user_id, {_DAY}, -id AS nth, id, s, e FROM x WHERE id % 5 <> 0 OR id % 10 = 0', f'SELECT user_id, {_DAY}, id AS nth, id, s, e FROM x WHERE id % 5 = 0 AND id % 15 <> 0')}
SELECT user_id, day, id, kept, clash FROM g WHERE i > 0""")
def clash_report(t):
    """New slots against a plan whose every third entry goes in the same edit: what stays is fixed, what is proposed yields, and to what."""
    slots = _slots(t).withColumn("day", F.floor(F.col("s") / 1440))
    fixed = slots.where("id % 5 = 0 AND id % 15 <> 0").withColumn("nth", F.col("id"))
    return intervals.clash_filter(slots.where("id % 5 <> 0 OR id % 10 = 0").withColumn("nth", -F.col("id")), ["user_id", "day"], fixed)


RATE_LIMIT, RATE_WINDOW_S = 3, 3600


@query(f"""WITH RECURSIVE h AS MATERIALIZED (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s FROM events),
a AS (SELECT user_id, min(s) AS s FROM h GROUP BY user_id UNION ALL SELECT a.user_id, min(h.s) FROM a JOIN h ON h.user_id = a.user_id AND h.s >= a.s + {RATE_WINDOW_S} GROUP BY a.user_id)
SELECT event_id, h.user_id, row_number() OVER (PARTITION BY h.user_id, a.s ORDER BY h.s, event_id) <= {RATE_LIMIT} AS allowed FROM h ASOF JOIN a ON h.user_id = a.user_id AND h.s >= a.s""")
def rate_limit(t):
    """Events that a limit of RATE_LIMIT in RATE_WINDOW_S, anchored at the first hit, lets through."""
    hits = t("events").select(F.col("event_id").alias("id"), "user_id", F.unix_timestamp("ts").alias("s"))
    return intervals.rate_limited(hits, ["user_id"], RATE_LIMIT, RATE_WINDOW_S).select(F.col("id").alias("event_id"), "user_id", "allowed")
