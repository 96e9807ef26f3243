"""Plans of people: shared sessions, common free time, plans as items and as text, conditional edits, and guards on what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import intervals
from quern.storage import dealt

# Identifiers of stands in a reply, and keys that may not stand in a document.
STAND = r"(?i)\b(?:booth|stall|kiosk)\s*(?:no\.?|number|#)?\s*[:#-]?\s*[A-Za-z]{0,3}-?\d+[A-Za-z]?\b"
BANNED_KEYS = ("booth", "boothnumber", "boothno", "boothsource", "stall")


def in_every(plans: DataFrame, chosen: DataFrame) -> DataFrame:
    """grp and item of items that every chosen person of a group has planned. plans: person, item. chosen: grp, person."""
    asked = chosen.select("grp", "person").distinct()
    size = asked.groupBy("grp").agg(F.count("*").alias("size"))
    per = asked.join(plans.select("person", "item").distinct(), "person").groupBy("grp", "item").agg(F.count("*").alias("n"))
    return per.join(size, "grp").where("n = size").select("grp", "item")


def free_time(busy: DataFrame, bounds: DataFrame, by: list[str], least: int) -> DataFrame:
    """Gaps of at least `least` in which none of a key's intervals lies, within the day's bounds; a day without bounds has none.

    busy: the keys, day, s, e. bounds: day, start, end. A key without intervals on a day is not asked for.
    """
    inside = busy.join(bounds, "day")
    folded = inside.groupBy(*by, "day", "start", "end", "s").agg(F.max("e").alias("e"))
    key = Window.partitionBy(*by, "day").orderBy("s")
    ahead = F.greatest("start", F.max("e").over(key.rowsBetween(Window.unboundedPreceding, -1)))
    gaps = folded.withColumn("free", F.coalesce(ahead, F.col("start"))).select(*by, "day", F.col("free").alias("from"), F.col("s").alias("to"))
    tails = folded.groupBy(*by, "day", "start", "end").agg(F.greatest("start", F.max("e")).alias("from")).select(*by, "day", "from", F.col("end").alias("to"))
    return gaps.unionByName(tails).where(F.col("to") - F.col("from") >= least)


def shown(plans: DataFrame, items: DataFrame) -> DataFrame:
    """Plan entries as items, in their order, with why and who proposed them; `known` is false for ids that no item has.

    plans: person, ids (array), why and source (maps by id). items: id, label, day, detail.
    """
    each = plans.select("person", F.posexplode("ids").alias("pos", "id"), "why", "source")
    why, source = F.try_element_at("why", F.col("id")), F.try_element_at("source", F.col("id"))
    each = each.select("person", "pos", "id", F.coalesce(why, F.lit("")).alias("why"), F.coalesce(source, F.lit("agent")).alias("source"))
    return each.join(items.withColumn("known", F.lit(True)), "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def day_text(entries: DataFrame, label: Column) -> DataFrame:
    """person, day, n, first start and the day's plan as one text. entries: person, day, start, end, hall, label, why."""
    line = F.concat(F.lit("At "), "start", F.lit(" to "), "end", F.coalesce(F.concat(F.lit(", in "), "hall"), F.lit("")), F.lit(": "), "label", F.lit("."), F.coalesce(F.concat(F.lit(" "), F.nullif("why", F.lit(""))), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("start", "label", line.alias("line"))))
    per = entries.groupBy("person", "day").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), ordered.alias("lines"))
    head = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " session on ").otherwise(" sessions on "), label, F.lit(":"))
    return per.select("person", "day", "n", "first_start", F.concat_ws(" ", head, F.array_join(F.transform("lines", lambda x: x["line"]), " ")).alias("text"))


def visibility(plans: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requests (person, visible) with the plan's new state; null where there is no plan."""
    have = plans.select("person", F.lit(True).alias("there")).distinct()
    return wanted.join(have, "person", "left").select("person", F.when(F.col("there"), F.col("visible")).alias("visible"))


def patched(existing: DataFrame, patches: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Documents after patches: the patch's value, else what was there, else a default."""
    e = existing.select(key, *[F.col(c).alias(f"e_{c}") for c in defaults])
    p = patches.select(key, *[F.col(c).alias(f"p_{c}") for c in defaults])
    return e.join(p, key, "full").select(key, *[F.coalesce(F.col(f"p_{c}"), F.col(f"e_{c}"), d).alias(c) for c, d in defaults.items()])


def guarded(reply: Column, notice: str) -> Column:
    """A reply without identifiers of stands, with a notice if it had any."""
    return F.when(reply.rlike(STAND), F.concat(F.regexp_replace(reply, STAND, "[not published]"), F.lit(f"\n\n{notice}"))).otherwise(reply)


def clean_ids(ids: Column, most: int = 100, longest: int = 120) -> Column:
    """The first `most` ids, trimmed, of 1 to `longest` characters."""
    return F.slice(F.filter(F.transform(ids, lambda x: F.btrim(x)), lambda x: F.length(x).between(1, longest)), 1, most)


def is_email(c: Column) -> Column:
    return F.coalesce((F.length(c) <= 254) & c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def is_phone(c: Column) -> Column:
    """An international number of 8 to 15 digits."""
    return F.coalesce(c.rlike(r"^\+[1-9][0-9]{7,14}$"), F.lit(False))


def banned_keys(doc: Column, keys: tuple[str, ...] = BANNED_KEYS) -> Column:
    """Keys of a JSON text at any depth that may not stand there, in normal form, each once."""
    found = F.regexp_extract_all(doc, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda k: F.regexp_replace(F.lower(k), "[^a-z]", "")), lambda k: k.isin(*keys)))


def needle(fields: list[Column], wanted: Column) -> Column:
    """Whether the joined fields hold what a user typed, whatever the case; an empty search finds all."""
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lower(F.btrim(wanted)))


def salted_slug(name: Column, salt: Column) -> Column:
    """A slug with four characters from a hash of the salt: h * 31 + character over its characters, 32 bits, in base 36."""
    chars = F.filter(F.split(F.lower(salt), ""), lambda x: x != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda a, x: (a * 31 + F.ascii(x)).bitwiseAND(F.lit(4294967295)))
    return F.concat_ws("-", tx.slug(name), F.substring(F.lower(F.conv(h.cast("string"), 10, 36)), 1, 4))


def session_line(code: Column, day: Column, title: Column, hall: Column, most: int) -> Column:
    """One line of a catalogue: fields between bars, the title cut with an ellipsis."""
    one = F.btrim(F.regexp_replace(F.coalesce(title, F.lit("")), r"[ \t-\r]+", " "))
    cut = F.when(F.length(one) <= most, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, most - 1)), F.lit("…")))
    return F.concat_ws(" | ", code, F.substring(day, 6, 5), cut, F.coalesce(hall, F.lit("")))


def rationale(terms: Column, fields: Column) -> Column:
    """Why a record matched, from its matched terms and fields; empty if none did."""
    quoted = F.array_join(F.transform(terms, lambda x: F.concat(F.lit("“"), x, F.lit("”"))), ", ")
    return F.when(F.size(terms) > 0, F.concat(F.lit("Matched "), quoted, F.lit(" in its "), F.array_join(fields, ", "), F.lit("."))).otherwise("")


def fallback(picks: DataFrame, plans: DataFrame, records: DataFrame, rows: int | None = None) -> DataFrame:
    """person, id, kept and clash of matched items for plans: what a plan has is dropped, and what no record knows; of the rest, in the order of
    matching, each is kept unless it overlaps the plan or one kept before on its day. Items without times are kept.

    picks: person, id, nth. plans: person, id. records: id, day, s, e. A pick that is matched again counts once, at its first place. rows: how many
    picks and entries of plans there are at most.
    """
    have = dealt(plans.select("person", "id"), rows, "person", "id").distinct()
    fresh = dealt(picks, rows, "person", "id").join(have, ["person", "id"], "left_anti").groupBy("person", "id").agg(F.min("nth").alias("nth"))
    known = dealt(records, rows, "id")
    fresh = dealt(fresh, rows, "id").join(known, "id")
    held = dealt(have, rows, "id").join(known, "id").where("s IS NOT NULL AND e IS NOT NULL").withColumn("nth", F.col("id"))
    return intervals.clash_filter(fresh, ["person", "day"], held, rows=rows).select("person", "id", "kept", "clash")
