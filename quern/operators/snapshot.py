"""Snapshots: differences, protected upserts with soft withdrawal, and plan edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx


def same(a: Column, b: Column) -> Column:
    """Null and blank are alike."""
    return F.nullif(a.cast("string"), F.lit("")).eqNullSafe(F.nullif(b.cast("string"), F.lit("")))


def diff(old: DataFrame, new: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """key, status (added, disappeared, changed, same) and the watched fields that changed, sorted."""
    o, n = (d.select(F.col(key), F.struct(*watched).alias(s), F.lit(True).alias(f"in_{s}")) for d, s in ((old, "o"), (new, "n")))
    both = o.join(n, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~same(F.col(f"o.{w}"), F.col(f"n.{w}")), F.lit(w)) for w in sorted(watched)]))
    status = F.when(F.col("in_o").isNull(), "added").when(F.col("in_n").isNull(), "disappeared").when(F.size(changed) > 0, "changed").otherwise("same")
    return both.select(key, status.alias("status"), F.when(status == "changed", changed).otherwise(F.array().cast("array<string>")).alias("fields"))


def upsert(old: DataFrame, new: DataFrame, key: str, protected: list[str], columns: list[str]) -> DataFrame:
    """The merged table: new values win, but protected fields keep what they have; vanished rows stay, withdrawn."""
    o, n = (d.select(F.col(key), F.struct(*columns).alias(s), F.lit(True).alias(f"in_{s}")) for d, s in ((old, "o"), (new, "n")))
    both = o.join(n, key, "full_outer")

    def merged(c: str) -> Column:
        first, second = (f"o.{c}", f"n.{c}") if c in protected else (f"n.{c}", f"o.{c}")
        return F.coalesce(F.col(first), F.col(second)).alias(c)

    return both.select(key, *[merged(c) for c in columns], F.when(F.col("in_n").isNull(), "withdrawn").otherwise("active").alias("status"))


def apply_ops(ids: Column, source: Column, remove: Column, add: Column, writer: str) -> tuple[Column, Column]:
    """A plan's ids and their sources after removals, then additions; the first writer of an id stays its source."""
    left = F.filter(ids, lambda x: ~F.array_contains(remove, x))
    fresh = F.filter(F.array_distinct(add), lambda x: ~F.array_contains(left, x))
    kept = F.map_filter(source, lambda k, _: F.array_contains(left, k))
    return F.concat(left, fresh), F.map_concat(kept, F.map_from_entries(F.transform(fresh, lambda x: F.struct(x, F.lit(writer)))))


def natural_key(parts: list[Column], fallback: list[Column]) -> Column:
    """A key of several parts; where one is null, the fallback's parts behind a mark of their own."""
    missing = parts[0].isNull()
    for p in parts[1:]:
        missing = missing | p.isNull()
    joined = lambda cs: F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("?")) for c in cs])
    return F.when(missing, F.concat(F.lit("~"), joined(fallback))).otherwise(joined(parts))


def changes(old: DataFrame, new: DataFrame, key: str, watched: list[str], moved: set[str], title: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """Keys whose watched fields differ, with old and new values by field, what lists gained and lost, and whether they moved or got
    another title. Null and blank are alike; order within a list does not count, but how often a value stands in it does."""
    o, n = (d.select(F.col(key), F.struct(*watched, *lists).alias(s)) for d, s in ((old, "o"), (new, "n")))
    both = o.join(n, key)
    cell = lambda w: F.struct(F.lit(w).alias("field"), F.nullif(F.col(f"o.{w}").cast("string"), F.lit("")).alias("old"), F.nullif(F.col(f"n.{w}").cast("string"), F.lit("")).alias("new"))
    differing = F.array_compact(F.array(*[F.when(~same(F.col(f"o.{w}"), F.col(f"n.{w}")), cell(w)) for w in watched]))
    out = both.withColumn("fields", differing)
    none = F.array().cast("array<string>")
    touched = F.size("fields") > 0
    for c in lists:
        a, b = F.coalesce(F.col(f"o.{c}"), none), F.coalesce(F.col(f"n.{c}"), none)
        out = out.withColumn(f"{c}_added", _lacking(F.array_sort(b), a))
        out = out.withColumn(f"{c}_removed", _lacking(F.array_sort(a), b))
        touched = touched | ~F.array_sort(a).eqNullSafe(F.array_sort(b))
    names = F.transform("fields", lambda x: x["field"])
    flags = (F.arrays_overlap(names, F.array(*map(F.lit, sorted(moved)))).alias("rescheduled"), F.array_contains(names, F.lit(title)).alias("retitled"))
    return out.where(touched).select(key, "fields", *[f"{c}_{x}" for c in lists for x in ("added", "removed")], *flags)


def _lacking(values: Column, others: Column) -> Column:
    return F.filter(values, lambda x: ~F.array_contains(others, x))


def report(rows: DataFrame, kind: str, order: str, caps: dict[str, int | None]) -> DataFrame:
    """The first lines of each kind of change, in order, and `more`, how many are left out; a cap of None shows all."""
    nth = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    counted = rows.withColumn("nth", nth)
    shown = F.lit(True)
    for name, most in caps.items():
        if most is not None:
            shown = shown & ((F.col(kind) != name) | (F.col("nth") <= most))
    total = rows.groupBy(kind).agg(F.count("*").alias("total"))
    kept = counted.where(shown)
    left = kept.groupBy(kind).agg(F.count("*").alias("kept")).join(total, kind).select(kind, (F.col("total") - F.col("kept")).alias("more"))
    return kept.join(left, kind)


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of `incoming` whose key is not there yet: what an insert would write, and what a dry run counts."""
    return incoming.join(existing.select(key), key, "left_anti")


def fill_blank(base: DataFrame, donor: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The base with blank fields filled from the donor's row of the same key; a donor has each key once."""
    given = donor.select(key, *[F.col(c).alias(f"d_{c}") for c in columns])
    blank = lambda c: F.nullif(F.btrim(F.col(c)), F.lit(""))
    joined = base.join(given, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(blank(c).isNull(), F.col(f"d_{c}")).otherwise(F.col(c)))
    return joined.drop(*[f"d_{c}" for c in columns])


def aliases(old: Column, new: Column) -> Column:
    """Both lists of aliases as one, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(old, none), F.coalesce(new, none)))


def sourced(records: DataFrame, traced: DataFrame) -> DataFrame:
    """One record an entity of two writers' records, field by field by trust: traced text and uses win, else the other writer's are shown and
    marked unsourced; theirs are kept apart in any case; names that go become aliases; blanks are filled from the other record and
    then from what is traced; the other's id is `deleted`.

    status: 'merged' (both wrote it), 'upgraded' (only the other did), 'untouched' (only we did, which stays as it is). records: entity, id,
    theirs, name, text, uses, tier, website; of several the smallest id counts. traced: name, text, uses, confidence, website, met by
    name whatever its case. Everything combines map-side.
    """
    fields = F.struct("id", "name", "text", "uses", "tier", "website")
    blank = records.select("entity", "id", "theirs", "name", *[tx.clean(c).alias(c) for c in ("text", "tier", "website")], F.coalesce("uses", F.array().cast("array<string>")).alias("uses"))
    of = lambda test: F.min_by(fields, F.when(test, F.col("id")))
    per = blank.groupBy("entity").agg(of(~F.col("theirs")).alias("ours"), of(F.col("theirs")).alias("them"))
    both = F.col("ours").isNotNull() & F.col("them").isNotNull()
    status = F.when(both, "merged").when(F.col("them").isNotNull(), "upgraded").otherwise("untouched")
    base = per.select("entity", status.alias("status"), F.coalesce("ours", "them").alias("b"), F.when(both, F.col("them")).alias("x"), F.col("them").alias("u"))
    known = traced.groupBy(F.lower(F.btrim("name")).alias("key")).agg(F.min_by(F.struct("name", tx.clean("text").alias("text"), "uses", "confidence", tx.clean("website").alias("website")), "name").alias("s"))
    keyed = base.withColumn("key", F.when(F.col("status") != "untouched", F.lower(F.btrim("b.name"))))
    m = keyed.join(known, "key", "left")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    changed = F.col("status") != "untouched"
    aliases = F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(F.col("x.name") != F.col("b.name"), F.col("x.name")), F.when(F.col("s.name") != F.col("b.name"), F.col("b.name"))))))
    shown = F.coalesce("u.text", "b.text")
    method = F.when(changed & F.col("s.text").isNotNull(), "traced").when(changed & shown.isNotNull(), "unsourced")
    return m.select(
        "entity", "status", F.col("b.id").alias("id"), F.coalesce("s.name", "b.name").alias("name"), aliases.alias("aliases"), F.coalesce(F.col("s.text"), shown).alias("text"), method.alias("text_method"),
        F.when(method == "traced", F.coalesce("s.confidence", F.lit("medium"))).when(method == "unsourced", "low").alias("confidence"),
        F.when(some("s.uses"), F.col("s.uses")).when(some("u.uses"), F.col("u.uses")).otherwise(F.col("b.uses")).alias("uses"), F.when(some("s.uses"), "traced").when(some("u.uses"), "unsourced").alias("uses_method"),
        F.when(F.col("u.text").isNotNull() | some("u.uses"), F.struct("u.text", "u.uses")).alias("unsourced"), F.coalesce("b.tier", "x.tier").alias("tier"), F.coalesce("b.website", "x.website", "s.website").alias("website"), F.col("x.id").alias("deleted"),
    )
