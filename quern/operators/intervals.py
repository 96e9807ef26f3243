"""Schedules: overlaps, free windows, the greedy clash filter over runs of overlapping slots, and anchored rate windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import dealt, new_path, remove, stored


def overlaps(slots: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs a < b of the same keys whose half-open intervals [s, e) meet. slots: id, s, e and the keys; a slot longer than width is an error.

    Slots are cut into bins of `width`, so that a busy key is many small groups; a slot lies in at most two bins, and a pair is
    reported only from the bin where the later of the two starts.
    """
    fits = F.when(F.col("e") - F.col("s") <= width, F.col("e")).otherwise(F.raise_error(F.lit(f"a slot is longer than {width}")).cast("long"))
    binned = slots.withColumn("e", fits).withColumn("bin", F.explode(F.array_distinct(F.array(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)))))
    a, b = (binned.select(*by, "bin", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "s", "e")]) for x in "ab")
    meet = (F.col("s_a") < F.col("e_b")) & (F.col("s_b") < F.col("e_a")) & (F.col("id_a") < F.col("id_b"))
    here = F.floor(F.greatest("s_a", "s_b") / width) == F.col("bin")
    return a.join(b, [*by, "bin"]).where(meet & here).select(*by, F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def running_end(slots: DataFrame, by: list[str], width: int) -> DataFrame:
    """The keys, s, e and `before` for each distinct start s of a key: the latest end at s, and the latest of all earlier starts (null at the
    first). Slots that start alike are folded first. The running maximum is taken within bins of `width` and then over one row a
    bin, so a busy key is many small windows."""
    folded = slots.groupBy(*by, "s").agg(F.max("e").alias("e")).withColumn("bin", F.floor(F.col("s") / width))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = folded.withColumn("local", F.max("e").over(earlier(Window.partitionBy(*by, "bin").orderBy("s"))))
    bins = folded.groupBy(*by, "bin").agg(F.max("e").alias("e"))
    carried = bins.select(*by, "bin", F.max("e").over(earlier(Window.partitionBy(*by).orderBy("bin"))).alias("carry"))
    return inside.join(carried, [*by, "bin"]).select(*by, "s", "e", F.greatest("local", "carry").alias("before"))


def free_windows(busy: DataFrame, by: list[str], least: int, width: int = 1440) -> DataFrame:
    """Gaps of at least `least` between the busy intervals (s, e) of each key."""
    gaps = running_end(busy, by, width).where(F.col("s") - F.col("before") >= least)
    return gaps.select(*by, F.col("before").alias("from"), F.col("s").alias("to"))


def islands(slots: DataFrame, by: list[str], width: int) -> DataFrame:
    """The slots with `island`, the start of the run of overlapping slots that each stands in: a run ends where nothing of it goes on."""
    ends = running_end(slots, by, width)
    heads = ends.withColumn("head", F.when(F.col("before").isNull() | (F.col("s") >= F.col("before")), F.col("s"))).withColumn("bin", F.floor(F.col("s") / width))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    inside = heads.withColumn("local", F.max("head").over(upto(Window.partitionBy(*by, "bin").orderBy("s"))))
    bins = heads.groupBy(*by, "bin").agg(F.max("head").alias("head"))
    carried = bins.select(*by, "bin", F.max("head").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    named = inside.join(carried, [*by, "bin"]).select(*by, "s", F.coalesce("local", "carry").alias("island"))
    return slots.join(named, [*by, "s"])


_HELD = "struct<held:array<struct<id:long,s:long,e:long>>,said:array<struct<id:long,kept:boolean,clash:long>>>"


def clash_filter(proposals: DataFrame, by: list[str], fixed: DataFrame | None = None, width: int = 240, rows: int | None = None) -> DataFrame:
    """The keys, id, kept and clash of proposals: each, in its order, is kept unless it overlaps a fixed point or one kept before; `clash` is
    the first such obstacle, fixed points first.

    proposals: the keys, nth, id, s, e. fixed: the same, what stays in the plan; a proposal that is fixed itself is kept. Of repeated
    proposals each is judged. Proposals without times are kept. Only runs of overlapping slots are folded: what clashes with nothing is
    a run of its own. rows: how many of both there are at most; very many are dealt by key to shares of bounded rows.
    """
    columns = [*by, "nth", "id", "s", "e"]
    timed = proposals.select(*columns, F.lit(1).alias("kind"))
    if fixed is not None:
        timed = timed.unionByName(fixed.select(*columns, F.lit(0).alias("kind")))
    whole = F.col("s").isNotNull() & F.col("e").isNotNull()
    runs = dealt(islands(dealt(timed.where(whole), rows, *by), by, width), rows, *by, "island").groupBy(*by, "island").agg(F.array_sort(F.collect_list(F.struct("kind", "nth", "id", "s", "e"))).alias("slots"))
    alone = runs.where(F.size("slots") == 1).select(*by, F.inline("slots")).where("kind = 1").select(*by, "id", F.lit(True).alias("kept"), F.lit(None).cast("long").alias("clash"))

    def step(acc: Column, x: Column) -> Column:
        slot = F.struct(x["id"].cast("long").alias("id"), x["s"].cast("long").alias("s"), x["e"].cast("long").alias("e"))
        hit = F.get(F.filter(acc["held"], lambda y: (y["id"] != x["id"]) & (y["s"] < x["e"]) & (x["s"] < y["e"])), F.lit(0))
        planned = F.exists(acc["held"], lambda y: y["id"] == x["id"]) & (x["kind"] == 1)
        fine = (x["kind"] == 0) | planned | hit["id"].isNull()
        held = F.when(fine & ~planned, F.array_append(acc["held"], slot)).otherwise(acc["held"])
        said = F.struct(x["id"].cast("long").alias("id"), fine.alias("kept"), F.when(~fine, hit["id"]).alias("clash"))
        return F.struct(held.alias("held"), F.when(x["kind"] == 1, F.array_append(acc["said"], said)).otherwise(acc["said"]).alias("said")).cast(_HELD)

    start = F.struct(F.array().alias("held"), F.array().alias("said")).cast(_HELD)
    folded = runs.where(F.size("slots") > 1).select(*by, F.inline(F.aggregate("slots", start, step, lambda acc: acc["said"])))
    timeless = proposals.where(~whole).select(*by, F.col("id").cast("long").alias("id"), F.lit(True).alias("kept"), F.lit(None).cast("long").alias("clash"))
    return alone.withColumn("id", F.col("id").cast("long")).unionByName(folded).unionByName(timeless)


def anchors(hits: DataFrame, by: list[str], window: int) -> DataFrame:
    """The keys and the starts s of the windows of `window` that open at a key's first hit and at the first hit after each window's end.

    Every hit's next anchor is the first hit outside its window. A hit after a gap as long as a window is an anchor whatever came before,
    so chains start there; the links are doubled until no chain goes on, in steps that grow with the logarithm of the longest. hits:
    the keys and s. Windows are over bins as long as a window, so a busy key is many small ones.
    """
    times = hits.select(*by, "s").distinct().withColumn("bin", F.floor(F.col("s") / window))
    firsts = times.groupBy(*by, "bin").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    order = Window.partitionBy(*by).orderBy("bin")
    firsts = firsts.select(*by, "bin", "first", F.lag("last").over(order).alias("left"))
    near = Window.partitionBy(*by, "bin").orderBy("s")
    starts = times.withColumn("ahead", F.lag("s").over(near)).join(firsts, [*by, "bin"]).withColumn("ahead", F.coalesce("ahead", "left"))
    heads = starts.where(F.col("ahead").isNull() | (F.col("s") - F.col("ahead") >= window)).select(*by, "s")
    # the end of a window lies in the next bin: the first hit there from it on, else the first of the next bin that has one
    asked = times.select(*by, (F.col("bin") + 1).alias("bin"), (F.col("s") + window).alias("at"), F.col("s").alias("from"))
    marks = asked.select(*by, "bin", "at", F.lit(1).alias("kind"), "from").unionByName(times.select(*by, "bin", F.col("s").alias("at"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("from")))
    coming = Window.partitionBy(*by, "bin").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    found = marks.withColumn("next", F.first(F.when(F.col("kind") == 2, F.col("at")), ignorenulls=True).over(coming)).where("kind = 1")
    later = firsts.select(*by, F.col("bin").alias("b"), "first").unionByName(asked.select(*by, F.col("bin").alias("b"), F.lit(None).cast("long").alias("first")).distinct())
    beyond = later.groupBy(*by, "b").agg(F.max("first").alias("first"))
    after = beyond.withColumn("beyond", F.first("first", ignorenulls=True).over(Window.partitionBy(*by).orderBy("b").rowsBetween(1, Window.unboundedFollowing)))
    links = found.join(after.select(*by, F.col("b").alias("bin"), "beyond"), [*by, "bin"]).select(*by, F.col("from").alias("s"), F.coalesce("next", "beyond").alias("next"))
    links = links.where("next IS NOT NULL").join(heads.withColumnRenamed("s", "next"), [*by, "next"], "left_anti")  # chains end at the next head
    spark = hits.sparkSession
    marked, link_path, mark_path = None, new_path(spark, "anchor-links"), new_path(spark, "anchors")
    marked, links = stored(heads, mark_path), stored(links, link_path)
    while True:
        more = marked.join(links, [*by, "s"]).select(*by, F.col("next").alias("s"))
        if more.isEmpty():
            return marked
        before_marks, before_links = mark_path, link_path
        mark_path, link_path = new_path(spark, "anchors"), new_path(spark, "anchor-links")
        marked = stored(marked.unionByName(more).distinct(), mark_path)
        links = stored(links.join(links.select(*by, F.col("s").alias("next"), F.col("next").alias("further")), [*by, "next"]).select(*by, "s", F.col("further").alias("next")), link_path)
        remove(spark, before_marks)
        remove(spark, before_links)


def rate_limited(hits: DataFrame, by: list[str], limit: int, window: int) -> DataFrame:
    """The hits (the keys, id, s) with `allowed`: the first `limit` of each window, in the order of s and id."""
    opened = anchors(hits, by, window).withColumnRenamed("s", "anchor").withColumn("bin", F.explode(F.array_distinct(F.array(F.floor(F.col("anchor") / window), F.floor((F.col("anchor") + window - 1) / window)))))
    placed = hits.withColumn("bin", F.floor(F.col("s") / window)).join(opened, [*by, "bin"]).where((F.col("s") >= F.col("anchor")) & (F.col("s") < F.col("anchor") + window))
    nth = F.row_number().over(Window.partitionBy(*by, "anchor").orderBy("s", "id"))
    return placed.select(*hits.columns, (nth <= limit).alias("allowed"))
