"""Mixing sources to target weights, in DataFrame functions only.

The words of each source form a stream, packed into blocks of a fixed length. Each source has a goal of output slots that adds up
to its target: whole passes over its blocks, then a part of one more pass whose last block is cut.

Every slot of every output shard draws its source with a chance proportional to the goals, by a seeded hash, so the source counts
of a shard are a multinomial draw. Prefix sums of these counts over the shards number each source's slots. A sum of draws misses a
goal by about its square root; slots that a source drew beyond its goal, chosen by a pseudorandom permutation, are settled upon the
sources that drew too few, so that the totals meet the goals. Slot k of a source then takes block p(k) of the pass at hand, where p
is a pseudorandom permutation of the block indexes, evaluated per index (swap-or-not rounds, exact for any number of blocks), and
slots and blocks are joined by index.

A source's order is fixed by hashes of its rows, so reruns agree. Offsets are two-level prefix sums: hash buckets of a source
first, rows within a bucket next, so a source that holds a third of all rows is spread over many tasks. What has one row a source
(goals, running totals) is assumed to fit one task; all else is spread.

Defined results: a null or empty text has size 0 and is never taken. A null source is a source of its own, the last. Repeated
rows are separate rows of the stream; rows of one doc_id and size stand in order of a hash of their columns (those of map type
left out), and rows alike in all of these may stand for one another. Extra columns may have any name. If nothing has words, all
targets are 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import column, materialise, row_hash, words_of

BLOCK_WORDS = 512
SHARD_SLOTS = 4096
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
ROUNDS = 24
SEED = 20
BUCKET_ROWS = 2_000
_CHUNK = 4096
_BINS = 4096


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """The image of index x under the keyed permutation of 0..n-1. Each round swaps x with its partner, or not."""
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        bit = F.xxhash64(key, r, F.greatest(at, partner)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in order]), x.cast("long"), swap)


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, size in words, a hash to break ties by, the source as (no_src, src), and the columns to keep."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")
    source = F.col("source").cast("string")
    tie = row_hash(docs).alias("tie")
    return docs.select("doc_id", size.alias("size"), tie, source.isNull().alias("no_src"), F.coalesce(source, F.lit("")).alias("src"), *keep)


def targets(sizes: DataFrame) -> DataFrame:
    """A row per source: sid (its rank), source_size, weight, target, and how its slots are made up.

    The targets fill up as water does: in ascending order of limit / weight, a source whose share of what is left exceeds its
    limit stays at the limit, and the first that doesn't fixes the share of all after it.
    """
    per = sizes.groupBy("no_src", "src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("no_src", "src"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("sid", (rank - 1).cast("long")).withColumn("weight", weight).withColumn("most", MAX_REPEATS * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    per = per.withColumn("share", left.cast("double") / F.sum("weight").over(onward).cast("double"))
    per = per.withColumn("level", F.min_by("share", F.when(F.col("weight") * F.col("share") <= F.col("most"), F.col("most") / F.col("weight"))).over(everything))
    per = per.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0))))
    size, n = F.col("source_size"), F.col("n_blocks")
    per = per.where("source_size > 0").select(
        "no_src", "src", "sid", "source_size", "target",
        F.expr(f"(source_size + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}").alias("n_blocks"),
        F.least(F.lit(MAX_REPEATS).cast("long"), F.floor(F.col("target") / size)).alias("passes"),
    ).unionByName(per.where("source_size = 0").select("no_src", "src", "sid", "source_size", "target", F.lit(0).cast("long").alias("n_blocks"), F.lit(0).cast("long").alias("passes")))
    per = per.withColumn("rest", F.greatest(F.lit(0).cast("long"), F.least(size, F.round("target").cast("long") - F.col("passes") * size)))
    per = per.withColumn("rest", F.when(F.col("passes") >= MAX_REPEATS, F.lit(0).cast("long")).otherwise(F.col("rest")))
    last = permuted(n - 1, n, F.xxhash64(F.lit(SEED), "sid", "passes"), inverse=True)
    per = per.withColumn("tail", size - (n - 1) * BLOCK_WORDS).withColumn("tail_at", F.when(n > 0, last))
    short = F.expr(f"(rest + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}")
    longer = F.expr(f"(rest + 2 * {BLOCK_WORDS} - tail - 1) div {BLOCK_WORDS}")
    extra = F.when(F.col("rest") <= F.col("tail_at") * BLOCK_WORDS, short).otherwise(F.greatest(F.col("tail_at") + 1, longer))
    return per.withColumn("n_slots", F.when(n > 0, F.col("passes") * n + extra).otherwise(F.lit(0)).cast("long"))


def before(df: DataFrame, group: list[str], index: str, value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` over the rows of the group with a smaller `index`; no task sorts more than _CHUNK indexes of a group."""
    ahead = Window.unboundedPreceding, -1
    chunked = df.withColumn("chunk", F.expr(f"{index} div {_CHUNK}"))
    totals = chunked.groupBy(*group, "chunk").agg(F.sum(value).alias("chunk_sum"))
    outer = F.sum("chunk_sum").over(Window.partitionBy(*group).orderBy("chunk").rowsBetween(*ahead))
    totals = totals.select(*group, "chunk", F.coalesce(outer, F.lit(0)).alias("outer_sum"))
    inner = F.sum(value).over(Window.partitionBy(*group, "chunk").orderBy(index).rowsBetween(*ahead))
    joined = chunked.withColumn("inner_sum", F.coalesce(inner, F.lit(0))).join(totals, [*group, "chunk"])
    return joined.withColumn(name, F.col("outer_sum") + F.col("inner_sum")).drop("chunk", "outer_sum", "inner_sum")


def placed(sizes: DataFrame, goals: DataFrame, rows: int) -> DataFrame:
    """Each row of `sizes` with its source's goals and `start`, its first word's index in the source's stream."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    keyed = sizes.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size", "tie"), F.lit(buckets)))
    key = ["no_src", "src", "bucket"]
    totals = keyed.groupBy(*key).agg(F.sum("size").alias("words"))
    offsets = before(totals, key[:2], "bucket", "words", "offset").drop("words").join(goals, ["no_src", "src"])
    within = Window.partitionBy(*key).orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ordered = keyed.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return ordered.join(offsets, key).withColumn("start", F.col("offset") + F.col("within")).drop("offset", "within", "bucket", "tie")


def located(rows: DataFrame, ranges: DataFrame, x: str, total: int) -> DataFrame:
    """Rows joined with the range [low, high) of 0..total-1 that holds their x, by equality of bins."""
    width = max(1, -(-total // _BINS))
    bins = F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})"))
    spread = ranges.where("low < high").withColumn("bin", bins)
    found = rows.withColumn("bin", F.expr(f"{x} div {width}")).join(spread.hint("merge"), "bin")  # a size estimated before an explode would broadcast the rows
    return found.where((F.col(x) >= F.col("low")) & (F.col(x) < F.col("high"))).drop("bin")


def draws(goals: DataFrame) -> DataFrame:
    """A row per output slot: shard, slot (its place there) and the sid it draws, with a chance proportional to the goals."""
    total = goals.agg(F.sum("n_slots")).first()[0] or 0
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    ranges = goals.select("sid", "n_slots", F.sum("n_slots").over(upto).alias("high")).select("sid", (F.col("high") - F.col("n_slots")).alias("low"), "high")
    shards = goals.sparkSession.range(-(-total // SHARD_SLOTS)).withColumnRenamed("id", "shard")
    each = shards.withColumn("slot", F.explode(F.expr(f"sequence(0L, least({SHARD_SLOTS}L, {total}L - shard * {SHARD_SLOTS}) - 1)")))
    drawn = each.withColumn("x", F.pmod(F.xxhash64(F.lit(SEED), F.lit("draw"), "shard", "slot"), F.lit(max(1, total)).cast("long")))
    return located(drawn, ranges, "x", total).select("shard", "slot", "sid")


def shard_counts(drawn: DataFrame) -> DataFrame:
    """Slots that each source drew in each output shard: a multinomial draw for every shard."""
    return drawn.groupBy("shard", "sid").agg(F.count("*").alias("n"))


def slots(goals: DataFrame) -> DataFrame:
    """One row per output slot: its shard and place there, and the sid, pass, block and number of words it takes of the block."""
    drawn = materialise(draws(goals), "mix-draws")
    counts = materialise(shard_counts(drawn), "mix-counts")
    sums = goals.join(counts.groupBy("sid").agg(F.sum("n").alias("n_drawn")), "sid", "left").withColumn("n_drawn", F.coalesce("n_drawn", F.lit(0).cast("long")))
    zero, upto = F.lit(0).cast("long"), Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    over, lack = F.greatest(zero, F.col("n_drawn") - F.col("n_slots")), F.greatest(zero, F.col("n_slots") - F.col("n_drawn"))
    sums = sums.select("*", over.alias("over"), lack.alias("lack")).select("*", F.sum("over").over(upto).alias("over_to"), F.sum("lack").over(upto).alias("high"))
    goal = F.struct("n_blocks", "passes", "rest", "tail", "tail_at").alias("goal")
    sums = materialise(sums.select("sid", "n_drawn", "n_slots", (F.col("over_to") - F.col("over")).alias("over_from"), (F.col("high") - F.col("lack")).alias("low"), "high", goal), "mix-sums")
    ahead = before(counts, ["sid"], "shard", "n", "ahead").drop("n").join(sums.drop("low", "high"), "sid")
    nth = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    own = drawn.withColumn("nth", nth).join(ahead, ["shard", "sid"])
    own = own.withColumn("k", permuted(F.col("ahead") + F.col("nth"), F.col("n_drawn"), F.xxhash64(F.lit(SEED), F.lit("settle"), "sid")))
    stay = own.where("k < n_slots").select("shard", "slot", "sid", "k", "goal")
    moved = own.where("k >= n_slots").select("shard", "slot", (F.col("over_from") + F.col("k") - F.col("n_slots")).alias("e"))
    lacking = sums.select("sid", "n_drawn", "low", "high", "goal")
    moved = located(moved, lacking, "e", sums.agg(F.max("high")).first()[0] or 0)
    moved = moved.select("shard", "slot", "sid", (F.col("n_drawn") + F.col("e") - F.col("low")).alias("k"), "goal")
    each = stay.unionByName(moved).select("shard", "slot", "sid", F.col("k").alias("nth"), "goal.*")
    each = each.withColumn("pass", F.expr("nth div n_blocks")).withColumn("k", F.expr("nth % n_blocks"))
    each = each.withColumn("block", permuted(F.col("k"), F.col("n_blocks"), F.xxhash64(F.lit(SEED), "sid", "pass")))
    length = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("tail")).otherwise(F.lit(BLOCK_WORDS)).cast("long")
    earlier = F.col("k") * BLOCK_WORDS - F.when(F.col("k") > F.col("tail_at"), BLOCK_WORDS - F.col("tail")).otherwise(F.lit(0))
    cut = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - earlier))
    return materialise(each.select("shard", "slot", "sid", "pass", "block", cut.alias("cut")), "mix-slots")


def pieces(where: DataFrame) -> DataFrame:
    """Rows of `where` once for each block they reach into, with the span [lo, hi) of the block that is theirs."""
    size = F.expr(f"explode(sequence(start div {BLOCK_WORDS}, (start + size - 1) div {BLOCK_WORDS}))")
    cut = where.where("size > 0").select("*", size.alias("block"))
    first = F.col("block") * BLOCK_WORDS
    return cut.withColumn("lo", F.greatest("start", first) - first).withColumn("hi", F.least(F.col("start") + F.col("size"), first + BLOCK_WORDS) - first)


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, and the first output shard that holds words of it."""
    sizes = materialise(sized(docs), "mix-sizes")
    goals = materialise(targets(sizes), "mix-goals")
    where = materialise(placed(sizes, goals, sizes.count()).select("doc_id", "size", "source_size", "target", "sid", "start"), "mix-places")
    taken = F.when(F.col("cut") > F.col("lo"), F.least("hi", "cut") - F.col("lo")).otherwise(F.lit(0).cast("long"))
    joined = pieces(where).join(slots(goals).hint("merge"), ["sid", "block"], "left")
    first = F.min(F.when(taken > 0, F.col("shard"))).alias("first_shard")
    some = joined.groupBy("sid", "start", "doc_id", "size", "source_size", "target").agg(F.sum(taken).alias("taken"), first)
    none = where.where("size = 0").select("*", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    names = ["doc_id", "size", "source_size", "target", "taken", "first_shard"]
    return some.select(names).unionByName(none.select(names))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row for each document and pass that takes some of its words, repeats counted.

    A text that is taken whole stays as it is; of one that is cut, the taken words remain, joined by single spaces, and
    `n_chars` is counted anew. Documents of which nothing is taken go.
    """
    columns = docs.columns
    kept = [column(c).alias(f"doc__{i}") for i, c in enumerate(columns)]
    named = docs.select("doc_id", "text", "source", *kept)
    sizes = materialise(sized(named, *[f"doc__{i}" for i in range(len(columns))]), "mix-texts")
    goals = materialise(targets(sizes.select("doc_id", "size", "no_src", "src")), "mix-goals")
    where = materialise(placed(sizes, goals, sizes.count()).drop("no_src", "src"), "mix-places")
    joined = pieces(where.select("sid", "start", "size")).join(slots(goals).hint("merge"), ["sid", "block"]).where("cut > lo")
    span = F.struct((F.col("block") * BLOCK_WORDS + F.col("lo") - F.col("start")).alias("a"), (F.col("block") * BLOCK_WORDS + F.least("hi", "cut") - F.col("start")).alias("b"))
    takes = joined.groupBy("sid", "start", "pass").agg(F.collect_list(span).alias("spans"), F.sum(F.least("hi", "cut") - F.col("lo")).alias("n"))
    out = where.where("size > 0").join(takes.hint("merge"), ["sid", "start"])
    text = F.col(f"doc__{columns.index('text')}")
    in_order = F.sort_array("spans")
    cut = F.transform(F.array(words_of(text)), lambda ws: F.flatten(F.transform(in_order, lambda s: F.slice(ws, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))))
    text = F.when(F.col("n") == F.col("size"), text).otherwise(F.array_join(F.get(cut, F.lit(0)), " "))
    out = out.withColumn("mixed_text", text)
    new = {"text": F.col("mixed_text"), "n_chars": F.length("mixed_text").cast("long")}
    return out.select(*[new.get(c, F.col(f"doc__{i}")).alias(c) for i, c in enumerate(columns)])
