"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most three bits differ in at
most one bit of some segment, so they share a variant of that segment with one bit wildcarded. Variants are indexed,
equality-joined and verified. Exact copies are folded to one fingerprint first; a variant that very many fingerprints share
is cut again on its other segment, which is exact too, so no bucket is capped.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and links like any other; texts of
one or two words have their whole sequence as the only shingle. Repeated rows share fingerprint and component; a doc_id
that stands on several rows keeps one row for each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column, map_batches, materialise, new_path, remove, row_hash, stored, texts_of

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
SEGMENT_BITS = 32
#: A variant shared by more fingerprints than this is cut again before it is joined.
LARGE_BUCKET = 256
_CHUNK = 1 << 16
#: Every side of these joins grows with the corpus, so none is broadcast: the driver would hold it.
APART = "merge"


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z only) word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total, ones = max(1, len(words) - SHINGLE + 1), np.zeros(64, dtype=np.int64)
    for at in range(0, total, _CHUNK):
        end = min(total, at + _CHUNK)
        part = words[at : end + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=end - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in texts_of(batch)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found.view(np.int64))], ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, `row`, a hash of the whole row (columns of map type left out), and `fp`, the fingerprint as a signed long."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), "text")
    return map_batches(keyed, _fingerprints, "doc_id long, row long, fp long")


def _variants(at: Column, value: Column, bits: int) -> Column:
    """Key of one-wildcard variant `at` (0 to 2 * bits - 1) of the two `bits`-wide segments of `value`."""
    segment = F.expr(f"shiftrightunsigned({value}, cast({at} div {bits} * {bits} as int))").bitwiseAND(F.lit((1 << bits) - 1))
    hole = F.expr(f"shiftleft(1L, cast({at} % {bits} as int))")
    return F.expr(f"shiftleft(cast({at} as bigint), {bits})").bitwiseOR(segment.bitwiseAND(F.bitwise_not(hole)))


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs a < b of distinct fingerprints of `fps` (column fp) that differ in at most `max_distance` bits, each once."""
    if max_distance > 3:
        raise ValueError("two segments with one wildcard each find up to three differing bits")
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT_BITS - 1))).alias("at"))
    keyed = variants.select(_variants("at", "fp", SEGMENT_BITS).alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")  # combines map-side: no task holds a variant's fingerprints
    shared = materialise(keyed.join(sizes.hint(APART), "key"), "simhash-shared")
    usual = shared.where(F.col("n") <= LARGE_BUCKET).select("key", F.lit(0).cast("long").alias("key2"), "fp")
    other = F.expr(f"shiftrightunsigned(fp, cast(if(shiftrightunsigned(key, {SEGMENT_BITS}) < {SEGMENT_BITS}, {SEGMENT_BITS}, 0) as int))").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    large = (
        shared.where(F.col("n") > LARGE_BUCKET)
        .select("key", "fp", other.alias("other"), F.explode(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))).alias("at"))
        .select("key", _variants("at", "other", SEGMENT_BITS // 2).alias("key2"), "fp")
    )
    index = usual.unionByName(large)
    a, b = index.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    return a.join(b.hint(APART), ["key", "key2"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node` and `label`, the smallest node it is linked with, for each node of the edges (a, b).

    Alternates large-star and small-star until the edges no longer change. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    path, state = new_path(spark, "components"), None
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), path)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint(APART), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest.hint(APART), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        before, path = path, new_path(spark, "components")
        now = stored(small, path)
        remove(spark, before)
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if was == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, row, fp, component_id (the smallest doc_id reachable over links, the document itself included) and
    `group`, the component's smallest fingerprint, which tells components apart even where no row has a doc_id.
    """
    each = materialise(fingerprints(docs), "simhash")
    reps = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    found = components(links(reps.select("fp"))).withColumnRenamed("node", "fp")
    joined = found.join(reps.hint(APART), "fp")
    least = joined.groupBy("label").agg(F.min("rep").alias("least"))
    linked = joined.join(least.hint(APART), "label").select("fp", "label", "least")
    by_fp = reps.join(linked.hint(APART), "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), F.coalesce("label", "fp").alias("group"))
    return each.join(by_fp.hint(APART), "fp").select("doc_id", "row", "fp", "component_id", "group")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest doc_id (a null one last; ties go to the smaller row hash), with all its columns.

    The choice is made on ids and hashes alone; texts move once, to meet it. Of rows that are alike in every column one stays.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    chosen = cluster(docs).groupBy("group", "doc_id", "row").agg(F.count("*").alias("n"))
    chosen = chosen.groupBy("group").agg(F.min_by(F.struct("doc_id", "row", "n"), place).alias("c"))
    chosen = materialise(chosen.select(F.col("c.doc_id").alias("keep_id"), F.col("c.row").alias("keep_row"), F.col("c.n").alias("keep_n")), "simhash-kept")
    named = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"))

    def kept(some: DataFrame) -> DataFrame:
        return named.join(some.hint(APART), (F.col("row") == F.col("keep_row")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")

    once = kept(chosen.where("keep_n = 1"))
    again = kept(chosen.where("keep_n > 1")).dropDuplicates(["doc_id", "row"])
    return once.unionByName(again).select("doc.*")


def op10(docs: DataFrame) -> DataFrame:
    return cluster(docs.select("doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
