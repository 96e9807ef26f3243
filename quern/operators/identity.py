"""Entity identity: records that share any key are one entity; survivors are merged from all members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import new_path, remove, stored


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node it is linked with, for all nodes of the edges (a, b). Large-star and small-star rounds.
    Their joins are merges: a broadcast of what grows with the edges would pass through the driver."""
    spark = edges.sparkSession
    paths = [new_path(spark, "components")]
    now, state = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), paths[0]), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(lowest.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        paths.append(new_path(spark, "components"))
        now = stored(rest.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), paths[-1])
        remove(spark, paths.pop(0))
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if was == state:
            tops = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops)


def resolve(records: DataFrame) -> DataFrame:
    """id and entity, the smallest id of all records linked by shared keys. records: id, keys (array).

    A key links its records to the smallest of them, so a key shared by very many costs one edge each.
    """
    keyed = records.select("id", F.explode("keys").alias("key"))
    edges = keyed.join(keyed.groupBy("key").agg(F.min("id").alias("b")), "key").select(F.col("id").alias("a"), "b")
    found = components(edges)
    return records.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("entity"))
