"""Claims of test cases, verified against facts; and checks of a suite of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import sentences as sn


def facts(records: DataFrame, kind: str, key: Column, fields: dict[str, Column]) -> DataFrame:
    """kind, key, field and value (text) of records, one row a field; the key is compared in its normal form."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()])
    return records.select(F.lit(kind).alias("kind"), sn.norm(key.cast("string")).alias("key"), F.inline(each))


def verify(claims: DataFrame, known: DataFrame) -> DataFrame:
    """The claims with `error`, null if the claim holds. claims: case, claim, kind, key, field, want.

    `equals`, `contains` and `missing` speak of one field of a record, `closed` of its isClosedDoor, `none` says that no record of the
    kind has the field, and `count` that so many have it. A claim meets its facts by equality of (kind, key, field).
    """
    per = known.groupBy("kind", "key", "field").agg(F.max("value").alias("value"))
    records = known.select("kind", "key").distinct().withColumn("there", F.lit(True))
    filled = per.groupBy("kind", "field").agg(F.count_if(F.coalesce(F.btrim("value"), F.lit("")) != "").alias("filled"))
    asked = claims.withColumn("field", F.when(F.col("claim") == "closed", "isClosedDoor").otherwise(F.col("field"))).withColumn("key", sn.norm(F.col("key")))
    found = asked.join(per, ["kind", "key", "field"], "left").join(records, ["kind", "key"], "left").join(filled, ["kind", "field"], "left")
    got, want = F.coalesce("value", F.lit("")), F.coalesce("want", F.lit(""))
    about_one = F.col("claim").isin("equals", "contains", "missing", "closed")
    closed = F.lower(got).isin("true", "1", "y")
    error = (
        F.when(about_one & F.col("there").isNull(), F.concat(F.lit("no record of "), F.coalesce("key", F.lit(""))))
        .when((F.col("claim") == "equals") & (got != want), F.concat(F.lit("is "), got))
        .when((F.col("claim") == "contains") & ~sn.holds(sn.padded(got), want), F.concat(F.lit("does not hold "), want))
        .when((F.col("claim") == "missing") & (F.btrim(got) != ""), F.lit("is present"))
        .when((F.col("claim") == "closed") & (closed != (F.lower(want) == "true")), F.lit("is otherwise"))
        .when((F.col("claim") == "none") & (F.coalesce("filled", F.lit(0)) > 0), F.concat(F.col("filled").cast("string"), F.lit(" have it")))
        .when((F.col("claim") == "count") & (F.coalesce("filled", F.lit(0)).cast("string") != want), F.concat(F.lit("counts "), F.coalesce("filled", F.lit(0)).cast("string")))
        .when(~about_one & ~F.col("claim").isin("none", "count"), F.concat(F.lit("unknown claim "), F.col("claim")))
    )
    return found.select("case", "claim", "kind", "key", "field", "want", error.alias("error"))


def appears(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """phrase and `n`, the number of texts that hold it as whole words. A phrase meets the texts that have its
    first word: words and ids are joined alone, and each text is read once more, with the phrases it may hold."""
    asked = phrases.select("phrase", sn.norm(F.col("phrase")).alias("p")).where("p <> ''").distinct().withColumn("word", F.split_part("p", F.lit(" "), F.lit(1)))
    words = texts.select("id", F.explode(F.array_distinct(F.split(F.btrim(sn.padded(F.col("text"))), " "))).alias("word"))
    near = words.join(asked, "word").groupBy("id").agg(F.collect_set(F.struct("phrase", "p")).alias("near"))  # no more than the phrases of a suite
    held = lambda x: F.contains(F.col("pad"), F.concat(F.lit(" "), x["p"], F.lit(" ")))
    met = texts.select("id", sn.padded(F.col("text")).alias("pad")).join(near, "id").select("id", F.explode(F.transform(F.filter("near", held), lambda x: x["phrase"])).alias("phrase"))
    return phrases.select("phrase").distinct().join(met.groupBy("phrase").agg(F.countDistinct("id").alias("n")), "phrase", "left").select("phrase", F.coalesce("n", F.lit(0)).alias("n"))


def validate(cases: DataFrame, detectors: set[str], present: DataFrame, generic: tuple[str, ...] = ()) -> DataFrame:
    """case, level and problem of a suite: ids used twice, no checks, unknown detectors, no claims, expected texts in no record.

    cases: case, checks (array of detector and expected texts), n_claims. present: phrase, n, as `appears` gives them.
    """
    repeated = cases.groupBy("case").agg(F.count("*").alias("k")).where("k > 1").select("case", F.lit("error").alias("level"), F.lit("id used twice").alias("problem"))
    bare = cases.where(F.size("checks") <= 0).select("case", F.lit("error").alias("level"), F.lit("no checks").alias("problem"))
    each = cases.select("case", F.inline("checks"))
    unknown = each.where(F.col("detector").isNull() | ~F.col("detector").isin(*sorted(detectors)))
    unknown = unknown.select("case", F.lit("error").alias("level"), F.concat(F.lit("unknown detector "), F.coalesce("detector", F.lit("null"))).alias("problem"))
    unproven = cases.where("n_claims = 0").select("case", F.lit("warning").alias("level"), F.lit("no claims").alias("problem"))
    expected = each.select("case", F.explode("expected").alias("phrase")).where(~sn.norm(F.col("phrase")).isin(*generic) if generic else F.lit(True))
    untraced = expected.join(present.where("n > 0"), "phrase", "left_anti").select("case", F.lit("warning").alias("level"), F.concat(F.lit("in no record: "), F.col("phrase")).alias("problem"))
    return repeated.unionByName(bare).unionByName(unknown).unionByName(unproven).unionByName(untraced)


def verify_texts(asked: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """Claims about texts with `error`, null if the claim holds: 'present' and 'absent' speak of the present texts, 'prior' of the earlier ones.

    asked: case, claim, want. now, before: id, text. A text holds `want` as whole words in its normal form.
    """
    phrases = asked.select(F.col("want").alias("phrase")).distinct()
    found = appears(phrases, now).withColumnRenamed("n", "n_now").join(appears(phrases, before).withColumnRenamed("n", "n_before"), "phrase")
    met = asked.join(found, asked["want"] == found["phrase"], "left")
    said = lambda x: F.concat(F.col("want"), F.lit(x))
    error = (
        F.when((F.col("claim") == "present") & (F.col("n_now") == 0), said(" does not appear"))
        .when((F.col("claim") == "absent") & (F.col("n_now") > 0), said(" does appear"))
        .when((F.col("claim") == "prior") & (F.col("n_before") == 0), said(" does not appear before"))
        .when(~F.col("claim").isin("present", "absent", "prior"), F.concat(F.lit("unknown claim "), F.col("claim")))
    )
    return met.select("case", "claim", "want", error.alias("error"))
