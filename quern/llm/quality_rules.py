"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy is
a versioned mask over those bits, so applying a policy or asking what each rule removes needs no second look at texts.

Defined results: a null or empty text has no words, lines or symbols and fails `too_short`. Repeated rows, and rows that
share a doc_id, are judged one by one. Extra columns of the input are ignored. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column, words_of

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]
#: A rule's bit is its place here: add new ones at the end.
RULES = ("too_short", "repeated_words", "symbol_heavy", "duplicate_lines", "word_length", "shouting")


def rules() -> dict[str, Column]:
    """Rule name -> failure condition over the measurements, in the order of RULES."""
    n = {m: F.col(m) for m in MEASURES}
    return {
        "too_short": n["n_words"] < 50,
        "repeated_words": 100 * n["n_repeat_words"] > 50 * n["n_words"],
        "symbol_heavy": 10 * n["n_symbols"] > n["n_words"],
        "duplicate_lines": 2 * n["n_dup_lines"] > n["n_lines"],
        "word_length": (n["word_chars"] < 2 * n["n_words"]) | (n["word_chars"] > 12 * n["n_words"]),
        "shouting": 2 * n["n_upper"] > n["word_chars"],
    }


@dataclass(frozen=True)
class Policy:
    """A version of the set of rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base-1", ("too_short", "repeated_words"))
PRODUCTION = Policy("production-1", RULES)


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep and the measurements of every text. All work is within a row, so nothing is shuffled.

    Windows of three words are compared by a 64-bit hash; only texts that repeat one sort their windows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0)
    parts = docs.select(
        "doc_id",
        *keep,
        words_of("text").alias("words"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    words = F.col("words")
    counted = parts.select(
        "doc_id",
        *keep,
        "n_symbols",
        "n_upper",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
            lambda word, i: F.xxhash64(word, F.get(words, i + 1), F.get(words, i + 2)),
        ).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    keyed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    ranked = counted.withColumn("ranked", F.when(repeats, F.sort_array(keyed))).drop("windows")
    near = F.col("ranked")
    twice = F.filter(near, lambda x, i: (x["h"] == F.get(near, i - 1)["h"]) | (x["h"] == F.get(near, i + 1)["h"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return ranked.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select("doc_id", *keep, *MEASURES)


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, the measurements, and `fail_bits`: bit i is set if the i-th rule fails.

    The partition's number stands in the bits: across it the optimizer does not move a filter, which would write out every
    measurement once for each use.
    """
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, fails in enumerate(rules().values())]
    fail_bits = bits[0]
    for bit in bits[1:]:
        fail_bits = fail_bits.bitwiseOR(bit)
    return measure(docs, *keep).withColumn("fail_bits", F.when(F.spark_partition_id() >= 0, fail_bits))


def rejected_by(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with `kept` and the policy's version."""
    return book.withColumn("kept", ~rejected_by(policy)).withColumn("policy", F.lit(policy.version))


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents it fails, those it alone rejects, and those kept if it were left out.

    The ledger is first folded to one row per combination of bits, at most 2 ** rules rows; no text is read again.
    """
    by_bits = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    bit = F.lit(1).cast("long")
    each = by_bits.withColumn("rule", F.explode(F.array(*[F.lit(r) for r in policy.rules])))
    mask = F.lit(0).cast("long")
    for r in policy.rules:
        mask = F.when(F.col("rule") == r, F.lit(1 << RULES.index(r)).cast("long")).otherwise(mask)
    hit = F.col("fail_bits").bitwiseAND(F.col("bit"))
    others = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long") - F.col("bit"))
    return (
        each.withColumn("bit", mask * bit)
        .groupBy("rule")
        .agg(
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("fails"),
            F.sum(F.when((hit != 0) & (others == 0), F.col("n")).otherwise(0)).alias("only_this"),
            F.sum(F.when(others == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def accepted(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The documents that the policy keeps, with their own columns, whatever their names; texts are measured where they lie."""
    named = docs.select("doc_id", "text", F.struct(*[column(c) for c in docs.columns]).alias("doc"))
    return ledger(named, "doc").where(~rejected_by(policy)).select("doc.*")


def op1(docs: DataFrame) -> DataFrame:
    """The ledger under the production policy, with the verdict of the two base rules beside it."""
    book = apply_policy(ledger(docs), PRODUCTION)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rejected_by(BASE).alias("base_failed"), "kept", "fail_bits",
    )


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t-\r]+')) AS word,
             generate_subscripts(regexp_extract_all(text, '[^ \t-\r]+'), 1) AS i FROM docs),
tri AS (SELECT doc_id, i, word, lead(word) OVER d AS w2, lead(word, 2) OVER d AS w3 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM ln WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(wc.n_words, 0)::BIGINT AS n_words, coalesce(wc.word_chars, 0)::BIGINT AS word_chars,
        length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(d.text, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper,
        coalesce(dl.n_lines, 0)::BIGINT AS n_lines, coalesce(dl.dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM docs d LEFT JOIN wc USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END
        + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

ABLATION_ORACLE = f"""WITH book AS ({ORACLE}), r AS (SELECT unnest({[*PRODUCTION.rules]}) AS rule, unnest({[1 << RULES.index(r) for r in PRODUCTION.rules]}) AS bit)
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS fails, count(*) FILTER (fail_bits & bit <> 0 AND fail_bits & (63 - bit) = 0) AS only_this, count(*) FILTER (fail_bits & (63 - bit) = 0) AS kept_without
FROM book, r GROUP BY rule"""
