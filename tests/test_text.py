"""Text functions on invented names and texts."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def many(spark, column, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", column(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_punctuation_and_case_do_not_tell_terms_apart(spark):
    spelled = ["Quillo", "QUILLO", "Quillo's", "Quillo’s", "quillo.", "«Quillo»", "[Quillo];", "Quíllo"]
    assert many(spark, tx.tokens, spelled) == [["quillo"]] * len(spelled)


def test_divided_words_give_the_glued_form_and_their_parts(spark):
    assert many(spark, tx.tokens, ["Tarn.io", "wind–mill"]) == [["tarnio", "tarn", "io"], ["windmill", "wind", "mill"]]


def test_stopwords_short_terms_and_nulls(spark):
    found = many(spark, tx.tokens, ["what is the price of a boat", "x 7 of", "", None])
    assert found == [["price", "boat"], ["7"], [], []]


@pytest.mark.parametrize(
    ("plural", "stem"),
    [("berries", "berry"), ("boxes", "box"), ("lashes", "lash"), ("churches", "church"), ("glass", "glass"), ("cactus", "cactus"), ("iris", "iris"), ("chaos", "chaos"), ("oars", "oar"), ("gas", "gas")],
)
def test_stems(spark, plural, stem):
    assert one(spark, tx.stem_plural, plural) == stem


def test_people(spark):
    names = ["Dr. Olu Wren", "Prof. Dr. Ina  Voss", "Shri Tam O'Leary Jr.", "Bea Lund, Head of Ropes, Wharf", "Íñigo Sær", "Mr.", "", None]
    assert many(spark, tx.person_key, names) == ["olu wren", "ina voss", "tam oleary", "bea lund", "inigo sær", "", "", ""]
    assert tuple(one(spark, tx.split_speaker, "Ro Finn, Pilot, Harbour Trust, North")) == ("Ro Finn", "Pilot", "Harbour Trust, North")
    assert tuple(one(spark, tx.split_speaker, "\t")) == (None, None, None) or tuple(one(spark, tx.split_speaker, "  ")) == (None, None, None)


def test_companies(spark):
    assert one(spark, tx.company_aliases, "Wharf & Sons Pvt. Ltd.") == ["wharf and son", "wharf and son pvt ltd", "wharfandson", "wharfandsonpvtltd"]
    same = lambda a, b: bool(set(one(spark, tx.company_keys, a)) & set(one(spark, tx.company_keys, b)))
    assert same("Blue Kelp", "BlueKelp") and same("Ostrava", "Ostrava Bank (North)") and not same("Blue Kelp", "Red Kelp")


def test_junk(spark):
    assert many(spark, tx.junk_reason, ["$b2", "tba", "http://y.example/z", "A rope works", None]) == ["unresolved-placeholder-token", "placeholder-value", "link-only-no-prose", None, None]


def test_minutes_and_hashes(spark):
    assert many(spark, tx.to_minutes, ["7:30", "23:59", "late", "1:5"]) == [450, 1439, 0, 0]
    assert many(spark, tx.hhmm, ["450", "1439"]) == ["07:30", "23:59"]

    def fnv(text):
        h = 2166136261
        for c in text.encode():
            h = (h ^ c) * 16777619 % 2**32
        return h

    assert many(spark, tx.fnv1a, ["", "kelp", "rope works"]) == [fnv(x) for x in ("", "kelp", "rope works")]
