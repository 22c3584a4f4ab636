import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.udfs import jaro_winkler_of, porter_of


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*columns).first())


def test_names_lose_marks_and_punctuation(spark):
    assert one(spark, "  José  Ñuñez-O'Hara ", T.normalize_name(F.col("t"))) == ("jose nunez-o hara",)
    assert one(spark, None, T.normalize_name(F.col("t"))) == ("",)


@pytest.mark.parametrize(("text", "stem"), [("@maria.s", "maria"), ("lena-sales (ops)", "lena-sales"), ("", None), ("jin: hi", "jin")])
def test_handle_stem(spark, text, stem):
    assert one(spark, text, T.handle_stem(F.col("t"))) == (stem,)


def test_locals_need_two_words(spark):
    assert one(spark, "mei chen", T.name_locals(F.col("t"))) == (["mei.chen", "mei_chen", "meichen", "mchen", "meic"],)
    assert one(spark, "mei", T.name_locals(F.col("t"))) == ([],)


def test_dates(spark):
    assert one(spark, "on 2024-02-03 10:15 and", T.first_date(F.col("t"))) == (dt.datetime(2024, 2, 3, 10, 15),)
    assert one(spark, "on 2024-02-30 and 2024-03-01", T.first_date(F.col("t"))) == (None,)
    assert one(spark, "Tue, 5 Mar 2024 09:08:07 -0800", T.header_date(F.col("t"))) == (dt.datetime(2024, 3, 5, 9, 8, 7),)
    assert one(spark, "yesterday", T.header_date(F.col("t"))) == (None,)


def test_references(spark):
    assert one(spark, "ENG-12, PR #7; ff_20240101_ab, ENG-12", T.cross_references(F.col("t"))) == ("ENG-12,PR#7,ff_20240101_ab",)


def test_ordered_distinct_keeps_first_places(spark):
    got = spark.createDataFrame([([" b", "a", "", "b", None],)], "x array<string>").select(T.ordered_distinct(F.col("x"))).first()[0]
    assert got == ["b", "a"]


def test_query_terms(spark):
    assert one(spark, "What is the status of ENG-30521?", T.query_terms(F.col("t")), T.match_expression(F.col("t"))) == (["status", "eng-30521"], '"status" OR "eng-30521"')
    assert one(spark, "what is it", T.query_terms(F.col("t"))) == (["what", "is", "it"],)


def test_ids_are_stable_and_not_negative(spark):
    a, b, c = one(spark, "x", T.mint_id("e", F.col("t"), F.lit("y")), T.mint_id("e", F.col("t"), F.lit("y")), T.surrogate_id(F.col("t")))
    assert a == b and len(a) == 18 and 0 <= c < 1 << 62


def test_organization_of(spark):
    assert one(spark, "x@north-star.co.uk", T.organization_of(F.col("t"))) == ("North-Star",)


def test_json_inside(spark):
    assert one(spark, 'Sure:\n```json\n{"a": [1]}\n``` done', T.json_inside(F.col("t"))) == ('{"a": [1]}',)
    assert one(spark, "nothing", T.json_inside(F.col("t"))) == (None,)


def test_similarity_and_stems():
    assert round(jaro_winkler_of("martha", "marhta"), 4) == 0.9611
    assert jaro_winkler_of("abc", "xyz") == 0 and jaro_winkler_of("", "a") == 0
    assert [porter_of(w) for w in ("caresses", "ponies", "relational", "hopping", "sky")] == ["caress", "poni", "relat", "hop", "sky"]
