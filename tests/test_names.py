import pytest
from pyspark.sql import functions as F

from loomstead.functions import names as N
from loomstead.functions.porter import porter


def rows(spark, values, column):
    return {r.v: r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", column.alias("x")).collect()}


def test_names_in_normal_form(spark):
    q = F.array(F.lit("ae"), F.lit("northwind"), F.lit("head"))
    got = rows(spark, ["Maya Chen (Northwind AE)", "Maya Chen Northwind AE", "  maya   CHEN ", "Conor O’Brien", "Ann Head", "Müller, Anna"], N.norm_name(F.col("v"), q))
    assert got == {"Maya Chen (Northwind AE)": "maya chen", "Maya Chen Northwind AE": "maya chen", "  maya   CHEN ": "maya chen", "Conor O’Brien": "conor o'brien", "Ann Head": "ann head", "Müller, Anna": "müller anna"}


def test_shapes(spark):
    person = rows(spark, ["Maya Chen", "Tomás O'Connell", "Maya", "Action Items", "Room 12", "A B C D E", "The Team"], N.looks_like_person_name(F.col("v")))
    assert [k for k, v in person.items() if v] == ["Maya Chen", "Tomás O'Connell"]
    handle = rows(spark, ["maya.c", "8.8.8.8", "a b", "", "x" * 41, "é1"], N.looks_like_handle(F.col("v")))
    assert [k for k, v in handle.items() if v] == ["maya.c", "é1"]
    mail = rows(spark, ["a.b+c@x-y.co.uk", "a@b", "Name <a@b.c>", "ü@b.de"], N.is_email(F.col("v")))
    assert [k for k, v in mail.items() if v] == ["a.b+c@x-y.co.uk", "ü@b.de"]


def test_fold(spark):
    assert rows(spark, ["Müller", "Strauß", "Łódź", "e\u0301"], N.fold(F.col("v"))) == {"Müller": "muller", "Strauß": "strauss", "Łódź": "łodz", "e\u0301": "e"}


def test_words_of_containers(spark):
    got = rows(spark, ["EvalHarness", "eng-serving_runtime", "the HTTPServer pages", "success status channels"], F.array_join(N.content_words(F.col("v")), " "))
    assert got == {"EvalHarness": "eval harness", "eng-serving_runtime": "eng serving runtime", "the HTTPServer pages": "http server", "success status channels": "success status"}


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("triplicate", "triplic"), ("adjustable", "adjust"), ("rate", "rate"), ("controll", "control"), ("sky", "sky"), ("été", "été")])
def test_porter(word, stem):
    assert porter(word) == stem
