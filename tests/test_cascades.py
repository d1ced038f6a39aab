"""Names, marks, addresses and answers on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from questmill.functions.text import encode_segment, image_url
from questmill.operators.explore import question_in_unit
from questmill.operators.library import answers_of, tab_to_show, unfenced
from questmill.operators.normalize import maths_marks
from questmill.sources.names import paper_name


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "subject,file,want",
    [
        ("chemistry", "WCH14-01R_que_20230110.pdf", (4, "R", "WCH14R", "WCH14/01R")),
        ("chemistry", "chem_u6_a.pdf", (6, "A", "WCH16A", "WCH16/01A")),
        ("chemistry", "Unit 2 unused.pdf", (2, "UNUSED", "WCH12_UNUSED", "WCH12/01UNUSED")),
        ("chemistry", "notes.pdf", (None, "", "UNKNOWN", "UNKNOWN/01")),
        ("physics", "Unit1(WPH11) R.pdf", (1, "", "WPH11", "WPH11/01")),
        ("physics", "Unit 3-a.pdf", (3, "A", "WPH13A", "WPH13/01A")),
        ("physics", "notes.pdf", (1, "", "WPH11", "WPH11/01")),
        ("mathematics", "Questionpaper-PureMathematicsP3-January2019.pdf", (3, "", "WMA13", "WMA13/01")),
        ("mathematics", "Maths_S1A_MS.pdf", (6, "A", "WST01A", "WST01/01A")),
        ("mathematics", "26_06_QP_P4A.pdf", (4, "A", "WMA14A", "WMA14/01A")),
        ("mathematics", "wme01_01r unused.pdf", (5, "UNUSED", "WME01_UNUSED", "WME01/01UNUSED")),
        ("mathematics", "notes unused.pdf", (None, "", None, None)),
    ],
)
def test_paper_names(spark, subject, file, want):
    got = one(spark, paper_name(F.lit(file), subject))
    assert (got.unit, got.variant, got.unit_code, got.paper_code) == want


def test_maths_marks(spark):
    text = lambda *p: [F.lit(x).cast("string") for x in p]
    assert one(spark, maths_marks(F.lit(3), *text("(Total for Question 13 is 4 marks) (total for question 3 is 9 marks)", "(Total 5 marks)", "(2 marks)"))) == 9
    assert one(spark, maths_marks(F.lit(3), *text(None, "(Total for Question 3 is 7 marks) (Total for Question 4 is 8 marks)", None))) == 7
    assert one(spark, maths_marks(F.lit(3), *text("", "", "(2 marks) (3 marks) [Total 6]"))) == 3
    assert one(spark, maths_marks(F.lit(3), *text(None, None, None))) == 0


def test_image_addresses(spark):
    versions = F.create_map(F.lit("q1"), F.lit("5"), F.lit("b c.png"), F.lit("2"))
    of = lambda path, key=None: one(spark, image_url([F.lit(path)], F.lit(key), versions, "https://cdn", ["/crops/"]))
    assert of("crops/a/b c.png") == "https://cdn/crops/a/b%20c.png?v=2" and of("crops/b%20c.png") == "https://cdn/crops/b%20c.png"
    assert of("other/é.png?w=1", "q1") == "/other/%C3%A9.png?w=1&v=5" and of("x.png?v=9", "q1") == "/x.png?v=9"
    assert of("http://h/b c.png") == "http://h/b c.png?v=2" and of("  ") == "" and of(None) == ""
    assert one(spark, encode_segment(F.lit("50% (a)+b!"))) == "50%25%20(a)%2Bb!"


def test_answers(spark):
    of = lambda raw: one(spark, answers_of(F.lit(raw), "struct<a:int>"))
    assert [r.a for r in of('```json\n[{"a": 1}, {"a": 2}]\n```')] == [1, 2] and [r.a for r in of('{"questions": [{"a": 3}]}')] == [3]
    assert [r.a for r in of('{"a": 4}')] == [4] and of("no") is None and of(None) is None and of("[]") == []
    assert one(spark, unfenced(F.lit("``` \n x \n```"))) == "x"
    assert tab_to_show({"a": 0, "b": 2}, "a") == "b" and tab_to_show({"a": 1, "b": 2}, "a") == "a" and tab_to_show({}, "a") == "a"


@pytest.mark.parametrize("unit,code,wanted,want", [("Unit 1: Pure (P1)", "WMA11", "p1", True), ("Unit 1", None, "1", True), ("Unit 12", None, "1", False), (None, "WST01", " s1", True), (None, None, "1", False), ("Unit 3", "", "", False), ("x", "wch 11", "WCH11", True)])
def test_units(spark, unit, code, wanted, want):
    assert one(spark, question_in_unit(F.lit(unit), F.lit(code), wanted)) is want


def test_an_image_url_computes_its_path_once(spark):
    rows = spark.createDataFrame([("/crops/a b.png", "k"), (None, None), ("https://h/x.png", "k")], "given string, key string").repartition(1)
    url = image_url([F.upper("given")], F.col("key"), F.create_map(F.lit("k"), F.lit("3"), F.lit("e"), F.lit("")), "https://cdn", ["/CROPS/"])
    got = rows.select(url.alias("url"))
    assert [r.url for r in got.collect()] == ["https://cdn/CROPS/A%20B.PNG?v=3", "", "/HTTPS%3A//H/X.PNG?v=3"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(given#") <= 2 and len(plan) < 10_000  # null if it is empty: at most twice
