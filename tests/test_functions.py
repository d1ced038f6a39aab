import math

import pytest
from pyspark.sql import functions as F

from questmill.functions import keys, numbers, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw,want", [("Q2(a)", "2a"), ("Question 2(a)", "2a"), ("20(b)(iv)", "20biv"), ("18(b)(ii) Clip with (b)(iii)", "18bii"), ("*14", "14"), ("21 (b) (i)", "21bi"), ("q_3-a", "3a"), ("eclipse 4(a)", "eclipse4a"), ("", ""), ("3μ†", "3μ")])
def test_canonical_id(spark, raw, want):
    assert value(spark, keys.canonical_id(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("20(b)(iv)", "20_b_iv"), ("Q 4 (A)", "q_4_a"), ("((", ""), ("1.3 & 1.12", "1_3_1_12")])
def test_slug(spark, raw, want):
    assert value(spark, keys.slug(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("Jan", "January"), ("May June", "June"), ("may", "May"), ("Oct Nov", "October"), ("Nov", "Nov"), ("JUNE", "June")])
def test_session_name(spark, raw, want):
    assert value(spark, keys.session_name(F.lit(raw))) == want


def test_keys(spark):
    rows = spark.createDataFrame([("10(a)",), ("2(b)",), ("2(a)(ii)",), ("2(a)(i)",)], "q string")
    assert [r.q for r in rows.orderBy(keys.natural_key(F.col("q"))).collect()] == ["2(a)(i)", "2(a)(ii)", "2(b)", "10(a)"]
    assert value(spark, keys.leading_int(F.lit("20(a)"))) == 20 and value(spark, keys.leading_int(F.lit("x"))) is None
    assert value(spark, keys.parent_number(F.lit("20(a)(i)"))) == "20"
    assert value(spark, keys.first_text(F.lit(None).cast("string"), F.lit(""), F.lit("x"))) == "x"
    assert value(spark, keys.question_id(keys.paper_id(F.lit("WCH11"), F.lit(""), F.lit(2020), F.lit("May/June")), F.lit("2(a)"))) == "wch11_2020_mayjune_q2_a"
    assert value(spark, keys.roman_rank(F.lit("IV"))) == 4 and value(spark, keys.roman_rank(F.lit("q"))) == 0


@pytest.mark.parametrize("z,want", [(0.0, 0.5), (0.5, 0.6915), (1.0, 0.8413), (1.96, 0.975), (-1.0, 0.1587), (-1.96, 0.025), (2.5758, 0.995), (3.89, 0.9999), (3.9, 1.0), (4.0, 1.0)])
def test_normal_cdf(spark, z, want):
    assert math.isclose(value(spark, numbers.normal_cdf(F.lit(z))), want, abs_tol=1e-9)


@pytest.mark.parametrize("marks,maths,practical,physics,want", [(75, True, False, False, 90), (80, False, False, False, 90), (90, False, False, False, 105), (50, False, False, False, 75), (50, False, True, True, 80), (51, False, True, False, 75), (51, False, False, False, 59), (20, False, False, False, 23), (0, False, False, False, 0)])
def test_exam_minutes(spark, marks, maths, practical, physics, want):
    assert value(spark, numbers.exam_minutes(F.lit(marks), F.lit(maths), F.lit(practical), F.lit(physics))) == want


@pytest.mark.parametrize("m,want", [(0, "0m"), (45, "45m"), (60, "1h"), (75, "1h 15m"), (105, "1h 45m")])
def test_format_minutes(spark, m, want):
    assert value(spark, numbers.format_minutes(F.lit(m))) == want


@pytest.mark.parametrize("earned,want", [(85.0, "A*"), (84.9, "A"), (75.0, "A"), (65.0, "B"), (55.0, "C"), (45.0, "D"), (35.0, "E"), (34.9, "U")])
def test_grade(spark, earned, want):
    assert value(spark, numbers.grade(F.lit(earned), F.lit(100))) == want
    assert value(spark, numbers.grade(F.lit(earned), F.lit(0))) == "Ungraded"


@pytest.mark.parametrize("t,marks,number,want", [("Explain why (2)", 2, None, 9), ("Calculate the mass of the sample. (3)", 3, None, 72), ("........", 1, None, -95), ("(a) State the unit", 1, "3(a)", 66)])
def test_content_score(spark, t, marks, number, want):
    assert value(spark, text.content_score(F.lit(t), F.lit(marks), F.lit(number) if number else None)) == want


def test_text(spark):
    assert value(spark, text.clean_text(F.lit("State why ........ \n*P12345A0128* do not write in this area  x"))) == "State why x"
    assert value(spark, text.clean_text(F.lit("abcdef ghij"), 7)) == "abcdef..."
    assert value(spark, text.clean_text(F.lit(None).cast("string"))) == ""
    for note, key in (("B is not\nD is the only correct answer", "D"), ("Answer: c", "C"), ("x\nA\ny", "A"), ("none", None)):
        assert value(spark, text.answer_key(F.lit(note))) == key
    assert value(spark, text.encode_path(F.lit("a b/ñ.png?x=1"))) == "a%20b/%C3%B1.png"
    assert value(spark, text.shift_glyphs(F.lit("\x07\x08"))) == "$%" and value(spark, text.shift_glyphs(F.lit("ab"))) == "ab"
    assert value(spark, text.strip_latex(F.lit(r"\frac{a}{b} x^2"))) == "ab x2"
    assert value(spark, text.mime_type(F.lit("x.PNG"))) == "image/png"
    assert value(spark, text.join_context(F.lit("a"), F.lit(""), F.lit("b"))) == "a | b"
    assert value(spark, numbers.overlap_share(*(F.lit(float(x)) for x in (100, 200, 150, 350)))) == 0.5
