import pytest
from pyspark.sql import functions as F

from questmill.operators import report, structure


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw,parent,sub,active,letter,want",
    [
        ("20(b)(iv)", None, None, None, None, ("20(b)(iv)", "20", "(b)(iv)")), ("Q14(a)", None, None, None, None, ("14(a)", "14", "(a)")), ("*14a", None, None, None, None, ("14(a)", "14", "(a)")),
        ("20(ii)", None, None, None, "b", ("20(b)(ii)", "20", "(b)(ii)")), ("20(i)", None, None, None, "h", ("20(i)", "20", "(i)")), ("(b)(i)", None, None, "7", None, ("7(b)(i)", "7", "(b)(i)")),
        ("(iii)", "5", None, "7", "c", ("5(c)(iii)", "5", "(c)(iii)")), ("(a)", None, None, None, None, ("1(a)", "1", "(a)")), ("20", None, "b ii", None, None, ("20(b)(ii)", "20", "(b)(ii)")),
        ("20", None, "i", None, "i", ("20(i)", "20", "(i)")), ("20", None, None, None, None, ("20", "20", "")), ("x", None, "s", "3", None, ("x", "3", "s")), (None, None, None, None, None, ("", "", "")),
    ],
)
def test_hierarchical_id(spark, raw, parent, sub, active, letter, want):
    lit = lambda x: F.lit(x).cast("string")
    assert tuple(one(spark, structure.hierarchical_id(lit(raw), lit(parent), lit(sub), lit(active), lit(letter)))) == want


def test_labels(spark):
    assert one(spark, structure.alpha_letter(F.lit("20 *(b)(ii)"))) == "b" and one(spark, structure.alpha_letter(F.lit("20(i)"))) is None
    ranks = [tuple(one(spark, structure.marker_rank(F.lit(x)))) for x in ("2", "2(a)", "2(a)(i)", "2(a)(iv)", "2(b)", "10")]
    assert ranks == sorted(ranks)
    assert one(spark, structure.is_measure(F.lit("25 cm3 of acid"))) and not one(spark, structure.is_measure(F.lit("25 Calculate")))
    assert one(spark, structure.clean_title(F.lit("1.2-1.4: Atoms"))) == "Atoms" and one(spark, structure.clean_title(F.lit("Topic 3: Waves"))) == "Waves"
    assert one(spark, structure.series_label(F.lit("January"), F.lit(2024), F.lit("s"), F.lit("WCH11"))) == "Jan 2024 · WCH11"
    category = lambda *u: one(spark, structure.unit_category(F.array(*map(F.lit, u)).cast("array<string>")))
    assert category() == "mixed_or_all" and category("Unit 3", "WCH16") == "unit3_6" and category("4", "unit 5") == "ia2" and category("1") == "as" and category("1", "4") == "mixed_or_all"
    code = lambda t: one(spark, structure.unit_code(F.lit(t), {"pure 1": "WMA11"}, r"w[a-z]{2}\d\d", "WMA11x"))
    assert code("The Pure 1 paper") == "WMA11" and code("wst02 x") == "WST02" and code("?") == "WMA11x"


def test_pages(spark):
    blocks = spark.createDataFrame([(1, "State and explain why the mass changes here", 100.0, 800.0), (1, "*P123*", 100.0, 800.0), (2, "BLANK PAGE", 400.0, 800.0), (3, "one two", 10.0, 800.0)], "page int, text string, y0 double, page_height double")
    assert {r.page: r.blank for r in structure.blank_pages(blocks, ["page"]).collect()} == {1: False, 2: True, 3: True}
    spans = spark.createDataFrame([(1, 10.0, 90.0), (1, 50.0, 90.0)], "g int, y0 double, y1 double")
    assert [r.y1 for r in structure.clamp_to_next(spans, ["g"], ["y0"], "y0", "y1").orderBy("y0").collect()] == [46.0, 90.0]
    heads = spark.createDataFrame([(1, 1, 3), (1, 2, None), (1, 3, 2), (1, 4, 99), (1, 5, 5)], "g int, o int, h int")
    assert [r.parent_no for r in structure.guard_parent(heads, ["g"], ["o"], F.col("h"), F.col("h") < 50).orderBy("o").collect()] == [3, 3, 3, 3, 5]
    parts = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (1, 4, None), (1, 5, "b"), (1, 6, "c")], "g int, o int, l string")
    assert [r.letter_group for r in structure.letter_groups(parts, ["g"], ["o"], F.col("l")).orderBy("o").collect()] == [1, 1, 2, 2, 2, 3]


def test_cache_and_batches(spark):
    legal = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "z")], "unit string, label string")
    items = spark.createDataFrame([("1", "u", "t1"), ("2", "u", "t2"), ("3", "v", "t3")], "id string, unit string, text string")
    cache = spark.createDataFrame([("1", "u", "b"), ("2", "u", "gone"), ("3", "u", "a")], "id string, unit string, label string")
    hit, miss = structure.split_by_cache(items, cache, legal)
    assert [r.id for r in hit.collect()] == ["1"] and sorted(r.id for r in miss.collect()) == ["2", "3"]
    done = structure.classify_in_batches(items, lambda unit, texts: [f"{unit}:{t}" for t in texts], size=1)
    assert {r.id: r.label for r in done.collect()} == {"1": "u:t1", "2": "u:t2", "3": "v:t3"}
    assert {r.id: r.label for r in structure.repair(done, legal).collect()} == {"1": "a", "2": "a", "3": "z"}


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n int")
    assert [tuple(r) for r in report.with_total(df, "k", "n").collect()] == [("a", 4), ("b", 2), ("TOTAL", 6)]
    page = report.html_report(df, "x <y>", ["n"], most=2)
    assert "3 rows, 2 shown" in page and "x &lt;y&gt;" in page


def test_header_rows(spark):
    rows = [(["Question", "Answer"],), ([None, " Number ", ""],), (["number", "of moles"],), (["Acceptable answers"],), (["a", None],), ([],), (None,)]
    df = spark.createDataFrame(rows, "cells array<string>")
    assert [r.x for r in df.select(structure.is_header_row(F.col("cells")).alias("x")).collect()] == [True, True, False, True, False, False, False]
