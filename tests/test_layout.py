"""The layout parser on hand-written papers."""

import pytest
from pyspark.sql import functions as F

from questmill.operators import layout as Y

SCHEMA = "doc long, page long, line long, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"


def paper(spark, pages, doc=1):
    rows, line = [], 0
    for page, texts in enumerate(pages):
        for k, text in enumerate(texts):
            rows.append((doc, page, line, text, 50.0, 40.0 + 60 * k, 500.0, 60.0 + 60 * k, 595.0, 842.0))
            line += 1
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


PAGES = [
    ["SECTION A", "1\tWhich of these is a metal?", "2:\tWhich gas is given off?", "14:\t(a)\tHairdressers use it", "36\tToo large a number"],
    ["19: This question is about the reactions of alkenes", "(a) State the meaning of this. (3)", "more of it", None, "(b)(i) Draw it.", ""],
    ["(ii) alone opens nothing", "(b)(ii) Explain why. (4)", "(Total for Question 19 = 9 marks)", "20\tThe next question"],
    ["(a) A part of the question before"],
]


def test_records(spark):
    got = {r.line: r for r in Y.parse_layout(paper(spark, PAGES)).collect()}
    seen = {k: (r.number, r.kind, r.marks, r.section, r.depends_on_stem, r.stem_source) for k, r in got.items()}
    assert seen == {
        1: ("1", "choice", 1, "A", False, "none"),
        2: ("2", "choice", 1, "A", False, "none"),
        3: ("14(a)", "compound", 1, "A", False, "none"),
        5: ("19", "choice", 1, None, False, "none"),
        6: ("19(a)", "part", 3, None, True, "current_page"),
        9: ("19(b)(i)", "part", 2, None, True, "current_page"),
        12: ("19(b)(ii)", "part", 4, None, True, "previous_page"),
        14: ("20", "choice", 1, None, False, "none"),
        15: ("20(a)", "part", 2, None, True, "previous_page"),
    }
    assert (got[6].n_lines, got[6].n_words, got[6].last_line) == (3, 10, 8)
    assert got[1].box.asDict() == {"top": 106, "left": 58, "bottom": 332, "right": 941} and got[6].box.right == 960
    rolled = {(r.question, r.parent): r for r in Y.question_rollup(Y.parse_layout(paper(spark, PAGES))).collect()}
    assert rolled[5, 19].marks == 10 and rolled[5, 19].n_records == 4 and (rolled[5, 19].first_page, rolled[5, 19].last_page) == (1, 2)
    assert rolled[14, 20].n_records == 2


def test_headers_and_sections_of_other_papers(spark):
    pages = [["SECTION A", "1\tWhich?", "11\tA stem"], ["SECTION B", "(a) First", "12\tNext", "(a) Second", "3:\t(b)\tPair", "11:\t(b)\tno pair"]]
    got = {r.line: (r.number, r.kind, r.marks) for r in Y.parse_layout(paper(spark, pages), most=10, choice_needs_section=True, default_parent=11).collect()}
    assert got == {1: ("1", "choice", 1), 4: ("11(a)", "part", 2), 6: ("12(a)", "part", 2), 7: ("3(b)", "compound", 1)}
    alone = Y.parse_layout(paper(spark, [["(a) Without a number", "text"]]), practical=True).collect()
    assert [(r.number, r.section, r.question, r.depends_on_stem, r.n_lines) for r in alone] == [("20(a)", "B", -1, False, 2)]
    assert Y.parse_layout(paper(spark, [[None, "", "plain"]])).collect() == []


def test_a_long_document_is_read_by_page(spark):
    pages = [[f"{p % 35 + 1}.\tThe start"] + ["(a) one (2)", "words of it"] * 3 if p % 50 == 0 else ["words"] * 5 + ["(b) two"] for p in range(600)]
    got = Y.parse_layout(paper(spark, pages))
    assert got.where("kind = 'part'").groupBy("parent").count().where("parent is null").count() == 0
    parents = {r.page: r.parent for r in got.where("kind = 'part'").select("page", "parent").collect()}
    assert all(parents[p] == (p // 50 * 50) % 35 + 1 for p in range(600))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "line#" in line]
    assert windows and all("page#" in line for line in windows)  # no window over all lines of a document


def test_snapping(spark):
    blocks = paper(spark, PAGES)
    got = {r.line: (r.top, r.bottom) for r in Y.snap_boxes(Y.parse_layout(blocks), blocks, page_height=842.0).collect()}
    assert got[1] == (106, 168) and got[2] == (178, 239)  # down to just above the next choice
    assert got[6][1] == int((40 + 60 * 4 - 8) * 1000 / 842)  # above the next part's marker
    assert got[12][1] > got[12][0] and got[14][1] >= got[14][0] + 50


@pytest.mark.parametrize("edges,want", [([5, 10, 20], 10), ([10], 10), ([3], None), ([], None)])
def test_next_at(spark, edges, want):
    rows = spark.createDataFrame([("g", 7, "x")], "g string, at int, note string")
    marks = spark.createDataFrame([("g", e) for e in edges] + [("h", 8)], "g string, edge int")
    assert [(r.note, r.edge) for r in Y.next_at(rows, marks, ["g"], "at", "edge", "edge").select("note", F.col("edge")).collect()] == [("x", want)]
