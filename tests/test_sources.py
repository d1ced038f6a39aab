import json

from pyspark.sql import functions as F

from questmill.operators.explore import FilterSpec
from questmill.operators.normalize import box, marks_of, normalize, question_type, subject
from questmill.sources import bank, spec

UNITS = [r"wch1([1-6])[-_]01([ra]?)", r"wch1([1-6])([ra]?)", r"unit[\s_-]?([1-6])[\s_-]?([ra]?)"]


def test_scan_and_pair(spark, tmp_path):
    for i, name in enumerate(["2024 Jan/wch11-01-que-x.pdf", "2024 Jan/wch11-01-rms-x.pdf", "2024 Jan/wch11-01r_que.pdf", "2024 Jan/WCH12_01_que.pdf", "2023 May June/deep/question-paper/unit 1.pdf", "2023 May June/deep/mark-scheme/unit 1.pdf", "2024 Jan/notes.txt"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%d" % i)
    files = bank.scan_papers(spark, str(tmp_path), UNITS)
    got = {(r.series, r.unit_num, r.variant, r.role, r.year, r.session) for r in files.collect()}
    assert ("2024 Jan", 1, "R", "qp", 2024, "January") in got and ("2023 May June", 1, "", "ms", 2023, "June") in got and len(got) == 6
    assert {(r.unit_num, r.variant, r.year) for r in bank.pair_papers(files).collect()} == {(1, "", 2024), (1, "", 2023)}
    assert {(r.unit_num, r.variant, r.year) for r in bank.pair_papers(files, fall_back_to_base=True).collect()} == {(1, "", 2024), (1, "R", 2024), (1, "", 2023)}


def test_incremental(spark):
    papers = spark.createDataFrame([("p1", "h1", "a"), ("p2", "h2", "b"), ("p3", "h3", "c"), ("p4", "h4", "d")], "paper_id string, que_hash string, que_path string")
    manifest = spark.createDataFrame([("p1", "zz", "zz", "completed"), ("old", "h2", "zz", "completed"), ("p3", "h3", "c", "failed"), ("p4", "h4", "d", "completed")], "paper_id string, que_hash string, que_path string, status string")
    stored = spark.createDataFrame([("p1", "q1"), ("old", "q2")], "paper_id string, id string")
    assert sorted(r.paper_id for r in bank.unfinished(papers, manifest, stored).collect()) == ["p3", "p4"]
    assert {r.paper_id: r.question_count for r in bank.manifest_rows(stored).collect()} == {"p1": 1, "old": 1}


def test_uploads(spark):
    local = spark.createDataFrame([("k1", 10), ("k2", 11), ("k3", 5)], "key string, size long")
    remote = spark.createDataFrame([("k1", 10), ("k2", 10)], "key string, size long")
    assert sorted(r.key for r in bank.upload_plan(local, remote).collect()) == ["k2", "k3"]
    assert bank.upload_plan(local, remote, force=True).count() == 3
    assert [r.key for r in bank.orphans(local, remote).collect()] == ["k3"]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "v": "old"}, {"id": "2", "v": "x"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "1", "v": "new"}]))
    schema = spark.createDataFrame([], "id string, v string").schema
    assert {r.id: r.v for r in bank.latest_of_many(spark, f"{tmp_path}/*.json", schema, "id").collect()} == {"1": "new", "2": "x"}
    assert bank.read_json(spark, f"{tmp_path}/a.json", schema).count() == 2
    assert bank.read_or_empty(spark, f"{tmp_path}/none", schema).count() == 0
    rows = spark.createDataFrame([("chem", "u1", "a"), ("chem", "u2", "b")], "subject string, unit_code string, id string")
    out = str(tmp_path / "bank")
    bank.write_bank(rows, out)
    bank.write_bank(spark.createDataFrame([("chem", "u2", "c")], rows.schema), out)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "c"]
    assert bank.first_existing(spark, [f"{tmp_path}/none", out], rows.schema).count() == 2
    bank.upsert(rows, spark.createDataFrame([("chem", "u1", "z")], rows.schema), ["unit_code"], str(tmp_path / "next"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "next")).collect()) == ["b", "z"]
    (tmp_path / "crops_x").mkdir()
    (tmp_path / "crops_x" / "1.png").write_bytes(b"abc")
    assert [(r.key, r["size"]) for r in bank.list_assets(spark, str(tmp_path), "*.png").collect()] == [("crops_x/1.png", 3)]
    sent = spark.sparkContext.accumulator(0)
    bank.send_in_batches(spark.range(120).repartition(1), lambda batch: sent.add(1), 50)
    assert sent.value == 3
    pages = spark.createDataFrame([("p", 1), ("p", 2)], "paper_id string, page int")
    cache = pages.where("page = 1").select(F.sha2(F.concat_ws("_", "paper_id", F.lit("v1"), F.col("page").cast("string")), 256).alias("key"), F.lit("hit").alias("result"))
    hit, miss = bank.cached_pages(pages, cache, "v1")
    assert [r.page for r in hit.collect()] == [1] and [r.page for r in miss.collect()] == [2]


def test_spec_round_trip():
    want = FilterSpec(units=["Unit 1", "Unit 2"], subtopics=["a & b"], years=[2020, 2021], series=["jan"], search="x y", kind="mcq", primary_only=True, status="review", bookmarked=True)
    assert spec.parse("#/topical?" + spec.render(want)) == want
    assert spec.render(FilterSpec()) == "" and spec.parse("#/topical") == FilterSpec() and spec.parse("?type=odd&status=x") == FilterSpec()


def test_normalize(spark):
    raw = spark.createDataFrame([("wch11_2020_q2a", None, "0", "", ["s1", "s2", "s1"], "U"), ("x", "20(a)(i)", "abc", "t", [], "U"), (None, None, "4", None, None, None)], "id string, questionNumber string, marks string, topic string, subtopics array<string>, unit string")
    a, b, c = normalize(raw).collect()
    assert (a.questionNumber, a.marks, a.mainSubtopic, a.relatedSubtopics, a.subtopics, a.mainTopic, a.year) == ("2a", 1, "s1", ["s2"], ["s1", "s2"], "General", 2024)
    assert (b.parentQuestion, b.marks, b.mainSubtopic, b.topics) == ("20", 1, "General", ["t"]) and (c.id, c.questionNumber, c.marks, c.unit) == ("", "1", 4, "")
    once = normalize(raw)
    assert sorted(map(str, normalize(once).collect())) == sorted(map(str, once.collect()))
    valid = spark.createDataFrame([("U", "s9")], "unit string, subtopic string")
    assert all(not r.relatedSubtopics for r in normalize(raw, valid).collect())


def test_derived(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(subject(lit("WMA11"), lit(""), lit(""), lit(""), {"mathematics": ["wma", "wme"], "physics": ["wph"]}, "chemistry")) == "mathematics"
    kind = lambda **k: one(question_type(*(lit(k.get(n, d)) for n, d in (("s", "chemistry"), ("unit", "Unit 1"), ("code", "WCH11"), ("section", ""), ("given", ""), ("parent", "5"), ("number", "5"), ("sub", "")))))
    assert kind() == "mcq" and kind(parent="21") == "theory" and kind(number="5(a)(ii)") == "theory" and kind(section="A", parent="30") == "mcq" and kind(code="WPH13") == "theory" and kind(s="mathematics", section="A") == "theory"
    assert tuple(one(box(F.array(*(lit(x) for x in (0.2, 0.0, 0.1, 1.0)))))) == (100.0, 0.0, 200.0, 1000.0)
    assert one(marks_of(lit(0), lit(None).cast("int"), lit(4))) == 4 and one(marks_of(lit(0))) == 1
