import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from questmill import registry
from questmill.operators.exam import assemble, bounded_pool, closest_subset, exact_subset, prepare_pool, preset_requests, remaining, select_exams
from questmill.operators.explore import FilterSpec, facet_all, facet_many, unit_matches
from questmill.operators.match import anti_any, asof_join, fallback_join, nearest_join
from questmill.operators.merge import ghost_purge, latest, merge_progress, partial_latest, replace_by
from questmill.operators.ordered import islands, keep_best, sequential_gate
from questmill.operators.taxonomy import apply_rules, classify_by_keywords, code_index, consistency, led_by, number_index, promote, replaced, resolve, resolve_number, scoped, specific_first, stripped


def test_exact_subset_vectors():
    pick = lambda m, t: (lambda p: None if p is None else [m[i] for i in p])(exact_subset(m, t))
    assert pick([3, 5, 7], 12) == [5, 7] and pick([3, 5, 7], 11) is None and pick([4, 4, 4], 8) == [4, 4]
    assert pick([6, 2, 2, 2], 6) == [6] and pick([2, 2, 2, 6], 6) == [2, 2, 2] and pick([1], 0) == [] and pick([], 3) is None


def test_closest_subset_vectors():
    total = lambda m, t: sum(m[i] for i in closest_subset(m, t))
    assert total([3, 5, 7], 11) == 10 and total([4, 6, 8], 5) == 4 and total([10, 10], 9) == 10
    assert closest_subset([30], 10) == [0] and total([3, 4], 50) == 7 and closest_subset([], 5) == []


def test_subsets_use_each_item_once_and_are_best():
    rng = random.Random(1)
    for _ in range(200):
        marks, target = [rng.randint(1, 12) for _ in range(rng.randint(1, 12))], rng.randint(1, 60)
        sums = {0}
        for m in marks:
            sums |= {s + m for s in sums}
        found = exact_subset(marks, target)
        assert (found is not None) == (target in sums)
        if found is not None:
            assert len(set(found)) == len(found) and sum(marks[i] for i in found) == target
        near = closest_subset(marks, target)
        assert len(set(near)) == len(near)
        reachable = [s for s in sums if 0 < s <= target + 12]
        if reachable and sum(marks) > target:
            assert abs(sum(marks[i] for i in near) - target) == min(abs(s - target) for s in reachable)


def test_select_exams_whole_requests(spark):
    rows = [(f"r{i % 3}", 20, f"q{i}", i % 7 + 1, "mcq" if i % 4 == 0 else "theory", f"t{i % 5}", f"p{i % 6}", 50, f"{i * 37 % 101:03d}") for i in range(90)]
    pool = spark.createDataFrame(rows, "request string, target int, id string, marks int, kind string, topic string, paper string, priority int, `order` string")
    for share in (0.0, 0.22):
        got = select_exams(pool, mcq_share=share).collect()
        assert {r.request for r in got} == {"r0", "r1", "r2"} and all(r.total == 20 for r in got)
        assert len({r.id for r in got}) == len(got)


def test_fallback_join_takes_the_first_key(spark):
    left = spark.createDataFrame([(1, "21bi", "21b"), (2, "x", "21b"), (3, "y", "z"), (4, None, "21bi")], "i int, a string, b string")
    right = spark.createDataFrame([("21b", 3), ("21bi", 2)], "k string, marks int")
    got = {r.i: (r.marks, r.matched_by) for r in fallback_join(left, right, ["i"], [F.col("a"), F.col("b")], "k").collect()}
    assert got == {1: (2, 1), 2: (3, 2), 3: (None, None), 4: (2, 2)}


def test_asof_with_tolerance(spark):
    anchors = spark.createDataFrame([("p", 100.0, "1a"), ("p", 200.0, "1b")], "page string, y double, anchor string")
    blocks = spark.createDataFrame([("p", 90.0, 1), ("p", 184.0, 2), ("p", 185.0, 3), ("p", 400.0, 4), ("q", 1.0, 5)], "page string, y double, n int")
    assert {r.n: r.anchor for r in asof_join(blocks, anchors, ["page"], "y", "anchor", 15).collect()} == {1: "1a", 2: "1a", 3: "1b", 4: "1b", 5: None}


def test_nearest_within_band(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 50.0), (3, 99.9)], "g int, y double").withColumn("g", F.lit(1))
    right = spark.createDataFrame([(1, 8.0, "a"), (1, 12.0, "b"), (1, 103.0, "c")], "g int, y double, m string")
    assert {r.y: r.m for r in nearest_join(left, right, ["g"], "y", "m", 5.0).collect()} == {10.0: "a", 50.0: None, 99.9: "c"}


def test_anti_any(spark):
    left = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, None), (4, "h4")], "id int, h string")
    done = spark.createDataFrame([(1, None), (None, "h2")], "id int, h string")
    assert sorted(r.id for r in anti_any(left, done, [["id"], ["h"]]).collect()) == [3, 4]


def test_merge_progress(spark):
    shape = "q int, status string, is_bookmarked boolean, user_answer string"
    local = spark.createDataFrame([(1, "review", False, ""), (2, "unattempted", False, "A"), (3, "unattempted", False, None)], shape)
    remote = spark.createDataFrame([(1, "mastered", True, "B"), (2, "mastered", False, None), (4, "mastered", False, "C")], shape)
    got = {r.q: (r.status, r.is_bookmarked, r.user_answer, r.migrate) for r in merge_progress(local, remote, ["q"]).collect()}
    assert got == {1: ("review", True, "B", True), 2: ("mastered", False, "A", True), 3: ("unattempted", False, None, False), 4: ("mastered", False, "C", False)}
    again = merge_progress(merge_progress(local, remote, ["q"]).drop("migrate"), remote, ["q"])
    assert {r.q: r.status for r in again.collect()} == {q: v[0] for q, v in got.items()}


def test_replace_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = replace_by(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, replace_by(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_folds(spark):
    e = spark.createDataFrame([(1, 1, "x", None), (1, 2, None, "m"), (1, 3, "y", None), (2, 1, None, None)], "k int, t int, a string, b string")
    assert {r.k: (r.a, r.b) for r in partial_latest(e, ["k"], ["t"], "a", "b").collect()} == {1: ("y", "m"), 2: (None, None)}
    assert {r.k: (r.a, r.b) for r in latest(e, ["k"], ["t"], "a", "b").collect()} == {1: ("y", None), 2: (None, None)}


def test_ordered(spark):
    assert spark.range(1).select(sequential_gate(F.array(*map(F.lit, [1, 2, 4, 3, 3, 4]))).alias("v")).first().v == 4
    s = spark.createDataFrame([(10, 20), (21, 30), (40, 50)], "a int, b int").withColumn("g", F.lit(1))
    assert [r.island for r in islands(s, ["g"], ["a"], F.col("a"), F.col("b"), F.lit(1.5)).orderBy("a").collect()] == [1, 1, 2]
    d = spark.createDataFrame([(1, 10, 0), (1, 10, 1), (1, 12, 2), (2, 10, 3), (2, 10, 4)], "id int, score int, at int")
    assert {r.id: r["at"] for r in keep_best(d, ["id"], F.col("score").desc(), "at").collect()} == {1: 2, 2: 3}


def test_ghost_purge(spark):
    q = spark.createDataFrame([("p", "16", None), ("p", "16(a)", "16"), ("p", "17", None)], "paper string, q string, parent string")
    assert sorted(r.q for r in ghost_purge(q, ["paper"], F.col("q"), F.col("parent")).collect()) == ["16(a)", "17"]


def test_explorer(spark):
    q = spark.createDataFrame([("1", "U1", "A", "s", 2020, "January", "mcq", ["s2"]), ("2", "U2", "B", "s2", 2021, "June", "theory", [])], "id string, unit string, topic string, subtopic string, year int, session string, kind string, related array<string>")
    ids = lambda **k: [r.id for r in q.where(FilterSpec(**k).predicate()).orderBy("id").collect()]
    assert ids() == ["1", "2"] and ids(units=["U1"]) == ["1"] and ids(subtopics=["s2"]) == ["1", "2"] and ids(subtopics=["s2"], primary_only=True) == ["2"]
    assert ids(series=["May/June"]) == ["2"] and ids(search="u1") == ["1"] and ids(kind="theory") == ["2"] and ids(years=[2020, 2021], series=["jan"]) == ["1"]
    assert [r.id for r in q.where(unit_matches(F.col("unit"), "u 1: all")).collect()] == ["1"]
    assert {r.bucket: r.n for r in facet_many(q, {"a": F.lit(True), "b": F.col("year") > 2020}).collect()} == {"a": 2, "b": 1}
    every = spark.createDataFrame([("U1",), ("U9",)], "unit string")
    assert {r.unit: r.n for r in facet_all(q, "unit", every).collect()} == {"U1": 1, "U9": 0}


def test_taxonomy(spark):
    dim = spark.createDataFrame([("u", "1.1: Atoms"), ("u", "1.2: Bonds"), ("v", "1.1: Waves")], "unit string, label string")
    items = spark.createDataFrame([(1, "u", "1.1: atoms"), (2, "u", "1.2"), (3, "v", "1.1: other"), (4, "u", "zzz")], "i int, unit string, given string")
    got = resolve(items, code_index(dim, "unit", "label").withColumnRenamed("unit", "unit"), ["i"], F.col("unit"), F.col("given"))
    assert {r.i: r.label for r in got.collect()} == {1: "1.1: Atoms", 2: "1.2: Bonds", 3: "1.1: Waves", 4: None}
    t = spark.createDataFrame([("Hazard sign",), ("nothing",)], "t string").select(classify_by_keywords(F.col("t"), [("safety", ["hazard"])], "other").alias("v"))
    assert [r.v for r in t.collect()] == ["safety", "other"]
    rows = spark.createDataFrame([("general", ["a", "b"], True), ("x", ["x", "b", "c"], False)], "main string, rel array<string>, generic boolean")
    assert [(r.main, r.rel) for r in apply_rules(rows, "main", "rel", [promote(F.col("generic"))]).collect()] == [("a", ["b"]), ("x", ["b"])]


def test_pool_preparation(spark):
    rows = [("r", 10, f"q{i}", 2 + i % 3, "mcq" if i < 3 else "theory", "t", f"s{i % 2}", "U1", "p", "mastered" if i % 4 == 0 else None, i == 5) for i in range(12)]
    df = spark.createDataFrame(rows, "request string, target int, id string, marks int, kind string, topic string, subtopic string, unit string, paper string, status string, is_bookmarked boolean")
    assert prepare_pool(df, units=["none"]).count() == 12 and prepare_pool(df, structure="mcq_sprint").count() == 3
    assert {r.subtopic for r in prepare_pool(df, subtopics=["s1"]).collect()} == {"s1"}
    assert prepare_pool(df, mode="unattempted_only").where("status = 'mastered'").count() == 0
    assert prepare_pool(df.withColumn("target", F.lit(1000)), mode="unattempted_only").count() == 12
    best = prepare_pool(df, mode="review_first").orderBy(F.col("priority").desc()).first()
    assert best.id == "q5" and best.priority >= 300
    pool = prepare_pool(df)
    left = remaining(pool, pool.where("id = 'q1'").select("request", "id", "marks"))
    assert left.count() == 11 and left.first().target == 7
    assert select_exams(left).first().total == 7


@pytest.mark.parametrize("goal", [0, 5, 37, 61])
def test_bounded_pools_give_the_selections_of_whole_pools(spark, goal):
    rng = random.Random(goal)
    rows = [("a" if i % 3 else "b", goal, f"i{i:03d}", rng.choice([0, 1, 2, 3, 7, 30, 90]), rng.choice(["mcq", "theory"]), rng.choice("xyz"), rng.choice("pqrstuvw"), rng.randrange(4), f"{rng.randrange(99):02d}") for i in range(200)]
    columns = ["request", "target", "id", "marks", "kind", "topic", "paper", "priority", "order"]
    pool = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c in ('target', 'marks', 'priority') else 'string'}" for c in columns))
    want = {0.0: [], 0.22: []}
    for request in "ab":
        frame = pd.DataFrame([r for r in rows if r[0] == request], columns=columns).sort_values(["order", "id"], kind="stable").reset_index(drop=True)
        for share, out in want.items():
            places = assemble(frame, goal, share)[0] if share else closest_subset(frame["marks"].tolist(), goal)
            out += [(request, frame["id"][i], int(frame["marks"][i])) for i in places]
    for share, out in want.items():
        got = select_exams(pool, mcq_share=share).select("request", "id", "marks").collect()
        assert sorted(map(tuple, got)) == sorted(out)
    assert bounded_pool(pool.unionByName(pool).unionByName(pool)).groupBy("request", "marks").count().where(f"count > 2 + floor(({goal} + 12) / marks)").count() == 0


def test_numbers_and_letters_of_a_syllabus(spark):
    labels = ["4A (4.1-4.3): hazards and risk", "4A (4.4-4.8): naming of alkanes", "5B: moles", "1.3.1: units", "1.3.2: forces", "Spec 7-9: waves", "Spec 20, 22: light", "U3.2: practical", "P1 5.2a: lines", "9.1: first", "9.1: second"]
    dim = spark.createDataFrame([("X", i, x) for i, x in enumerate(labels)], "unit string, place int, label string")
    want = {
        "4.2": 0, "see 4.7 there": 1, "4A naming of things": 1, "4A": 0, "5b": 2, "part 5B here": 2, "1.3.2 of it": 4, "Specification 8": 5, "spec 21": None, "SPEC20": 6, "SPEC22": None, "u3.2": 7, "3.2": 7,
        "P1 5.2a": 8, "P1 5.3": None, "5.2a lines": 8, "9.1": 10, "9.1: first": 9, "9.1: second": 10, "moles": 2, "the 1.3.1: units, all": 3, "P2 4.2": None, "1.9.9 units": None, "": None, "nothing": None,
    }
    items = spark.createDataFrame([(i, "X", g) for i, g in enumerate([*want, None])], "i int, unit string, given string")
    got = {r.i: r.label for r in resolve_number(items, dim, "unit", "label", "place", ["i"], F.col("given"), foreign=F.col("given").startswith("P2"), strict=F.lit(True)).collect()}
    assert {g: got[i] for i, g in enumerate(want)} == {g: None if k is None else labels[k] for g, k in want.items()} and got[len(want)] is None
    assert number_index(dim.limit(0), "unit", "label", "place").count() == 0 and resolve_number(items.limit(0), dim, "unit", "label", "place", ["i"], F.col("given")).count() == 0


def test_hierarchy_rules_in_order(spark):
    legal = F.array(*map(F.lit, ["eq", "names", "hazard", "alkane", "acid"]))
    rules = [scoped(legal), stripped("hazard", ~F.col("t").contains("risk")), led_by("hazard", F.col("t").contains("risk")), specific_first(["eq", "names"], ["eq", "names"]), replaced("eq", F.col("t").contains("burn"), "alkane")]
    rows = [("out", ["far", "acid", "acid", "eq"], ""), ("out", [], ""), ("hazard", ["acid"], "x"), ("hazard", [], "x"), ("acid", ["hazard"], "x"), ("acid", ["eq"], "risk"), ("eq", ["names", "acid"], ""), ("eq", ["names"], "burn"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, main string, related array<string>, t string")
    got = [(r.main, r.related) for r in apply_rules(df, "main", "related", rules).orderBy("i").collect()]
    assert got == [("acid", ["eq"]), ("eq", []), ("acid", []), ("hazard", []), ("acid", []), ("hazard", ["acid"]), ("acid", ["eq"]), ("alkane", ["eq"]), ("eq", [])]


def test_consistency_issues(spark):
    row = lambda *x: spark.createDataFrame([x], "mt string, ms string, rel array<string>, t string, s string, ts array<string>, ss array<string>, parent string")
    legal, known, topics = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("T"))
    of = lambda df: df.select(consistency(*map(F.col, ["mt", "ms", "rel", "t", "s", "ts", "ss", "parent"]), legal=legal, known=known, topics=topics).alias("x")).first().x
    assert of(row("T", "a", ["b"], "T", "a", ["T"], ["a"], "T")) == []
    assert of(row(None, " General ", None, None, None, None, None, None)) == ["invalid_main_topic", "invalid_main", "invalid_topic", "invalid_subtopic", "unknown_main_topic", "unknown_main", "foreign_main", "legacy_subtopic", "legacy_subtopics", "legacy_topics"]
    assert of(row("U", "c", ["c", "z"], "T", "c", ["T"], ["c"], "T")) == ["unknown_main_topic", "unknown_related", "foreign_main", "wrong_parent", "many_related", "main_repeated", "foreign_related", "legacy_topic", "legacy_topics"]


@pytest.mark.parametrize("share", [0.0, 0.22])
def test_selections_move_rows_once_and_cut_large_requests(spark, share):
    rng = random.Random(7)
    rows = [(r, 40, f"{r}{i:03d}", rng.choice([0, 1, 2, 3, 7, 30]), rng.choice(["mcq", "theory"]), rng.choice("xyz"), rng.choice("pqrs"), rng.randrange(4), f"{rng.randrange(99):02d}") for r, n in (("a", 90), ("b", 9), ("c", 40), (None, 60)) for i in range(n)]
    pool = spark.createDataFrame(rows + rows[:5], "request string, target int, id string, marks int, kind string, topic string, paper string, priority int, `order` string").coalesce(1)
    whole = select_exams(pool, mcq_share=share)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = sorted(map(str, whole.collect()))
    assert len({r.split("id=")[0] for r in want}) == 4
    for most_rows in (2, 45, 70):
        assert sorted(map(str, select_exams(pool, mcq_share=share, most_rows=most_rows).collect())) == want
    assert select_exams(pool.limit(0), mcq_share=share).count() == 0


def test_pools_are_looked_up_for_chosen_questions_alone(spark, small):
    plan = registry.QUERIES["q_exam_full_totals"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 1


def test_presets_do_not_bring_all_questions_to_one_task(spark):
    questions = spark.createDataFrame([("q1", "u", "WX11", "mcq", 3), ("q2", "u", "WX11", "theory", 4), ("q3", "u", "WX12", "mcq", 5)], "id string, unit string, unit_code string, kind string, marks int")
    presets = spark.createDataFrame([("a", "wx11", 9, "theory"), ("b", "WX12", 9, "theory"), ("c", "all", 9, "mcq"), ("d", "WX19", 9, "other"), ("e", "WX19", 9, "theory")], "preset string, unit_code string, target int, kind string")
    pool = preset_requests(questions, presets, ["WX1"])
    assert sorted((r.request, r.id) for r in pool.collect()) == [("a", "q2"), ("b", "q3"), ("c", "q1"), ("c", "q3"), ("d", "q1"), ("d", "q2"), ("d", "q3"), ("e", "q2")]
    assert "hashpartitioning" not in pool._jdf.queryExecution().executedPlan().toString()


def test_selections_move_numbers_to_their_request_and_no_order_to_python(spark, small):
    from questmill.plans.exams import _pool, q_exam_closest

    plan = _pool(spark, small, 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "concat" in plan and "concat" not in plan[plan.index("Join ") :]
    plan = q_exam_closest(spark, small)._jdf.queryExecution().analyzed().toString()
    assert not any("order#" in line for line in plan.splitlines()[:2]) and "Sort [request" in plan
    text = spark.createDataFrame([(f"r{k % 3}", 20, f"i{k}", 1 + k % 7, f"{(k * 37) % 101:032x}") for k in range(60)], "request string, target int, id string, marks int, order string")
    assert sorted(select_exams(text).collect()) == sorted(select_exams(text.withColumn("order", F.unhex("order"))).collect())


def test_selections_make_id_and_order_behind_the_move(spark, small):
    from questmill.plans.exams import q_exam_closest

    plan = q_exam_closest(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression") :]
    assert "md5" in plan and "md5" not in moved and "concat" not in moved
    raw = spark.createDataFrame([(k % 3, 20, 1 + k % 7, k // 2) for k in range(60)], "request long, target int, marks int, n long")
    made = {"id": F.concat(F.lit("i"), F.col("n").cast("string")), "order": F.unhex(F.md5((F.col("n") % 9).cast("string")))}
    want = sorted(map(str, select_exams(raw.withColumns(made).withColumn("request", F.col("request").cast("string"))).collect()))
    assert len(want) > 3
    for most_rows in (2, 20, 1000):
        assert sorted(map(str, select_exams(raw, made=made, most_rows=most_rows).collect())) == want
    mixed = raw.where("request > 0 or n < 9")
    assert sorted(map(str, select_exams(mixed, made=made, most_rows=10).collect())) == sorted(map(str, select_exams(mixed.withColumns(made)).collect()))
