"""Streams in several batches: sittings with timers and late rows, state in deltas, machines folded in chunks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from questmill.operators.ordered import fold_machine
from questmill.plans import streams
from questmill.streaming import sittings
from questmill.streaming.progress import folded, merge_batches
from questmill.streaming.sittings import clicked, next_status, run_sittings

DAY = datetime(2024, 3, 1)
EVENT = "user_id long, ts timestamp, event_id long, marks long, submits boolean"


def at(minutes):
    return DAY + timedelta(minutes=minutes)


def test_sittings_close_by_timer_and_survive_a_restart(spark, tmp_path):
    folder = str(tmp_path)

    def more(rows):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{folder}/in")
        got = run_sittings(spark, stream, 60, "10 minutes", f"{folder}/out", f"{folder}/checkpoint")
        return sorted((r.user_id, (r.opened - DAY).seconds // 60, (r.closed - DAY).seconds // 60, r.answers, r.total, r.reason) for r in got.collect())

    first = more([(1, at(0), 1, 5, False), (1, at(10), 2, 3, False), (2, at(5), 3, 1, False), (2, at(6), 4, 2, True)])
    assert first == [(2, 5, 6, 2, 3, "submitted")]
    second = more([(1, at(20), 5, 1, False), (3, at(55), 6, 9, False)])  # the same sitting goes on after the restart
    assert second == first
    third = more([(4, at(90), 7, 1, False)])  # the watermark reaches 80: the sitting of user 1 closes by itself
    assert third == sorted([*first, (1, 0, 60, 3, 9, "time")])
    fourth = more([(1, at(30), 8, 100, False), (3, at(120), 9, 4, True)])  # a late row is left out; user 3's time was up at 115
    assert fourth == sorted([*third, (3, 55, 115, 1, 9, "time"), (3, 120, 120, 1, 4, "submitted")])


def test_state_in_deltas(spark, tmp_path):
    folder, rows = str(tmp_path), []
    schema = "user_id long, ts timestamp, event_type string, event_id long"
    for k in range(5):
        part = [(u, at(10 * k + u), f"type {k}", 100 * k + u) for u in range(6) if (u + k) % 3]
        rows += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        merge_batches(stream, f"{folder}/state", f"{folder}/checkpoint", ["user_id"], every=2)
    want = {u: max((ts, kind, i) for v, ts, kind, i in rows if v == u) for u in range(6)}
    assert {r.user_id: (r.ts, r.event_type, r.event_id) for r in folded(spark, f"{folder}/state", ["user_id"]).collect()} == want
    assert {p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("full")} == {"full=1", "full=3"}


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_machines_fold_alike_in_chunks_of_any_size(spark, chunk):
    rows = [(k % 3, k, (k * k + k // 5) % 6) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, n int, x int").repartition(4)
    got = fold_machine(df, ["g"], F.floor(F.col("n") / chunk), ["n"], F.col("x"), 6, lambda s, x: F.when(x == s + 1, x).otherwise(s))
    want = {}
    for g, _, x in rows:
        want[g] = x if x == want.get(g, 0) + 1 else want.get(g, 0)
    assert {r.g: r.state for r in got.collect()} == want


def test_status_cycle(spark):
    rows = spark.createDataFrame([(s,) for s in (None, "unattempted", "review", "incorrect", "mastered", "correct")], "s string")
    assert [r.n for r in rows.select(next_status(F.col("s")).alias("n")).collect()] == ["review", "review", "mastered", "mastered", "unattempted", "unattempted"]
    line = spark.range(1).select(clicked(F.array(F.lit(None).cast("string"), F.lit("incorrect"), F.lit(None), F.lit(None))).alias("end"))
    assert line.first().end == "unattempted"


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        streams.shared_folder(Session())


def test_sittings_read_their_state_once_a_batch_for_many_users(spark, tmp_path, monkeypatch):
    calls = str(tmp_path / "calls")

    def counted(minutes, fold=sittings._sittings_of):
        def call(key, batches, state):
            with open(calls, "a") as f:
                f.write(f"{key[0]}\n")
            yield from fold(minutes)(key, batches, state)

        return call

    monkeypatch.setattr(sittings, "_sittings_of", counted)
    rows = [(u, at(k), 100 * u + k, 1, k % 2 == 1) for u in range(32) for k in range(8)] + [(-1, at(3), 1, 2, False), (None, at(4), 2, 3, False), (None, at(5), 4, 2, True), (99, at(300), 3, 1, False)]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = sittings.run_sittings(spark, spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), 60, "10 minutes", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    found = sorted(((r.user_id, r.opened, r.closed, r.answers, r.total, r.reason) for r in got.collect()), key=str)
    want = [(u, at(k), at(k + 1), 2, 2, "submitted") for u in range(32) for k in range(0, 8, 2)] + [(-1, at(3), at(63), 1, 2, "time"), (None, at(4), at(5), 2, 5, "submitted")]
    assert found == sorted(want, key=str)
    with open(calls) as f:  # a call for the sitting of user -1 closes it
        assert sorted(f.read().lower().replace("none", "nan").split()) == ["-1", "-1", "0", "1", "6", "nan"]
