"""The asset store: round trips, failing tasks and retries; the table function against the grouped selection."""

import os

import pytest
from pyspark.sql import functions as F

from questmill.operators.exam import register_build_exam, select_exams
from questmill.sources.assets import AssetWriter, Store, listing, to_upload, upload

ASSET = "key string, content binary"


def files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)


def test_round_trip(spark, tmp_path):
    store = str(tmp_path / "store")
    assert listing(spark, store).collect() == []
    rows = spark.createDataFrame([(f"a/{k}.png", bytearray(b"x" * k)) for k in range(20)], ASSET).repartition(4)
    upload(to_upload(rows, listing(spark, store), "new", "again"), store)
    got = {r.key: (r.size, r.content_type, r.cache_control) for r in listing(spark, store).collect()}
    assert got == {f"a/{k}.png": (k, "image/png", "new") for k in range(20)}
    assert to_upload(rows, listing(spark, store), "new", "again").count() == 0
    assert to_upload(rows, listing(spark, store), "new", "again", force=True).count() == 20
    changed = spark.createDataFrame([("a/3.png", bytearray(b"longer")), ("b.webp", bytearray(b"y"))], ASSET)
    upload(to_upload(changed, listing(spark, store), "new", "again"), store)
    got = {r.key: (r.size, r.content_type, r.cache_control) for r in listing(spark, store).collect()}
    assert got["a/3.png"] == (6, "image/png", "again") and got["b.webp"] == (1, "image/webp", "new") and len(got) == 21
    page = spark.read.format("assets").option("store", store).load().where("page = 1 and key = 'b.webp'").first()
    assert Store(store).get(page.object) == b"y" and len(Store(store).pages()) == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("a.png", bytearray(b"1")), ("b.png", bytearray(b"2")), (None, bytearray(b"3"))], ASSET).coalesce(1)
    with pytest.raises(Exception, match="no key"):
        upload(rows.withColumn("content_type", F.lit("x")).withColumn("cache_control", F.lit("y")), store)
    assert files(store) == [] and listing(spark, store).count() == 0


def test_retries(tmp_path):
    class Flaky(Store):
        left = 2

        def put(self, content):
            if self.left:
                self.left -= 1
                raise OSError("busy")
            return super().put(content)

    rows = [{"key": "a", "content": b"1", "content_type": "t", "cache_control": "c"}]
    store = Flaky(str(tmp_path))
    writer = AssetWriter(store, 3, 0.0)
    message = writer.write(iter(rows))
    assert store.pages() == [] and len(files(tmp_path)) == 1
    writer.commit([message, None])
    assert [r["key"] for r in store.read_page(store.pages()[0])] == ["a"]
    store.left = 3
    with pytest.raises(OSError):
        writer.write(iter(rows))
    again = AssetWriter(store, 3, 0.0).write(iter(rows))
    writer.abort([again])
    assert len(files(tmp_path / "objects")) == 1 and len(store.pages()) == 1


def test_table_function_equals_the_grouped_selection(spark):
    rows = [(f"r{k % 5}", 30 + k % 5, f"i{k}", 1 + (k * k) % 9, f"{(k * 37) % 101:03d}") for k in range(200)]
    pool = spark.createDataFrame(rows, "request string, target int, id string, marks int, order string")
    register_build_exam(spark)
    pool.createOrReplaceTempView("pool_of_test")
    by_function = spark.sql("SELECT * FROM build_exam(TABLE(pool_of_test) PARTITION BY request ORDER BY (`order`, id))")
    grouped = select_exams(pool).drop("log")
    assert sorted(map(tuple, by_function.collect())) == sorted(map(tuple, grouped.select(by_function.columns).collect()))


@pytest.mark.parametrize("size", [3, 50, 10_000])
def test_table_function_reads_many_requests_of_a_part_in_batches(spark, size):
    rows = [(f"r{k % 13}" if k % 13 else None, 30 + k % 13, f"i{k}", (k * k) % 9, f"{(k * 37) % 101:03d}") for k in range(400)]
    pool = spark.createDataFrame(rows, "request string, target int, id string, marks int, order string")
    register_build_exam(spark)
    pool.createOrReplaceTempView("pool_of_test")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, size)
    try:
        by_part = spark.sql("SELECT * FROM build_exam(TABLE(pool_of_test) PARTITION BY pmod(hash(request), 2) ORDER BY (request, `order`, id))").collect()
    finally:
        spark.conf.set(setting, before)
    grouped = select_exams(pool).drop("log")
    assert sorted(map(str, by_part)) == sorted(map(str, grouped.select("request", "id", "marks", "total", "target").collect()))
