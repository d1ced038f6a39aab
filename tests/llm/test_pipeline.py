"""The stages against plain versions of what each decides, and the registered queries against their SQL."""

import random

import duckdb
import pytest

import corpus_pipeline
from questmill.llm import entries
from questmill.llm.near_dup import near_duplicates
from questmill.llm.quality import with_quality
from questmill.llm.shared import stash

from .test_judges import base_counts
from .test_near_dup import brute
from .test_tokens import check_pieces


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{small}/labels.parquet")
    kept = stash(corpus_pipeline.quality_rules(spark, docs, small))
    assert kept.columns == columns and kept.count() == with_quality(docs, labels).where("quality.kept").count()
    assert not any(base_counts(r.text)[-1] for r in kept.collect())
    told = stash(corpus_pipeline.language_id(spark, kept, small))
    assert told.columns == columns and told.count() == kept.count()  # all of these are clean prose
    single = stash(corpus_pipeline.near_dedup(spark, told, small))
    want = brute([(r.doc_id, r.text) for r in told.collect()], percent=80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, low) in want.items() if i == low)
    assert near_duplicates(single).where("not kept").count() == 0
    clean = stash(corpus_pipeline.personal_data(spark, single, small))
    assert clean.columns == columns and clean.where("text rlike '[a-z0-9]+@mail[0-9]+[.]example' or n_chars <> length(text)").count() == 0
    pieces = corpus_pipeline.packing(spark, clean, small).collect()
    check_pieces(pieces, [r.text for r in clean.collect()])


def test_near_dedup_decides_on_rows(spark):
    one, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(3, one, 1), (5, other, 2), (5, one + " tail", 3), (5, other, 1), (6, third, 1), (6, third + " tail", 1), (7, "", 1), (7, None, 1), (7, "", 1), (8, "Four words of it", 1), (8, "four words  of it", 1), (None, one, 1), (None, one, 1), (None, third, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    six = [r for r in got if r[0] == 6]
    eight = [r for r in got if r[0] == 8]
    assert len(six) == len(eight) == 1 and six[0] in rows and eight[0] in rows
    rest = sorted((r for r in got if r[0] not in (6, 8)), key=repr)
    assert rest == sorted([(3, one, 1), (5, other, 1), (7, "", 1), (7, None, 1), (None, one, 1), (None, one, 1), (None, third, 1)], key=repr)


def test_run(spark, small):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "PII", "packing"]
    assert corpus_pipeline.run(spark, small).count() > 0


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(entries.oracle_sql()[name])
    got = entries.queries()[name](spark, small)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, want.df()[columns].values.tolist())) == sorted(map(tuple, got.toPandas()[columns].values.tolist()))


def test_stages_keep_columns_of_any_name_and_type(spark, small, tmp_path):
    rng = random.Random(1)
    kept = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c``d` int, m map<string,int>, s struct<`x.y`:int>, __id int, __key string, __quality string, __lang int, __share string, __row int, __order int, kept int, __text string"
    base = spark.read.parquet(f"{small}/documents.parquet").where("lang is not null").limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, f"a{k}", k, {"k": k} if k % 3 else None, (k,), 7, f"key {rng.random()}", "q", k, "share", 5, 6, 8, "t") for k, r in enumerate(base)]
    docs = spark.createDataFrame(rows, kept)
    want = {r[0]: r for r in rows}
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.language_id, corpus_pipeline.near_dedup, corpus_pipeline.personal_data):
        docs = stash(stage(spark, docs, small))
        assert docs.columns == [f.name for f in spark.createDataFrame([], kept).schema]
        got = docs.collect()
        assert len(got) > 10
        for r in got:
            same = [(x, y) for k, (x, y) in enumerate(zip(r, want[r.doc_id], strict=True)) if k not in (1, 4)]
            assert all(tuple(x) == y if isinstance(x, tuple) else x == y for x, y in same)
    assert corpus_pipeline.packing(spark, docs, small).count() >= docs.count()
