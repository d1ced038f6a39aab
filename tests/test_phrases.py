"""Phrase search against a plain search, with one automaton and with several."""

import random

import pytest

import duckdb

from questmill import registry
from questmill.operators.phrases import longest_first, lowered, phrase_hits


def plain(text, phrases):
    low = lowered(text or "")
    edge = lambda i: i < 0 or i >= len(low) or not low[i].isalnum()
    found = [(i, i + len(p)) for p in phrases for i in range(len(low)) if p and low.startswith(p, i) and edge(i - 1) and edge(i + len(p))]
    return sorted(found)


@pytest.mark.parametrize("most", [10_000, 9])
def test_hits(spark, most):
    rng = random.Random(2)
    words = ["ab", "abc", "b", "Éa", "c d", "ß", "İx", "a"]
    phrases = ["ab", "ab abc", "abc b", "b", "éa", "c d ab", "a a", "", None, "AB"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for k in range(80)] + [(90, None), (91, ""), (92, "ab-ab.ab ab")]
    frame = spark.createDataFrame(texts, "id int, text string").repartition(3)
    known = spark.createDataFrame([(p,) for p in phrases], "p string")
    small = {(p or "").lower() for p in phrases} - {""}
    for overlapping in (True, False):
        got = {r.id: [(h.start, h.start + h.length) for h in r.hits] for r in phrase_hits(frame, ["id"], "text", known, "p", overlapping=overlapping, most=most).collect()}
        for k, text in texts:
            want = plain(text, small)
            assert sorted(got[k]) == want if overlapping else got[k] == longest_first(want)
    none = phrase_hits(frame, ["id"], "text", known.limit(0), "p").collect()
    assert len(none) == len(texts) and not any(r.hits for r in none)


def test_phrases_that_overlap_themselves_agree_with_their_sql(spark, tmp_path):
    texts = ["atthe the the end", "the the the the", "the the", "so the th", "the thee the the.", "no. no no no no", "the  the the", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "The the end"), (2, "no no more"), (3, "so the rest")], "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "the end is")], "conv_id long, turn long, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = sorted(con.execute(registry.ORACLES["q_phrase_hits"]).fetchall())
    assert sorted(map(tuple, registry.QUERIES["q_phrase_hits"](spark, str(tmp_path)).collect())) == want
    assert (0, 1, 6, 7, 1) in want and (1, 2, 8, 14, 1) in want and (5, 2, 14, 10, 1) in want
