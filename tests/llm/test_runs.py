"""Periodic runs against a search of every period at every place."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from questmill.llm.entries import op12_periodic_runs
from questmill.llm.runs import find_runs, kept_words, periodic_runs


def brute_runs(words, least=24, times=3):
    """All maximal stretches with their smallest period."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, length, q) for (a, length), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute_runs(words)
    drop = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("least,times", [(24, 3), (1, 3), (5, 3), (7, 4), (40, 5)])
def test_runs_of_random_words(least, times):
    rng = np.random.default_rng(least)
    for k in range(400):
        words = rng.integers(0, 1 + k % 4, rng.integers(0, 90))
        for _ in range(k % 4):
            piece = rng.integers(0, 3, rng.integers(1, 12))
            words = np.concatenate([words, np.tile(piece, rng.integers(2, 9))[: rng.integers(1, 90)], rng.integers(0, 30, k % 5)])
        assert find_runs(words, least, times) == brute_runs(words.tolist(), least, times)


def test_long_runs():
    rng = np.random.default_rng(1)
    for period in (1, 7, 8, 9, 16, 1000, 6666, 6667):
        words = np.tile(rng.integers(0, 10**9, period), 20_000 // period + 1)[:20_000]
        assert find_runs(words) == ([(0, 20_000, period)] if 3 * period <= 20_000 else [])
    assert find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert find_runs(np.arange(300_000)) == [] and find_runs(np.zeros(23, np.int64)) == [] and find_runs(np.zeros(0, np.int64)) == []
    assert kept_words(6, [(1, 4, 1)]).tolist() == [True, True, False, False, False, True]


def test_query(spark, small, documents):
    got = op12_periodic_runs(spark, small)
    assert got.columns == COLUMNS
    short = {r.doc_id: r.text for r in documents.collect()}
    for r in got.collect():
        if len(short[r.doc_id]) < 12_000:
            assert tuple(r) == wanted(r.doc_id, short.pop(r.doc_id))
    assert len(short) < 10


def test_odd_rows(spark, odd, none, tmp_path):
    rows = periodic_runs(odd).collect()
    assert len(rows) == odd.count() and periodic_runs(none).collect() == []
    by_id = {r.doc_id: r for r in rows}
    assert by_id[10].runs[0].asDict() == {"start": 0, "length": 300, "period": 1} and by_id[10].collapsed == "word"
    assert all(by_id[i].runs == [] and by_id[i].collapsed == "" for i in (1, 2, 3)) and by_id[4].collapsed == "one two three"
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in op12_periodic_runs(spark, str(tmp_path)).collect() if r.doc_id not in (7, 8)]
    want = [wanted(r.doc_id, r.text) for r in odd.collect() if r.doc_id not in (7, 8)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_planted_documents_of_every_id(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = [(k, " ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 300)))) for k in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_periodic_runs(spark, str(tmp_path)).collect()))
    assert got == [wanted(i, t) for i, t in texts] and sum(r[1] > 0 for r in got) > 10
