"""Importance resampling against a plain version that counts every document by itself."""

import hashlib
import math
import re
import zlib
from collections import Counter

from questmill.llm import importance
from questmill.llm.entries import op13_segment_resampling

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target):
    read = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, x in read for b in x), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out = []
    for i, n, x in read:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: 5 * len(order) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def test_query(spark, small, documents):
    got = op13_segment_resampling(spark, small)
    assert got.columns == COLUMNS
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = plain([(r.doc_id, r.text) for r in documents.collect()], target)
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(r[4] is not None for r in want) > 5


def test_odd_rows(spark, odd, none, documents):
    target = spark.createDataFrame([("one two three\nalpha",), (None,), ("",)], "text string")
    both = odd.select("doc_id", "text").union(documents.select("doc_id", "text")).union(odd.select("doc_id", "text"))
    got = importance.resample(both, target).select(*COLUMNS).collect()
    want = plain([tuple(r) for r in both.collect()], ["one two three\nalpha"])
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert importance.resample(none, target).collect() == [] and importance.resample(odd, none).count() == odd.count()


def test_runs_across_lines_and_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(importance, "HOT_SHARE", 0.05)
    text = "The\n\n one  TWO\nthree, four\n.\nfive\nsix\nÀé ÉE\r\n\n"
    docs = [(k, f"{text}{'x y z ' * (k % 30)}\nthe same line in every text\n{text * (k % 3)}tail {k}") for k in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    target = ["the same line in every text\nthree four", "x y z"]
    got = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string")).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(plain(docs, target))
    split = [importance.WORD.findall(x) for x in text.encode().lower().split(b"\n")]
    whole = [b for words in split for b in importance.gram_buckets(words)] + importance.crossing_buckets(split)
    assert sorted(whole) == sorted(features(text)[1])
