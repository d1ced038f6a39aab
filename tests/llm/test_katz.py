"""The language model against a plain version with dictionaries, and its sums over all words."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from questmill.llm import katz
from questmill.llm.entries import op11_katz_scores


def out():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def words(text):
    return [w for w in bytes(text or "", "utf-8").lower().split()] + [None]


class Plain:
    """Katz backoff of order two, one token at a time."""

    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for t in texts:
            h = "begin"
            for w in words(t):
                self.one[w] += 1
                self.two[h, w] += 1
                h = w
        self.after = Counter()
        self.follow = {}
        for (h, w), c in self.two.items():
            self.after[h] += c
            self.follow.setdefault(h, []).append(w)
        self.total = sum(self.one.values())
        self.d = [katz.discounts(Counter(x.values())) for x in (self.one, self.two)]
        low = self.one and min(self.one.values()) > katz.CUT
        self.p1 = {w: self.cut(c, self.d[0], low) / self.total for w, c in self.one.items()}
        self.unknown = 1 - math.fsum(self.p1.values())
        self.weights = {}

    @staticmethod
    def cut(c, d, all_high):
        return d[c] * c if c <= katz.CUT else c - 0.5 * bool(all_high)

    def pair(self, h, w):
        high = min(self.two[h, x] for x in self.follow[h]) > katz.CUT
        return self.cut(self.two[h, w], self.d[1], high) / self.after[h]

    def p(self, h, w):
        if (h, w) in self.two:
            return self.pair(h, w)
        if h not in self.after:
            return self.p1.get(w, self.unknown)
        if h not in self.weights:
            self.weights[h] = (1 - math.fsum(self.pair(h, x) for x in self.follow[h])) / (1 - math.fsum(self.p1[x] for x in self.follow[h]))
        return self.weights[h] * self.p1.get(w, self.unknown)

    def score(self, text):
        h, out = "begin", []
        for w in words(text):
            out.append(math.log10(self.p(h, w)))
            h = w
        return math.fsum(out)

    def base(self, text):
        return math.fsum(math.log10((self.one[w] + 0.1) / (self.total + 0.1 * (len(self.one) + 1))) for w in words(text))


def check(rows, texts):
    model = Plain([t for i, t in texts if not held(i)])
    assert len(rows) == len(texts)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    want = sorted(((i, t) for i, t in texts), key=key)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for i, t in want:
        w = words(t)
        match = [r for r in got[i] if r.n_tokens == len(w) and math.isclose(r.score, model.score(t), rel_tol=1e-9, abs_tol=1e-9)]
        assert match, (i, t and t[:40], model.score(t), got[i])
        r = match[0]
        assert r.held_out == held(i) and r.train_tokens == model.total and r.n_known == sum(model.one[x] > 0 for x in w)
        assert math.isclose(r.base_score, model.base(t), rel_tol=1e-9, abs_tol=1e-9)
    return model


def test_scores_equal_the_plain_model(spark, documents):
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    rows = katz.score_texts(documents, held_out=out(), block_tokens=3000, part_tokens=5000).collect()
    model = check(rows, texts)
    fresh = [r for r in rows if r.held_out]
    assert len(fresh) > 10 and sum(r.score for r in fresh) > sum(r.base_score for r in fresh)
    for h in ["begin", b"the", *list(model.follow)[5:200:20]]:
        assert math.isclose(sum(model.p(h, w) for w in model.one) + model.p(h, b"\x00 none"), 1, abs_tol=1e-9)


def test_sums_over_all_words_are_one(spark):
    rng = np.random.default_rng(1)
    words_ = katz.Words([(9, 1), (4, 2), (2, 3), (1, 5)], 6)
    ids = np.array([katz.END, katz.UNKNOWN, *range(katz.FIRST, katz.FIRST + 11)])
    assert words_.count(ids).tolist() == [6, 0, 9, 4, 4, 2, 2, 2, 1, 1, 1, 1, 1]
    assert math.isclose(words_.p(ids).sum(), 1) and math.isclose(katz.Words([(9, 3)], 6).p(np.array([0, 2, 3, 4, 5])).sum(), 1)
    d = katz.discounts({1: 50, 2: 20, 3: 9, 4: 5, 5: 3, 6: 2})
    assert (d[1:] > 0).all() and (d[1:] < 1).all()
    packed = rng.integers(-(2**60), 2**60, 1000)
    assert (katz.unpack(katz.pack(packed), np.int64) == packed).all() and len(katz.unpack(katz.pack(packed[:0]), np.int64)) == 0


def test_odd_rows(spark, odd, none):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    check(katz.score_texts(odd, held_out=out()).collect(), texts)
    assert katz.score_texts(none, held_out=out()).collect() == []
    alone = katz.score_texts(odd, held_out=F.lit(True)).collect()
    assert len(alone) == len(texts) and all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in alone)


@pytest.mark.parametrize("texts", [["a a a a a a a a", "b a"], ["x y"] * 40 + ["x z"], ["", None, ""], ["one"] * 7])
def test_small_corpora(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts * 3)]
    check(katz.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), held_out=out(), block_tokens=7, part_tokens=3).collect(), rows)


def test_query(spark, small, documents):
    got = op11_katz_scores(spark, small)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and got.count() == documents.count()
