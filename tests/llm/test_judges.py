import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from questmill.llm import langid, pii
from questmill.llm.quality import with_quality


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, windows = len(words), Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i in range(n - 2):
        if windows[words[i], words[i + 1], words[i + 2]] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def test_quality_counts_and_verdicts(spark, documents, odd, none, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    for docs in (documents, odd):
        rows = with_quality(docs, labels).select("doc_id", "text", "quality.*").collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(r.text)
            assert not (r.base_failed and r.kept)
    judged = with_quality(documents, labels).join(labels.withColumnRenamed("quality", "good"), "doc_id").where("not quality.base_failed")
    assert judged.where("good = 1 and not quality.kept").count() == 0
    assert judged.where("good = 0 and quality.kept").count() == 0
    assert with_quality(none, labels).collect() == []
    assert with_quality(documents, labels.limit(0)).where("quality.score <> 0").count() == 0


def test_quality_filter_stays_above_the_counts(spark, documents, small):
    plan = with_quality(documents, spark.read.parquet(f"{small}/labels.parquet")).where("quality.kept")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.replace("+- ", "").strip().startswith("Filter ") and "judged" in line]
    assert filters and not any("xxhash64" in line or "regexp_extract_all" in line for line in filters)


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        odd = [int(c) for c in d[::-1]]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(odd)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(3)
    alphabet = list("0123456789") * 3 + list("@.+-( )ab_%é") + ["255", "4111111111111111", "a@b.c", "+1 (234) 555-6789"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.render(pii.base_spans(text)) == base_spans(text)
    assert pii.base_spans("9" * 200_000 + "x" * 200_000) == []


def test_addresses_with_very_long_numbers():
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []
    zeros = "0" * 5000 + "7.1.255.1"
    assert pii.base_spans(zeros) == [(0, len(zeros), 1)] and pii.base_spans("1.256.1.1 0256.1.1.1") == []


@pytest.fixture(scope="module")
def tagger(documents):
    return pii.fit(documents)


def spelled(rng):
    """Personal data in spellings that the patterns miss, from words and formats of this test's own."""
    one = lambda *x: x[int(rng.integers(len(x)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    roll = int(rng.integers(3))
    if roll == 0:
        name = one("maria.schmidt", "j.doe", "support", "info", "anna_lopez", "press-office", "li.wei88", "t.okafor", "sales.team", "webmaster")
        at, dot = one((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", "."), (" @ ", "."))
        return name + at + one("firma-nord", "uni-leipzig", "acme", "blue-river", "museum", "data4u", "northwind") + dot + one("de", "com", "org", "net", "fr"), 0
    if roll == 1:
        body = one("4", "5", "37") + digits(16)
        body = body[:15]
        check = next(c for c in "0123456789" if pii.luhn(body + c))
        number = body + check
        return one(".", "  ").join(number[i : i + 4] for i in range(0, 16, 4)), 2
    return one(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"({digits(3)}){digits(3)}-{digits(4)}", f"0{digits(2)}/{digits(7)}"), 3


def test_network_on_spans_of_another_source(documents, tagger):
    rng = np.random.default_rng(5)
    prose = [r.text for r in documents.where("length(text) > 2500 and not text rlike '[0-9@]'").limit(40).collect()]
    texts, wanted = [], []
    for k in range(600):
        text, (span, kind) = prose[k % len(prose)], spelled(rng)
        cut = text.index(" ", int(rng.integers(0, len(text) - 600)))
        left = text[:cut] + (" call " if kind == 3 else " write to ")
        texts.append(left + span + " today. " + text[cut + 1 :])
        wanted.append((len(left), len(left) + len(span), kind))
    base = [pii.base_spans(t) for t in texts]
    open_ = [i for i, b in enumerate(base) if not b]
    got = [set(g) for g in pii.add_spans(tagger, texts, base)]
    assert len(open_) > 500
    assert sum(wanted[i] in got[i] for i in open_) >= 0.9 * len(open_)
    assert sum(len(got[i] - {wanted[i]}) for i in open_) <= 0.02 * len(open_)
    assert [len(g) for g in pii.add_spans(tagger, prose, [[] for _ in prose])] == [0] * len(prose)  # clean text is left alone


def test_windows_cover_and_meet_outside():
    for n in (1, 5, pii.SPAN_WINDOW, pii.SPAN_WINDOW + 1, 3 * pii.SPAN_WINDOW + 77):
        at = 0
        for a, b in pii._windows(n):
            assert a <= at and b > at
            at = b
        assert at == n
    # a span in the overlap that only the second window sees whole is read from there
    n, step = 2 * pii.SPAN_WINDOW - pii.OVERLAP, pii.SPAN_WINDOW - pii.OVERLAP
    first, second = np.zeros(pii.SPAN_WINDOW, np.int64), np.zeros(pii.SPAN_WINDOW, np.int64)
    first[-20:], second[pii.OVERLAP - 20], second[pii.OVERLAP - 19 : pii.OVERLAP + 30] = 2, 1, 2
    first[-20] = 1
    parts = pii.reconciled(n, [(0, first, np.ones(len(first))), (step, second, np.ones(len(second)))])
    whole = np.concatenate([lab for _, lab, _ in parts])
    assert len(whole) == n and np.flatnonzero(whole).tolist() == list(range(step + pii.OVERLAP - 20, step + pii.OVERLAP + 30))
    assert pii.reconciled(n, [(step, second, np.ones(len(second)))])[-1][0] + len(pii.reconciled(n, [(step, second, np.ones(len(second)))])[-1][1]) == n


def test_proof_of_outside_is_right(documents, tagger):
    texts = [r.text for r in documents.collect() if r.text]
    windows = sorted([t[a:b] for t in texts[:80] for a, b in pii._windows(len(t))], key=len, reverse=True)
    lengths = np.array([len(w) for w in windows])
    grid = np.zeros((len(windows), lengths[0]), np.int64)
    for j, w in enumerate(windows):
        grid[j, : len(w)] = pii.symbols(w)
    scores = tagger.emissions(grid, lengths)
    sure, labels = tagger.certain(scores, lengths), tagger.viterbi(scores, lengths)
    assert sure.any() and not labels[sure].any()
    for j in (0, len(windows) // 2, len(windows) - 1):  # what stands beside a window does not matter
        alone = tagger.emissions(grid[j : j + 1, : lengths[j]], lengths[j : j + 1])
        assert np.allclose(alone[:, :, 0], scores[: lengths[j], :, j], atol=1e-3)


def test_personal_data_of_documents(documents, odd, none, tagger):
    for docs in (documents, odd):
        text = {r.doc_id: r.text or "" for r in docs.collect()}
        rows = pii.find_personal_data(docs, tagger, keep_text=True).collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = base_spans(text[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(want.split(",")) * bool(want)
            assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert pii.find_personal_data(none, tagger).collect() == []
    assert pii.redact("a b@c.de f +1 (234) 555-6789.", pii.base_spans("a b@c.de f +1 (234) 555-6789.")) == "a <EMAIL> f <PHONE>."
    changed = pii.redact_documents(odd, tagger)
    assert changed.columns == odd.columns and changed.where("text is null").count() == 1
    # the network finds most spellings that the patterns miss, and little else
    rng = np.random.default_rng(99)
    found = wanted = extra = 0
    for text, spans in pii.labelled_windows([r.text for r in documents.collect()], rng)[-600:]:
        got = pii.add_spans(tagger, [text], [[]])[0]
        wanted += len(spans)
        found += len(set(got) & set(spans))
        extra += len(set(got) - set(spans))
    assert found > 0.5 * wanted and extra < 0.05 * wanted


def test_long_spans_are_found_whole(documents, tagger):
    for found in ("customer.support.international.department (at) example (dot) com", "a.name (at) the-long-name-of-a-very-large-company-of-sorts.example (dot) org"):
        text = f"please write to {found} today"
        assert pii.add_spans(tagger, [text], [[]])[0] == [(16, 16 + len(found), 0)]
    rows = [(t, s) for t, s in pii.labelled_windows([r.text for r in documents.collect()], np.random.default_rng(99))[-900:] if s and s[0][1] - s[0][0] >= 40]
    got = pii.add_spans(tagger, [t for t, _ in rows], [[] for _ in rows])
    assert len(rows) > 50 and sum(set(s) <= set(g) for g, (_, s) in zip(got, rows, strict=True)) > 0.5 * len(rows)


def test_language_on_held_out_documents(documents, odd, none):
    model = langid.fit(documents)
    rows = langid.with_language(documents, model).collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) > 20 and sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)
    strange = {r.doc_id: r for r in langid.with_language(odd, model).collect()}
    assert strange[1].lang_pred == strange[2].lang_pred == strange[3].lang_pred == "und"
    assert len(langid.with_language(odd, model).collect()) == 12
    assert langid.with_language(none, model).collect() == []
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.with_language(documents, None).collect()} == {"und"}


def test_columns_of_any_name_pass_through(spark, small, documents, tagger):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    names = ["__text", "__redacted", "__n", "lang_pred", "score", "quality", "row", "judged", "words", "c0", "c1", "a.b"]
    docs = documents.limit(20).select("doc_id", "text", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    clean = pii.redact_documents(docs, tagger)
    assert clean.columns == docs.columns and clean.select("__text", "__redacted", "c0", "`a.b`").distinct().collect() == [(0, 1, 9, 11)]
    told = langid.with_language(docs, langid.fit(documents))
    assert sorted(told.columns) == sorted(docs.columns) and told.select("__text", "__n", "quality", "`a.b`").distinct().collect() == [(0, 2, 5, 11)]
    judged = with_quality(docs, labels)
    assert sorted(judged.columns) == sorted(docs.columns) and judged.select("row", "judged", "words", "`a.b`").distinct().collect() == [(6, 7, 8, 11)]
    assert judged.where("quality.n_words is null").count() == 0


def test_words_of_switched_text(documents):
    model = langid.fit(documents)
    by = {}
    for r in documents.where("length(text) > 1500").collect():
        by.setdefault(r.lang, r.text.split()[:60])
    a, b = "en", next(x for x in ("de", "fr", "es") if x in by)
    labeller = langid.Labeller(model)
    rows = labeller.rows(by[a] + by[b])
    post = labeller.posteriors(rows[rows >= 0], np.array([(rows >= 0).sum()]))
    named = [model.languages[i] for i in post.argmax(1)]
    assert named[:50].count(a) > 45 and named[-50:].count(b) > 45


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    scores, trans, start = rng.random((1, 5, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    post, moves = langid.forward_backward(scores, np.array([5]), trans, start)
    total, want, pairs = 0.0, np.zeros((5, 3)), np.zeros((3, 3))
    for path in np.ndindex(*[3] * 5):
        p = start[path[0]] * np.prod([scores[0, t, path[t]] for t in range(5)]) * np.prod([trans[path[t], path[t + 1]] for t in range(4)])
        total += p
        for t in range(5):
            want[t, path[t]] += p
        for t in range(4):
            pairs[path[t], path[t + 1]] += p
    assert np.allclose(post[0], want / total) and np.allclose(moves, pairs / total)


def test_texts_without_a_letter_are_undetermined(spark, documents):
    model = langid.fit(documents)
    rows = spark.createDataFrame([(1, "²"), (2, "½ ①"), (3, "12 -- 7_8"), (4, None), (5, "Ⅷ ٣"), (6, "² the")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.with_language(rows, model).collect()}
    assert all(got[k] == ("und", 0.0) for k in (1, 2, 3, 4, 5)) and got[6][0] != "und"


def test_a_language_of_long_documents_alone_is_learned(spark, documents):
    rows = [(k, " ".join(f"zug{chr(97 + (i * k) % 26)}om" for i in range(4000)), "xx") for k in range(40)]
    both = documents.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = langid.fit(both)
    assert "xx" in model.languages
    told = langid.with_language(spark.createDataFrame([(1, "zugaom zugbom zugcom zugdom")], "doc_id long, text string"), model).first()
    assert told.lang_pred == "xx"


def test_quality_scores_equal_a_plain_version(spark, documents, small):
    from math import log

    import xxhash

    from questmill.llm.quality import BUCKETS, SMOOTHING

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = lambda w, seed=42: xxhash.xxh64(w.encode(), seed=seed).intdigest()
        return [h(w[-3:]) % BUCKETS for w in words] + [h(a, h(b)) % BUCKETS for a, b in zip(words, words[1:], strict=False)]

    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    texts = {r.doc_id: grams(r.text) for r in documents.collect()}
    raw, target = Counter(b for x in texts.values() for b in x), Counter(b for i, x in texts.items() if i in good for b in x)
    a, b = sum(raw.values()) + SMOOTHING * BUCKETS, sum(target.values()) + SMOOTHING * BUCKETS
    weight = {k: log((target[k] + SMOOTHING) / b) - log((raw[k] + SMOOTHING) / a) for k in raw}
    for r in with_quality(documents, labels).select("doc_id", "quality.score", "quality.kept", "quality.base_failed").collect():
        want = sum(weight[k] for k in texts[r.doc_id]) / len(texts[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-9) and (r.base_failed or r.kept == (want > -0.2))
