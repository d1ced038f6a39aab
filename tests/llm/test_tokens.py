import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from questmill.llm.bpe import PrefixEncoder, encode_documents
from questmill.llm.packing import ChunkTokens, combinations, nnls, pack_documents, plan
from questmill.llm.shared import vocabulary
from questmill.llm.shared import stash
from questmill.llm.token_edits import ChunkCounter, TokenTree, count_edited, edit_trees, plant_trees, repeated_lines

PARTS = ["  ", "\n", " ", "\t", "a", "the", " The", "'s", "é", "日本", "🙂", "123", "<|endoftext|>", "\x1c", "\x85", "!!", "aaaaaaaa", "　", "ab" * 30, "don't", "Word,", "İ,", "ŉ.", "Σ", "́", "\x00", "ԙ", "՘"]


def texts(n, seed, parts=PARTS):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def test_prefix_encoder_is_the_library(library):
    enc = PrefixEncoder(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz'’ éßABC0"
    for t in [*texts(3000, 1), *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)), "x" * 5000]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == ids
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_encode_documents(documents, odd, none, library):
    for docs in (documents, odd):
        got = sorted(map(tuple, encode_documents(docs, vocabulary("byte_bpe_50k.json")).collect()), key=str)
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert encode_documents(none, vocabulary("byte_bpe_50k.json")).collect() == []
    kept = encode_documents(documents, vocabulary("byte_bpe_50k.json"), keep_ids=True).first()
    assert len(kept.ids) == kept.n_tokens


def test_chunk_tokens_are_the_library():
    path = vocabulary("word_bpe_49k.json")
    lib, mine = Tokenizer.from_file(path), ChunkTokens(path)
    for t in texts(3000, 2):
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def check_pieces(rows, docs, window=4096):
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    whole = sorted(tuple(lib.encode(t or "", add_special_tokens=False).ids + [2]) for t in docs)
    covered = 0
    for r in rows:
        assert 0 < r.length <= window
        covered += r.length
    assert covered == sum(map(len, whole))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padded += window - at
    return padded / (len(sequences) * window) if sequences else 0


def test_pack_documents(documents, odd, none):
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = pack_documents(documents, vocabulary("word_bpe_49k.json")).collect()
    texts_ = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    assert check_pieces(rows, texts_.values()) < 0.05
    for r in rows:
        ids = lib.encode(texts_[r.doc_id], add_special_tokens=False).ids + [2]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    odd_rows = pack_documents(odd, vocabulary("word_bpe_49k.json")).collect()
    check_pieces(odd_rows, [r.text for r in odd.collect()])
    assert sum(r.doc_id == 5 for r in odd_rows) == 2
    assert pack_documents(none, vocabulary("word_bpe_49k.json")).collect() == []


def test_nnls_and_plan():
    rng = np.random.default_rng(1)
    a, x = rng.random((30, 12)), np.maximum(0, rng.normal(size=12))
    assert np.allclose(nnls(a, a @ x), x, atol=1e-6)
    assert all(sum(c) == 32 and len(c) <= 3 for c in combinations(32))
    for _ in range(20):
        h = rng.integers(0, 60, 33) * (rng.random(33) < 0.5)
        h[0] = 0
        used = np.zeros(33, int)
        for pattern, n in plan(h):
            assert sum(pattern) <= 32
            for c in pattern:
                used[c] += n
        assert (used == h).all()


def test_token_tree_follows_edits(library):
    counter, rng = ChunkCounter(vocabulary("byte_bpe_50k.json")), random.Random(4)
    parts = [p for p in PARTS if p != "<|endoftext|>"] + [" ", " word", " x"] * 4
    for t in texts(600, 5, parts):
        tree = TokenTree(t, counter, leaf=2)
        for _ in range(4):
            a = rng.randint(0, len(t))
            b = rng.randint(a, min(len(t), a + 8))
            new = "".join(rng.choice(parts) for _ in range(rng.randint(0, 3)))
            t = t[:a] + new + t[b:]
            tree.edit(a, b, new)
            assert tree.text == t
            assert tree.total == len(library.encode(t, add_special_tokens=False).ids)


def test_edits_touch_little(library):
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = TokenTree(text, ChunkCounter(vocabulary("byte_bpe_50k.json")))
    tree.encoded = 0
    tree.edit(50_000, 50_003, "abc def")
    assert tree.encoded < 2_000
    assert tree.total == len(library.encode(text[:50_000] + "abc def" + text[50_003:], add_special_tokens=False).ids)


def test_count_edited(documents, odd, none, spark, library):
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for docs in (documents, odd):
        source = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
        got = sorted(count_edited(docs, vocabulary("byte_bpe_50k.json")).collect(), key=lambda r: str((r.doc_id, dict(source)[r.doc_id])))
        for (doc_id, t), r in zip(source, got, strict=True):
            done = t
            for a, b, new in sorted(repeated_lines(t), reverse=True):
                done = done[:a] + new + done[b:]
            assert (r.doc_id, r.n_tokens, r.n_tokens_edited, r.n_chars) == (doc_id, n(t), n(done), len(t))
    assert count_edited(none, vocabulary("byte_bpe_50k.json")).collect() == []
    given = spark.createDataFrame([(1, "one two three four", [(4, 7, "twenty two"), (100, 200, "!")]), (2, None, None)], "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>")
    a, b = sorted(count_edited(given, vocabulary("byte_bpe_50k.json"), edits_col="edits").collect())
    assert a.n_tokens_edited == n("one twenty two three four!") and b.n_tokens == b.n_edits == 0


def test_stored_trees_take_edits(spark, odd, none, library):
    path = vocabulary("byte_bpe_50k.json")
    planted = stash(plant_trees(odd.where("doc_id is not null and doc_id <> 5"), path))
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in planted.collect():
        assert "".join(r.leaves) == text[r.doc_id] and r.n_tokens == sum(r.counts) == len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
    edits = spark.createDataFrame([(7, [(10, 25, "new words here"), (100, 100, " put in")]), (9, [(0, 2, "")])], "doc_id long, edits array<struct<start: int, end: int, new: string>>")
    want = dict(text)
    for i, e in ((7, [(100, 100, " put in"), (10, 25, "new words here")]), (9, [(0, 2, "")])):
        for a, b, new in e:
            want[i] = want[i][:a] + new + want[i][b:]
    edited = edit_trees(planted, edits, path).collect()
    assert len(edited) == planted.count()
    for r in edited:
        assert "".join(r.leaves) == want[r.doc_id] and r.n_tokens == len(library.encode(want[r.doc_id], add_special_tokens=False).ids)
        assert r.n_chars_encoded_again < 3000 and (r.n_chars_encoded_again > 0) == (r.doc_id in (7, 9))
    assert plant_trees(none, path).collect() == [] and edit_trees(planted.limit(0), edits, path).collect() == []


def test_leaves_do_not_outgrow_their_size():
    counter = ChunkCounter(vocabulary("byte_bpe_50k.json"))
    tree = TokenTree(" ".join(f"w{i}" for i in range(200)), counter, leaf=8)
    for k in range(60):
        tree.edit(20, 20, f" more and more {k}")
    assert max(len(counter.cut(t)) for t in tree.texts) <= 8
    assert tree.total == sum(counter.counts(counter.cut(tree.text)))
