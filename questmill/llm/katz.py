"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, one score for each text.

The model is of order two. Documents are numbered in blocks of some ``BLOCK_TOKENS`` tokens, and a block asks for each of its distinct
pairs once, however often they occur, so that a very common pair costs one row a block. Words are numbered by falling frequency: a
word's count then follows from its number and the table of how many words have each count (at most sqrt(2N) rows), and pairs
of small numbers pack well. Pairs are dealt to parts by their first word, those of the ``HOT`` most frequent words to as many
parts as their share asks for. Each part adds up its pairs, stores them as its part of the model and answers every block with the
counts and with what the backoff weight of each first word needs; blocks then evaluate their texts token by token.

    P(w)     = d c(w) / N, and what the discounts leave over is P(unknown)
    P(w | h) = d c(hw) / c(h) where hw is known, else a(h) P(w); a(h) makes the sum over all words and the unknown one exactly 1

d follows Good and Turing for counts up to ``CUT`` as Katz has it, and is 1 above; where the counts of counts give no value between 0
and 1, half an occurrence is taken off. A first word all of whose pairs occur more often gives up half an occurrence of each, so that
something is always left for other words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import global_rank, map_arrow, pick, small_batches, stash

BLOCK_TOKENS = 1_000_000
PART_TOKENS = 1_000_000
CUT = 5
HOT = 65_536
#: Numbers of the end of a text, of its beginning (a first word only) and of words that training lacks; known words follow.
END, BEGIN, UNKNOWN, FIRST = 0, 1, 2, 3

BLOCKS = "block long, doc_id array<long>, held array<boolean>, size array<int>, tokens binary, words array<binary>, n array<long>"
ASKS = "part int, block long, pairs binary, n binary"
MERGED = "kind string, part int, block long, counts binary, firsts binary, h array<int>, w array<int>, c array<long>, word long, pieces array<double>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(numbers: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, then zstd: small numbers take little room."""
    raw = np.ascontiguousarray(numbers)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return len(raw).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(packed[:8], "little"), np.dtype(dtype).itemsize
    raw = pa.decompress(packed[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(width, n).T.copy().view(dtype).reshape(n)


def discounts(n: dict[int, int], cut: int = CUT) -> np.ndarray:
    """d of counts 0 to ``cut`` (0: unused) from the number ``n[r]`` of types that occur r times."""
    tail = (cut + 1) * n.get(cut + 1, 0) / n[1] if n.get(1) else 1.0
    out = [0.0]
    for r in range(1, cut + 1):
        d = ((r + 1) * n.get(r + 1, 0) / n[r] / r - tail) / (1 - tail) if n.get(r) and tail != 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array(out)


def mass(c: np.ndarray, d: np.ndarray, all_high: np.ndarray | bool) -> np.ndarray:
    """Discounted counts; ``all_high`` where no count of the same kind is at most CUT."""
    return np.where(c <= CUT, d[np.minimum(c, CUT)] * c, np.where(all_high, c - 0.5, c))


class Words:
    """Unigram statistics by word number, from how many known words have each count; the end of texts is a word like others."""

    def __init__(self, histogram: list[tuple[int, int]], texts: int):
        rows = sorted(histogram, reverse=True)
        self.upto = np.cumsum([n for _, n in rows], dtype=np.int64)
        self.steps = np.array([c for c, _ in rows], np.int64)
        self.texts = texts
        counts: dict[int, int] = dict(rows)
        if texts:
            counts[texts] = counts.get(texts, 0) + 1
        self.total = sum(c * n for c, n in counts.items())
        self.types = sum(counts.values())
        self.d = discounts(counts)
        self.all_high = min(counts, default=0) > CUT
        kept = math.fsum(float(mass(np.array(c), self.d, self.all_high)) * n for c, n in counts.items())
        self.unknown = 1.0 - kept / self.total if self.total else 1.0

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training occurrences of each word number; of BEGIN, the number of training texts."""
        if not len(self.steps):
            return np.where((ids == END) | (ids == BEGIN), self.texts, 0)
        at = np.minimum(np.searchsorted(self.upto, np.maximum(ids - FIRST, 0), side="right"), len(self.steps) - 1)
        return np.where(ids >= FIRST, self.steps[at], np.where(ids == UNKNOWN, 0, self.texts))

    def p(self, ids: np.ndarray) -> np.ndarray:
        c = self.count(ids)
        return np.where(c > 0, mass(c, self.d, self.all_high) / max(self.total, 1), self.unknown)


def number_words(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents whose words are numbered within the block; number 0 is the end of a text."""

    class Numbers(dict):
        def __missing__(self, word):
            self[word] = found = len(self)
            return found

    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("size", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))])
    base, seq = TaskContext.get().partitionId() << 32, 0
    numbers, ids, doc_ids, held, sizes = Numbers({b"": END}), [], [], [], []

    def block():
        at = np.array(ids, np.int32)
        train = np.repeat(~np.array(held), sizes)
        n = np.bincount(at[train], minlength=len(numbers))
        return pa.RecordBatch.from_pylist([{"block": base + seq, "doc_id": doc_ids, "held": held, "size": sizes, "tokens": pack(at), "words": list(numbers), "n": n.tolist()}], schema)

    for batch in batches:
        for doc_id, text, out in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = (text or "").encode().lower().split()
            ids.extend([numbers[w] for w in words])
            ids.append(END)
            doc_ids.append(doc_id)
            held.append(out)
            sizes.append(len(words) + 1)
            if len(ids) >= tokens:
                yield block()
                seq += 1
                numbers, ids, doc_ids, held, sizes = Numbers({b"": END}), [], [], [], []
    if doc_ids:
        yield block()


def pack_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pack(np.array(x, np.int32)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["block", "ids"])


def _mixed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def deal(pairs: np.ndarray, words: Words, parts: int) -> np.ndarray:
    """The part of each pair: by its first word, or by both words where the first is one of the most frequent."""
    h, w = pairs >> 32, pairs & 0xFFFFFFFF
    spread = np.where(h < HOT, np.ceil(words.count(h) / max(words.total, 1) * parts), 1).astype(np.int64)
    return (_mixed(h) + _mixed(w + 1) % np.maximum(spread, 1)) % parts


def spreads(h: np.ndarray, words: Words, parts: int) -> np.ndarray:
    return (h < HOT) & (words.count(h) * parts > words.total)


def pairs_of(size: np.ndarray, tokens: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, pairs) of a block's tokens."""
    w = unpack(ids, np.int32)[unpack(tokens, np.int32)]
    pairs = np.empty(len(w), np.int64)
    pairs[1:] = w[:-1]
    pairs[np.concatenate([[0], np.cumsum(size)[:-1]])] = BEGIN
    pairs <<= 32
    pairs |= w
    return w, pairs


def ask(batches: Iterator[pa.RecordBatch], words: Words, parts: int) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each block with their training occurrences, one row for each part that has some."""
    for batch in batches:
        for row in range(batch.num_rows):
            block, held, size, tokens, ids = (batch.column(k)[row].as_py() for k in range(5))
            _, pairs = pairs_of(np.array(size), tokens, ids)
            found, place = np.unique(pairs, return_inverse=True)
            n = np.bincount(place[np.repeat(~np.array(held), size)], minlength=len(found))
            part = deal(found, words, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            out = [(int(part[s[0]]), block, pack(np.diff(found[s], prepend=0)), pack(n[s])) for s in np.split(order, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "pairs", "n"])


def merge(table: pa.Table, words: Words, parts: int) -> pa.Table:
    """All blocks' questions to one part: its pairs' counts (kind model), each block's answers (answer) and the shares of first words
    that several parts hold (hot).

    For each first word the pieces of its backoff weight are: pairs that occur 1 to CUT times, all pairs, and the unigram
    probability of their second words.
    """
    asked = [np.cumsum(unpack(x, np.int64)) for x in table.column("pairs").to_pylist()]
    pairs, place = np.unique(np.concatenate(asked), return_inverse=True)
    c = np.bincount(place, weights=np.concatenate([unpack(x, np.int64) for x in table.column("n").to_pylist()])).astype(np.int64)
    h, at = np.unique(pairs >> 32, return_inverse=True)
    seen = c > 0
    columns = [np.bincount(at[c == r], minlength=len(h)) for r in range(1, CUT + 1)] + [np.bincount(at[seen], minlength=len(h))]
    pieces = np.stack([*columns, np.bincount(at[seen], weights=words.p(pairs[seen] & 0xFFFFFFFF), minlength=len(h))], axis=1)
    part = table.column("part")[0].as_py()
    known = pairs[seen]
    out = [{"kind": "model", "part": part, "h": known >> 32, "w": known & 0xFFFFFFFF, "c": c[seen]}]
    out += [{"kind": "hot", "part": part, "word": int(h[i]), "pieces": pieces[i]} for i in np.flatnonzero(spreads(h, words, parts))]
    start = 0
    for block, mine in zip(table.column("block").to_pylist(), asked, strict=True):
        here = place[start : start + len(mine)]
        start += len(mine)
        firsts = at[here[np.concatenate([[True], np.diff(mine >> 32) != 0])]]
        out.append({"kind": "answer", "part": part, "block": block, "counts": pack(c[here]), "firsts": pack(pieces[firsts].ravel())})
    types = {"kind": pa.string(), "part": pa.int32(), "block": pa.int64(), "counts": pa.binary(), "firsts": pa.binary(), "h": pa.list_(pa.int32()), "w": pa.list_(pa.int32()), "c": pa.list_(pa.int64()), "word": pa.int64(), "pieces": pa.list_(pa.float64())}
    return pa.table({k: pa.array([x.get(k) for x in out], t) for k, t in types.items()})


def backoff(h: np.ndarray, pieces: np.ndarray, words: Words, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, whether no pair is discounted by Good and Turing) of each first word; unknown first words have weight 1."""
    low, types, lower = pieces[:, :CUT], pieces[:, CUT], pieces[:, CUT + 1]
    all_high = (low.sum(axis=1) == 0) & (types > 0)
    lost = (low * (np.arange(1, CUT + 1) * (1 - d[1:]))).sum(axis=1) + np.where(all_high, 0.5 * types, 0)
    left = lost / np.maximum(words.count(h), 1)
    return np.where(types > 0, left / (1 - np.where(types > 0, lower, 0)), 1.0), all_high


def evaluate(batches: Iterator[pa.RecordBatch], words: Words, parts: int, d: np.ndarray, hot: dict[int, list[float]]) -> Iterator[pa.RecordBatch]:
    """Score the texts of each block from the answers of the parts."""
    for batch in batches:
        for row in range(batch.num_rows):
            block, doc_id, held, size, tokens, ids, answers = (batch.column(k)[row].as_py() for k in range(7))
            size = np.array(size)
            w, pairs = pairs_of(size, tokens, ids)
            found, place = np.unique(pairs, return_inverse=True)
            part = deal(found, words, parts)
            order = np.argsort(part, kind="stable")
            answers.sort(key=lambda x: x["part"])
            c = np.empty(len(found), np.int64)
            c[order] = np.concatenate([unpack(x["counts"], np.int64) for x in answers])
            firsts = (found >> 32)[order]
            new = np.concatenate([[True], (np.diff(firsts) != 0) | (np.diff(part[order]) != 0)])
            pieces = np.concatenate([unpack(x["firsts"], np.float64) for x in answers]).reshape(-1, CUT + 2)
            h = firsts[new]
            for i in np.flatnonzero(spreads(h, words, parts)):
                pieces[i] = hot[int(h[i])]
            weight, all_high = backoff(h, pieces, words, d)
            of = np.empty(len(found), np.int64)
            of[order] = np.cumsum(new) - 1
            known = mass(c, d, all_high[of]) / np.maximum(words.count(found >> 32), 1)
            logp = np.log10(np.where(c > 0, known, weight[of] * words.p(found & 0xFFFFFFFF)))
            del pairs, known, pieces, of, order, part
            c1 = words.count(w)
            base = np.log10((c1 + 0.1) / (words.total + 0.1 * (words.types + 1)))
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            total = lambda x: np.add.reduceat(x, start)
            arrays = [pa.array(doc_id, pa.int64()), pa.array(held, pa.bool_()), size.astype(np.int64), total((c1 > 0).astype(np.int64)), np.full(len(size), words.total, np.int64), total(base), total(logp[place])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [x.split()[0] for x in SCORES.split(", ")])


def score_texts(docs: DataFrame, *, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where ``held_out``, a condition on ``doc_id`` and ``text``, is not true. Tokens are the words of a text, A to Z in lower case, and one end;
    null and empty texts have the end alone. ``n_known`` counts tokens that training holds. ``base_score`` is the sum of log10 of
    add-0.1 unigram probabilities, ``score`` the Katz model's log10 probability of the text. Rows are scored one by one, equal texts
    alike; rows without an id count as any other; columns other than id and text never reach the result; an empty table gives
    none, and without training rows every token is the unknown word, of probability 1.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    blocks = stash(map_arrow(rows, number_words, BLOCKS, tokens=block_tokens), codec="zstd")
    local = blocks.select("block", F.posexplode(F.arrays_zip("words", "n")).alias("pos", "x")).select("block", "pos", F.col("x.words").alias("word"), F.col("x.n").alias("n"))
    counted = local.where("pos > 0 and n > 0").groupBy("word").agg(F.sum("n").alias("c")).withColumn("falling", -F.col("c"))
    ranked = global_rank(counted, ["falling", "word"], "id").select("word", "c", (F.col("id") + FIRST).cast("int").alias("id"))
    texts = local.where("pos = 0").agg(F.sum("n")).first()[0] or 0
    words = Words([(r["c"], r["n"]) for r in ranked.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()], texts)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.total // part_tokens + 1)
    numbered = local.join(ranked.select("word", "id"), "word", "left").select("block", F.struct("pos", F.when(F.col("pos") == 0, END).otherwise(F.coalesce("id", F.lit(UNKNOWN))).alias("id")).alias("x"))
    ids = numbered.groupBy("block").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["id"]).alias("ids"))
    ids = stash(map_arrow(ids, pack_numbers, "block long, ids binary"))
    asks = map_arrow(blocks.select("block", "held", "size", "tokens").join(ids, "block"), ask, ASKS, words=words, parts=parts)
    merged = stash(asks.repartition(parts, "part").groupBy("part").applyInArrow(lambda table: merge(table, words, parts), MERGED), "kind", codec="zstd")
    counts = merged.where("kind = 'model'").select(F.explode("c").alias("c")).where(F.col("c") <= CUT + 1).groupBy("c").count()
    d = discounts({r["c"]: r["count"] for r in counts.collect()})
    shares = merged.where("kind = 'hot'").select("word", F.posexplode("pieces")).groupBy("word", "pos").agg(F.sum("col").alias("x"))
    hot: dict[int, list[float]] = {}
    for r in shares.collect():
        hot.setdefault(r["word"], [0.0] * (CUT + 2))[r["pos"]] = r["x"]
    answers = merged.where("kind = 'answer'").groupBy("block").agg(F.collect_list(F.struct("part", "counts", "firsts")).alias("answers"))
    ready = blocks.select("block", "doc_id", "held", "size", "tokens").join(ids, "block").join(answers, "block")
    return small_batches(ready).mapInArrow(partial(evaluate, words=words, parts=parts, d=d, hot=hot), SCORES)
