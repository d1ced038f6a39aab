"""Packing of token sequences by non-negative least squares over length combinations.

Each document gives full windows and one remainder. Remainders are counted by length class (16 tokens). Combinations of up to three
classes that fill a window are enumerated, their repeat counts solved against the histogram by non-negative least squares and
rounded down; what is left is packed greedily, a pattern at a time. The plan is a short table of ranges: piece number r of class c
takes slot s of sequence b + r - start. Only the histogram (256 numbers) reaches the driver; pieces get their place by a join.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_alphabet
from .shared import global_rank, map_arrow, pick, stash, text_list

WINDOW = 4096
STEP = 16
CACHE_CHUNKS = 400_000
END_ID = 2
#: A word and the marks after it, which no pre-token joins; letters whose lower case is one letter, whatever stands around it.
WORD_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-įĲ-ňŋ-ſ]+)([!-/:-@\[-`{-~]*)")


class ChunkTokens:
    """Ids of space-delimited chunks as little-endian 32-bit bytes.

    For a tokenizer that lower-cases, drops white space and keeps letters, digits and marks apart, a text's ids are those of its
    chunks in order, and a chunk's those of its word and of the marks after it. Words and marks are one pre-token each: they go to
    the vocabulary's merges as the characters that stand for their bytes. Other chunks go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = self.tokenizer.model
        self.letters = {b: c for c, b in byte_alphabet().items()}
        #: What was seen lately, and before that; a chunk looked up again moves to the first.
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _pretoken(self, part: str) -> bytes:
        if not part:
            return b""
        found = self.seen.get(part)
        if found is None:
            found = self.before.get(part)
            if found is None:
                known = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
                found = array("I", [t.id for t in self.merges.tokenize(known)]).tobytes()
            if len(part) <= 48:
                self.seen[part] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = self.before.get(chunk)
        if found is None:
            m = WORD_AND_MARKS.fullmatch(chunk)
            if m:
                found = self._pretoken(m[1].lower()) + self._pretoken(m[2])
            else:
                found = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes() if chunk else b""
        if len(chunk) <= 48:
            self.seen[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        if len(self.seen) > CACHE_CHUNKS:
            self.seen, self.before = {}, self.seen
        seen = self.seen
        words = text.replace("\n", " ").split(" ")
        out = list(map(seen.get, words))
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    known = seen.get(words[i])
                    out[i] = self._chunk(words[i]) if known is None else known
        return b"".join(out)


_tokenizers: dict[str, ChunkTokens] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int, step: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokens(path)
    tok, end = _tokenizers[path], np.array([end_id], "<u4").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), text_list(batch.column(1)), strict=True):
            ids = tok.ids(text) + end
            total = len(ids) // 4
            for start in range(0, total, window):
                part = ids[4 * start : 4 * (start + window)]
                n = len(part) // 4
                rows.append((doc_id, start, n, zlib.crc32(part), total, -(-n // step), part))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        arrays = [pa.array(c, pa.int64()) for c in cols[:6]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
        if keep_ids:
            arrays, names = [*arrays, pa.array(cols[6], pa.binary())], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def combinations(classes: int) -> list[tuple[int, ...]]:
    """Up to three classes, largest first, that add up to a window."""
    found = [(classes,)]
    for a in range(classes - 1, 0, -1):
        if a >= classes - a:
            found.append((a, classes - a))
        for b in range(min(a, classes - a - 1), 0, -1):
            c = classes - a - b
            if 1 <= c <= b:
                found.append((a, b, c))
    return found


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson and Hanson's active-set method for min |matrix @ x - target|, x >= 0."""
    n = matrix.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, right = None, matrix.T @ target
    residual = target.astype(float)
    tolerance = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds or 3 * matrix.shape[0]):
        slope = matrix.T @ residual
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        active[best] = True
        while True:
            cols = np.flatnonzero(active)
            gram = matrix[:, cols].T @ matrix[:, cols]
            try:
                z = np.linalg.solve(gram, right[cols])
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(gram, right[cols], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            low = z <= 0
            ratio = (x[cols][low] / np.maximum(x[cols][low] - z[low], 1e-300)).min()
            x[cols] += ratio * (z - x[cols])
            gone = cols[(x[cols] <= 1e-12) & low] if ((x[cols] <= 1e-12) & low).any() else cols[low][:1]
            x[gone] = 0
            active[gone] = False
        residual = target - matrix @ x
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """[(classes of one sequence, how many such sequences)] that uses every piece; ``histogram[c]`` counts pieces of class c."""
    classes = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[classes]:
        out.append(((classes,), int(left[classes])))
        left[classes] = 0
    present = left > 0
    combos = [c for c in combinations(classes)[1:] if all(present[x] for x in c)]
    if combos:
        matrix = np.zeros((classes + 1, len(combos)))
        for j, combo in enumerate(combos):
            for x in combo:
                matrix[x, j] += 1
        keep = np.flatnonzero(present)
        for j, count in enumerate(np.floor(nnls(matrix[keep], left[keep].astype(float)) + 1e-6).astype(np.int64)):
            uses = {x: combos[j].count(x) for x in combos[j]}
            count = min([int(count), *[int(left[x] // k) for x, k in uses.items()]])
            if count > 0:
                out.append((combos[j], count))
                for x, k in uses.items():
                    left[x] -= k * count
    while left.any():  # the largest class left, then whatever still fits; one pattern as often as its classes allow
        pattern, room, open_ = [], classes, left.copy()
        while room:
            fits = np.flatnonzero(open_[: room + 1])
            if not len(fits):
                break
            x = int(fits[-1])
            k = int(min(open_[x], room // x))
            pattern += [x] * k
            open_[x] -= k
            room -= k * x
        uses = {x: pattern.count(x) for x in set(pattern)}
        count = min(int(left[x] // k) for x, k in uses.items())
        out.append((tuple(pattern), count))
        for x, k in uses.items():
            left[x] -= k * count
    return out


def ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, slot) of every pattern's slots; ranks count the pieces of a class."""
    used: dict[int, int] = {}
    base, out = 0, []
    for pattern, count in patterns:
        for slot, x in enumerate(pattern):
            first = used.get(x, 0)
            out.append((x, first, first + count, base, slot))
            used[x] = first + count
        base += count
    return out


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, step: int = STEP, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with ``ids`` (little-endian 32-bit)
    on request.

    Each row's text is tokenized whole and closed by ``end_id``; null or empty text is that id alone. Documents longer than a
    window are cut into full windows and a remainder, and each id lies in exactly one piece. Rows that repeat a doc_id are packed
    as documents of their own. Other columns are ignored; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    base = pick(docs, doc_id=id_col, text=text_col)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long" + (", ids binary" if keep_ids else "")
    pieces = stash(map_arrow(base.withColumn("doc_id", F.col("doc_id").cast("long")), _pieces, schema, path=vocabulary, window=window, step=step, end_id=end_id, keep_ids=keep_ids))
    histogram = np.zeros(window // step + 1, np.int64)
    for r in pieces.groupBy("class").count().collect():
        histogram[r["class"]] = r["count"]
    slots = spark.createDataFrame(ranges(plan(histogram)), "class long, first long, end long, base long, slot long")
    starts = spark.createDataFrame([(i, int(x)) for i, x in enumerate(np.concatenate([[0], histogram.cumsum()[:-1]]))], "class long, before long")
    ranked = global_rank(pieces, ["class", "doc_id", "start", "ids_crc32"]).join(F.broadcast(starts), "class").withColumn("rank", F.col("rank") - F.col("before"))
    placed = ranked.join(F.broadcast(slots), "class").where("rank >= first and rank < end").withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("first"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
