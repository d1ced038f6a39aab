"""Token counts that follow edits.

A document's pre-token counts are the leaves of a segment tree. An edit replaces a stretch of code points; only the pre-tokens it
touches, and a little of what stands around them, are cut and encoded again, and the sums above them are updated. Trees can be stored
(``plant_trees``) and edited later (``edit_trees``).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import map_arrow, pick, text_list

LEAF = 64
CACHE_CHUNKS = 600_000
#: Where a text may be cut so that both sides encode on their own: before a single space between two characters that aren't white space.
SAFE = regex.compile(r"(?<=[^\p{White_Space}]) (?=[^\p{White_Space}])")
#: Texts without this can be cut at every space.
UNEASY = regex.compile(r" (?:\p{White_Space}|$)|^ |\p{White_Space} ")


class ChunkCounter:
    """Token counts of chunks between safe cuts, by the tokenizers library, remembered for chunks seen before."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.seen: dict[str, int] = {}

    @staticmethod
    def cut(text: str) -> list[str]:
        if not text:
            return []
        if "\0" not in text and not UNEASY.search(text):
            return text.replace(" ", "\0 ").split("\0")
        marks = [m.start() for m in SAFE.finditer(text)]
        return [text[a:b] for a, b in zip([0, *marks], [*marks, len(text)], strict=True)]

    def counts(self, chunks: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > CACHE_CHUNKS:
            seen.clear()
        out = list(map(seen.get, chunks))
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    n = len(self.tokenizer.encode(chunks[i], add_special_tokens=False).ids)
                    out[i] = n
                    if len(chunks[i]) <= 48:
                        seen[chunks[i]] = n
        return out


_counters: dict[str, ChunkCounter] = {}


class TokenTree:
    """Counts of a text's chunks, in leaves of about ``LEAF`` chunks, under a tree of sums. Leaves hold the text itself."""

    def __init__(self, text: str, counter: ChunkCounter, leaf: int = LEAF):
        self.counter, self.encoded, self.leaf = counter, len(text), leaf
        chunks = counter.cut(text)
        starts = np.arange(0, len(chunks), leaf)
        self.texts = ["".join(chunks[i : i + leaf]) for i in starts] or [""]
        self._plant(np.add.reduceat(np.array(counter.counts(chunks), np.int64), starts) if chunks else np.zeros(1, np.int64))

    @classmethod
    def kept(cls, texts: list[str], counts: list[int], counter: ChunkCounter, leaf: int = LEAF) -> TokenTree:
        """A tree from its stored leaves; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.counter, tree.encoded, tree.leaf, tree.texts = counter, 0, leaf, list(texts) or [""]
        tree._plant(np.array(list(counts) or [0], np.int64))
        return tree

    def _plant(self, counts: np.ndarray) -> None:
        """Levels of sums, each half as long as the one below; lengths of the leaves likewise, to find a position."""
        self.counts, self.lengths = [counts], [np.array([len(t) for t in self.texts], np.int64)]
        for levels in (self.counts, self.lengths):
            while len(levels[-1]) > 1:
                low = levels[-1]
                levels.append(np.add.reduceat(low, np.arange(0, len(low), 2)))

    @property
    def total(self) -> int:
        return int(self.counts[-1][0])

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a code point and the point's place in it, from the root down."""
        at = 0
        for level in range(len(self.lengths) - 2, -1, -1):
            at *= 2
            size = self.lengths[level]
            if position >= size[at] and at + 1 < len(size):
                position -= int(size[at])
                at += 1
        return at, position

    def _update(self, leaf: int) -> None:
        self.lengths[0][leaf] = len(self.texts[leaf])
        for level in range(1, len(self.counts)):
            leaf //= 2
            for levels in (self.counts, self.lengths):
                levels[level][leaf] = levels[level - 1][2 * leaf : 2 * leaf + 2].sum()

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace code points [start, end) by ``new``.

        The touched leaves are joined and encoded again, with as many neighbours as it takes for the stretch to begin and end at a
        safe cut (the boundary context). The new chunks go into these leaves; leaves left over stay as empty ones, and where there are
        too few, new ones are planted, so no leaf outgrows its size.
        """
        first, at = self._find(start)
        last, stop = self._find(max(start, end - 1))
        stop += 1 if end > start else 0
        text = self.texts[first][:at] + new + self.texts[last][stop:]
        while first > 0 and not self._safe(first - 1, text):
            first -= 1
            text = self.texts[first] + text
        while last + 1 < len(self.texts) and not self._safe_after(text, last + 1):
            last += 1
            text += self.texts[last]
        chunks = self.counter.cut(text)
        self.encoded += len(text)
        starts = range(0, len(chunks), self.leaf)
        texts = ["".join(chunks[i : i + self.leaf]) for i in starts]
        counts = [sum(self.counter.counts(chunks[i : i + self.leaf])) for i in starts]
        spare = last + 1 - first - len(texts)
        if spare < 0:  # more than the touched leaves hold: new leaves, and the sums above them anew; no other leaf is encoded
            self.texts[first : last + 1] = texts
            self._plant(np.concatenate([self.counts[0][:first], np.array(counts, np.int64), self.counts[0][last + 1 :]]))
            return
        for leaf, (t, n) in enumerate(zip(texts + [""] * spare, counts + [0] * spare, strict=True), first):
            self.texts[leaf], self.counts[0][leaf] = t, n
            self._update(leaf)

    def _safe(self, before: int, text: str) -> bool:
        left = self.texts[before]
        return bool(left) and bool(SAFE.search(left[-1:] + text[:2]))

    def _safe_after(self, text: str, after: int) -> bool:
        right = self.texts[after]
        return bool(right) and bool(text) and bool(SAFE.search(text[-1:] + right[:2]))

    @property
    def text(self) -> str:
        return "".join(self.texts)


def repeated_lines(text: str) -> list[tuple[int, int, str]]:
    """Edits that delete every line, with its line end, which has a word and repeats an earlier line of its text."""
    lines = text.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    seen: set[str] = set()
    out = []
    for i, line in enumerate(lines):
        if line in seen and line.strip():
            out.append((starts[i] - 1, starts[i] + len(line), ""))
        seen.add(line)
    return out


def _counts(batches: Iterator[pa.RecordBatch], path: str, rule: Callable[[str], list] | None) -> Iterator[pa.RecordBatch]:
    counter = _counters.get(path) or _counters.setdefault(path, ChunkCounter(path))
    for batch in batches:
        rows = []
        given = batch.column(2).to_pylist() if rule is None else [None] * batch.num_rows
        for doc_id, text, edits in zip(batch.column(0).to_pylist(), text_list(batch.column(1)), given, strict=True):
            edits = rule(text) if rule else [(e["start"], e["end"], e["new"]) for e in edits or []]
            tree = TokenTree(text, counter)
            before, tree.encoded = tree.total, 0
            for start, end, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
                lo = min(max(start, 0), len(text))
                tree.edit(lo, min(max(end, lo), len(text)), new or "")
            rows.append((doc_id, before, len(edits), tree.total, len(text), tree.encoded))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars", "n_chars_encoded_again"])


def _plant_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = _counters.get(path) or _counters.setdefault(path, ChunkCounter(path))
    for batch in batches:
        trees = [TokenTree(t, counter) for t in text_list(batch.column(1))]
        yield _tree_batch(batch.column(0), trees, [0] * len(trees))


def _edit_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = _counters.get(path) or _counters.setdefault(path, ChunkCounter(path))
    for batch in batches:
        trees = []
        for texts, counts, edits in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            tree = TokenTree.kept(texts or [], counts or [], counter)
            size = sum(map(len, tree.texts))
            for e in sorted(edits or [], key=lambda e: (e["start"], e["end"]), reverse=True):
                lo = min(max(e["start"], 0), size)
                tree.edit(lo, min(max(e["end"], lo), size), e["new"] or "")
            trees.append(tree)
        yield _tree_batch(batch.column(0), trees, [t.encoded for t in trees])


def _tree_batch(ids: pa.Array, trees: list[TokenTree], again: list[int]) -> pa.RecordBatch:
    columns = [ids, pa.array([t.texts for t in trees], pa.list_(pa.string())), pa.array([t.counts[0].tolist() for t in trees], pa.list_(pa.int64())), pa.array([t.total for t in trees], pa.int64()), pa.array(again, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "leaves", "counts", "n_tokens", "n_chars_encoded_again"])


TREE = "doc_id long, leaves array<string>, counts array<bigint>, n_tokens long, n_chars_encoded_again long"


def plant_trees(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tree as a row to be stored: (doc_id, leaves, counts, n_tokens, n_chars_encoded_again = 0). The leaves' texts joined
    are the document. Null text: one empty leaf. One row per input row, repeats included; an empty table gives none."""
    base = pick(docs, doc_id=id_col, text=text_col)
    return map_arrow(base.withColumn("doc_id", F.col("doc_id").cast("long")), _plant_rows, TREE, path=vocabulary)


def edit_trees(trees: DataFrame, edits: DataFrame, vocabulary: str) -> DataFrame:
    """Stored trees after ``edits`` (doc_id, edits: array<struct<start, end, new>> in code points, not overlapping): the leaves that
    are touched are encoded again, with their boundary context, and nothing else. Documents without edits stay as they are."""
    both = trees.select("doc_id", "leaves", "counts").join(edits.select("doc_id", "edits"), "doc_id", "left")
    return map_arrow(both, _edit_rows, TREE, path=vocabulary)


def count_edited(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, rule: Callable[[str], list] | None = repeated_lines) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_chars, n_chars_encoded_again): counts before and after each row's edits.

    Edits come from the column ``edits_col``, array<struct<start, end, new>> in code points of the original text, not overlapping,
    or from ``rule``, a function of the text that gives such triples. They are applied from the last to the first. Null edits:
    none. Null text: empty. Positions beyond the text are drawn to its ends. One row per input row, repeats included; other
    columns are ignored; an empty table gives none.
    """
    columns = {"doc_id": id_col, "text": text_col} | ({"edits": edits_col} if edits_col else {})
    base = pick(docs, **columns)
    return map_arrow(base.withColumn("doc_id", F.col("doc_id").cast("long")), _counts, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars long, n_chars_encoded_again long", path=vocabulary, rule=None if edits_col else rule)
