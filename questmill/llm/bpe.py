"""Exact byte-level BPE by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is one last token with which its encoding ends. It is the token that is a suffix of the
prefix (all of them come from one pass of an Aho-Corasick automaton over the vocabulary, by its suffix links) and is compatible with the last token of what comes
before: no merge across their border would have come first. Back-pointers from the end give the ids. Words and pre-tokens seen before are looked up; the tables that hold them are bounded.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .shared import map_arrow, pick, text_list

CACHE_CHUNKS = 400_000
CACHE_PIECES = 400_000
CACHE_PAIRS = 1_000_000
_NEVER = 1 << 60
#: What ``uneasy`` finds in ASCII texts, besides a space at the end.
UNEASY = tuple(" " + c for c in " \t\n\v\f\r")
#: A chunk of two pre-tokens at most: letters, with the space before them, and marks that no contraction begins with.
WORD_AND_MARKS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ſ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder and decoder for a byte-level BPE vocabulary file in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        self.ids = {raw[token]: i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = self.ids[raw[left]], self.ids[raw[right]]
            whole = self.ids[raw[left] + raw[right]]
            self.rank[a, b] = rank
            self.made.setdefault(whole, (a, b, rank))
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: A space before white space or the end: only then may a cut at single spaces fall inside a pre-token.
        self.uneasy = regex.compile(r" (?:\p{White_Space}|$)")
        self.edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        #: Decimal ids of chunks and pre-tokens seen lately, and before that; what is looked up again moves to the first.
        self.chunks: dict[str, str] = {}
        self.chunks_before: dict[str, str] = {}
        self.known: dict[str, str] = {}
        self.known_before: dict[str, str] = {}
        # tokens that their own bytes don't encode to end no prefix
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ids.items():
            if self.reachable(i):
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        last = max(self.bytes_of) + 1
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(last)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.every_byte = np.frombuffer(b"".join([self.bytes_of.get(i, b"") for i in range(last)]), np.uint8)
        self.letters = {c: chr(b) for c, b in letters.items()}
        self.library = Tokenizer.from_file(path).pre_tokenizer

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Tokens that stand at one edge of ``token`` while it is built, each with the rank of the merge that uses it up."""
        found = self.edges.get((token, right))
        if found is None:
            found, at = [(token, _NEVER)], token
            while at in self.made:
                a, b, rank = self.made[at]
                at = b if right else a
                found.append((at, rank))
            self.edges[token, right] = found
        return found

    def _crossed(self, left: int, right: int, besides: int = -1) -> bool:
        """Whether a merge across the border comes before both sides are complete; of equal merges the leftmost is first."""
        for a, a_used in self.edge(left, True):
            for b, b_used in self.edge(right, False):
                rank = self.rank.get((a, b))
                if rank is not None and rank != besides and rank < a_used and rank <= b_used:
                    return True
        return False

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = not self._crossed(left, right)
        return found

    def reachable(self, token: int) -> bool:
        """Whether a token's own bytes encode to it."""
        found = self.whole.get(token)
        if found is None:
            if token in self.made:
                a, b, rank = self.made[token]
                found = self.reachable(a) and self.reachable(b) and not self._crossed(a, b, rank)
            else:
                found = len(self.bytes_of[token]) == 1
            self.whole[token] = found
        return found

    def encode_pretoken(self, data: str) -> list[int]:
        """Ids of one pre-token, given as one character a byte."""
        n = len(data)
        tokens, sizes = [0] * (n + 1), [0] * (n + 1)  # of each prefix, the last token (shifted, as the first half of a pair) and its size
        pairs, done = self.pairs, -1
        for at, (size, token) in self.automaton.iter(data):
            if at == done:
                continue
            if at >= size:
                before = tokens[at + 1 - size]
                fits = pairs.get(before | token)
                if not (self.compatible(before >> 20, token) if fits is None else fits):
                    continue
            tokens[at + 1], sizes[at + 1], done = token << 20, size, at
        out = []
        while n:
            out.append(tokens[n] >> 20)
            n -= sizes[n]
        out.reverse()
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text in order, one character a byte. Letters beyond the range in which this module's and the library's
        Unicode tables are known to agree leave the cutting to the library."""
        if text.isascii():
            return self.split.findall(text)
        if max(text) <= "\u0557":
            return [p.encode("utf-8").decode("latin-1") for p in self.split.findall(text)]
        letters = self.letters
        return ["".join([letters[c] for c in p]) for p, _ in self.library.pre_tokenize_str(text)]

    def _piece(self, piece: str) -> str:
        """Decimal ids of one pre-token."""
        found = self.known.get(piece)
        if found is None:
            found = self.known_before.get(piece)
            if found is None:
                found = ",".join(map(str, self.encode_pretoken(piece)))
            if len(piece) <= 64:
                if len(self.known) > CACHE_PIECES:
                    self.known, self.known_before = {}, self.known
                self.known[piece] = found
        return found

    def _chunk(self, chunk: str) -> str:
        m = WORD_AND_MARKS.fullmatch(chunk)
        if m:
            if not chunk.isascii():
                return f"{self._piece(m[1].encode().decode('latin-1'))},{self._piece(m[2])}" if m[2] else self._piece(m[1].encode().decode("latin-1"))
            return f"{self._piece(m[1])},{self._piece(m[2])}" if m[2] else self._piece(m[1])
        if self.special_split and "<" in chunk:
            parts = [p for p in self.special_split.split(chunk) if p]
        else:
            parts = [chunk]
        out = []
        for part in parts:
            if part in self.special:
                out.append(str(self.special[part]))
            else:
                out += map(self._piece, self.pieces(part))
        return ",".join(out)

    def chunked(self, text: str) -> list[str]:
        """Decimal ids of consecutive parts of a text, cut at single spaces between words where that is safe."""
        if (any(map(text.__contains__, UNEASY)) or text.endswith(" ") if text.isascii() else self.uneasy.search(text)) or "<|" in text:
            return [self._chunk(text)] if text else []
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks, self.chunks_before = {}, self.chunks
        chunks, before = self.chunks, self.chunks_before
        words = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self._cut(text)
        if not words[0]:
            del words[0]
        out = list(map(chunks.get, words))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    w = words[i]
                    out[i] = found = chunks.get(w) or before.get(w) or self._chunk(w)
                    if len(w) <= 48:
                        chunks[w] = found
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def encode(self, text: str) -> list[int]:
        return [int(x) for part in self.chunked(text) for x in part.split(",")]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """What the library's decode gives: the tokens' bytes as UTF-8, malformed ones replaced."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ids) else 0) + np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.every_byte[place].tobytes().decode("utf-8", "replace")


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
        gc.freeze()  # tables of many small objects that stay: no later pass of the collector needs to visit them
    return _encoders[path]


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        counts, digests, decoded, lists = [], [], [], []
        for text in text_list(batch.column(1)):
            parts = enc.chunked(text)
            joined = ",".join(parts)
            ids = np.fromstring(joined, np.int64, sep=",") if joined else np.empty(0, np.int64)
            counts.append(len(ids))
            digests.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded.append(hashlib.sha256(enc.decode(ids).encode("utf-8")).hexdigest())
            if keep_ids:
                lists.append(ids)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names)


def encode_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Ids of every whole text and what they decode to: (doc_id, n_tokens, ids_sha256, decoded_sha256), with ``ids`` on request.

    One row per input row, repeats included. Null text counts as empty: no tokens, digests of the empty string. Special tokens
    written out in a text become their ids, as the library does by default. Other columns are ignored; an empty table stays empty.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    base = pick(docs, doc_id=id_col, text=text_col)
    return map_arrow(base.withColumn("doc_id", base.doc_id.cast("long")), _round_trip, schema, path=vocabulary, keep_ids=keep_ids)
