"""Language of every word by a linear-chain conditional random field, and of documents from their words.

Emission scores come from hashed features of a word (the word itself, affixes, character n-grams, and the language of the training
lexicon it belongs to); transition scores are learned with them. Forward-backward over overlapping windows gives every word's
posterior, so code-switched text is labelled word by word. A document's language is the one with the largest mean posterior.

The model learns from a bounded sample: at most ``TRAIN_DOCS`` documents a language, those with the smallest hash of id and text,
of a longer text a stretch of ``TRAIN_CHARS`` characters; at most ``TRAIN_WORDS`` of their words a language. Prediction reads every text whole.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import map_arrow, named, pick, stretch

TRAIN_DOCS = 150
TRAIN_CHARS = 20_000
TRAIN_WORDS = 40_000
FEATURES = 1 << 16
WINDOW, CONTEXT = 256, 16
CACHE_WORDS = 300_000
OTHER = re.compile(r"[\W\d_]+")


def letters(token: str) -> str:
    """A token's letters in lower case; tokens without one are no words. Fractions, raised and enclosed digits are no letters."""
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, OTHER.sub("", token))).lower()


def _hash(kind: int, *codes: np.ndarray) -> np.ndarray:
    """Feature numbers of tuples of integers, 16 bits."""
    x = np.full(codes[0].shape, kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for c in codes:
        x = (x ^ c.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)) & np.uint64(FEATURES - 1)


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, the word each belongs to) of lower-case words, all at once.

    Features: the word; its 2- and 3-grams with the edges marked, which are also its affixes of one and two letters; affixes of
    three letters; its lexicon language.
    """
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    rest = sizes[owner] - place
    flat, own = [_hash(0, np.zeros(len(words), np.uint64))], [np.arange(len(words))]
    whole = np.add.reduceat((codes + np.uint64(7)) * ((place.astype(np.uint64) + np.uint64(3)) * np.uint64(0xFF51AFD7ED558CCD) | np.uint64(1)), starts)
    flat.append(_hash(1, whole))
    own.append(np.arange(len(words)))
    for kind, n, where in ((2, 2, rest >= 2), (3, 3, rest >= 3), (4, 4, (place == 0) & (rest >= 4)), (5, 4, rest == 4)):
        at = np.flatnonzero(where)
        flat.append(_hash(kind, *(codes[at + k] for k in range(n))))
        own.append(owner[at])
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    flat.append(_hash(6, known[known >= 0]))
    own.append(np.flatnonzero(known >= 0))
    return np.concatenate(flat).astype(np.int64), np.concatenate(own)


def _sum_features(weights: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, weights[flat, y], n) for y in range(weights.shape[1])], axis=1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of padded sequences, longest first: scores (n, time, labels) are exponentiated emissions, ``trans`` and ``start``
    exponentiated too. Also gives the expected transitions, summed."""
    n, time, labels = scores.shape
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    active = np.searchsorted(-lengths, -np.arange(1, time + 1), side="right")  # sequences with more than t words
    a = start * scores[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for t in range(1, time):
        k = active[t]
        if not k:
            break
        a = (alpha[:k, t - 1] @ trans) * scores[:k, t]
        alpha[:k, t] = a / a.sum(1, keepdims=True)
    beta[np.arange(n), lengths - 1] = 1.0
    moves = np.zeros_like(trans)
    for t in range(time - 2, -1, -1):
        k = active[t + 1]
        if not k:
            continue
        x = scores[:k, t + 1] * beta[:k, t + 1]
        b = x @ trans.T
        size = b.sum(1, keepdims=True)
        beta[:k, t] = b / size
        norm = (alpha[:k, t] * b).sum(1, keepdims=True)
        moves += (alpha[:k, t] / norm).T @ x
    post = alpha * beta
    return post / np.maximum(post.sum(2, keepdims=True), 1e-30), moves * trans


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp(score) of each word and label, largest 1."""
        total = _sum_features(self.weights, *word_features(words, self.lexicon), len(words))
        return np.exp(total - total.max(1, keepdims=True)) + 1e-12


def train(samples: list[tuple[str, str]], *, rounds: int = 40, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Model | None:
    """A model from (language, text). Stretches of 20 to 120 words of different texts are chained, so that switches occur and their
    transitions are learned; their words carry their document's language."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    spans: list[tuple[int, list[str]]] = []
    counts: dict[str, Counter] = {}
    used = [0] * len(languages)
    for lang, text in samples:
        y = languages.index(lang)
        words = [w for w in map(letters, text.split()) if w]
        if used[y] >= TRAIN_WORDS or not words:
            continue
        words = words[: TRAIN_WORDS - used[y]]
        used[y] += len(words)
        for w in words:
            counts.setdefault(w, Counter())[y] += 1
        at = 0
        while at < len(words):
            size = int(rng.integers(20, 121))
            spans.append((y, words[at : at + size]))
            at += size
    if not spans:
        return None
    lexicon = {w: c.most_common(1)[0][0] for w, c in counts.items() if c.total() >= 3 and c.most_common(1)[0][1] >= 0.95 * c.total()}
    types = {w: i for i, w in enumerate(counts)}
    order = rng.permutation(len(spans))
    ids = np.array([types[w] for s in order for w in spans[s][1]])
    labels = np.array([spans[s][0] for s in order for _ in spans[s][1]])
    size = 128
    n = -(-len(ids) // size)
    lengths = np.full(n, size)
    lengths[-1] = len(ids) - size * (n - 1)
    pad = n * size - len(ids)
    grid = np.concatenate([ids, np.zeros(pad, int)]).reshape(n, size)
    real = (np.arange(n * size) < len(ids)).reshape(n, size)
    gold = np.concatenate([labels, np.zeros(pad, int)]).reshape(n, size)
    flat, owner = word_features(list(types), lexicon)
    k = len(languages)
    weights, trans, start = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(x, 1e-6) for x in (weights, trans, start)]
    seen_moves = np.zeros((k, k))
    inside = real[:, 1:]
    np.add.at(seen_moves, (gold[:, :-1][inside], gold[:, 1:][inside]), 1)
    total = len(ids)
    for _ in range(rounds):
        emit = _sum_features(weights, flat, owner, len(types))
        emit -= emit.max(1, keepdims=True)
        post, moves = forward_backward(np.exp(emit)[grid], lengths, np.exp(trans), np.exp(start))
        diff = -post
        diff[np.arange(n)[:, None], np.arange(size)[None, :], gold] += 1
        diff[~real] = 0
        by_type = np.stack([np.bincount(grid.ravel(), diff[:, :, y].ravel(), len(types)) for y in range(k)], axis=1)
        grads = [np.stack([np.bincount(flat, by_type[owner, y], FEATURES) for y in range(k)], axis=1) / total, (seen_moves - moves) / total, diff[:, 0].sum(0) / total]
        for x, g, s in zip((weights, trans, start), grads, sums, strict=True):
            g -= decay * x / 100
            s += g * g
            x += rate * g / np.sqrt(s)
    return Model(languages, weights.astype(np.float32), np.exp(trans), np.exp(start), lexicon)


class Labeller:
    """Word posteriors of texts; scores of words seen before are remembered, boundedly."""

    def __init__(self, model: Model):
        self.model, self.known, self.table = model, {}, np.zeros((0, len(model.languages)), np.float32)

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Table rows of white-space tokens; -1 for those without a letter."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.table = {}, self.table[:0]
        known = self.known
        found = list(map(known.get, tokens))
        if None in found:
            new = dict.fromkeys([w for w, x in zip(tokens, found, strict=True) if x is None])
            words = {w: letters(w) for w in new}
            fresh = [w for w, x in words.items() if x]
            at = len(self.table)
            known.update((w, -1) for w, x in words.items() if not x)
            known.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            parts = [self.model.emissions([words[w] for w in fresh[i : i + 20_000]]).astype(np.float32) for i in range(0, len(fresh), 20_000)]
            self.table = np.concatenate([self.table, *parts])
            found = list(map(known.get, tokens))
        return np.array(found, np.int64)

    def posteriors(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(words, labels) for texts laid end to end, ``sizes`` words each. Windows overlap by ``CONTEXT`` words on either side."""
        scores = self.table[rows]
        out = np.zeros(scores.shape)
        ends = np.cumsum(sizes)
        low, high, lo, hi = [], [], [], []
        for first, end in zip(ends - sizes, ends, strict=True):
            cuts = np.arange(first, end, WINDOW)
            low.append(cuts)
            high.append(np.minimum(cuts + WINDOW, end))
            lo.append(np.maximum(cuts - CONTEXT, first))
            hi.append(np.minimum(cuts + WINDOW + CONTEXT, end))
        if not low:
            return out
        low, high, lo, hi = map(np.concatenate, (low, high, lo, hi))
        order = np.argsort(lo - hi, kind="stable")
        for at in range(0, len(order), 2000):
            w = order[at : at + 2000]
            lengths = hi[w] - lo[w]
            place = lo[w][:, None] + np.arange(lengths[0])[None, :]
            inside = place < hi[w][:, None]
            post, _ = forward_backward(scores[np.minimum(place, len(scores) - 1)].astype(np.float64), lengths, self.model.trans, self.model.start)
            take = inside & (place >= low[w][:, None]) & (place < high[w][:, None])
            out[place[take]] = post[take]
        return out


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    labeller = Labeller(model) if model else None
    for batch in batches:
        tokens = [t.split() if t else [] for t in batch.column(1).to_pylist()]
        sizes = np.array([len(f) for f in tokens], np.int64)
        langs, scores = ["und"] * len(tokens), np.zeros(len(tokens))
        if labeller and sizes.sum():
            rows = labeller.rows([w for f in tokens for w in f])
            owner = np.repeat(np.arange(len(tokens)), sizes)[rows >= 0]
            sizes = np.bincount(owner, minlength=len(tokens))
            some = np.flatnonzero(sizes)
            post = labeller.posteriors(rows[rows >= 0], sizes[some])
            if len(some):
                share = np.add.reduceat(post, np.cumsum(sizes[some]) - sizes[some], axis=0) / sizes[some][:, None]
                best = share.argmax(1)
                scores[some] = np.clip(share[np.arange(len(some)), best], 0, 1)
                for i, b in zip(some, best, strict=True):
                    langs[i] = model.languages[b]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, batch.num_columns)), pa.array(langs, pa.string()), pa.array(scores)], [*batch.schema.names[2:], "__lang_pred", "__score"])


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id's text is 2 modulo 4. A null id is held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(True))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((n, lang, text) for batch in batches for lang, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(lang, text) for _, lang, text in rows]))], pa.binary())], ["model"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model | None:
    """Train in one task on at most ``train_docs`` documents a language that are labelled and not held out, those with the smallest
    hash of id and text; None if there are none. Of a text above ``train_chars`` characters a stretch of that length is read, from
    a place that the hash names, so a language of long documents alone is learned too. The driver sees a count a language and the model."""
    base = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1))
    limits = {r["lang"]: 1.5 * (train_docs + 100) / r["count"] for r in base.groupBy("lang").count().collect()}
    if not limits:
        return None
    # texts above a limit that follows from their language's count are left out before any is moved
    limit = F.create_map(*(F.lit(x) for lang, share in limits.items() for x in (lang, int((1 << 63) * min(share, 1 - 2**-53)))))
    first = Window.partitionBy("lang").orderBy("order", "doc_id", "text")
    near = base.withColumn("order", order).where(F.col("order") <= F.element_at(limit, F.col("lang")))
    sample = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= train_docs).select("lang", stretch(F.col("text"), F.col("order"), train_chars).alias("text"), "n").repartition(1)
    models = map_arrow(sample, _train_task, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else None


def with_language(docs: DataFrame, model: Model | None, *, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its mean posterior. Only the text is read. Null texts and texts without a letter
    are ``und`` with score 0, and so is everything when nothing could be learned. Of languages with equal posteriors the first by name counts. Rows are judged one by one, repeats alike; other
    columns pass through; an empty table stays empty."""
    # columns travel under numbers, so that no name of the input can clash; a column called as a result is replaced
    kept = [c for c in docs.columns if c not in names]
    numbered = [f"c{i}" for i in range(len(kept))]
    fields = [StructField(n, docs.schema[c].dataType) for n, c in zip(numbered, kept, strict=True)]
    rows = docs.select(F.lit(0).alias("__n"), F.col(f"`{text_col}`").alias("__text"), *(named(c).alias(n) for n, c in zip(numbered, kept, strict=True)))
    out = map_arrow(rows, _predict, StructType([*fields, StructField("__lang_pred", StringType()), StructField("__score", DoubleType())]), model=model)
    return out.select(*(F.col(n).alias(c) for n, c in zip(numbered, kept, strict=True)), F.col("__lang_pred").alias(names[0]), F.col("__score").alias(names[1]))
