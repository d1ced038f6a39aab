"""Near-duplicate documents by b-bit MinHash.

1. Every document becomes its set of distinct word shingles (64-bit hashes). The minima of 192 hash functions give 32 bands of six
   rows and a packed signature of the low two bits of each minimum. Documents with one and the same set collapse to the smallest id.
2. Documents that share a band are compared by signature: equal two-bit symbols are counted by bit counts and the estimate is
   corrected for chance collisions. A bucket passes on a spanning forest of the pairs whose estimate could still be a link
   (threshold less ``SLACK``), never all of them. Buckets above ``tile_rows`` are compared in tiles that different tasks take.
3. Components of these candidates are small families. Their full shingle sets meet once, in tiles of bounded size, and links are
   confirmed exactly. Components of the confirmed links are the result.

A pair exactly at a similarity of 0.85 shares no band with probability 3e-7, and falls below the slack with about 3e-6; at 0.80, the
default, with 6e-5 and about 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns_of, components, map_arrow, pick, stash

BANDS, ROWS, BITS = 32, 6, 2
HASHES = BANDS * ROWS
SLACK = 0.14
#: The lowest similarity that the bands find with all but certainty.
LEAST_PERCENT = 80
TILE_ROWS = 4096
TILE_SHINGLES = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS = HASHES // 64


def _seeds() -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``k``-word shingles; A-Z in lower case, words parted by ASCII white space.

    Fewer than ``k`` words: the whole sequence is the one shingle. No words or no text: empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out *= _MIX
        out ^= out >> np.uint64(31)
        out += h[i : n - k + 1 + i]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest value of each multiply hash over a set, 32 bits each."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32) | np.uint32(1)
    low = np.full(len(seeds), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        v = seeds[:, None] * x[None, at : at + 512]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(low, v.min(1), out=low)
    return low


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    seeds = _seeds()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        n = len(texts)
        count, digest, low = np.zeros(n, np.int64), [None] * n, np.zeros((n, HASHES), np.uint32)
        for i, text in enumerate(texts):
            s = shingles(text, k)
            if len(s):
                count[i], digest[i], low[i] = len(s), xxhash.xxh3_128_digest(s.tobytes()), minima(s, seeds)
        band = low.reshape(n, BANDS, ROWS)
        keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
        for r in range(ROWS):
            keys = (keys ^ band[:, :, r]) * _MIX
            keys ^= keys >> np.uint64(32)
        planes = [np.packbits(((low >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1) for b in range(BITS)]
        packed = np.concatenate(planes, axis=1)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(count), pa.array(digest, pa.binary()), lists, pa.array([x.tobytes() for x in packed], pa.binary()), batch.column(2)], ["doc_id", "n_shingles", "digest", "bands", "packed", "text_key"])


def matches_needed(threshold: float) -> int:
    """Equal symbols from which the corrected similarity estimate reaches ``threshold``."""
    chance = 2.0**-BITS
    return int(np.ceil(HASHES * (chance + (1 - chance) * threshold)))


def _equal_symbols(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal low-bit symbols of packed signatures, (…, BITS * _WORDS) of uint64 that broadcast."""
    differ = x[..., :_WORDS] ^ y[..., :_WORDS]
    for b in range(1, BITS):
        differ |= x[..., b * _WORDS : (b + 1) * _WORDS] ^ y[..., b * _WORDS : (b + 1) * _WORDS]
    return HASHES - np.bitwise_count(differ).sum(-1, dtype=np.int32)


class Forest:
    """Union-find over 0..n-1 that remembers the edges which joined something."""

    def __init__(self, n: int):
        self.up, self.edges = np.arange(n), []

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return int(i)

    def join(self, i: int, j: int) -> None:
        p, q = self.top(i), self.top(j)
        if p != q:
            self.up[max(p, q)] = min(p, q)
            self.edges.append((i, j))


def spread(forest: Forest, linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
    """Join what a block's boolean matrix links; a row joins one of each group of columns only, so work is linear in its rows."""
    for r in np.flatnonzero(linked.any(1)):
        hit = columns[np.flatnonzero(linked[r])]
        tops = forest.up[hit]
        while (tops != forest.up[tops]).any():
            tops = forest.up[tops]
        forest.up[hit] = tops
        _, first = np.unique(tops, return_index=True)
        for c in hit[first]:
            forest.join(int(rows[r]), int(c))


def _bucket_edges(batches: Iterator[pa.RecordBatch], need: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket and tile: (bucket, ti, tj, block, rep, packed). Gives a forest of each group's likely pairs."""
    for keys, cols in groups(batches, 3):
        side, rep = cols[0], cols[1]
        sig = np.frombuffer(b"".join(cols[2]), np.uint64).reshape(len(rep), -1)
        forest, n = Forest(len(rep)), len(rep)
        if n < 2:
            continue
        for at in range(0, n, 256):
            rows = np.arange(at, min(n, at + 256))
            ok = _equal_symbols(sig[rows][:, None, :], sig[None, at:, :]) >= need
            columns = np.arange(at, n)
            ok &= columns[None, :] > rows[:, None]
            if keys[1] != keys[2]:
                ok &= side[rows][:, None] != side[None, at:]
            spread(forest, ok, rows, columns)
        if forest.edges:
            e = np.array(forest.edges)
            yield pa.RecordBatch.from_arrays([pa.array(rep[e[:, 0]]), pa.array(rep[e[:, 1]])], ["a", "b"])


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list]]:
    """Runs of equal leading key columns in sorted batches, as numpy arrays (lists for binary columns); a run may span batches."""
    held: list[pa.RecordBatch] = []
    key = None

    def out():
        t = pa.Table.from_batches(held)
        return [c.to_pylist() if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c.to_numpy() for c in t.columns[n_keys:]]

    for batch in batches:
        if not batch.num_rows:
            continue
        ks = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in ks])) + 1 if batch.num_rows > 1 else []
        bounds = [0, *cuts, batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            now = tuple(k[lo] for k in ks)
            if now != key and held:
                yield key, out()
                held = []
            key = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, out()


def tiled(df: DataFrame, by: list[str], share: F.Column | str, limit: int) -> DataFrame:
    """Give each row its group's tiles (ti <= tj): groups whose summed ``share`` is above ``limit`` are dealt to blocks, and each
    pair of blocks is one tile, so that no task holds a group. Groups of one row are left out."""
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.sum(share).alias("__size")).where("__n > 1")
    parted = df.join(size, by).withColumn("nb", F.ceil(F.col("__size") / F.lit(limit)).cast("int"))
    block = parted.withColumn("block", F.when(F.col("nb") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")))
    return block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("ti", F.least("block", "other")).withColumn("tj", F.greatest("block", "other")).drop("__n", "__size", "nb", "other")


def _confirm(batches: Iterator[pa.RecordBatch], need: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by family and tile: (family, ti, tj, block, rep, packed, hashes). Exact links, as a forest."""
    for keys, cols in groups(batches, 3):
        side, rep, packed, sets = cols
        n = len(rep)
        if n < 2:
            continue
        sig = np.frombuffer(b"".join(packed), np.uint64).reshape(n, -1)
        sets = [np.frombuffer(x, np.uint64) for x in sets]
        size = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(n), size)
        _, index, uses = np.unique(every, return_inverse=True, return_counts=True)
        common = uses[index] > 1
        names = np.full(len(uses), -1)
        names[uses > 1] = np.arange((uses > 1).sum())
        width = max(1, -(-int((uses > 1).sum()) // 64))
        column = names[index[common]]
        forest, step = Forest(n), 64
        for lo in range(0, n, step):
            rows = np.arange(lo, min(n, lo + step))
            left = _bits(column, owner[common], rows, width)
            for at in range(lo, n, step):
                columns = np.arange(at, min(n, at + step))
                likely = _equal_symbols(sig[rows][:, None, :], sig[columns][None, :, :]) >= need
                likely &= columns[None, :] > rows[:, None]
                small, large = np.minimum(size[rows][:, None], size[columns][None, :]), np.maximum(size[rows][:, None], size[columns][None, :])
                likely &= 100 * small >= percent * large
                if keys[1] != keys[2]:
                    likely &= side[rows][:, None] != side[columns][None, :]
                i, j = np.nonzero(likely)
                if not len(i):
                    continue
                right = left if at == lo else _bits(column, owner[common], columns, width)
                linked = np.zeros(likely.shape, bool)
                part = max(1, 4_000_000 // (8 * width))
                for p in range(0, len(i), part):
                    both = np.bitwise_count(left[i[p : p + part]] & right[j[p : p + part]]).sum(1, dtype=np.int64)
                    union = size[rows[i[p : p + part]]] + size[columns[j[p : p + part]]] - both
                    linked[i[p : p + part], j[p : p + part]] = 100 * both >= percent * union
                spread(forest, linked, rows, columns)
        if forest.edges:
            e = np.array(forest.edges)
            yield pa.RecordBatch.from_arrays([pa.array(rep[e[:, 0]]), pa.array(rep[e[:, 1]])], ["a", "b"])


def _bits(column: np.ndarray, owner: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """One bit a shingle that at least two of the group hold, for the given rows."""
    lo, hi = np.searchsorted(owner, [rows[0], rows[-1] + 1])
    flat = np.zeros((len(rows), width * 64), np.uint8)
    flat[owner[lo:hi] - rows[0], column[lo:hi]] = 1
    return np.packbits(flat, axis=1, bitorder="little").view(np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Full sets of the documents that stand for theirs; another text under the same doc_id is left out by its digest."""
    for batch in batches:
        sets = [shingles(t, k).tobytes() for t in batch.column(4).to_pylist()]
        same = [xxhash.xxh3_128_digest(x) == d for x, d in zip(sets, batch.column(3).to_pylist(), strict=True)]
        out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], ["rep", "family", "packed", "digest", "hashes"])
        yield out.filter(pa.array(same))


def text_key(text: F.Column) -> F.Column:
    """Names a text among the rows of one doc_id; a null text has its own name."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def _judge(docs: DataFrame, *, id_col: str, text_col: str, words: int, percent: int, tile_rows: int, tile_shingles: int) -> DataFrame:
    """(doc_id, n_shingles, digest, text_key, component_id, head), one per input row; ``head`` is the digest of the row that a group
    of near copies is named after, the smallest of those with its smallest doc_id."""
    base = pick(docs, doc_id=id_col, text=text_col)
    long_id = base.withColumn("doc_id", F.col("doc_id").cast("long"))
    keyed = long_id.withColumn("text_key", text_key(F.col("text")))
    sigs = stash(map_arrow(keyed, _signatures, "doc_id long, n_shingles long, digest binary, bands array<long>, packed binary, text_key string", k=words))
    full = sigs.where("digest is not null and doc_id is not null")
    # links are between texts, not ids: rows of one doc_id with different texts are different nodes, named by a hash of the digest
    firsts = full.groupBy("digest").agg(F.min("doc_id").alias("first"))
    # joined by both keys: a digest that many copies share is dealt by their ids
    own = full.withColumnRenamed("doc_id", "first").join(firsts, ["digest", "first"]).dropDuplicates(["first", "digest"])
    heads = own.select(F.xxhash64("digest").alias("rep"), "first", "bands", "packed", "digest")
    need = matches_needed(percent / 100 - SLACK)
    tiles = tiled(heads.select("rep", F.explode("bands").alias("bucket")), ["bucket"], F.lit(1), tile_rows)
    tiles = tiles.join(heads.select("rep", "packed"), "rep").select("bucket", "ti", "tj", "block", "rep", "packed")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_tiles = tiles.repartition(parts, "bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj", "rep")
    likely = stash(map_arrow(sorted_tiles, _bucket_edges, "a long, b long", need=need))
    families = components(likely)
    held = heads.join(families.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep").select("rep", "first", "family", "packed", "digest")
    texts = held.join(long_id.withColumnRenamed("doc_id", "first"), "first").select("rep", "family", "packed", "digest", "text")
    sets = map_arrow(texts, _sets, "rep long, family long, packed binary, digest binary, hashes binary", k=words).dropDuplicates(["rep", "digest"])
    packs = tiled(sets, ["family"], F.octet_length("hashes") / 8, tile_shingles).select("family", "ti", "tj", "block", "rep", "packed", "hashes")
    sorted_packs = packs.repartition(parts, "family", "ti", "tj").sortWithinPartitions("family", "ti", "tj", "rep")
    links = stash(map_arrow(sorted_packs, _confirm, "a long, b long", need=need, percent=percent))
    linked = stash(components(links).withColumnRenamed("node", "rep").join(firsts.select(F.xxhash64("digest").alias("rep"), "first", "digest"), "rep"))
    # stored, so that each join below is one of two plain shuffles, which Spark can split where many texts share a group or a digest
    names = stash(linked.groupBy("component").agg(F.min(F.struct("first", "digest")).alias("name")))
    named = linked.join(names, "component").select("digest", "name")
    group = stash(firsts.join(named, "digest", "left").select("digest", F.coalesce("name.first", "first").alias("component"), F.coalesce("name.digest", "digest").alias("head")))
    out = sigs.select("doc_id", "n_shingles", "digest", "text_key").join(group, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "digest", "text_key", component.alias("component_id"), "head")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets. ``component_id`` is the smallest
    doc_id reachable by links. Null or empty text: no shingles, linked with nothing, kept. Rows that repeat a doc_id and its text
    give the same row as often as they occur; rows of one doc_id with different texts are judged each by its own text. Null doc_id:
    component null and kept true, linked with nothing. Other columns of the input are ignored. An empty table gives an empty result.
    The bands are made for a similarity of 0.8 and more; a lower ``percent`` is refused, since it would lose links.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent must be at least {LEAST_PERCENT}")
    out = _judge(docs, id_col=id_col, text_col=text_col, words=words, percent=percent, tile_rows=tile_rows, tile_shingles=tile_shingles)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, one of each group of near copies: the one with the smallest doc_id.

    Rows are told apart by doc_id and text. Different texts under one doc_id all stay unless they are near copies; of near copies
    under the smallest doc_id of their group one text stays, chosen by hashes. Rows that repeat doc_id and text stay once, the one
    whose other columns come first as JSON text. Every row with a null doc_id stays. Columns keep their values, whatever their names
    and types.
    """
    judged = _judge(docs, id_col=id_col, text_col=text_col, words=words, percent=percent, tile_rows=TILE_ROWS, tile_shingles=TILE_SHINGLES)
    first = judged.where("doc_id = component_id and digest <=> head")
    texts = first.groupBy("doc_id", "digest", F.when(F.col("digest").isNull(), F.col("text_key")).alias("empty")).agg(F.min("text_key").alias("__key"))
    chosen = texts.select(F.col("doc_id").alias("__id"), "__key")
    others = [c for name, c in zip(docs.columns, columns_of(docs), strict=True) if name not in (id_col, text_col)]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), text_key(F.col(f"`{text_col}`")).alias("__key"), order.alias("__order"), F.struct(*columns_of(docs)).alias("__row"))
    once = rows.join(chosen, ["__id", "__key"], "left_semi").groupBy("__id", "__key").agg(F.min_by("__row", "__order").alias("__row"))
    return once.select("__row.*").unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
