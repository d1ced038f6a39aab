"""Near-duplicate vectors by tiled comparison in PCA order.

Equal vectors of a label collapse first. The rest are turned into the basis of the whole table's principal components, ranked by
label and leading component and cut into blocks of bounded size. Two blocks of a label meet only if the boxes of their leading
components come near enough. Within a tile products are accumulated a few leading dimensions at a time; what the remaining
dimensions can add is bounded by the product of suffix norms, and pairs that can no longer reach the threshold are dropped.
Survivors are confirmed from the original components in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dup import Forest, groups, spread
from .shared import components, global_rank, map_arrow, pick, sample_rows, stash

BLOCK = 2048
LEAD = 4
STEP = 8
#: Vectors that the axes are fitted on, at most.
SAMPLE = 20_000
MARGIN = 1e-7


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for v in batch.column(0).to_pylist():
            x = _unit(np.array(v))
            sums.setdefault(len(x), np.zeros((len(x), len(x))))
            sums[len(x)] += np.outer(x, x)
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([m.tobytes()], pa.binary())], ["dim", "moments"])


def principal_axes(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Columns by falling variance about the origin, for each dimension that occurs in ``sample`` vectors chosen by a hash.

    Any orthonormal basis gives the same links; a basis that fits only makes the comparisons stop earlier. One task sums the
    moments of the sample; one matrix a dimension reaches the driver.
    """
    axes: dict[int, np.ndarray] = {}
    rows = map_arrow(sample_rows(vectors.select("rep", "vector"), sample, "rep", "vector").select("vector").repartition(1), _moments, "dim long, moments binary").collect()
    for r in rows:
        m = np.frombuffer(r["moments"]).reshape(r["dim"], r["dim"])
        axes[r["dim"]] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return axes


def _basis(axes: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The axes of a dimension; those of the components themselves where the sample had none of it."""
    return axes[dim] if dim in axes else axes.setdefault(dim, np.eye(dim))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _turn(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.array(v) for v in batch.column(3).to_pylist()]
        lead = np.zeros((len(vectors), LEAD))
        for i, v in enumerate(vectors):
            turned = _unit(v) @ _basis(axes, len(v))
            lead[i, : min(LEAD, len(v))] = turned[:LEAD]
        names = ["rep", "label", "many", "dim", "raw", *(f"p{k}" for k in range(LEAD))]
        data = [*batch.columns[:3], pa.array([len(v) for v in vectors], pa.int64()), pa.array([v.tobytes() for v in vectors], pa.binary()), *(pa.array(lead[:, k]) for k in range(LEAD))]
        yield pa.RecordBatch.from_arrays(data, names)


def _links(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of rows with cosine >= threshold; progressive over leading components."""
    u, v = _unit(x) @ axes, _unit(y) @ axes
    d = u.shape[1]
    rest_u = np.sqrt(np.maximum(0, np.cumsum((u * u)[:, ::-1], axis=1)[:, ::-1]))
    rest_v = np.sqrt(np.maximum(0, np.cumsum((v * v)[:, ::-1], axis=1)[:, ::-1]))
    rows, cols = np.arange(len(u)), np.arange(len(v))
    product = np.zeros((len(u), len(v)))
    alive = np.ones((len(u), len(v)), bool)
    at = 0
    while at < d:
        step = min(STEP if at < 4 * STEP else d - at, d - at)
        product += u[rows, at : at + step] @ v[cols, at : at + step].T
        at += step
        if at < d:
            alive &= product + rest_u[rows, at][:, None] * rest_v[cols, at][None, :] >= threshold - MARGIN
        else:
            alive &= product >= threshold - MARGIN
        keep_r, keep_c = alive.any(1), alive.any(0)
        if not keep_r.any():
            return np.zeros((len(x), len(y)), bool)
        if not keep_r.all() or not keep_c.all():
            rows, cols = rows[keep_r], cols[keep_c]
            product, alive = product[np.ix_(keep_r, keep_c)], alive[np.ix_(keep_r, keep_c)]
    i, j = np.nonzero(alive)
    i, j = rows[i], cols[j]
    out = np.zeros((len(x), len(y)), bool)
    norm_x, norm_y = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    safe = np.isfinite(norm_x).all() and np.isfinite(norm_y).all() and norm_x.min() > 1e-150 and norm_y.min() > 1e-150
    if not safe:
        x, y = _unit(x), _unit(y)
        norm_x, norm_y = np.ones(len(x)), np.ones(len(y))
    for p in range(0, len(i), 65536):
        a, b = i[p : p + 65536], j[p : p + 65536]
        out[a, b] = np.einsum("ij,ij->i", x[a], y[b]) / (norm_x[a] * norm_y[b]) >= threshold
    return out


def _tiles(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by tile: (label, dim, ti, tj, block, rep, many, raw). For each vector its links in the tile and a forest."""
    for keys, cols in groups(batches, 4):
        block, rep, many, raw = cols
        x = np.frombuffer(b"".join(raw), np.float64).reshape(len(rep), -1)
        same = keys[2] == keys[3]
        left = np.flatnonzero(block == keys[2])
        right = left if same else np.flatnonzero(block == keys[3])
        if not len(left) or not len(right):
            continue
        forest, links = Forest(len(rep)), np.zeros(len(rep), np.int64)
        for lo in range(0, len(left), 512):
            rows = left[lo : lo + 512]
            linked = _links(x[rows], x[right], _basis(axes, x.shape[1]), threshold)
            if same:
                linked[np.arange(len(rows)), np.arange(lo, lo + len(rows))] = False
            links[rows] += linked @ many[right]
            if not same:
                links[right] += many[rows] @ linked
            spread(forest, linked, rows, right)
        hit = np.flatnonzero(links)
        if len(hit):
            roots = np.array([forest.top(int(i)) for i in hit])
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(rep[roots]), pa.array(links[hit])], ["rep", "root", "links"])


def similar_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Rows are compared when their labels, of whatever type, are equal and not null and their vectors have the same length. Null, zero or non-finite
    vectors link with nothing. ``n_links`` counts the other rows linked directly, equal vectors and repeated rows included;
    ``component_id`` is the smallest vec_id reachable. Null vec_id: counted among the links of others only if its vector equals
    theirs; component null. Other columns are ignored; an empty table gives none.
    """
    base = pick(table, vec_id=id_col, vector=vector_col, label=label_col).withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("vector", F.col("vector").cast("array<double>"))
    base = base.withColumn("vector", F.when(usable(F.col("vector")) & F.col("label").isNotNull(), F.transform("vector", lambda x: x + F.lit(0.0))))
    reps = stash(base.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many")).where("rep is not null"))
    axes = principal_axes(reps)
    turned = map_arrow(reps.select("rep", F.col("label").cast("string"), "many", "vector"), _turn, f"rep long, label string, many long, dim long, raw binary, {', '.join(f'p{k} double' for k in range(LEAD))}", axes=axes)
    ranked = stash(global_rank(turned, ["label", "dim", "p0", "rep"]).withColumn("block", F.expr(f"rank div {block}")))
    boxes = ranked.groupBy("label", "dim", "block").agg(*(f(f"p{k}").alias(f"{n}{k}") for k in range(LEAD) for n, f in (("lo", F.min), ("hi", F.max))))
    far = boxes.select("label", "dim", F.col("block").alias("tj"), *(F.col(f"{n}{k}").alias(f"{n}{k}_") for k in range(LEAD) for n in ("lo", "hi")))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{k}_") - F.col(f"hi{k}"), F.col(f"lo{k}") - F.col(f"hi{k}_")), F.lit(2.0)) for k in range(LEAD)), F.lit(0.0))
    reach = max(0.0, 2 - 2 * threshold) + 1e-6
    pairs = boxes.withColumnRenamed("block", "ti").join(far, ["label", "dim"]).where(F.col("ti") <= F.col("tj")).where(gap <= reach).select("label", "dim", "ti", "tj")
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("ti", "tj"))))
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = ranked.join(sides, ["label", "dim", "block"]).select("label", "dim", "ti", "tj", "block", "rep", "many", "raw").repartition(parts, "label", "dim", "ti", "tj").sortWithinPartitions("label", "dim", "ti", "tj", "rep")
    found = stash(map_arrow(dealt, _tiles, "rep long, root long, links long", axes=axes, threshold=threshold))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = reps.join(counts, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    # stored, so that the join is one plain shuffle of the rows, which Spark can split where many rows hold one vector
    out = base.join(stash(whole), ["label", "vector"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
