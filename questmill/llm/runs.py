"""Periodic runs of words by a dictionary of basic factors.

Basic factors are the stretches of 1, 2, 4, 8, ... words; two have one name where their words are equal, and the names of one
length come from pairs of names of half the length. The next place of the same name, where it is at most the factor's length away,
proposes its distance as a period, and the places that propose one period one after the other (an arithmetic progression within twice
the factor's length) are one run, extended as far as it goes: the factor at i and at i + p are equal just where the words i to
i + p + length have period p, and the nearest such p is the smallest period. Each period belongs to one length, the smallest power of two
that is neither below it nor below ``FLOOR``, so that no run is found twice. Work ends at the first length whose factors are all different;
ordinary prose ends at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, pick, text_list

LEAST = 24
TIMES = 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def floor_length(least: int) -> int:
    """The longest power of two that fits into a run of ``least`` words beside a period of its own length."""
    return 1 << max(least // 2, 1).bit_length() - 1


def named(pairs: np.ndarray) -> tuple[np.ndarray, int]:
    """Names 0, 1, 2, ... of equal numbers, and how many there are."""
    found, names = np.unique(pairs, return_inverse=True)
    return names.astype(np.int64), len(found)


def proposals(names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the places whose name comes next ``low`` < distance <= ``high`` words later, by distance and place."""
    order = np.argsort(names, kind="stable")
    gap = np.diff(order)
    near = (names[order[1:]] == names[order[:-1]]) & (gap > low) & (gap <= high)
    at, gap = order[:-1][near], gap[near]
    by = np.lexsort((at, gap))
    return at[by], gap[by]


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run by start and period.

    ``ids`` are word numbers. A run has a smallest period q, at least ``least`` and ``times`` * q words, and
    its neighbours would break the period. ``times`` must be 3 or more: two factors a period apart then fit into every run.
    """
    if times < 3:
        raise ValueError("times must be at least 3")
    n, floor = len(ids), floor_length(least)
    names, distinct = named(ids)
    length, low, out = 1, 0, []
    while len(names) and distinct < len(names):
        if length >= floor:
            at, gap = proposals(names, low, length)
            new = (np.diff(at, prepend=-2) != 1) | (np.diff(gap, prepend=0) != 0)
            start, period = at[new], gap[new]
            size = np.bincount(np.cumsum(new) - 1, minlength=len(start)) - 1 + length + period
            whole = size >= np.maximum(least, times * period)
            out += zip(start[whole].tolist(), size[whole].tolist(), period[whole].tolist(), strict=True)
            low = length
        if low * times >= n or n < 2 * length:
            break
        names, distinct = named(names[: n - 2 * length + 1] * distinct + names[length:])
        length *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def read_runs(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, collapsed = [], []
        for text in text_list(batch.column(1)):
            words = text.encode().split()
            numbers: dict[bytes, int] = {}
            runs = find_runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), least, times)
            if runs:
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
            found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
            collapsed.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, RUN_TYPE), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, runs (array of start, length, period by start and period), collapsed (the words that
    no run holds after its first period, joined by one space).

    Words are stretches without white space. Null, empty and blank texts have no run and an empty collapsed text. Rows are read one by one and
    whole, repeats alike and those without an id too; other columns do not reach the result; an empty table gives none. A text's
    memory is some 60 bytes a word.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, read_runs, f"doc_id long, runs {RUNS}, collapsed string", least=least, times=times)
