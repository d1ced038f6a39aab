import random

import numpy as np
import pytest

from questmill.llm.near_dup import HASHES, _equal_symbols, matches_needed, near_duplicates, shingles
from questmill.llm.shared import components


def brute(rows, percent=85):
    """Components by comparing all pairs of texts."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    comp[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def families(n_groups, size, seed):
    """Near copies of random texts around the threshold, chains among them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
            if rng.random() < 0.3:
                base = copy
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile_rows,tile_shingles,percent", [(4096, 2_000_000, 85), (4, 400, 85), (4096, 2_000_000, 80)])
def test_components_equal_brute_force(spark, tile_rows, tile_shingles, percent):
    rows = families(12, 12, 5)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, tile_rows=tile_rows, tile_shingles=tile_shingles).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_components_of_long_chains(spark):
    falling, mixed = [0, *range(399, 0, -1)], [*range(1000, 1400)]
    random.Random(8).shuffle(mixed)
    edges = [(order[i], order[j]) for order, reach in ((falling, 1), (mixed, 3)) for i in range(400) for j in range(i + 1, min(400, i + 1 + reach))]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 if i < 1000 else 1000 for i in (*falling, *mixed)}
    with pytest.raises(RuntimeError, match="2 rounds"):
        components(spark.createDataFrame(edges, "a long, b long"), max_rounds=2)


def test_given_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = near_duplicates(documents, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


def test_odd_rows(odd):
    found = near_duplicates(odd).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 12
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[4].component_id == by[5].component_id == 4 and not by[5].kept
    assert by[8].component_id == 7
    assert by[None].component_id is None and by[None].kept


def test_no_rows(none):
    assert near_duplicates(none).collect() == []


def test_words_and_case():
    assert len(shingles("A b\tC\nd E f")) == 2
    assert (shingles("ONE two") == shingles("one  TWO")).all()
    assert len(shingles("É é é é é é")) == 2  # only A-Z change case
    assert len(shingles(None)) == 0


def test_signature_estimate_counts_equal_symbols():
    x = np.zeros((1, 6), np.uint64)
    assert _equal_symbols(x, x)[0] == HASHES
    y = x.copy()
    y[0, 0], y[0, 3] = 5, 4
    assert _equal_symbols(x, y)[0] == HASHES - 2
    assert matches_needed(1.0) == HASHES


def test_a_percent_that_the_bands_do_not_serve_is_refused(documents):
    with pytest.raises(ValueError, match="at least 80"):
        near_duplicates(documents, percent=79)


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_recall_of_planted_pairs(spark, percent):
    """2000 pairs whose similarity lies at the threshold or just above it: every one is found."""
    rng = random.Random(percent)
    rows, wanted = [], set()
    for k in range(2000):
        n = rng.randint(60, 200)
        base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        copy, shingles = list(base), n - 4
        # words put in place of the last ones cost as many shingles as there are of them
        lost = max(x for x in range(shingles) if 100 * (shingles - x) >= percent * (shingles + x))
        copy[n - lost :] = [f"v{rng.randrange(10**9)}" for _ in range(lost)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        wanted.add(2 * k + 1)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=percent).where("not kept").collect()
    assert {r.doc_id for r in found} == wanted
