"""Near vectors against brute force: clusters, chains, odd rows, and trees of several levels."""

import numpy as np
import pytest

from tunelake.llm import embedding_dedup
from tunelake.llm.cover_tree import CoverTree, Pairs, traverse


def brute(rows, cosine):
    """n_links and component of each row (vec_id, label, vector), by all pairs."""
    n = len(rows)
    usable = [r[1] is not None and r[2] is not None and len(r[2]) > 0 and all(x is not None and np.isfinite(x) for x in r[2])
              and any(r[2]) for r in rows]
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = np.array(rows[i][2], float), np.array(rows[j][2], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                    links[i].add(j), links[j].add(i)
    out = []
    for i in range(n):
        seen, open_ = {i}, [i]
        while open_:
            open_ = [k for j in open_ for k in links[j] if k not in seen and not seen.add(k)]
        out.append((rows[i][0], len(links[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def clouds(seed, size=6):
    """Random directions, a chain, tight and loose clusters and equal rows, in two labels."""
    draw = np.random.default_rng(seed)
    rows = []
    for label in (1, 2):
        for spread, n in ((0.0, 4), (0.02, 25), (0.12, 40), (0.2, 40), (3.0, 30)):
            middle = draw.normal(size=size)
            rows += [(label, (middle + spread * draw.normal(size=size)).tolist()) for _ in range(n)]
        rows += [(label, [float(np.cos(x)), float(np.sin(x))] + [0.0] * (size - 2)) for x in np.linspace(0, 3, 12)]
    order = draw.permutation(len(rows))
    return [(int(k), *rows[i]) for k, i in enumerate(order)]


def result(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = embedding_dedup.near_vectors(df, **settings).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in found)


def test_one_cell(spark):
    rows = clouds(1)
    assert result(spark, rows) == brute(rows, embedding_dedup.COSINE)


@pytest.mark.parametrize("seed", [2])
def test_tree_of_several_levels(spark, seed):
    rows = clouds(seed)
    assert result(spark, rows, cell=16) == brute(rows, embedding_dedup.COSINE)


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, 1, one), (2, 1, [2.0, 4.0, 6.0]), (3, None, one), (4, 1, None), (5, 1, []), (6, 1, [0.0, 0.0, 0.0]),
            (7, 1, [1.0, None, 3.0]), (8, 1, [1.0, float("nan"), 3.0]), (9, 1, [1.0, float("inf"), 3.0]),
            (10, 2, one), (11, 1, [1e300, 2e300, 3e300]), (12, 1, [1e-310, 2e-310, 3e-310]), (13, 1, [1.0, 2.0]),
            (14, 1, one), (15, 1, [-1.0, -2.0, -3.0])]
    assert result(spark, rows) == brute(rows, embedding_dedup.COSINE)


def test_many_points_in_one_place(spark):
    """Parallel vectors that rounding sets a little apart, more than a cell."""
    base = np.random.default_rng(5).normal(size=5)
    rows = [(i, 1, (base * (3 * i + 1) + 1e-12 * i).tolist()) for i in range(60)]
    assert result(spark, rows, cell=16) == brute(rows, embedding_dedup.COSINE)


def test_empty_table_repeated_and_null_keys(spark):
    schema = "vec_id long, label string, embedding array<float>, n_links string, node int"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(4, "a/1", [1.0, 0.0], "x", 1), (4, "a/1", [1.0, 0.01], "x", 1), (None, "a/1", [1.0, 0.02], "y", 2),
            (None, "b", [1.0, 0.0], "y", 2)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id is None, r.n_links, r.component_id or 0, r.kept) for r in found) == [
        (False, 2, 4, True), (False, 2, 4, True), (True, 0, 0, True), (True, 2, 4, False)]


@pytest.mark.parametrize("size", [2, 8, 64])
def test_traversal_counts_every_pair_once(size):
    draw = np.random.default_rng(size)
    middles = draw.normal(size=(20, size))
    points = np.concatenate([m + s * draw.normal(size=(30, size)) / np.sqrt(size) for m, s in zip(
        middles, np.geomspace(1e-3, 3, 20), strict=True)])
    points /= np.linalg.norm(points, axis=1)[:, None]
    weights = draw.integers(1, 4, len(points))
    hit = points @ points.T >= 0.93
    np.fill_diagonal(hit, False)
    own = Pairs(weights)
    tree = CoverTree(points)
    traverse(tree, tree, own, 0.93)
    assert (own.found == hit @ weights).all()
    both = Pairs(weights)
    left, right = CoverTree(points[:300]), CoverTree(points[300:])
    for x, y, shift in ((left, left, 0), (left, right, 300)):
        traverse(x, y, both, 0.93, shift)
    part = Pairs(weights[300:])
    traverse(right, right, part, 0.93)
    both.found[300:] += part.found
    assert (both.found == hit @ weights).all()
