import math

import numpy as np
import pytest

from ratebook.llm import negatives

KIND = "vec_id long, embedding array<double>, label int, score double, row int, v string"


def brute(rows):
    """Scores of all pairs of rows in whole numbers."""
    e = []
    for k, (vec_id, x, label, *_) in enumerate(rows):
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        e.append((k, vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    out = []
    for k, a, label, v in e:
        if a % 50:
            continue
        s = sorted((-sum(p * q for p, q in zip(v, w)), i, m == label) for j, i, m, w in e if j != k)
        for p, i, _ in [x for x in s if x[2]][:5]:
            good = [(-n, j) for n, j, same in s if not same and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, i, r, j, -p, n) for r, (n, j) in enumerate(good, 1)]
    return sorted(out)


def rows(seed, n=700, d=6, labels=4, shift=0.4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 0.3 + shift
    return [(int(k), x[k].tolist(), int(rng.integers(labels)), 0.5, 3, "x") for k in rng.permutation(n)]


@pytest.mark.parametrize(("seed", "shift", "size"), [(1, 0.4, 100), (2, 0.0, 64), (3, 0.9, 10_000)])
def test_equal_to_brute_force(spark, seed, shift, size):
    data = rows(seed, shift=shift)
    got = negatives.mine(spark.createDataFrame(data, KIND), rows=size, group=5)
    assert sorted(map(tuple, got.collect())) == brute(data) and got.count()


def test_ties_nulls_lengths_and_repeats(spark):
    data = [*rows(4, 300, 3), *rows(4, 300, 3), *[(50, [0.5, 0.5, 0.5], 1, 0.0, 0, "")] * 3, *[(k, [0.25, 0.25, 0.25], k % 3, 0.0, 0, "") for k in range(400, 440)],
            (None, [1.0], 1, 0.0, 0, ""), (51, None, 1, 0.0, 0, ""), (52, [None, 1.0], 1, 0.0, 0, ""), (53, [float("nan")], 1, 0.0, 0, ""), (54, [float("inf")], 1, 0.0, 0, ""),
            (55, [0.1] * 3, None, 0.0, 0, ""), (100, [], 2, 0.0, 0, ""), (150, [0.0] * 3, 2, 0.0, 0, ""), (200, [-3.0, 2.0], 2, 0.0, 0, ""), (56, [0.5, 0.5, 0.5, 0.5], 1, 0.0, 0, "")]
    got = negatives.mine(spark.createDataFrame(data, KIND), rows=90, group=3)
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_empty_tables(spark):
    assert negatives.mine(spark.createDataFrame([], KIND)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1, 0.0, 0, "")], KIND)).count() == 0


def test_lists_are_left_early_and_nothing_is_lost():
    """With few dimensions the threshold stops the reading; what it returns is what a full sort gives."""
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (20_000, 3))
    ids = rng.permutation(20_000)
    block, read = negatives.Block(ids, x), []
    scores = block.scores
    block.scores = lambda r, a: read.append(len(r)) or scores(r, a)
    for _ in range(20):
        a = rng.integers(-300, 300, 3)
        all_s = x @ a
        top = int(all_s.max())
        windows = np.array([[top * 8 // 10, top * 9 // 10], [top * 9 // 10, top]])
        for (low, high), (places, s) in zip(windows, block.best(a, windows, 3), strict=True):
            want = sorted((-int(v), int(i)) for v, i in zip(all_s, ids) if low <= v <= high)[:3]
            assert [(-int(v), int(i)) for v, i in zip(s, block.ids[places])] == want
    assert sum(read) < 20 * 10_000


def test_large_components_are_exact_or_an_error():
    x = np.array([[1 << 40, 1], [1 << 40, 2], [3, -(1 << 40)]])
    assert negatives.Block(np.arange(3), x).scores(np.arange(3), np.array([1 << 20, 1])).tolist() == [(1 << 60) + 1, (1 << 60) + 2, (3 << 20) - (1 << 40)]
    with pytest.raises(OverflowError):
        negatives.Block(np.arange(3), x).scores(np.arange(3), np.array([1 << 40, 1]))
