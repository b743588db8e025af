"""Hard negatives against brute force: ties, repeated ids, lengths, odd rows, negative scores; bounds of summaries."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from comarca.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, dim int, block string, ids binary, score int, rank int"


def _plain(rows, positives, negatives, least=30, greatest=90):
    """Scores of all pairs of distinct rows that take part, in plain integers."""
    kept = set()
    for name, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.add((name, tuple(math.floor(256 * x) for x in vector), label))
    last = lambda i: (i is None, i or 0)
    found = []
    for anchor in kept:
        if anchor[0] is None or anchor[0] % 3:
            continue
        scored = [(sum(x * y for x, y in zip(anchor[1], r[1], strict=True)), r) for r in kept if r != anchor and len(r[1]) == len(anchor[1])]
        scored.sort(key=lambda s: (-s[0], last(s[1][0])))
        for positive, p in [s for s in scored if s[1][2] == anchor[2]][:positives]:
            fits = [(s, r) for s, r in scored if r[2] != anchor[2] and least * positive <= 100 * s <= greatest * positive]
            found += [(anchor[0], p[0], k + 1, r[0], positive, s) for k, (s, r) in enumerate(fits[:negatives])]
    return sorted(found, key=lambda r: [last(x) for x in r])


def _found(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, 1, "b", b"i", 3, 4) for r in rows], SCHEMA)
    found = hard_negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 3 == 0, positives=3, negatives=4, **sizes)
    return sorted((tuple(r) for r in found.collect()), key=lambda r: [(x is None, x or 0) for x in r])


@pytest.mark.parametrize("spread", [1, 30])
def test_equal_to_brute_force_over_blocks(spark, spread):
    draw = random.Random(spread)
    centres = [[draw.gauss(0, 1) for _ in range(20)] for _ in range(4)]
    rows = []
    for i in range(260):
        vector = [round(spread * c + draw.gauss(0, 1), 1) / 4 for c in centres[i % 4]]
        rows.append((i, vector, draw.randrange(3)))
    rows += [(300 + i, rows[i % 7][1], rows[i % 5][2]) for i in range(40)]  # copies: ties
    expected = _plain(rows, 3, 4)
    assert len(expected) > 500
    assert _found(spark, rows, block_rows=50, group_rows=20) == expected
    assert _found(spark, rows) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 1.0], 1), (0, [0.5, 1.0], 2), (3, [1.0, -1.0], 1), (3, None, 1), (6, [1.0, 0.2], None),
            (9, [nan, 1.0], 1), (12, [inf, 1.0], 1), (15, [None, 1.0], 1), (18, [], 1), (21, [], 2), (24, [], 1), (27, [1.0], 1), (30, [0.5], 2), (33, [0.9], 1),
            (None, [0.6, 0.6], 2), (None, [0.6, 0.6], 2), (None, [0.9, 0.9], 1), (36, [0.0, 0.0], 1), (1, [0.4, 0.4], 3), (2, [0.4, 0.4], 3), (39, [-1.0, -1.0], 1)]
    expected = _plain(rows, 3, 4)
    assert any(None in r for r in expected) and any(r[4] == 0 for r in expected)
    assert _found(spark, rows, block_rows=4, group_rows=3) == expected
    assert _found(spark, []) == [] and _found(spark, rows[5:6]) == []
    with pytest.raises(Exception, match="component too large"):
        _found(spark, [(0, [1e6, 1.0], 1)])


def test_bounds_hold_and_close_in():
    draw = np.random.default_rng(0)
    for dim in (1, 3, 4, 5, 16, 64, 70):
        rows = np.floor(256 * draw.normal(size=(40, dim)))
        exact = rows @ rows.T
        widths = []
        for level in hard_negatives.summarised(rows):
            half = level.shape[1] // 2
            middle, spread = level[:, :half] @ level[:, :half].T, level[:, half:] @ level[:, half:].T
            assert (middle - spread <= exact + 1e-6 * np.abs(exact) + 1e-6).all() and (exact <= middle + spread + 1e-6 * np.abs(exact) + 1e-6).all()
            widths.append(spread.mean())
        assert widths == sorted(widths, reverse=True)


def test_summaries_spare_exact_scores(monkeypatch):
    """Of rows in clear clusters most are dropped by bounds alone."""
    draw = np.random.default_rng(0)
    centres = np.repeat(draw.normal(size=(40, 16)) * 200, 4, axis=1)
    rows = np.floor(centres[draw.integers(0, 40, 4000)] + draw.normal(size=(4000, 64)) * 5)
    levels = [x.tobytes() for x in hard_negatives.summarised(rows)]
    block = hard_negatives.Block(64, np.arange(4000).tobytes(), np.zeros(4000, "<i8").tobytes(), rows.astype("<i4").tobytes(), levels)
    scored = []
    block.vectors = _Counting(block.vectors, scored)
    ((places, scores),) = block.best(block_of(rows, levels), 0, np.arange(4000), [(-np.inf, np.inf)], 5)
    exact = rows @ rows[0]
    assert places.tolist() == np.lexsort((np.arange(4000), -exact))[:5].tolist() and scores.tolist() == np.sort(exact)[::-1][:5].tolist()
    assert sum(scored) < 800


def block_of(rows, levels):
    n = len(rows)
    return hard_negatives.Block(64, np.arange(n).tobytes(), np.zeros(n, "<i8").tobytes(), rows.astype("<i4").tobytes(), levels)


class _Counting:
    def __init__(self, rows, scored):
        self.rows, self.scored = rows, scored

    def __getitem__(self, places):
        self.scored.append(len(places))
        return self.rows[places]
