import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import envspark.llm.negatives as M


def literal(rows, modulus, positives=5, negatives=3):
    def ok(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if ok(v, label)]
    rows = [r for r in rows if all(abs(x) < math.sqrt(2.0 ** 62 / max(len(r[1]), 1)) for x in r[1])]

    def first(k, scored):
        return sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
    out = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or i % modulus:
            continue
        score = [(sum(x * y for x, y in zip(v, w, strict=True)), j, other, n) for n, (j, w, other) in enumerate(rows) if len(w) == len(v) and n != k]
        for p, j, _, _ in first(positives, [s for s in score if s[2] == label]):
            fits = [s for s in score if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p]
            out += [(i, j, r, neg, p, s) for r, (s, neg, _, _) in enumerate(first(negatives, fits), 1)]
    return sorted(out, key=repr)


def mine(spark, rows, modulus, **kw):
    df = spark.createDataFrame([(i, v, label, "x", 0) for i, v, label in rows],
                               "vec_id long, embedding array<double>, label int, anchor string, row int")
    out = M.mine_negatives(df, F.col("vec_id") % modulus == 0, **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("dim,levels,few,step", [(24, 6, 20, 7), (64, 1, 1 << 20, 64), (70, 3, 50, 3)])
def test_against_brute_force(spark, monkeypatch, dim, levels, few, step):
    monkeypatch.setattr(M, "FEW_ROWS", few)
    monkeypatch.setattr(M, "STEP", step)
    rng = random.Random(dim)
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(220):
        v = [x + rng.gauss(0, 1.2) for x in centre[i % 4]]
        n = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / n for x in v], rng.choice([i % 4, i % 4, rng.randrange(5)])))
    rows += [(300, None, 1), (310, rows[0][1], None), (320, [float("nan")] * dim, 1), (330, [float("inf")] * dim, 1), (340, [None] * dim, 2),
             (350, [0.0] * dim, 1), (360, [], 1), (370, [], 1), (380, [0.5, 0.5], 1), (390, [0.5, 0.4], 1), (400, [0.5, 0.3], 2), (None, rows[5][1], 2),
             (None, rows[6][1], 2), (410, [1e300] * dim, 1), (10, rows[10][1], rows[10][2]), (10, rows[10][1], rows[10][2]), (15, rows[10][1], 9)]
    rng.shuffle(rows)
    want = literal(rows, 5)
    assert len(want) > 100
    assert mine(spark, rows, 5, levels=levels) == want


def test_ties_equal_rows_and_fewer_than_asked(spark):
    rows = [(i, [1.0, 0.0], 1) for i in range(8)] + [(100 + i, [0.9, 0.0], 2) for i in range(6)] + [(50, [0.1, 0.0], 3)]
    got = mine(spark, rows, 4)
    assert got == literal(rows, 4) and [r[3] for r in got if r[0] == 0][:3] == [100, 101, 102]
    assert mine(spark, [(0, [1.0], 1), (1, [1.0], 1)], 1) == []


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 8 * 16 * 12)        # a dozen vectors a block
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0.3, 1) for _ in range(16)], i % 3) for i in range(150)]
    assert mine(spark, rows, 2) == literal(rows, 2)


def test_intervals_hold_every_score():
    rng = np.random.default_rng(3)
    for dim in (5, 64, 130):
        v, q = rng.normal(size=(300, dim)) * 256, rng.normal(size=(20, dim)) * 256
        for levels in (1, 4):
            codes, align, coded, rest = M.encode_rows(v, levels)
            lower, upper = M.intervals(M.Queries(q), slice(0, 20), codes, align, coded, rest)
            score = q @ v.T
            assert (lower <= score).all() and (score <= upper).all()


def test_empty(spark):
    assert mine(spark, [], 5) == []
