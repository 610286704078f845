"""Hard negatives against all pairs, and what the bounds leave out."""

import math
import random

import numpy as np
import pytest
from conftest_llm import by_row
from pyspark.sql import functions as F

from canvass.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """Triples over all pairs, in Python whole numbers."""
    ok = []
    for i, (vec, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec is not None and vec % 7 == 0:
            label = (label + 1) % 10
        ok.append((i, vec, [math.floor(256 * float(np.float32(x))) for x in v], label))
    last = 1 << 63
    out = []
    for i, vec, v, label in ok:
        if vec is None or vec % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), last if o is None else o, j, other)
                        for j, o, w, other in ok if j != i)
        for s, pos, _, _ in [r for r in scored if r[3] == label][:5]:
            window = [r for r in scored if r[3] != label and -30 * s <= -100 * r[0] <= -90 * s][:10]
            out += [(vec, None if pos == last else pos, k + 1, None if r[1] == last else r[1], -s, -r[0])
                    for k, r in enumerate(window)]
    return sorted(map(repr, out))


def run(frame, **kw):
    every = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hn.hard_negatives(frame, F.col("vec_id") % 100 == 0, every, **kw)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(600):
        v = [rng.gauss(0.1, 1) for _ in range(rng.choice([7, 20, 20, 20]))]
        out.append((i, v, rng.choice([1, 1, 1, 2, 3])))
    out += [out[100], out[100], out[200], out[5], out[5]]  # repeated rows, anchors among them
    out += [(None, out[7][1], 1), (None, out[300][1], 2), (700, None, 1), (701, [1.0, None], 1), (800, [1.0], None),
            (702, [float("nan")] * 20, 2), (900, [float("inf")] * 20, 2), (1000, [], 1), (1100, [0.0] * 20, 2),
            (1200, [-0.001] * 20, 3), (-100, [0.5] * 20, 1), (None, None, None)]
    out += [(2000 + i, [0.25] * 20, 1 + i % 3) for i in range(60)]  # ties
    return out


@pytest.mark.parametrize("passes", [16_384, 3])
def test_triples_match_all_pairs(spark, rows, passes):
    assert by_row(run(spark.createDataFrame(rows, SCHEMA), anchors_a_pass=passes)) == plain(rows)


def test_given_tables_match_all_pairs(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = [tuple(r) for r in frame.select("vec_id", "embedding", "label").collect()]
    assert by_row(run(frame)) == plain(got)


def test_no_rows_no_anchors_and_clashing_names(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert run(frame.where("false")).count() == 0 and run(frame.where("vec_id % 100 != 0")).count() == 0
    more = frame.select("*", *[F.lit(1).alias(c) for c in "score rank anchor place id v _row anchor_id row_ x".split()])
    assert by_row(run(more)) == plain(rows)


def anchor(q):
    return hn.Anchors(np.array([-1]), np.array([0]), np.array([q], np.int64), [[]])


def test_large_components_stay_exact():
    q, x = [1 << 26] * 64, np.full((64, 3), (1 << 26) - 1, np.int64)
    block = hn.Block(np.arange(3), np.arange(3), np.zeros(3, np.int64), x, anchor(q))
    at, score = block.scan(0, np.ones(3, bool), lambda low, high: np.ones(len(low), bool))
    assert score.tolist() == [64 * (1 << 26) * ((1 << 26) - 1)] * 3


def test_bounds_shrink_the_bitmap():
    """Vectors far from an anchor leave after its largest components are read, and bounds always hold."""
    rng = np.random.default_rng(1)
    q = np.sort(rng.integers(1, 200, 64))[::-1] ** 2 // 200
    x = rng.integers(-20, 20, (64, 2000))
    x[:16, :50] += 100
    block = hn.Block(np.arange(2000), np.arange(2000), np.zeros(2000, np.int64), x, anchor(q.tolist()))
    seen = []

    def shrink(low, high):
        seen.append(len(low))
        exact = q @ x[:, :]
        assert low.min() <= exact.max() and high.max() >= exact.max()
        return high >= hn._kth(low, 5)

    at, score = block.scan(0, np.ones(2000, bool), shrink)
    assert set(np.argsort(-(q @ x))[:5]) <= set(at) and seen[0] == 2000 and len(at) <= 60
    assert score.tolist() == (q @ x)[at].tolist()
