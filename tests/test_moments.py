"""Blocks of many sets: ranges of labels, levels of merging, packing."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pls import data, frame

from latentspark.operators import moments, resample, rowwise
from latentspark.operators.moments import Moments


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("held,fan_in", [(1 << 28, 64), (900, 2), (1, 3)])
def test_ranges_and_levels_give_the_same_blocks(spark, monkeypatch, weighted, held, fan_in):
    monkeypatch.setattr(moments, "HELD", held)
    monkeypatch.setattr(rowwise, "FAN_IN", fan_in)
    x, y, w = data(60, 4)
    f = frame(spark, x, y, w if weighted else None, parts=9)
    sets = F.filter(F.array(*[F.when(F.pmod(F.col("row_id"), F.lit(m)) == 0, F.lit(m)) for m in range(1, 7)]), lambda s: s.isNotNull())
    centre = np.arange(5.0)
    got = moments.collected(moments.set_blocks(f, sets, centre, 7), f)
    assert set(got) == set(range(1, 7))
    for m, block in got.items():
        own = np.arange(60) % m == 0
        want = Moments.of(x[own] - centre[:4], y[own, None] - centre[4:], w[own] if weighted else None)
        np.testing.assert_allclose(block.flat(), want.flat(), rtol=1e-11, atol=1e-9)


@pytest.mark.parametrize("weighted", [False, True])
def test_blocks_are_packed(weighted):
    rng = np.random.default_rng(0)
    m = Moments.of(rng.normal(size=(9, 5)), rng.normal(size=(9, 3)), rng.uniform(1, 2, 9) if weighted else None)
    flat = m.flat(weighted)
    assert len(flat) == Moments.size(5, 3, weighted) and len(flat) == (4 + 3 * 5 + 3 * 3 + 2 * 15 + 2 * 15 + 2 * 3 + 16 if weighted else 4 + 5 + 3 + 15 + 15 + 3 + 16)
    back = Moments.unflat(flat, 5, 3, weighted)
    np.testing.assert_allclose(back.flat(), m.flat(), rtol=1e-13)
    np.testing.assert_array_equal(back.xxw, back.xxw.T)


def test_tasks_are_some_for_each_core(spark):
    x, y, _ = data(60, 3)
    f = frame(spark, x, y, parts=200)
    width = rowwise.width(spark)
    assert rowwise.few(f.rows).select(F.spark_partition_id().alias("p")).distinct().count() <= width < 200
    np.testing.assert_allclose(rowwise.row_sums(f, 3, lambda x, y, w: x.sum(0)), x.sum(0))


def test_pairs_lie_together(spark, monkeypatch):
    from latentspark.operators.inference import pair_blocks, per_pair

    monkeypatch.setattr(moments, "HELD", 2000)
    x, y, _ = data(50, 3)
    f = frame(spark, x, y, parts=5)
    blocks = pair_blocks(f, resample.halves(f.rows, 3, "split", 9, 25), np.zeros(4), 9)
    got = per_pair(blocks, f, lambda b, inside, rest: [(b, inside.rows, rest.rows)], "b int, n_in int, n_out int").orderBy("b").collect()
    assert [tuple(r) for r in got] == [(b, 25, 25) for b in range(9)]


@pytest.mark.parametrize("weighted", [False, True])
def test_few_columns_are_summed_without_python(spark, monkeypatch, weighted):
    x, y, w = data(50, 4)
    f = frame(spark, x, y, w if weighted else None)
    centre = np.arange(5.0)
    got = moments.total(f, centre)
    monkeypatch.setattr(moments, "PLAIN", 0)
    np.testing.assert_allclose(got.flat(), moments.total(f, centre).flat(), rtol=1e-12)
