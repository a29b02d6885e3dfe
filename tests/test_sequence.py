"""Components tested one after the other: from blocks of one pass, and from deflated rows."""

import numpy as np
import pytest
from test_pls import data, frame

import latentspark as ls
from latentspark.operators import selection


@pytest.mark.parametrize("weighted,keep", [(False, None), (True, None), (False, 3)])
def test_blocks_equal_deflated_rows(spark, monkeypatch, weighted, keep):
    x, y, w = data(90, 6, snr=2)
    y = y + 2 * x[:, 3] * np.random.default_rng(1).choice([0.9, 1.1], 90)
    if weighted:
        w[:20] = 0
    f = frame(spark, x, y, w if weighted else None)
    passes = []
    own = selection.pls1_confirmatory_test
    monkeypatch.setattr(selection, "pls1_confirmatory_test", lambda *a, **b: passes.append(1) or own(*a, **b))
    run = lambda: ls.pls1_find_k_sequence(f, 4, alpha=0.5, args={"n_splits": 8, "force": True}, seed=3, keep=keep)
    blocks = run()
    assert not passes
    monkeypatch.setattr(selection, "sequence_of_blocks", lambda *a: None)
    rows = run()
    assert passes and blocks.k_star == rows.k_star
    np.testing.assert_allclose(blocks.pvalues, rows.pvalues, atol=1e-9)


def test_columns_that_components_explain_go_over_rows(spark):
    """Two features and two components: nothing is left for the third, and rows say so."""
    x, y, _ = data(60, 2, snr=3)
    f = frame(spark, np.column_stack([x, x[:, 0] + x[:, 1]]), y)
    r = ls.pls1_find_k_sequence(f, 3, alpha=0.99, args={"n_splits": 4, "force": True}, seed=3)
    assert r.pvalues[0] < 0.05 and len(r.pvalues) == 3
