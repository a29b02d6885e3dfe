"""Every registered query against its SQL, as the driver compares them, on the smallest tables."""

import json
import os

import duckdb
import numpy as np
import pytest
from rowform import pls1

from latentspark.functions import kernels
from latentspark.operators import resample
from latentspark.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, sql, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), sql.execute(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(repr, df[columns].values.tolist())) for df in (got, want)]
    assert rows[0] == rows[1]


def plain_frame():
    t = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.array([r[1] for r in t], float)
    return np.array([r[0] for r in t]), x, 4 * (x[:, 1] + x[:, 2]) + 0.05 * (np.array([r[2] for r in t]) - 4.5)


def test_all_but_two_have_sql():
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"rotate", "rotation_stability"}


def test_rotate_equals_plain(spark):
    """No turn of two axes makes the rotated weights simpler, and they span what the plain fit's weights span."""
    got = queries.rotate(spark, SF).orderBy("feature").toPandas()[["w1", "w2", "w3"]].to_numpy()
    _, x, y = plain_frame()
    w = pls1(x, y, 3)[3]
    turn = w.T @ got
    np.testing.assert_allclose(turn @ turn.T, np.eye(3), atol=1e-5)
    np.testing.assert_allclose(w @ turn, got, atol=1e-5)
    simple = lambda a: ((a / np.linalg.norm(a, axis=1, keepdims=True)) ** 2).var(axis=0).sum()
    for i, j in ((0, 1), (0, 2), (1, 2)):
        for angle in np.linspace(-np.pi / 4, np.pi / 4, 181):
            other = got.copy()
            other[:, [i, j]] = got[:, [i, j]] @ np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
            assert simple(other) <= simple(got) + 1e-5


def test_rotation_stability_equals_plain(spark):
    """The registered query against fits of every subsample over its rows."""
    ids, x, y = plain_frame()
    got = queries.rotation_stability(spark, SF).first()
    f = queries.embeddings(spark, SF)
    draws = resample.ranks(f.rows, queries.SEED, "stability", 1000).filter(f"rank < {got['m']}").toPandas()
    plain = pls1(x, y, 2)[3]
    turn = lambda w: w @ kernels.varimax(w)[0]
    rotated, sums = turn(plain), np.zeros(2)
    place = {v: i for i, v in enumerate(ids)}
    for _, rows in draws.groupby("b"):
        own = [place[i] for i in rows.row_id]
        w = pls1(x[own], y[own], 2)[3]
        near = turn(w @ kernels.procrustes(w, plain))
        sums += [((kernels.signed_permutation(a, to) - to) ** 2).sum() for a, to in ((w, plain), (near, rotated))]
    ratio = json.loads(got["variance_ratio"])
    assert ratio["point"] == pytest.approx(sums[1] / sums[0], rel=1e-6) and ratio["lower"] <= ratio["point"] <= ratio["upper"]
