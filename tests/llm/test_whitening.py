"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest

from roamgrid.llm import whitening

ROWS = "vec_id long, embedding array<float>, n long, component string"


def vectors(n=500, d=70, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, d)) * np.linspace(2, 0.2, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0] + 3


def frame(spark, vecs, more=()):
    return spark.createDataFrame([(i, [float(c) for c in np.float32(v)], 7, "q") for i, v in enumerate(vecs)] + [(i, v, None, None) for i, v in more], ROWS).repartition(3)


def expected(vecs, k=32):
    x = np.floor(64 * np.float32(vecs).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (np.square(n * x - s)).sum(1), centred @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def check(rows, vecs, k=32):
    deviation, white, explained = expected(vecs, k)
    assert len(rows) == len(vecs) * k
    got = {(r["vec_id"], r["component"]): r for r in rows}
    table = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i in range(len(vecs))])
    sign = np.sign((table * white).sum(0))
    assert np.abs(table - white * sign).max() < 1e-7
    assert [got[i, 1]["deviation"] for i in range(len(vecs))] == deviation.tolist() and {r["n"] for r in rows} == {len(vecs)}
    assert np.allclose([got[0, c + 1]["explained"] for c in range(k)], explained, rtol=1e-9)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_equals_numpy(spark):
    vecs = vectors()
    bad = [(900, None), (901, []), (902, [None, *vecs[0][1:].tolist()]), (903, [float("nan"), *vecs[0][1:].tolist()]), (904, [float("inf"), *vecs[0][1:].tolist()]), (905, [1.0])]
    check(whitening.whiten(frame(spark, vecs, bad)).collect(), vecs)


def test_registered_query(spark, tmp_path):
    vecs = vectors(200, 40, 4)
    frame(spark, vecs).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(whitening.query(spark, str(tmp_path)).collect(), vecs)


def test_close_eigenvalues(spark):
    """A flat spectrum, where filters have little to tell components by."""
    vecs = np.random.default_rng(2).standard_normal((3000, 90))
    check(whitening.whiten(frame(spark, vecs)).collect(), vecs)


@pytest.mark.parametrize("d", [1, 5])
def test_few_dimensions(spark, d):
    vecs = vectors(60, d, 3)
    check(whitening.whiten(frame(spark, vecs)).collect(), vecs, d)


def test_flat_directions(spark):
    """Directions without any spread have no component; repeated and null ids stay rows of their own."""
    vecs = vectors(50, 10, 6)
    vecs[:, 4] = 1.5
    vecs[:, 5] = vecs[:, 6]
    df = spark.createDataFrame([(None if i < 3 else i // 2, [float(c) for c in v]) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df).collect()
    assert len(rows) == 50 * 8 and sum(r["vec_id"] is None for r in rows) == 3 * 8
    assert rows[0]["identity_error"] < 1e-6


def test_without_spread(spark):
    one = frame(spark, np.ones((4, 6)))
    assert whitening.whiten(one).collect() == []
    empty = whitening.whiten(one.filter("false"))
    assert empty.collect() == [] and empty.columns == whitening.whiten(one).columns


def test_large_entries(spark):
    df = spark.createDataFrame([(1, [1e30, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(df)
    wide = np.array([[2**33 + 0.5, 1.0], [-(2**33), 5.0], [7.0, 2.0]])
    rows = whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "vec_id long, embedding array<double>")).collect
    with pytest.raises(Exception):  # the exact deviation needs more than 64 bits
        rows()
