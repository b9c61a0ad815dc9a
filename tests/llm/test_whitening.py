import math
from fractions import Fraction

import numpy as np
import pytest

from tollbook.llm import whitening as w


def plain(rows):
    """Vectors that take part, with deviations and covariance of whole numbers worked out exactly."""
    good = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    n, total = len(good), [sum(v[k] for _, v in good) for k in range(len(good[0][1]))]
    away = [[n * x - s for x, s in zip(v, total)] for _, v in good]
    centred = np.array([[float(Fraction(d, n)) for d in v] for v in away])
    return good, n, [sum(d * d for d in v) for v in away], centred, centred.T @ centred / n


def sample(seed=1, n=300, d=10):
    r = np.random.default_rng(seed)
    turn = np.linalg.qr(r.normal(size=(d, d)))[0]
    return [(int(i), [float(x) for x in (r.normal(size=d) * np.arange(1, d + 1)) @ turn + 3]) for i in range(n)]


@pytest.mark.parametrize("block_bytes, components", [(2 * 1024 * 1024, 32), (1000, 4), (80, 10)])
def test_like_plain_arithmetic(spark, monkeypatch, block_bytes, components):
    monkeypatch.setattr(w, "BLOCK_BYTES", block_bytes)
    rows = sample() + [(900, None), (901, []), (902, [None] + [1.0] * 9), (903, [float("nan")] * 10), (904, [float("-inf")] + [0.0] * 9), (905, [1.0, 2.0]), (None, [1.0] * 10), (0, sample()[0][1])]
    table = spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, codes string, component double, row int").repartition(5)
    good, n, deviation, centred, covariance = plain([(i, v) for i, v in rows if v is None or len(v) in (0, 10)])
    values, directions = np.linalg.eigh(covariance)
    got = w.whiten(table, components).collect()
    assert len(got) == n * min(components, 10) and {(r.vec_id, r.n, r.deviation) for r in got} == {(i, n, d) for (i, _), d in zip(good, deviation)}
    assert all(r.identity_error < 1e-9 for r in got) and len({r.identity_error for r in got}) == 1
    for c in range(1, min(components, 10) + 1):
        own = {r.vec_id: r for r in got if r.component == c}
        want = centred @ directions[:, -c] / np.sqrt(values[-c])
        sign = np.sign(want[0] * own[good[0][0]].whitened)
        for (i, _), x in zip(good, want):
            assert own[i].whitened == pytest.approx(sign * x, abs=1e-9)
            assert own[i].explained == pytest.approx(values[-c] / np.trace(covariance), rel=1e-9)


def test_dimensions_that_do_not_vary(spark):
    rows = [(i, [5.0, float(i % 7), 5.0]) for i in range(40)]
    got = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 120
    for r in got:
        assert (r.whitened is None) == (r.component > 1) and r.explained == pytest.approx(float(r.component == 1)) and r.identity_error < 1e-12
    one = w.whiten(spark.createDataFrame(rows[:1] * 2, "vec_id long, embedding array<float>")).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(2, 0, None, 0.0, None)} and len(one) == 6


def test_large_numbers_use_decimals(spark):
    rows = [(i, [x * 1e6 for x in v]) for i, v in sample(4, 60, 4)] + [(99, [1e300, 0.0, 0.0, 0.0])]
    got = {(r.vec_id, r.deviation) for r in w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    held = [(i, [min(x, 2.0**47) for x in v]) for i, v in rows]
    good, _, deviation, _, _ = plain(held)
    assert got == {(i, d if d < 1 << 63 else None) for (i, _), d in zip(good, deviation)}
    fine = {(r.vec_id, r.deviation) for r in w.whiten(spark.createDataFrame(rows[:60], "vec_id long, embedding array<double>")).collect()}
    good, _, deviation, _, _ = plain(rows[:60])
    assert fine == {(i, d if d < 1 << 63 else None) for (i, _), d in zip(good, deviation)}


def test_equal_lengths_go_to_the_longest(spark):
    rows = [(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [5.0, 1.0])]
    assert {r.vec_id for r in w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()} == {3, 4}


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    good, n, deviation, _, _ = plain(rows)
    got = w.op13_whitening(spark, sf).collect()
    assert len(got) == 32 * n and {(r.vec_id, r.deviation) for r in got} == {(i, d) for (i, _), d in zip(good, deviation)} and got[0].identity_error < 1e-4


def test_empty_table(spark):
    none = w.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
