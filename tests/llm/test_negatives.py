import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tollbook.llm import negatives as n


def brute(rows, positives=5, negatives=3, low=50, high=95, every=50):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, label, v) in enumerate(good):
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, b, own) for b, (i, own, w) in enumerate(good) if b != a and len(w) == len(v))
        for p, i, _, _ in [s for s in scored if s[3] == label][:positives]:
            hard = [s for s in scored if s[3] != label and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(anchor, i, rank, s[1], -p, -s[0]) for rank, s in enumerate(hard, 1)]
    return sorted(out)


def sample(seed, size=12, count=400, kind="clusters"):
    r = np.random.default_rng(seed)
    base = r.normal(size=(6, size))
    rows = []
    for i in range(count):
        v = base[r.integers(6)] + r.normal(size=size) * r.choice([0, 0.3, 0.8]) if kind == "clusters" else r.integers(-2, 3, size=size) / 256  # whole codes: many ties
        rows.append((int(i), int(r.integers(5)) if i % 9 else 3, [float(x) for x in v]))
    return rows


ODD = [(1000, None, [1.0] * 12), (1050, 3, None), (1100, 3, [None] + [1.0] * 11), (1150, 3, [float("nan")] * 12), (1200, 3, [float("inf")] + [0.0] * 11), (None, 3, [1.0] * 12),
       (1250, 3, []), (1251, 3, []), (1252, 4, []), (1300, 3, [0.0] * 12), (1350, 3, [1.0, 2.0]), (1351, 4, [1.0, 1.0]), (1352, 3, [2.0, 2.0]), (1400, 77, [0.5] * 12), (1450, 3, [-1e-9] * 12)]


@pytest.mark.parametrize("kind, block, tile", [("clusters", 2048, 16384), ("clusters", 50, 100), ("ties", 64, 1000), ("ties", 7, 90)])
def test_like_all_pairs(spark, monkeypatch, kind, block, tile):
    monkeypatch.setattr(n, "BLOCK", block)
    monkeypatch.setattr(n, "TILE", tile)
    rows = sample(block, kind=kind) + ODD
    rows += [rows[0], rows[50], rows[50], rows[7]]  # repeated rows, anchors among them
    table = spark.createDataFrame([(i, v, label, "x", 1) for i, label, v in rows], "vec_id long, embedding array<double>, label int, row_no string, place int")
    got = sorted(tuple(r) for r in n.hard_negatives(table, F.expr("id % 50 = 0")).collect())
    assert got == brute(rows) and len(got) > 50


def test_other_numbers(spark):
    rows = sample(3)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in n.hard_negatives(table, F.expr("id % 40 = 0"), positives=2, negatives=4, low=33, high=71).collect())
    assert got == brute(rows, 2, 4, 33, 71, 40)


def test_bounds_leave_the_best(spark):
    r = np.random.default_rng(5)
    columns = r.integers(-100, 100, size=(20, 300)).astype(float)
    looked = []
    for _ in range(20):
        anchor = r.integers(-100, 100, size=20).astype(float)
        true = (anchor @ columns).astype(int)
        keep = n.best_of(4)
        left, scores = n.scan(anchor, columns, columns.min(axis=1), columns.max(axis=1), np.ones(300, bool), lambda low, high: looked.append(len(low)) or keep(low, high))
        assert (scores == true[left]).all() and set(np.argsort(-true, kind="stable")[:4]) <= set(left)
        left, scores = n.scan(anchor, columns, columns.min(axis=1), columns.max(axis=1), np.ones(300, bool), n.inside([(0, 900), (2000, 2500)], 10**6))
        assert (scores == true[left]).all() and set(np.flatnonzero((true >= 0) & (true <= 900) | (true >= 2000) & (true <= 2500))) == set(left)
    assert min(looked) < 60  # candidates went before all dimensions were read


def test_large_components_stay_exact(spark):
    rows = [(0, 1, [1e300, 1.0]), (1, 1, [1e5, 3.0]), (2, 2, [6e4, 1.0]), (3, 2, [7e4, -1.0])]
    got = n.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.expr("id % 50 = 0")).collect()
    a = [n.LARGEST, 256]
    assert [(r.negative_id, r.negative_score) for r in got] == [(3, a[0] * 17920000 - 256 * 256), (2, a[0] * 15360000 + 256 * 256)]


def test_registered_query_like_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(duckdb.sql(n.OP11_SQL).fetchall())
    assert sorted(tuple(r) for r in n.op11_hard_negatives(spark, sf).collect()) == want and want


def test_empty_table(spark):
    assert n.hard_negatives(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), F.expr("id % 50 = 0")).count() == 0
