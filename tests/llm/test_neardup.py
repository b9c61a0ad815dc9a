import numpy as np
import pytest

from tollbook.llm import neardup as n


def brute(vectors, cosine):
    unit = {i: n.unit(v) for i, (_, v) in enumerate(vectors)}
    parent = list(range(len(vectors)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(vectors)
    for i, a in unit.items():
        for j, b in unit.items():
            if i < j and a is not None and b is not None and len(a) == len(b) and vectors[i][0] is not None and vectors[j][0] is not None and (a @ b >= cosine or (a == b).all()):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, (key, _) in enumerate(vectors):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return sorted(((k, links[i], low.get(find(i)) if k is not None else None, k is not None and low[find(i)] == k) for i, (k, _) in enumerate(vectors)), key=str)


def sample(r, size=8):
    base = r.normal(size=(12, size))
    rows = [base[r.integers(12)] + r.normal(size=size) * r.choice([0, 1e-9, 0.05, 0.2, 0.4]) for _ in range(260)]
    rows += [rows[0]] * 60 + [rows[1] * 3.0] * 5
    return [(i, x.tolist()) for i, x in enumerate(rows)]


@pytest.mark.parametrize("cosine, block", [(0.95, 4096), (0.95, 20), (0.8, 40)])
def test_like_all_pairs(spark, monkeypatch, cosine, block):
    monkeypatch.setattr(n, "BLOCK", block)
    monkeypatch.setattr(n, "SAMPLE", 9)
    rows = sample(np.random.default_rng(block)) + [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [1.0, 0.0]), (906, [2.0, 0.01]), (None, [1.0, 0.0]), (907, [float("inf")] * 8), (908, [1e308] * 8), (909, [1e-308] * 8)]
    rows += [(0, rows[0][1])]  # a repeated row
    table = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, node string, kept int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in n.near_duplicates(table, cosine).collect()), key=str)
    assert got == brute(rows, cosine)


def test_tree_covers_its_points():
    points = np.stack([n.unit(v) for _, v in sample(np.random.default_rng(2)) if v])
    tree, order = n.Tree.build(points)
    assert (points[order] == tree.points).all()
    for i in range(len(tree.start)):
        own = tree.points[tree.start[i]: tree.end[i]]
        assert np.sqrt(np.maximum(0, 2 - 2 * own @ own[0])).max() <= tree.radius[i] + n.SAFE
        if tree.children[i]:
            below = tree.below(i)
            assert tree.start[below[0]] == tree.start[i] and tree.end[below[-1]] == tree.end[i]


def test_empty_table(spark):
    assert n.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_one_large_ball_is_settled_without_moving_vectors(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 50)
    r = np.random.default_rng(1)
    centre = r.normal(size=16)
    rows = [(i, (centre + r.normal(size=16) * 1e-3).tolist()) for i in range(600)] + [(1000 + i, r.normal(size=16).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    moved = []
    staged = n.staged

    def counted(df, label):
        out = staged(df, label)
        moved.extend([out.count()] if label == "block-pairs" else [])
        return out

    monkeypatch.setattr(n, "staged", counted)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in n.near_duplicates(table, 0.95).collect()), key=str)
    assert got == brute(rows, 0.95) and moved[-1] < 200  # pairs of blocks; the ball alone would make as many


def test_a_very_long_vector(spark):
    v = np.random.default_rng(2).normal(size=20_000)
    rows = [(1, v.tolist()), (2, (v + 0.01).tolist()), (3, (-v).tolist())]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in n.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def exchanged(spark):
    """Bytes that tasks have written for exchanges so far."""
    found = spark._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_vectors_are_exchanged_once_however_many_pairs_of_blocks_are_left(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 50)
    monkeypatch.setattr(n, "SAMPLE", 9)
    r = np.random.default_rng(5)
    points = r.normal(size=(4000, 64))
    points[700:800] = points[:100] + r.normal(size=(100, 64)) * 0.1
    rows = [(i, x.tolist()) for i, x in enumerate(points)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = exchanged(spark)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in n.near_duplicates(table, 0.95).collect()), key=str)
    assert exchanged(spark) - before < 2 * points.nbytes
    units = np.stack([n.unit(x) for x in points])
    near = units @ units.T >= 0.95
    assert [x[1] for x in sorted(got)] == (near.sum(axis=1) - 1).tolist() and sum(x[3] for x in got) == 3900


@pytest.mark.parametrize("size", [64, 500])
def test_bounds_along_a_basis_lose_nothing(size):
    r = np.random.default_rng(size)
    points = n.scaled(np.concatenate([r.normal(size=(1800, size)), *[r.normal(size=size) + r.normal(size=(150, size)) * s for s in (1e-9, 0.01, 0.2, 0.24, 0.3)]]).astype(np.float32))
    points = points[r.permutation(len(points))]
    weights, basis = r.integers(1, 5, len(points)), np.linalg.qr(r.normal(size=(size, n.BASIS)))[0]
    near = points @ points.T >= 0.95
    np.fill_diagonal(near, False)
    for used in (None, basis):
        tree, order = n.Tree.build(points)
        links = n.traverse(tree, None, weights[order], 0.95, used)
        assert (links.count == (near @ weights)[order]).all()
        (a, first), (b, second) = n.Tree.build(points[:1300]), n.Tree.build(points[1300:])
        links = n.traverse(a, b, np.concatenate([weights[:1300][first], weights[1300:][second]]), 0.95, used)
        assert (links.count == np.concatenate([(near[:1300, 1300:] @ weights[1300:])[first], (near[1300:, :1300] @ weights[:1300])[second]])).all()


def test_few_pairs_of_blocks_are_joined(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 40)
    monkeypatch.setattr(n, "HEADS", 0)  # centres of many blocks are not broadcast
    r = np.random.default_rng(8)
    rows = [np.eye(16)[k // 2] * (-1) ** k + r.normal(size=16) * 0.07 for k in range(24) for _ in range(30)] + [np.eye(16)[15] + r.normal(size=16) * 0.07 for _ in range(70)]
    rows = [(i, x.tolist()) for i, x in enumerate(rows)]
    plans, few = [], n.few
    monkeypatch.setattr(n, "few", lambda df: plans.append(df.columns) or few(df))
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in n.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()), key=str)
    assert ["at", "at_2"] in plans and got == brute(rows, 0.95)
