"""Exact searches and density clusterings by cells, against plain computations."""

import numpy as np
import pytest
from acquira.operators import cells, clusters, density, neighbours
from pyspark.sql import functions as F

ROWS = "pos long, embedding array<double>, cluster string, q string, v int"


def frame(spark, x, keys=None):
    keys = range(len(x)) if keys is None else keys
    return spark.createDataFrame([(int(k), None if r is None else [float(c) for c in r], "?", "?", 0) for k, r in zip(keys, x)], ROWS)


def blobs(n, centres, d=8, seed=1, spread=0.15):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d)) * rng.uniform(0.3, 1.5, (n, 1))
    x[: n // 10] = rng.normal(size=(n // 10, d))  # noise
    return x


def unit(x):
    return x / np.sqrt((x * x).sum(1, keepdims=True))


# ---------------------------------------------------------------- k nearest


@pytest.mark.parametrize("k", [1, 7])
def test_nearest_equal_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(cells, "PART_ROWS", 16)
    monkeypatch.setattr(cells, "ASKERS", 50)
    x = blobs(400, 12)
    x[50:80] = x[50]  # copies, which tie
    keys = np.random.default_rng(2).permutation(1000)[:400]
    df = frame(spark, x, keys)
    got, found = cells.knn(df, df, k=k, id_col="pos")
    s = np.round(unit(x) @ unit(x).T, 9)
    for r in got.collect():
        row = s[np.flatnonzero(keys == r.pos)[0]]
        want = sorted(zip(-row, keys))[:k]
        assert [(round(n.far, 9), n.id) for n in r.near] == [(round(a, 9) + 0.0, b) for a, b in want]
    assert found.compared < 400 * 400 / 2  # clustered vectors: most cells are out of reach


def test_nearest_of_odd_rows(spark):
    df = frame(spark, [[1, 0], [0, 0], None, [0, 2], [1, 0]], [1, 2, 3, 4, 1])
    got = {}
    for r in neighbours.nearest_rows(df, df, k=3, id_col="pos").collect():
        got.setdefault(r.pos, []).append([(round(n.similarity, 6), n.id) for n in r.near])
    assert got == {1: [[(1.0, 1), (1.0, 1), (0.0, 2)]] * 2, 2: [[(0.0, 1), (0.0, 1), (0.0, 2)]], 3: [[]], 4: [[(1.0, 4), (0.0, 1), (0.0, 1)]]}
    none = df.where(F.lit(False))
    assert [r.near for r in neighbours.nearest(df, none, k=2, id_col="pos").collect()] == [[]] * 5 and neighbours.nearest(none, df, k=2, id_col="pos").count() == 0


# ---------------------------------------------------------------- DBSCAN


def dbscan_by_hand(x, keys, eps, minimum):
    near = 1 - unit(x) @ unit(x).T <= eps + 1e-9
    core = near.sum(1) >= minimum
    label = {}
    for i in np.argsort(keys):
        if core[i] and keys[i] not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if keys[j] not in label:
                    label[keys[j]] = keys[i]
                    todo += np.flatnonzero(near[j] & core).tolist()
    out = {}
    for i, k in enumerate(keys):
        if core[i]:
            out[k] = ("core", label[k])
        elif (near[i] & core).any():
            out[k] = ("border", label[min(keys[near[i] & core])])
        else:
            out[k] = ("noise", -1)
    return out


@pytest.mark.parametrize(("eps", "minimum"), [(0.005, 4), (0.02, 6), (0.3, 40), (2.0, 3)])
def test_dbscan_equals_plain_one(spark, monkeypatch, eps, minimum):
    monkeypatch.setattr(cells, "PART_ROWS", 16)
    x = blobs(350, 9, d=4)
    x[20:60] = x[20] + 1e-9
    keys = np.random.default_rng(3).permutation(2000)[:350]
    got = {r.pos: (r.status, r.cluster) for r in clusters.dbscan(frame(spark, x, keys), eps=eps, minimum=minimum, key="pos").collect()}
    assert got == dbscan_by_hand(x, keys, eps, minimum)


def test_dbscan_of_one_ball_compares_hardly_any(spark, monkeypatch):
    seen = []
    meet = cells.Cells.meet

    def counted(self, *a):
        before = self.compared
        out = meet(self, *a)
        seen.append(self.compared - before)
        return out

    monkeypatch.setattr(cells.Cells, "meet", counted)
    x = np.ones((3000, 6)) + 0.01 * np.random.default_rng(1).normal(size=(3000, 6))
    got = clusters.dbscan(frame(spark, x), eps=0.2, minimum=5, key="pos")
    assert {(r.status, r.cluster) for r in got.select("status", "cluster").distinct().collect()} == {("core", 0)}
    assert sum(seen) == 0  # every cell lies within every row's reach
    null = clusters.dbscan(frame(spark, [None, [1, 0], [1, 0]]), eps=0.1, minimum=2, key="pos").collect()
    assert sorted((r.pos, r.status, r.cluster) for r in null) == [(0, "noise", -1), (1, "core", 1), (2, "core", 1)]


# ---------------------------------------------------------------- HDBSCAN


def hdbscan_by_hand(x, size):
    """From all pairs: Kruskal's tree, then clusters from the whole downwards."""
    n = len(x)
    d = np.sqrt(np.maximum(2 - 2 * np.round(unit(x) @ unit(x).T, 12), 0))
    core = np.sort(d, 1)[:, size - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    i, j = np.triu_indices(n, 1)
    root, node, tree, count = list(range(n)), list(range(n)), {}, {v: 1 for v in range(n)}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for e in np.lexsort((j, i, w[i, j])):
        a, b = find(i[e]), find(j[e])
        if a != b:
            new = n + len(tree)
            tree[new] = (node[a], node[b], w[i[e], j[e]])
            count[new] = count[node[a]] + count[node[b]]
            root[b] = a
            node[a] = new
    if n <= size:
        return np.full(n, -1)

    def leaves(t):
        out, todo = [], [t]
        while todo:
            t = todo.pop()
            if t < n:
                out.append(t)
            else:
                todo += tree[t][:2]
        return out

    # a cluster: birth, rows' densities, children
    made, queue = [], [(n + len(tree) - 1, 0.0, None)]
    while queue:
        top, birth, parent = queue.pop()
        me = len(made)
        made.append({"birth": birth, "fall": {}, "children": [], "rows": set(leaves(top))})
        if parent is not None:
            made[parent]["children"].append(me)
        while top >= n:
            a, b, dist = tree[top]
            density_ = 1 / max(dist, density.LEAST)
            if count[a] >= size and count[b] >= size:
                for r in leaves(top):
                    made[me]["fall"][r] = density_
                queue += [(a, density_, me), (b, density_, me)]
                break
            big, small = (a, b) if count[a] >= size else (b, a)
            for r in leaves(small):
                made[me]["fall"][r] = density_
            if count[big] < size:
                for r in leaves(big):
                    made[me]["fall"][r] = density_
                break
            top = big
    best, take = {}, set()
    for c in reversed(range(len(made))):
        own = sum(made[c]["fall"].values()) - made[c]["birth"] * len(made[c]["rows"])
        below = sum(best[k] for k in made[c]["children"])
        if not made[c]["children"] or own >= below:
            take.add(c)
        best[c] = max(own, below) if made[c]["children"] else own
    labels, todo = np.full(n, -1), [*made[0]["children"]]
    while todo:
        c = todo.pop()
        if c in take:
            labels[list(made[c]["rows"])] = min(made[c]["rows"])
        else:
            todo += made[c]["children"]
    return labels


@pytest.mark.parametrize(("n", "size", "copies", "step"), [(500, 8, 0, 100_000), (500, 15, 120, 37), (2000, 25, 0, 100_000)])
def test_hdbscan_equals_plain_one(spark, monkeypatch, n, size, copies, step):
    monkeypatch.setattr(density, "PASS", step)
    x = blobs(n, 10, d=5, seed=n + size)
    x[100:100 + copies] = x[np.arange(copies) // 6 * 6 + 100] if copies else x[100:100]
    got = {r.pos: r.cluster for r in density.hdbscan(frame(spark, x), size=size).collect()}
    want = hdbscan_by_hand(x, size)
    assert [got[i] for i in range(n)] == want.tolist()
    assert len(set(want.tolist())) > 4


def test_hdbscan_of_few_or_equal_rows(spark):
    assert {r.cluster for r in density.hdbscan(frame(spark, [[1, 0], [0, 1], None]), size=5).collect()} == {-1}
    same = density.hdbscan(frame(spark, [[1, 0]] * 9 + [[0, 1]] * 9 + [[1, 1.2], None]), size=4).collect()
    assert {r.pos: r.cluster for r in same} == {**{i: 0 for i in range(9)}, **{i: 9 for i in range(9, 19)}, 19: -1}  # row 18 joins the nearer cluster before both are one
    assert density.hdbscan(frame(spark, []), size=5).count() == 0
