"""Campaigns, ceilings and cuts against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from acquira.operators import arms, ceiling, neighbours, research
from pyspark.sql import functions as F


def ranks(x):
    x = np.asarray(x, float)
    order = np.array([(sum(x < v) + sum(x <= v) - 1) / 2 for v in x])
    return order / max(len(x) - 1, 1)


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def dbscan(x, eps, minimum):
    near = [[j for j in range(len(x)) if 1 - x[i] @ x[j] <= eps + 1e-9 or i == j] for i in range(len(x))]
    core = {i for i in range(len(x)) if len(near[i]) >= minimum}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        todo, label[i] = [i], i
        while todo:
            a = todo.pop()
            for b in near[a]:
                if b in core and b not in label:
                    label[b] = i
                    todo.append(b)
    out = np.full(len(x), -1)
    for i in range(len(x)):
        if i in core:
            out[i] = label[i]
        elif hits := [j for j in near[i] if j in core]:
            out[i] = label[min(hits)]
    return out


def brute(x, entropy, images, cost, spec, budget, rounds, reference):
    mean = np.mean([cost[i] for i in sorted(set(images))])
    minimum = max(5, int(-(-len(x) * mean // max(budget, 1e-12))))
    opened, spent, picks, told = [], 0, [], reference
    for number in range(1, rounds + 1):
        allowed = budget * number // rounds - spent
        at = [i for i in range(len(x)) if images[i] not in opened]
        if allowed <= 0 or not at:
            continue
        v = x[at]
        label, g = np.zeros(len(at), int), np.ones(len(at))
        if spec.coherence == "density":
            if len(at) <= minimum:
                radius = math.inf
            else:
                radius = np.quantile([np.sort(np.sqrt(np.maximum(2 - 2 * (v @ w), 0)))[minimum] for w in v], spec.quantile)
            label = dbscan(v, min(radius, 2.0) ** 2 / 2, minimum)
            g = (label >= 0).astype(float)
        elif spec.coherence == "continuous" and len(at) > spec.k:
            d = np.array([np.sort(np.sqrt(np.maximum(2 - 2 * (v @ w), 0)))[spec.k] for w in v])
            g = 1 / (1 + d / np.median(d))
        raw = np.zeros(len(at))
        ids = sorted(set(label[label >= 0]))
        centres = [next(w for w in sorted(np.flatnonzero(label == c), key=lambda j: (-round(v[j] @ v[label == c].sum(0), 9), at[j]))) for c in ids]
        near = [max(range(len(ids)), key=lambda c: (round(r @ v[centres[c]], 9), -ids[c])) for r in told] if ids else []
        for k, c in enumerate(ids):
            raw[label == c] = max(math.log((1 + sum(label == c)) / (1 + near.count(k))), 0)
        r = np.where(label >= 0, ranks(np.round(raw, 9)), 0)
        u, novel = ranks(np.round(entropy[at], 9)), ranks(np.round(np.clip(1 - (v @ told.T).max(1), 0, 1), 9))
        batch, free, here, left = np.ones(len(at)), np.ones(len(at), bool), set(), allowed
        while free.any():
            d = {"none": 0, "labelled": novel, "batch": batch, "combined": (novel + batch) / 2}[spec.diversity]
            score = np.round(u + spec.diversity_weight * d + spec.rarity_weight * r * g, 9)
            j = min(np.flatnonzero(free), key=lambda j: (-score[j], at[j]))
            image = images[at[j]]
            if image not in here:
                if cost[image] > left:
                    break
                left -= cost[image]
                spent += cost[image]
                opened.append(image)
            picks.append((number, at[j], image, image in here))
            here.add(image)
            free[j] = False
            batch = np.minimum(batch, np.round(np.clip(1 - v @ v[j], 0, 1), 9))
            if left <= 0:
                break
        told = np.concatenate([x[[i for i in range(len(x)) if images[i] in opened]], reference])
    return picks


@pytest.mark.parametrize("spec", [research.Spec("combined", "density"), research.Spec("batch", "none", diversity_weight=0.9), research.Spec("labelled", "continuous")])
def test_research_campaign(spark, spec):
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(6, 8)))
    x = unit(centres[rng.integers(0, 6, 90)] + 0.15 * rng.normal(size=(90, 8)))
    images, entropy, reference = [int(i) for i in rng.integers(0, 40, 90)], np.round(rng.random(90), 2), unit(rng.normal(size=(7, 8)))
    cost = {i: i % 4 + 1 for i in range(40)}
    pool = spark.createDataFrame([(i, float(entropy[i]), images[i], cost[images[i]], x[i].tolist()) for i in range(90)], "pos long, entropy double, image_id long, cost long, embedding array<double>")
    ref = spark.createDataFrame([(r.tolist(),) for r in reference], "embedding array<double>")
    got = [(r.round, r.pos, r.image_id, r.redundant) for r in research.campaign(pool, spec, budget=30, rounds=2, reference=ref, ahead=9).orderBy("seq").collect()]
    assert got == brute(x, entropy, images, cost, spec, 30, 2, reference)


def test_arms_refuse_what_they_cannot_read(spark):
    pool = spark.createDataFrame([(1, 1, 1, 0.5, 0.5)], "pos long, image_id long, cost long, a double, entropy double")
    with pytest.raises(ValueError):
        arms.select("unheard", pool, budget=3)
    with pytest.raises(ValueError):
        arms.select("coreset", pool, budget=3)
    assert [tuple(r) for r in arms.select("entropy", pool, budget=3).collect()] == [(1, 1, 1)]


def world(spark):
    rng = np.random.default_rng(9)
    counts = {i: {c: int(rng.integers(1, 4)) for c in rng.choice(list("abcde"), rng.integers(0, 4), replace=False)} for i in range(60)}
    cost = {i: max(1, sum(c.values())) for i, c in counts.items()}
    rows = [(i, str(c), n) for i, cs in counts.items() for c, n in cs.items()]
    return counts, cost, spark.createDataFrame(rows, "image_id long, class_name string, n long"), spark.createDataFrame(list(cost.items()), "image_id long, cost long")


@pytest.mark.parametrize("policy", ["stratified", "stratified_cheapest"])
def test_stratified_ceilings(spark, policy):
    counts, cost, c, p = world(spark)
    budget, known = 40, {"a"}
    present = sorted({k for i in counts for k in counts[i]} - known)
    order = []
    for name in present:
        key = (lambda i: (-round(counts[i][name] / cost[i], 9), i)) if policy == "stratified" else (lambda i: (cost[i], i))
        spent = 0
        for i in sorted((i for i in counts if counts[i].get(name)), key=key):
            if i in order:
                continue
            if spent + cost[i] > budget / len(present):
                break
            order.append(i)
            spent += cost[i]
    order += [i for i in sorted(counts, key=lambda i: (hashlib.sha256(f"7|{i}".encode()).hexdigest(), i)) if i not in order]
    want, left = [], budget
    for i in order:
        if cost[i] > left:
            break
        want.append((i, cost[i]))
        left -= cost[i]
    assert ceiling.purchase(policy, c, p, budget=budget, known=["a"], seed=7) == want


def test_stratified_cut(spark):
    counts, _, c, _ = world(spark)
    by = {}
    for i, cs in counts.items():
        for k in cs:
            by.setdefault(k, []).append(i)
    for k in by:
        by[k].sort(key=lambda i: (hashlib.sha256(f"2|{k}|{i}".encode()).hexdigest(), i))
    kept, names = [], sorted(by, key=lambda k: (len(by[k]), k))
    queues = {k: list(v) for k, v in by.items()}
    while len(kept) < 17 and any(queues.values()):
        for k in names:
            while len(kept) < 17 and queues[k]:
                i = queues[k].pop(0)
                if i not in kept:
                    kept.append(i)
                    break
    assert ceiling.stratified_cut(c, limit=17, seed=2) == kept


def test_range_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PIVOTS", 5)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 16)
    x = unit(np.random.default_rng(4).normal(size=(150, 5)))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r.a, r.b) for r in neighbours.within(d, eps=0.2).collect())
    assert got == sorted((i, j) for i in range(150) for j in range(150) if 1 - x[i] @ x[j] <= 0.2 + 1e-9 or i == j)
    assert neighbours.within(d.where(F.lit(False)), eps=0.2).count() == 0
