"""Sequential choices see the whole gated pool, however few rows a pass brings to the driver."""

import numpy as np
import pandas as pd
from acquira.operators import gates, sequential
from acquira.plans import core, selection
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def cover(held, demand):
    missing, out = dict(demand), []
    gain = lambda i: sum(min(n, missing.get(c, 0)) for c, n in held[i].items())
    while any(missing.values()) and (best := min((i for i in held if i not in out), key=lambda i: (-gain(i), i), default=None)) is not None and gain(best):
        out.append(best)
        for c, n in held[best].items():
            missing[c] = max(0, missing.get(c, 0) - n)
    return out


def test_pool_is_the_gate_of_all_survivors(spark):
    kept = gates.suppress(core.by_admissibility(spark, SF), F.col("a")).where("kept").select("pos", "a").toPandas()
    want = kept.sort_values(["a", "pos"], ascending=[False, True])["pos"].head(round(len(kept) * 0.3))
    got = selection.gated_pool(spark, SF).select("pos").toPandas()["pos"]
    assert len(got) > 2000 and sorted(got) == sorted(want)


def test_set_cover_memory_counts_all_images(spark):
    c = selection.counts(spark, SF).toPandas()
    held = {i: dict(zip(g["class_name"], g["n"])) for i, g in c.groupby("image_id")}
    n = c.groupby("class_name")["n"].sum().sort_index()
    want = cover(held, sequential.power_allocation(n.to_dict(), total=200, alpha=0.5))
    assert [r.image_id for r in selection.set_cover_memory(spark, SF).collect()] == want


def test_passes_choose_as_one_does(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))[rng.integers(0, 40, 300)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    image = rng.integers(0, 150, 300)
    rows = pd.DataFrame({"pos": range(300), "image_id": image, "cost": image % 3 + 1, "tie": rng.integers(0, 4, 300).astype(float), "cluster": image % 5, "entropy": rng.integers(0, 9, 300) / 9, "embedding": x.tolist()})
    pool = spark.createDataFrame(rows).repartition(3)
    far, free, left, want = np.full(300, np.inf), np.ones(300, bool), 60, []
    while free.any():
        best = min(np.flatnonzero(free), key=lambda i: (-far[i], -rows["tie"][i], i))
        if rows["cost"][best] > left:
            break
        left -= rows["cost"][best]
        want.append((image[best], best))
        free &= image != image[best]
        far = np.minimum(far, np.round(1 - (x @ x[image == image[best]].T).max(1), 9) + 0.0)
    for ahead in (1, 7, 1000):
        got = sequential.k_centre(pool, budget=60, ahead=ahead)
        assert list(zip(got["image_id"], got["anchor_pos"])) == want
    quota = {0: 30.0, 1: 12.5, 2: 7.0, 3: 0.0}
    whole = sequential.emitted(pool, quota, ahead=1000).orderBy("seq").collect()
    assert sequential.emitted(pool, quota, ahead=2).orderBy("seq").collect() == whole and sorted(r.pos for r in whole) == list(range(300))
    c = pd.DataFrame({"image_id": np.repeat(range(100), 3), "class_name": ["a", "b", "c"] * 100, "n": rng.integers(1, 5, 300)})
    held = {i: dict(zip(g["class_name"], g["n"])) for i, g in c.groupby("image_id")}
    demand = {"a": 40, "b": 25, "c": 90}
    for ahead in (1, 5, 1000):
        assert sequential.image_memory(spark.createDataFrame(c), demand, ahead=ahead) == cover(held, demand)


def test_select_rounds_ranks_all_candidates(spark):
    from acquira.plans import reports

    d = reports.pool(spark, SF).select("pos", "vec_id", "u", "a", "r", "g").toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().set_index("vec_id")["embedding"]
    x = np.stack([np.asarray(e[v], float) for v in d["vec_id"]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d["d"], taken = 0.0, []
    for _ in range(3):
        left = d[~d.index.isin(taken)].copy()
        if taken:
            far = pd.Series(np.round(1 - (x[left.index] @ x[taken].T).max(1), 9), left.index)
            left["d"] = (far.rank(method="average") - 1) / (len(left) - 1)
        left["score"] = (left["a"] * (left["u"] + left["d"] + left["r"] * left["g"])).round(9)
        taken += left.sort_values(["score", "pos"], ascending=[False, True]).index[:40].tolist()
    got = [r.pos for r in reports.select_rounds(spark, SF).orderBy("pick").collect()]
    assert got == d["pos"][taken].tolist()
