"""Hand cases whose results follow from the definitions."""

import math

from acquira.functions import ranking, text, vec
from acquira.operators import curves, gates, ledger, match, stats
from pyspark.sql import functions as F


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_rank_normalise(spark):
    for xs, want in (([3, 1, 2], [1.0, 0.0, 0.5]), ([5, 1, 1, 9], [2 / 3, 1 / 6, 1 / 6, 1.0])):
        df = values(spark, list(enumerate(xs)), "pos int, x int")
        got = {r.pos: r.r for r in ranking.rank_normalised(df, "x", "r").collect()}
        assert all(math.isclose(got[i], w) for i, w in enumerate(want))


def test_row_numbers_are_global(spark):
    df = values(spark, [(i, (i * 37) % 11) for i in range(500)], "pos int, x int")
    got = sorted(map(tuple, ranking.row_numbers(df, ["x", "pos"], "rn", descending=True).select("rn", "x", "pos").collect()))
    want = sorted(((i * 37) % 11, i) for i in range(500))
    assert [g[1:] for g in got] == sorted(want, key=lambda r: (-r[0], r[1])) and [g[0] for g in got] == list(range(1, 501))


def test_top_share(spark):
    df = values(spark, [(i, i % 7) for i in range(100)], "pos int, x int")
    for share in (0.01, 0.3, 0.505, 0.999):
        k = max(1, round(100 * share))
        want = {i for _, i in sorted((-(i % 7), i) for i in range(100))[:k]}
        assert {r.pos for r in ranking.top_share(df, "x", "pos", share, "top").where("top").collect()} == want
    assert ranking.top_share(df, "x", "pos", 1.0, "top").where("top").count() == 100


def test_suppression(spark):
    df = values(spark, [(0, "i", 0.5, 0.5, 0.4, 0.4, 3.0), (1, "i", 0.51, 0.51, 0.4, 0.4, 2.0), (2, "i", 0.1, 0.1, 0.05, 0.05, 1.0)], "pos int, image_id string, cx double, cy double, w double, h double, key double")
    assert {r.pos for r in gates.suppress(df, F.col("key")).where("kept").collect()} == {0, 2}


def test_ledger_stops_and_never_skips(spark):
    df = values(spark, [(0, "a", 4.0), (1, "a", 3.0), (2, "b", 2.0), (3, "c", 1.0)], "pos int, image_id string, key double")
    cost = values(spark, [("a", 2), ("b", 3), ("c", 4)], "image_id string, cost int")
    got = {r.image_id: r.cum_cost for r in ledger.spend(df, "key", cost, budget=5).collect()}
    assert got == {"a": 2, "b": 5}
    cost = values(spark, [("a", 2), ("b", 9), ("c", 1)], "image_id string, cost int")
    assert [r.image_id for r in ledger.spend(df, "key", cost, budget=5).collect()] == ["a"]
    assert ledger.round_budgets(601, 6) == [101, 100, 100, 100, 100, 100]


def test_supervision(spark):
    counts = values(spark, [("i1", "person", 2), ("i1", "light", 1), ("i2", "hydrant", 3)], "image_id string, class_name string, n int")
    told = values(spark, [("person",), ("light",)], "class_name string")
    groups = values(spark, [("person", "head")], "class_name string, grp string")
    r = ledger.supervision(counts, counts.select("image_id"), told, groups).first()
    assert (r.boxes_labelled, r.boxes_supervised, r.boxes_banked, r.images_barren) == (6, 3, 3, 1)


def test_discovery_counts_objects(spark):
    rows = values(spark, [(i, "img", "unknown", "c", 7) for i in range(3)], "pos int, image_id string, kind string, class_name string, object_id long")
    groups = values(spark, [("c", "tail")], "class_name string, grp string")
    r = ledger.discovery(rows, groups).first()
    assert (r.unknown_objects, r.unknown_proposals, r.proposals_per_object, r.tail_objects) == (1, 3, 3.0, 1)
    empty = ledger.discovery(rows.where("pos < 0"), groups).first()
    assert empty.proposals == 0 and empty.proposals_per_object is None


def test_cost_to_reach(spark):
    df = values(spark, [("a", 1.0, 5.0), ("a", 3.0, 9.0), ("b", 2.0, 8.0), ("c", 1.0, 1.0)], "arm string, cost double, v double")
    got = {r.arm: r.cost_to_reach for r in curves.cost_to_reach(df, "arm", "cost", "v", F.lit(7.0)).collect()}
    assert got == {"a": 2.0, "b": 2.0, "c": None}


def test_spearman_and_auc(spark):
    df = values(spark, [(i, float(i), float(i**3), float(-i)) for i in range(9)], "pos int, x double, y double, z double")
    assert math.isclose(stats.spearman(df, "x", "y").first().rho, 1) and math.isclose(stats.spearman(df, "x", "z", ties="ordinal").first().rho, -1)
    assert stats.roc_auc(df, "x", F.col("x") > 4).first().auc == 1.0
    assert stats.roc_auc(df, "x", F.col("x") > 7).first().auc is None


def test_greedy_matching_is_one_to_one(spark):
    box = lambda x: (x, 0.0, x + 1.0, 1.0)
    schema = "image_id string, pos int, box struct<x1:double,y1:double,x2:double,y2:double>"
    truth = values(spark, [("i", 0, box(0.0))], schema)
    found = values(spark, [("i", 1, box(0.0), 0.9), ("i", 2, box(0.1), 0.8)], schema + ", score double")
    assert [r.recalled for r in match.greedy(found, truth, ["image_id"]).collect()] == [True]


def test_text_rules(spark):
    r = spark.range(1).select(
        text.parse_quota(F.lit("a:1;b:c:2;bad")).alias("q"), text.alias_id(F.lit("000000021740")).alias("a"), text.canonical_name(F.lit(" sofa ")).alias("c"), vec.entropy(F.array(F.lit(0.25), F.lit(0.25), F.lit(0.25), F.lit(0.25))).alias("u"),
    ).first()
    assert (r.q, r.a, r.c) == ({"a": 1, "b:c": 2}, "900000021740", "couch") and math.isclose(r.u, 1)


def test_power_allocation():
    from acquira.operators.sequential import power_allocation

    assert power_allocation({"a": 10000, "b": 1000, "c": 100}, total=300) == {"a": 100, "b": 100, "c": 100}
    got = power_allocation({"head": 262465, "tail": 1294}, total=50, alpha=1)
    assert sum(got.values()) == 50 and got["tail"] >= 1
    assert power_allocation({"a": 3, "b": 100}, total=50) == {"a": 3, "b": 47}
    assert sum(power_allocation({"a": 5, "b": 6, "c": 7}, total=2, alpha=1).values()) == 2 and power_allocation({"a": 0}, total=5) == {}


def test_k_centre_opens_the_uncovered(spark):
    import numpy as np
    from acquira.operators.sequential import k_centre

    e = np.eye(3)
    pool = values(spark, [(i, f"i{i}", 1, 0.0, e[i].tolist()) for i in range(3)], "pos int, image_id string, cost int, tie double, embedding array<double>")
    assert k_centre(pool, budget=1, reference=e[:2])["image_id"].tolist() == ["i2"]
    first = k_centre(pool, budget=3)
    assert first["distance"].isna().tolist()[0] and len(first) == 3


def test_emit_is_a_permutation_and_charges_openings(spark):
    from acquira.operators.sequential import emit

    pool = values(spark, [(0, 1, 0.9, "a", 2), (1, 1, 0.8, "a", 2), (2, 2, 0.7, "b", 1), (3, -1, 0.95, "c", 1)], "pos int, cluster int, entropy double, image_id string, cost int")
    got = emit(pool, {1: 2.5, 2: 1.0})
    assert got["pos"].tolist() == [0, 2, 1, 3] and got["paid"].tolist() == [True, True, True, False]


def test_herding_starts_at_the_mean(spark):
    from acquira.operators.sequential import herding

    rows = values(spark, [("c", 0, [0.0, 3.0]), ("c", 1, [0.0, 1.1]), ("c", 2, [0.0, -1.0])], "label string, pos int, embedding array<double>")
    assert {r.step: r.pos for r in herding(rows, "label").collect()}[1] == 1


def test_image_memory_covers_the_demand(spark):
    from acquira.operators.sequential import image_memory

    counts = values(spark, [("a", "x", 1), ("b", "x", 2), ("b", "y", 1), ("c", "y", 1)], "image_id string, class_name string, n int")
    assert image_memory(counts, {"x": 2, "y": 1}) == ["b"] and image_memory(counts, {"x": 1, "y": 1}, priority=["c", "a", "b"]) == ["c", "a"]


def test_static_arm_ignores_rounds(spark):
    from acquira.operators import campaign

    pool = campaign.terms(values(spark, [(i, "i", 0.1 + i % 5 / 10, 0.2, 0.5 + i % 3 / 10, [1.0, 2.0 + i % 4], i % 6) for i in range(60)], "pos long, image_id string, w double, h double, objectness double, q array<double>, cluster int"))
    one = {r.pos for r in campaign.select(pool, campaign.ARMS["prior_rarity"], budget=20, rounds=1).collect()}
    six = campaign.select(pool, campaign.ARMS["prior_rarity"], budget=20, rounds=6).collect()
    assert {r.pos for r in six} == one and [sum(r.round == i for r in six) for i in range(6)] == [4, 4, 3, 3, 3, 3]


def test_dbscan(spark, tmp_path):
    import math as m

    from acquira.operators import clusters

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    at = lambda d: [m.cos(m.radians(d)), m.sin(m.radians(d))]
    rows = values(spark, [(i, at(d)) for i, d in enumerate([0, 1, 2, 3, 6, 90, 91, 92, 200])], "vec_id int, embedding array<double>")
    got = {r.vec_id: (r.status, r.cluster) for r in clusters.dbscan(rows, eps=1 - m.cos(m.radians(3.2)), minimum=3).collect()}
    assert got[8] == ("noise", -1) and got[0] == ("core", 0) and got[4] == ("border", 0) and got[6] == ("core", 5)
