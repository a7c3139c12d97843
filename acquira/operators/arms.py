"""Registered selectors of images, and the one call that runs any of them over a pool."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acquira.functions import text
from acquira.operators import allocation, gates, ledger, research, sequential
from acquira.sources.shared import written


@dataclass(frozen=True)
class Arm:
    """kind: ranking, coverage, iterative or research; semantic: reads vectors; gated: only the top share by admissibility;
    informative: of those, only entropies from their median on; own: the labelled set is only what this campaign has bought."""

    kind: str
    semantic: bool = False
    gated: bool = False
    informative: bool = False
    own: bool = False
    spec: research.Spec | None = None


_R = research.Spec
#: The strategies' names, in order of execution.
ARMS = {
    "random": Arm("ranking"),
    "admissibility": Arm("ranking"),
    "proposed": Arm("coverage", True, True),
    "entropy": Arm("ranking"),
    "coreset": Arm("coverage", True),
    "proposed_v2": Arm("coverage", True, True, informative=True, own=True),
    "cost_aware": Arm("ranking", gated=True),
    "distribution_aware_v1": Arm("ranking", True, True),
    "distribution_aware_iterative_v1": Arm("iterative", True, True),
    "research_v2": Arm("research", True, True, spec=_R("combined", "density", "cluster")),
    "research_v2_plan": Arm("research", True, True, spec=_R("labelled", "continuous", "cluster")),
    "research_v2_no_gate": Arm("research", True, True, spec=_R("combined", "none", "cluster")),
    "research_v2_labeled_only": Arm("research", True, True, spec=_R("labelled", "density", "cluster")),
    "research_v2_batch_only": Arm("research", True, True, spec=_R("batch", "density", "cluster")),
}


def candidates(name: str, pool: DataFrame, *, share: float = 0.3) -> DataFrame:
    """The rows of the pool that an arm may choose from."""
    arm = ARMS[name]
    d = written(gates.admissible(pool, "a", share).where("in_gate").drop("in_gate")) if arm.gated else pool
    return gates.above_median(d, F.lit(True), "entropy") if arm.informative else d


def select(name: str, pool: DataFrame, *, budget: int, rounds: int = 1, seed: object = 0, reference: DataFrame | None = None, share: float = 0.3, vectors: DataFrame | None = None) -> DataFrame:
    """seq, image_id, cost of the images that an arm opens with a budget, in order.

    pool: pos, image_id, cost, a (admissibility), entropy and, for arms that read vectors, embedding (unit); reference: embedding.
    Arms of coverage and research also take a pool with vec_id and ``vectors`` (vec_id, embedding). An unknown arm, and vectors that are missing, raise.
    """
    if name not in ARMS:
        raise ValueError(f"{name!r} isn't one of {sorted(ARMS)}")
    arm = ARMS[name]
    if arm.semantic and "embedding" not in pool.columns and (vectors is None or arm.kind not in ("coverage", "research")):
        raise ValueError(f"{name} reads vectors, and the pool has none")
    spark, d = pool.sparkSession, candidates(name, pool, share=share)
    kind = d.schema["image_id"].dataType.simpleString()
    table = lambda rows: spark.createDataFrame([(i + 1, image, int(cost)) for i, (image, cost) in enumerate(rows)], f"seq long, image_id {kind}, cost long")
    cost = d.select("image_id", "cost").distinct()
    if arm.kind == "research":
        picks = research.campaign(d, arm.spec, budget=budget, rounds=rounds, reference=reference, vectors=vectors)
        return table([(r.image_id, r.cost) for r in picks.where("NOT redundant").orderBy("seq").collect()])  # a budget's images
    if arm.kind == "coverage":
        known = None
        if reference is not None and not arm.own:
            known = np.stack([np.asarray(r.embedding, float) for r in reference.select("embedding").collect()])  # the bounded labelled sample
        got = sequential.k_centre(d.select("pos", "image_id", "cost", F.col("a").alias("tie"), "embedding" if vectors is None else "vec_id"), budget=budget, reference=known, vectors=vectors)
        return table(zip(got["image_id"].tolist(), got["cost"].tolist(), strict=True))
    empty = d.select("embedding").limit(0) if arm.semantic else None
    if arm.kind == "iterative":
        got = allocation.rounds(d.select("pos", "entropy", "image_id", "cost", "embedding"), reference if reference is not None else empty, budget=budget, n=rounds)
        return table(zip(got["image_id"].tolist(), got["cost"].tolist(), strict=True))
    if name == "random":
        first = d.groupBy("image_id").agg(F.min(text.ordered_hash(seed, F.col("pos"))).alias("h"))
        walk = first.select("image_id", F.col("image_id").alias("pos"), (-F.conv(F.substring("h", 1, 13), 16, 10).cast("long")).alias("key"))
    elif name == "cost_aware":
        walk = ledger.cost_aware(d.select("pos", "image_id", "a"), "a").select("image_id", "pos", (-F.col("rn")).alias("key"))
    elif name == "distribution_aware_v1":
        order = allocation.order(d.select("pos", "entropy", "image_id", "cost", "embedding"), reference if reference is not None else empty, budget=budget)
        walk = order.join(d.select("pos", "image_id"), "pos").select("image_id", "pos", (-F.col("seq")).alias("key"))
    else:
        walk = d.select("image_id", "pos", F.col("a" if name == "admissibility" else "entropy").alias("key"))
    return ledger.spend(walk, "key", cost, budget=budget).select("seq", "image_id", "cost")
