"""Personalised PageRank by power iteration on DataFrames.

The transition is the row-normalised (A + At) / 2.  In modified mode an isolated node
passes its mass evenly to all other nodes: as one scalar a round, never as edges, and the
isolated nodes themselves follow a formula of two numbers.  Each round is one join on the
source and one pre-aggregated sum by target; lineage is cut every few rounds.

Defined results: seeds outside the graph are ignored; weights are normalised; without
positive weight every node is a seed alike; an empty graph gives no rows.  In the
non-modified mode isolated nodes leak their mass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import cut


def transition(edges: DataFrame) -> DataFrame:
    """``src, dst, p``: a one-way edge weighs 0.5, a reciprocal pair 1.0, rows sum to 1."""
    e = edges.where("source != target").select("source", "target").distinct()
    two = e.select(F.explode(F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")), F.struct(F.col("target").alias("src"), F.col("source").alias("dst")))).alias("x")).select("x.*")
    w = two.groupBy("src", "dst").agg((F.count("*") * 0.5).alias("w"))
    out = w.groupBy("src").agg(F.sum("w").alias("total"))
    return w.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))


def matrix_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n"))
    m = transition(edges).agg(F.count("*").alias("nonzero"))
    return n.join(m, F.lit(True)).withColumn("density", F.col("nonzero") / F.greatest(F.lit(1), F.col("n") * F.col("n")))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6, modified: bool = True, cut_every: int = 5) -> DataFrame:
    """``id, score`` for every node; ``seeds``: id, weight. ``tol=None`` runs exactly ``max_iter`` rounds."""
    ids = nodes.select("id").distinct()
    s = seeds.where("weight is not null and weight > 0").groupBy("id").agg(F.sum("weight").alias("w")).join(ids, "id", "left_semi")
    total = s.agg(F.sum("w")).first()[0]
    n = ids.count()
    if n == 0:
        return ids.withColumn("score", F.lit(0.0))
    m = cut(transition(edges))
    linked = m.select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True))
    share = F.coalesce(F.col("w") / F.lit(total), F.lit(0.0)) if total else F.lit(1.0 / n)
    base = cut(ids.join(s, "id", "left").join(linked, "id", "left").select("id", share.alias("s"), F.coalesce("linked", F.lit(False)).alias("linked")))
    # an isolated node's score is a + b * s with the same a and b for all of them, so the walk runs over linked nodes only
    n_lone, s_lone = base.where("not linked").agg(F.count("*"), F.coalesce(F.sum("s"), F.lit(0.0))).first()
    core = cut(base.where("linked").select("id", "s"))
    a, b = 0.0, 1.0
    v, marked = core.select("id", F.col("s").alias("score")), (core.select("id", F.col("s").alias("old")), a, b)
    for k in range(max_iter):
        spread = n_lone * a + b * s_lone if modified else 0.0  # the mass of isolated nodes
        moved = v.join(m, v["id"] == m["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("p")).alias("in"))
        per = spread / (n - 1) if n > 1 else 0.0
        v = core.join(moved, "id", "left").select("id", ((F.coalesce("in", F.lit(0.0)) + F.lit(per)) * alpha + F.col("s") * (1 - alpha)).alias("score"))
        lone = alpha / (n - 1) if modified and n > 1 else 0.0
        a, b, before = lone * (spread - a), 1 - alpha - lone * b, (a, b)
        if (k + 1) % cut_every == 0 or k + 1 == max_iter:
            v = cut(v, fresh=True)
            if tol is not None and k:
                # the change over the rounds since the last look bounds that of the last one
                d = v.join(marked[0], "id").agg(F.coalesce(F.sum(F.abs(F.col("score") - F.col("old"))), F.lit(0.0))).first()[0]
                da, db = a - before[0], b - before[1]
                d += base.where("not linked").agg(F.coalesce(F.sum(F.abs(F.lit(da) + F.lit(db) * F.col("s"))), F.lit(0.0))).first()[0] if n_lone else 0.0
                marked = (v.select("id", F.col("score").alias("old")), a, b)
                if d < tol:
                    break
    rest = base.where("not linked").select("id", (F.lit(a) + F.lit(b) * F.col("s")).alias("score"))
    return v.unionByName(rest)


def top_nodes(scores: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The k best; equal scores in order of arrival."""
    return scores.join(nodes.select("id", "type", "content", "seq"), "id").orderBy(F.desc("score"), "seq", "id").limit(k)
