"""Graph operators over edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions, the largest weight of each pair, no loops."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def bridges(members: DataFrame, key: str, node: str, rarest: int | None = None) -> DataFrame:
    """Nodes that share a key, as star edges to the key's smallest node, weighted by 1 / log2(1 + members): linear in the members."""
    per = members.select(key, node).distinct()
    size = per.groupBy(key).agg(F.count("*").alias("n"), F.min(node).alias("src")).where("n > 1")
    return per.join(size, key).where(F.col(node) != F.col("src")).groupBy("src", F.col(node).alias("dst")).agg(F.round(F.sum(1 / F.log2(1.0 + F.col("n"))), 8).alias("weight"))


def personalized(edges: DataFrame, seeds: DataFrame, rounds: int = 12, damping: float = 0.5, cut_every: int = 4) -> DataFrame:
    """(node, score) of personalized PageRank: `rounds` synchronous rounds; mass at nodes without edges is dropped. seeds: (node), equal shares."""
    from tessella.sources.tables import table

    total = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    moves = edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p"))
    start = seeds.join(F.broadcast(seeds.agg(F.count("*").alias("n"))), F.lit(True)).select("node", (1.0 / F.col("n")).alias("e"))  # one row
    rank = start.select("node", F.col("e").alias("score"))
    for k in range(rounds):
        flow = rank.join(moves, rank["node"] == moves["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("in"))
        rank = flow.join(start, "node", "full").select("node", (damping * F.coalesce("in", F.lit(0.0)) + (1 - damping) * F.coalesce("e", F.lit(0.0))).alias("score"))
        if (k + 1) % cut_every == 0 and k + 1 < rounds:
            rank = table(rank)
    return rank


def converged(edges: DataFrame, seeds: DataFrame, alpha: float = 0.5, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(node, score) of personalized PageRank run until the L1 change is under tolerance * nodes; mass of dead ends goes back to the seeds."""
    from tessella.sources.tables import table

    nodes = table(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).unionByName(seeds.select("node")).distinct())
    total = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    moves = table(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")))
    n = seeds.count()
    start = table(nodes.join(seeds.select("node", F.lit(1.0 / max(n, 1)).alias("e")), "node", "left").na.fill(0.0, ["e"]))
    ends = start.join(moves.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node")
    rank, size = start.select("node", F.col("e").alias("score")), nodes.count()
    for _ in range(most):
        lost = rank.join(ends, "node", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        flow = rank.join(moves, rank["node"] == moves["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("in"))
        new = table(start.join(flow, "node", "left").select("node", (alpha * (F.coalesce("in", F.lit(0.0)) + lost * F.col("e")) + (1 - alpha) * F.col("e")).alias("score")))
        change = new.join(rank.withColumnRenamed("score", "old"), "node").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        rank = new
        if change is None or change < tolerance * size:
            break
    return rank


def bundle(hits: DataFrame, edges: DataFrame, seeds: int = 15, support: float = 0.15, bonus: float = 0.05, valid=None) -> DataFrame:
    """(query, doc, score): the first `seeds` hits and what their typed edges lead to.

    A neighbour gets `support` of each seed's score along an edge; a seed that is also reached gets `bonus` more. `valid` is a condition on
    (query, doc) columns that reached documents must meet, such as being in force.
    """
    first = hits.where(F.col("rank") <= seeds).select("query", "doc", "score")
    reached = first.join(edges.select(F.col("src").alias("doc"), "dst"), "doc").groupBy("query", F.col("dst").alias("doc")).agg((support * F.sum("score")).alias("gain"))
    if valid is not None:
        reached = reached.where(valid)
    both = first.join(reached, ["query", "doc"], "full")
    return both.select("query", "doc", F.round(F.coalesce("score", "gain") + F.when(F.col("score").isNotNull() & F.col("gain").isNotNull(), bonus).otherwise(0.0), 6).alias("score"))
