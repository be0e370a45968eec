"""Connected components by alternating large and small stars (Kiveris et al., 2014), DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import scratch


def _met(edges: DataFrame, named: DataFrame, hub: int | None) -> DataFrame:
    """edges joined with (a, m, n) of their end a; nodes with more than ``hub`` edges are dealt to several tasks by their other end.

    ``hub`` is a partition's fair share of the edges or more, so there are no more hubs than partitions; None if no node can be one.
    """
    if hub is None:
        return edges.join(named, "a")
    hubs = scratch.cut(named.where(F.col("n") > hub).select("a", F.ceil(F.col("n") / hub).cast("int").alias("salts")))
    if hubs.isEmpty():
        return edges.join(named, "a")
    salted = edges.join(F.broadcast(hubs), "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), "salts").cast("int"), F.lit(0))).drop("salts")
    copied = named.join(F.broadcast(hubs), "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    return salted.join(copied, ["a", "salt"])


def _large_star(edges: DataFrame, hub: int | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return _met(both.where("b > a"), least, hub).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, hub: int | None) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    met = _met(down, least, hub)
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, max_rounds: int = 50, hub: int = 100_000) -> DataFrame:
    """Edges (a, b) of comparable ids to (node, component), component the smallest id reachable.

    Loops and edges with a null end are no edges; nodes without an edge don't appear. The rounds needed grow with
    the logarithm of the number of nodes; each round's edges are checkpointed in the shared folder. A node's edges are dealt
    to several tasks where they are more than ``hub`` and more than a partition's share.
    """
    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    now = scratch.cut(edges.select("a", "b").where("a <> b").distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        share = max(hub, 2 * state[0] // parts)
        share = share if share < state[0] else None
        now = scratch.cut(_small_star(_large_star(now, share), share))
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
