"""Connected components: alternating star contractions of any ids (GR7), randomised contraction of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixplan.plans.runtime import Scratch
from helixplan.plans.skew import dealt_join, hot_keys


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    both = _both(edges)
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return dealt_join(both.where("b > a"), low, "a", hot, F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = dealt_join(down, low, "a", hot, F.col("b"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")


def connected_components(edges: DataFrame, src: str, dst: str, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list.

    Returns ``(node, component)``, one row per node that occurs in ``edges``; self-loops make a node known
    but link nothing, rows with a null end are ignored. A round is two star contractions; both are an
    aggregation that combines on the map side and an equi-join, in which the edges of hubs are dealt by their
    other ends, so a hub costs no task more than its share. The number of rounds grows with the logarithm of
    the longest path; they end when every node links to one root. The driver gets two numbers and the list of
    hubs (bounded, see ``hot_keys``) a round, and each round is a table in the shared folder.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = scratch.keep(ends)
    now = scratch.keep(nodes.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        # How many each node links to, and how many link to it.
        met = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        up, down = F.col("up"), F.col("down")
        told = met.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).agg(F.sum(up).alias("n"), F.max(F.when(down > 0, up).otherwise(up - 1)).alias("open"), F.max(up + down).alias("most")).first()
        if not told["n"] or told["open"] <= 0:
            break
        hot = hot_keys(_both(now), "a", 2 * told["n"], most=told["most"])
        grown = scratch.keep(_small_star(_large_star(now, hot), hot).distinct())
        scratch.drop(now)
        now = grown
    else:
        raise RuntimeError("components did not settle")
    alone = nodes.select("a").unionByName(nodes.select(F.col("b").alias("a"))).distinct()
    return alone.join(now, "a", "left").select(F.col("a").alias("node"), F.coalesce("b", "a").alias("component"))


def contracted_components(edges: DataFrame, src: str, dst: str, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` as ``connected_components`` gives them, for ends that are longs.

    In a round every node takes the least name among its neighbours and itself, where names are ``xxhash64`` of a
    round's number and a long: a different long for each long (every step of that hash can be undone), and in another
    order each round. Nodes of the same name become one, edges within it vanish and equal edges become one, so the
    tables shrink by a share each round and all rounds together move a small multiple of the input. Each name keeps
    the least node behind it; once no edge is left, that node is handed back from round to round.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    now, rounds = ends.where("a <> b"), []
    lows: DataFrame | None = None
    for i in range(max_rounds):
        name = lambda c: F.xxhash64(F.lit(i), F.col(c))  # noqa: B023, E731
        near = _both(now).groupBy("a").agg(F.min(name("b")).alias("m"), F.count("*").alias("n"))
        taken = scratch.keep(near.select("a", F.least("m", name("a")).alias("r"), "n"))
        told = taken.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
        if not told["n"]:
            break
        known = taken.withColumn("low", F.col("a")) if lows is None else taken.join(lows, "a")
        lows = scratch.keep(known.groupBy(F.col("r").alias("a")).agg(F.min("low").alias("low"), F.count("*").alias("n")))
        rounds.append((taken, lows))
        lows = lows.select("a", "low")
        hot = hot_keys(_both(now), "a", told["n"], most=told["most"])
        names = taken.select("a", "r")
        first = dealt_join(now, names, "a", hot, F.col("b")).select(F.col("b").alias("a"), F.col("r").alias("x"))
        both = dealt_join(first, names, "a", hot, F.col("x")).select("x", F.col("r").alias("y")).where("x <> y")
        grown = scratch.keep(both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        if i:
            scratch.drop(now)
        now = grown
    else:
        raise RuntimeError("components did not settle")
    # A name that met no more edges is a component of its own; the others ask the round behind.
    done: DataFrame | None = None
    for taken, low in reversed(rounds):
        known = low.select(F.col("a").alias("r"), "low", "n")
        if done is not None:
            known = known.join(done.select(F.col("node").alias("r"), "component"), "r", "left").select("r", F.coalesce("component", "low").alias("low"), "n")
        told = low.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
        hot = hot_keys(taken, "r", told["n"], most=told["most"])
        done = scratch.keep(dealt_join(taken.select("a", "r"), known.select("r", "low"), "r", hot, F.col("a")).select(F.col("a").alias("node"), F.col("low").alias("component")))
    loops = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    if done is None:
        return loops.withColumn("component", F.col("node"))
    return done.unionByName(loops.join(done.select("node"), "node", "left_anti").withColumn("component", F.col("node")))
