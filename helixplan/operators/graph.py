"""The sequence graph: build, edit, simplify, position map, components.

``nodes``: ``node_id, kmer``; ``edges``: ``edge_id, src, dst, seq``. Both strands are stored, so the edge set is
closed under reverse complement. A node of a fresh graph is named by its k-mer and an edge by its start and
first base (``start:base``), which are unique; ids never depend on the order of execution. ``seq`` leaves out
the start k-mer and holds the last bases of the end k-mer, so its length counts k-mer steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from helixplan.functions.keys import MOST, keys
from helixplan.operators import kmers as K
from helixplan.plans.components import connected_components, contracted_components
from helixplan.plans.iterate import pointer_double
from helixplan.plans.runtime import Scratch

#: Distinct k-mers of a reference that may be broadcast.
BROADCAST_KMERS = 200_000


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    k: int

    def kept(self, scratch: Scratch) -> Graph:
        return Graph(scratch.keep(self.nodes), scratch.keep(self.edges), self.k)


def build_graph(solid: DataFrame, k: int, scratch: Scratch) -> Graph:
    """Compacted graph of solid canonical k-mers (``kmer``, or ``key`` as ``count_keys`` gives it): branches and tips are nodes, unary paths between them edges.

    Isolated k-mers and cycles without a branch vanish.
    """
    coded = keys(k)
    one = solid if "key" in solid.columns else solid.select(coded.encode(F.col("kmer")).alias("key"))
    marked = scratch.keep(K.canonical_degrees(one, k).where("in_deg > 0 or out_deg > 0").select("key", "terminal"))
    steps = scratch.keep(K.key_steps(marked, k))
    nodes = K.oriented_keys(marked.where("terminal"), k).select(coded.decode(F.col("key")).alias("kmer")).select(F.col("kmer").alias("node_id"), "kmer")
    # An inner k-mer points to the one before it; the first of a path has none.
    inner = steps.where("not tb").select(F.col("b").alias("id"), F.when(~F.col("ta"), F.col("a")).alias("up"))
    placed = pointer_double(inner, scratch)
    path = placed.groupBy("root").agg(F.max(F.struct("dist", "id"))["id"].alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dist", coded.last(F.col("id")).alias("c")))), lambda x: x["c"]), "").alias("bases"))
    begin = steps.where("ta and not tb").select("a", F.col("b").alias("root"))
    finish = steps.where("tb and not ta").select(F.col("a").alias("last"), F.col("b").alias("dst"))
    long = path.join(begin, "root").join(finish, "last").select(F.col("a").alias("src"), "dst", F.concat("bases", coded.last(F.col("dst"))).alias("seq"))
    short = steps.where("ta and tb").select(F.col("a").alias("src"), F.col("b").alias("dst"), coded.last(F.col("b")).alias("seq"))
    found = long.unionByName(short).select(coded.decode(F.col("src")).alias("src"), coded.decode(F.col("dst")).alias("dst"), "seq")
    edges = found.select(F.concat_ws(":", "src", F.left("seq", F.lit(1))).alias("edge_id"), "src", "dst", "seq")
    return Graph(nodes, edges, k).kept(scratch)


def adjacency(g: Graph) -> DataFrame:
    """``node_id, in_edges`` (sorted ids) and ``out_edges`` (first base to id)."""
    ins = g.edges.groupBy(F.col("dst").alias("node_id")).agg(F.array_sort(F.collect_list("edge_id")).alias("in_edges"))
    outs = g.edges.groupBy(F.col("src").alias("node_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.left("seq", F.lit(1)), "edge_id")))).alias("out_edges"))
    return g.nodes.select("node_id").join(ins, "node_id", "left").join(outs, "node_id", "left")


def with_node(g: Graph, node_id: str, kmer: str) -> Graph:
    one = g.nodes.sparkSession.createDataFrame([(node_id, kmer)], "node_id string, kmer string")
    return Graph(g.nodes.where(F.col("node_id") != node_id).unionByName(one), g.edges, g.k)


def with_edge(g: Graph, src: str, dst: str, seq: str) -> Graph:
    """Adds an edge; one of the same start and first base gives way."""
    name = f"{src}:{seq[:1]}"
    one = g.edges.sparkSession.createDataFrame([(name, src, dst, seq)], "edge_id string, src string, dst string, seq string")
    clash = (F.col("src") == src) & (F.left("seq", F.lit(1)) == seq[:1])
    return Graph(g.nodes, g.edges.where(~clash & (F.col("edge_id") != name)).unionByName(one), g.k)


def without_nodes(g: Graph, gone: DataFrame) -> Graph:
    """Drops nodes by ``node_id``; edges stay."""
    return Graph(g.nodes.join(gone.select("node_id"), "node_id", "left_anti"), g.edges, g.k)


def without_edges(g: Graph, gone: DataFrame) -> Graph:
    return Graph(g.nodes, g.edges.join(gone.select("edge_id"), "edge_id", "left_anti"), g.k)


def replace_ends(g: Graph, changes: DataFrame) -> Graph:
    """``changes``: ``edge_id, new_src, new_dst``; a null end stays."""
    moved = g.edges.join(changes.select("edge_id", "new_src", "new_dst"), "edge_id", "left")
    return Graph(g.nodes, moved.select("edge_id", F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "seq"), g.k)


def retain(g: Graph, nodes: DataFrame) -> Graph:
    """Only ``node_id`` of ``nodes``, and edges with both ends among them."""
    keep = nodes.select("node_id").distinct()
    edges = g.edges.join(keep.withColumnRenamed("node_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return Graph(g.nodes.join(keep, "node_id", "left_semi"), edges.select("edge_id", "src", "dst", "seq"), g.k)


def node_degrees(g: Graph) -> DataFrame:
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    sums = ends.groupBy("node_id").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))
    return g.nodes.join(sums, "node_id", "left").select("node_id", "kmer", F.coalesce("in_deg", F.lit(0)).alias("in_deg"), F.coalesce("out_deg", F.lit(0)).alias("out_deg"))


def edge_ends(g: Graph) -> DataFrame:
    """Each edge with the k-mers of its nodes, the start's out-degree and the end's in-degree."""
    d = node_degrees(g)
    start = d.select(F.col("node_id").alias("src"), F.col("kmer").alias("src_kmer"), F.col("out_deg").alias("src_out"))
    end = d.select(F.col("node_id").alias("dst"), F.col("kmer").alias("dst_kmer"), F.col("in_deg").alias("dst_in"))
    return g.edges.join(start, "src").join(end, "dst").select("edge_id", "src_kmer", "src_out", "dst_kmer", "dst_in")


def simplify(g: Graph, scratch: Scratch) -> Graph:
    """Drops isolated nodes and joins the two edges of every node with one in and one out; cycles of such nodes vanish.

    A joined edge keeps the name of its first part.
    """
    marked = scratch.keep(node_degrees(g))
    through = marked.where("in_deg = 1 and out_deg = 1").select("node_id")
    before = g.edges.select(F.col("dst").alias("node_id"), F.col("edge_id").alias("up")).join(through, "node_id", "left_semi")
    links = g.edges.select(F.col("edge_id").alias("id"), F.col("src").alias("node_id")).join(before, "node_id", "left").select("id", "up")
    placed = pointer_double(links, scratch)
    parts = placed.join(g.edges.withColumnRenamed("edge_id", "id"), "id")
    joined = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("dist", "src", "dst", "seq"))).alias("p"))
    edges = joined.select(F.col("root").alias("edge_id"), F.col("p")[0]["src"].alias("src"), F.element_at("p", -1)["dst"].alias("dst"), F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))
    nodes = marked.where("(in_deg > 0 or out_deg > 0) and not (in_deg = 1 and out_deg = 1)").select("node_id", "kmer")
    return Graph(nodes, edges, g.k).kept(scratch)


def positions(g: Graph) -> DataFrame:
    """``kmer, kind, id, dist``: nodes at 0 (``N``), inner k-mers of edges at 1 to length - 1 (``E``)."""
    inner = g.edges.where(F.length("seq") > 1).join(g.nodes.select(F.col("node_id").alias("src"), "kmer"), "src")
    whole = F.concat("kmer", "seq")
    rows = inner.select(F.col("edge_id").alias("id"), whole.alias("w"), F.explode(F.sequence(F.lit(1), F.length("seq") - 1)).alias("dist"))
    return rows.select(F.expr(f"substr(w, dist + 1, {g.k})").alias("kmer"), F.lit("E").alias("kind"), "id", "dist").unionByName(g.nodes.select("kmer", F.lit("N").alias("kind"), F.col("node_id").alias("id"), F.lit(0).alias("dist")))


def _plain(k: int) -> Column:
    """Whether a node is named by a k-mer of ``k`` bases, its own."""
    return F.coalesce((F.col("node_id") == F.col("kmer")) & F.col("kmer").rlike(f"^[ACGT]{{{k}}}$"), F.lit(False))


def packable(g: Graph) -> bool:
    """Whether all k-mers of the graph can be packed keys: bases alone, no more than a long holds."""
    odd = lambda c, n: ~F.coalesce(F.col(c).rlike(f"^[ACGT]{n}$"), F.lit(False))
    return g.k <= MOST and g.nodes.where(odd("kmer", f"{{{g.k}}}")).isEmpty() and g.edges.where(odd("seq", "*")).isEmpty()


def components(g: Graph, scratch: Scratch) -> DataFrame:
    """``node_id, component``: the smallest node id that is weakly connected; a node without edges is its own.

    Where every node is named by its k-mer, as in a fresh graph, ends are packed keys, which order like their texts.
    """
    if g.k <= MOST and g.nodes.where(~_plain(g.k)).isEmpty():
        coded = keys(g.k)
        ends = g.edges.select(coded.encode(F.col("src")).alias("a"), coded.encode(F.col("dst")).alias("b"))
        found = contracted_components(scratch.keep(ends), "a", "b", scratch)
        every = g.nodes.select(coded.encode(F.col("kmer")).alias("node")).join(found, "node", "left")
        return every.select(coded.decode(F.col("node")).alias("node_id"), coded.decode(F.coalesce("component", "node")).alias("component"))
    found = connected_components(g.edges, "src", "dst", scratch).withColumnRenamed("node", "node_id")
    return g.nodes.select("node_id").join(found, "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))


def neighbours(g: Graph, node_id: str, count: int, scratch: Scratch) -> DataFrame:
    """Breadth-first over edges of both directions until ``count`` nodes are seen; of the last layer the smallest ids.

    ``node_id, hop``. The result has ``count`` rows at most.
    """
    both = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(g.edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    seen = scratch.keep(g.nodes.where(F.col("node_id") == node_id).select("node_id", F.lit(0).alias("hop")))
    have, hop = seen.count(), 0
    while have < count:
        layer = both.join(seen.where(F.col("hop") == hop).select(F.col("node_id").alias("a")), "a").select(F.col("b").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        grown = scratch.keep(seen.unionByName(layer.orderBy("node_id").limit(count - have).withColumn("hop", F.lit(hop + 1))))
        now, hop = grown.count(), hop + 1
        if now == have:
            break
        seen, have = grown, now
    return seen


def parallel_bubbles(g: Graph) -> DataFrame:
    """Edges to drop: of parallel edges in the order A, G, C, T each that is like an earlier kept one (``5 * |a - b| < max(a, b)``)."""
    place = F.instr(F.lit("AGCT"), F.left("seq", F.lit(1)))
    sides = g.edges.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "edge_id", F.length("seq").cast("long").alias("len")))).alias("e")).where(F.size("e") > 1)
    kind = "array<struct<at:int,edge_id:string,len:bigint>>"
    like = lambda a, b: 5 * F.abs(a["len"] - b["len"]) < F.greatest(a["len"], b["len"])
    kept = F.aggregate("e", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: like(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return sides.select(F.explode(F.array_except(F.transform("e", lambda x: x["edge_id"]), F.transform(kept, lambda x: x["edge_id"]))).alias("edge_id"))


def remove_bubbles(g: Graph) -> Graph:
    return without_edges(g, parallel_bubbles(g))


def broken_edges(g: Graph) -> DataFrame:
    """Rows that violate the graph's invariants (none in a sound graph)."""
    lost = g.edges.join(g.nodes.select(F.col("node_id").alias("src")), "src", "left_anti").unionByName(g.edges.join(g.nodes.select(F.col("node_id").alias("dst")), "dst", "left_anti"), allowMissingColumns=True).select("edge_id", F.lit("end without node").alias("fault"))
    twice = g.edges.groupBy("src", F.left("seq", F.lit(1))).agg(F.count("*").alias("n"), F.min("edge_id").alias("edge_id")).where("n > 1").select("edge_id", F.lit("base taken twice").alias("fault"))
    a, b = g.nodes.select(F.col("node_id").alias("src"), F.col("kmer").alias("ka")), g.nodes.select(F.col("node_id").alias("dst"), F.col("kmer").alias("kb"))
    wrong = g.edges.join(a, "src").join(b, "dst").where(F.right(F.concat("ka", "seq"), F.lit(g.k)) != F.col("kb")).select("edge_id", F.lit("wrong end").alias("fault"))
    return lost.unionByName(twice).unionByName(wrong)


def missing_kmers(g: Graph, lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Valid k-mers of reference lines that no position of the graph has."""
    from helixplan.functions import seq as S

    asked = lines.where(~F.col(line_col).startswith(">")).select(F.explode(S.windows(F.col(line_col), g.k)).alias("kmer")).where(S.is_valid(F.col("kmer"))).distinct()
    held = positions(g).select("kmer")
    if asked.count() <= BROADCAST_KMERS:
        # A short reference goes to the graph, whose k-mers then stay where they are.
        held = F.broadcast(held.join(F.broadcast(asked), "kmer", "left_semi").distinct())
    return asked.join(held, "kmer", "left_anti")
