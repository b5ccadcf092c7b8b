"""Assembly statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from helixplan.operators.graph import Graph


def length_histogram(rows: DataFrame, length: str = "len") -> DataFrame:
    return rows.groupBy(F.col(length).cast("long").alias("len")).agg(F.count("*").alias("cnt"))


def edge_lengths(g: Graph) -> DataFrame:
    return g.edges.select(F.length("seq").cast("long").alias("len"))


def component_sizes(g: Graph, components: DataFrame) -> DataFrame:
    """``component, nodes, total_len``: nodes, and bases of the edges that start in it."""
    outs = g.edges.groupBy(F.col("src").alias("node_id")).agg(F.sum(F.length("seq").cast("long")).alias("n"))
    return components.join(outs, "node_id", "left").groupBy("component").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_len"))


def component_histogram(sizes: DataFrame, by: tuple[str, ...] = ("nodes",)) -> DataFrame:
    return sizes.groupBy(*by).agg(F.count("*").alias("components"))


def largest_component(sizes: DataFrame) -> DataFrame:
    """The component with most nodes, the least id among equals."""
    return sizes.orderBy(F.desc("nodes"), "component").limit(1)


def _running(histogram: DataFrame) -> DataFrame:
    # One row per distinct length, not per sequence.
    upto = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.select("len", "cnt", F.sum("cnt").over(upto).alias("rows_upto"), F.sum(F.col("len") * F.col("cnt")).over(upto).alias("len_upto"))


def n50(histogram: DataFrame) -> DataFrame:
    """``len, cnt`` at which the running total of ascending lengths crosses half of all."""
    total = histogram.agg(F.sum(F.col("len") * F.col("cnt")).alias("total"))
    run = _running(histogram).crossJoin(total)  # one row
    before = F.col("len_upto") - F.col("len") * F.col("cnt")
    return run.where((2 * before < F.col("total")) & (F.col("total") <= 2 * F.col("len_upto"))).select("len", "cnt")


def median_length(histogram: DataFrame) -> DataFrame:
    """The upper median: of n ascending lengths the one at index n div 2."""
    total = histogram.agg(F.sum("cnt").alias("n"))
    return _running(histogram).crossJoin(total).where("rows_upto > n div 2 and rows_upto - cnt <= n div 2").select(F.col("len").alias("median_len"))


def count_at_least(histogram: DataFrame, least: int = 100) -> DataFrame:
    return histogram.where(F.col("len") >= least).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("cnt"))


def contig_stats(lengths: DataFrame, above: int = 200) -> DataFrame:
    """One row: ``contigs, total_len, max_len, median_len, n50_weighted`` of lengths over ``above``."""
    long = length_histogram(lengths.where(F.col("len") > above))
    sums = long.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("contigs"), F.coalesce(F.sum(F.col("len") * F.col("cnt")), F.lit(0)).cast("long").alias("total_len"), F.max("len").alias("max_len"))
    return sums.join(median_length(long), how="left").join(n50(long).select(F.col("len").alias("n50_weighted")), how="left")


def graph_counts(g: Graph) -> DataFrame:
    return g.nodes.agg(F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)).alias("total_len")))
