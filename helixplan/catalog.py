"""Registered queries of the sequence-graph engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixplan import oracles
from helixplan.functions import seq as S
from helixplan.operators import graph as G, kmers as K, resolve as R, sinks, stats, walk as W
from helixplan.params import AssemblyParams
from helixplan.plans.runtime import Scratch, file_stamp
from helixplan.sources import packed, readers
from helixplan.sources.kmer_store import KmerStore
from helixplan.sources.adapters import document_pairs

#: Long edges and many components at 21; many repeated k-mers at 11. The cutoff suits the test tables' low coverage.
PARAMS = AssemblyParams(k=21, cutoff=5)
SHORT_K, CONTIG_ABOVE, REACH, TAKE_FIRST, RESTORE_DEPTH = 11, 20, 60, 100 << 32, 4
FLAGSHIP = "graph_nodes"

T = TypeVar("T")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES = oracles.build(PARAMS.k, SHORT_K, PARAMS.cutoff, CONTIG_ABOVE, TAKE_FIRST, RESTORE_DEPTH)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sequences(_table(spark, sf_dir, "documents"))


def _solid(spark: SparkSession, sf_dir: str, k: int = PARAMS.k) -> DataFrame:
    return K.solid_kmers(K.count_kmers(_seqs(spark, sf_dir), k), PARAMS.min_count)


_SHARED: dict[tuple, tuple[Scratch, object]] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[Scratch], T]) -> T:
    """What ``make`` builds out of the documents, as tables that later queries of the session read.

    They are built anew for another input or application, and if they were cleared. An input counts as the same
    while its folder, bytes, number of files and time of change are.
    """
    key = (spark.sparkContext.applicationId, name, sf_dir, *file_stamp(spark, f"{sf_dir}/documents.parquet"))
    if key not in _SHARED or not _SHARED[key][0].exists():
        scratch = Scratch(spark, name)
        _SHARED[key] = scratch, make(scratch)
    return _SHARED[key][1]


def _graph(spark: SparkSession, sf_dir: str) -> G.Graph:
    return _once(spark, sf_dir, "graph", lambda scratch: G.build_graph(K.solid_kmers(K.count_keys(_seqs(spark, sf_dir), PARAMS.k), PARAMS.min_count), PARAMS.k, scratch))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pairs(_table(spark, sf_dir, "documents"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "components", lambda scratch: scratch.keep(G.components(_graph(spark, sf_dir), scratch)))


def _evidence(spark: SparkSession, sf_dir: str) -> W.PairEvidence:
    return _once(spark, sf_dir, "evidence", lambda scratch: W.pair_evidence(_pairs(spark, sf_dir), _graph(spark, sf_dir), PARAMS, scratch))


def _register(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _on_graph(f: Callable[[G.Graph, Scratch], DataFrame]) -> Callable[[G.Graph, Scratch], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(_graph(spark, sf_dir), Scratch(spark, f.__name__))

    QUERIES[f.__name__] = query
    return f


def _on_parts(f: Callable[[G.Graph, DataFrame], DataFrame]) -> Callable[[G.Graph, DataFrame], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(_graph(spark, sf_dir), _parts(spark, sf_dir))

    QUERIES[f.__name__] = query
    return f


def _on_pairs(f: Callable[[G.Graph, DataFrame, Scratch], DataFrame]) -> Callable[[G.Graph, DataFrame, Scratch], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(_graph(spark, sf_dir), _pairs(spark, sf_dir), Scratch(spark, f.__name__))

    QUERIES[f.__name__] = query
    return f


def _on_evidence(f: Callable[[G.Graph, W.PairEvidence, Scratch], DataFrame]) -> Callable[[G.Graph, W.PairEvidence, Scratch], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(_graph(spark, sf_dir), _evidence(spark, sf_dir), Scratch(spark, f.__name__))

    QUERIES[f.__name__] = query
    return f


@_register
def seq_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return _seqs(spark, sf_dir).select("seq_id", S.complement(s).alias("complement"), F.reverse(s).alias("reversed"), S.revcomp(s).alias("revcomp"))


@_register
def seq_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seqs(spark, sf_dir).select("seq_id", S.canonical(F.col("seq")).alias("canonical"))


@_register
def seq_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return _seqs(spark, sf_dir).select(
        "seq_id", S.take(s, 10).alias("taken"), S.drop(s, 10).alias("dropped"), S.subseq(s, 5, 15).alias("part"), S.base_at(s, 0).alias("head"), F.length(s).cast("long").alias("len"), S.append(S.prepend(F.lit("A"), s), F.lit("T")).alias("grown")
    )


@_register
def valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), S.valid_prefix(letters).alias("prefix"))


@_register
def mate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@_register
def kmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kmer_windows(_seqs(spark, sf_dir), PARAMS.k, keep=("seq_id",), with_pos=True)


@_register
def seq_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solid(spark, sf_dir).select("kmer", S.pack(F.col("kmer")).alias("packed")).withColumn("unpacked", S.unpack(F.col("packed"), PARAMS.k))


@_register
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.count_kmers(_seqs(spark, sf_dir), SHORT_K)


@_register
def kmer_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solid(spark, sf_dir)


@_register
def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.spectrum(K.count_kmers(_seqs(spark, sf_dir), SHORT_K))


@_register
def kmer_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.distinct_kmers(_seqs(spark, sf_dir), PARAMS.k)


@_register
def conversion_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.conversion_counters(_pairs(spark, sf_dir), PARAMS.k)


@_register
def kmer_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.degrees(K.oriented(_solid(spark, sf_dir)), PARAMS.k)


@_register
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.degrees(K.oriented(_solid(spark, sf_dir)), PARAMS.k).where("terminal").select("kmer")


@_register
def kmer_oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.oriented(_solid(spark, sf_dir))


@_register
def kmer_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.successors(K.oriented(_solid(spark, sf_dir)), PARAMS.k)


@_register
def kmer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the benchmark's k-mers among the documents' solid ones."""
    asked = K.kmer_windows(S.sequences(_table(spark, sf_dir, "benchmark"), "item_id"), PARAMS.k)
    return K.lookup(asked, _solid(spark, sf_dir))


@_register
def pair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.packed_pairs(_pairs(spark, sf_dir)).select("pair_id", F.hex("record").alias("record"))


@_on_graph
def graph_edges(g: G.Graph, scratch: Scratch) -> DataFrame:
    return g.edges


@_on_graph
def graph_counts(g: G.Graph, scratch: Scratch) -> DataFrame:
    return stats.graph_counts(g)


@_on_graph
def graph_adjacency(g: G.Graph, scratch: Scratch) -> DataFrame:
    return G.adjacency(g).select("node_id", F.array_join("in_edges", ",").alias("in_edges"), F.array_join(F.array_sort(F.map_values("out_edges")), ",").alias("out_edges"))


@_on_graph
def edge_ends(g: G.Graph, scratch: Scratch) -> DataFrame:
    return G.edge_ends(g)


@_on_graph
def edge_labels(g: G.Graph, scratch: Scratch) -> DataFrame:
    return g.edges.select("edge_id", S.edge_label(F.col("seq")).alias("label"))


@_on_graph
def simplified_edges(g: G.Graph, scratch: Scratch) -> DataFrame:
    """The graph without its edges of one base, compacted."""
    return G.simplify(G.without_edges(g, g.edges.where(F.length("seq") < 2)), scratch).edges


@_on_graph
def edge_len_hist(g: G.Graph, scratch: Scratch) -> DataFrame:
    return stats.length_histogram(stats.edge_lengths(g))


@_on_graph
def n50(g: G.Graph, scratch: Scratch) -> DataFrame:
    return stats.n50(stats.length_histogram(stats.edge_lengths(g)))


@_on_graph
def median_length(g: G.Graph, scratch: Scratch) -> DataFrame:
    return stats.median_length(stats.length_histogram(stats.edge_lengths(g)))


@_on_graph
def long_edge_count(g: G.Graph, scratch: Scratch) -> DataFrame:
    return stats.count_at_least(stats.length_histogram(stats.edge_lengths(g)), 100)


@_on_graph
def contig_stats(g: G.Graph, scratch: Scratch) -> DataFrame:
    return stats.contig_stats(stats.edge_lengths(g), CONTIG_ABOVE)


@_on_parts
def graph_components(g: G.Graph, parts: DataFrame) -> DataFrame:
    return parts


@_on_parts
def component_hist(g: G.Graph, parts: DataFrame) -> DataFrame:
    return stats.component_histogram(stats.component_sizes(g, parts))


@_on_parts
def component_len_hist(g: G.Graph, parts: DataFrame) -> DataFrame:
    return stats.component_histogram(stats.component_sizes(g, parts), ("total_len",))


@_on_parts
def component_size_len_hist(g: G.Graph, parts: DataFrame) -> DataFrame:
    return stats.component_histogram(stats.component_sizes(g, parts), ("nodes", "total_len"))


@_on_parts
def largest_component(g: G.Graph, parts: DataFrame) -> DataFrame:
    return stats.largest_component(stats.component_sizes(g, parts))


@_on_parts
def retained_edges(g: G.Graph, parts: DataFrame) -> DataFrame:
    return G.retain(g, parts.join(stats.largest_component(stats.component_sizes(g, parts)), "component", "left_semi")).edges


@_on_graph
def kmer_positions(g: G.Graph, scratch: Scratch) -> DataFrame:
    return G.positions(g)


@_on_pairs
def pair_positions(g: G.Graph, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    flat = [F.col(f"pos{i}.{c}").alias(f"{c}{i}") for i in (1, 2) for c in ("kind", "id", "dist")]
    return W.pair_positions(pairs, g, PARAMS).select("pair_id", "orient", *flat)


@_on_pairs
def explained_pairs(g: G.Graph, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    return W.explained(W.pair_positions(pairs, g, PARAMS), PARAMS)


@_on_pairs
def unexplained_pairs(g: G.Graph, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    placed = scratch.keep(W.pair_positions(pairs, g, PARAMS))
    return W.unexplained(placed, PARAMS).select("pair_id", "orient").distinct()


@_on_graph
def reach_min_dist(g: G.Graph, scratch: Scratch) -> DataFrame:
    branches = g.edges.groupBy(F.col("src").alias("target")).count().where("count > 1").select("target")
    return W.reach(g, branches, REACH, scratch)


@_on_evidence
def pair_support(g: G.Graph, evidence: W.PairEvidence, scratch: Scratch) -> DataFrame:
    return evidence.support


@_on_evidence
def bad_pairs(g: G.Graph, evidence: W.PairEvidence, scratch: Scratch) -> DataFrame:
    return W.bad_pairs(evidence)


@_on_evidence
def node_matrix(g: G.Graph, evidence: W.PairEvidence, scratch: Scratch) -> DataFrame:
    return sinks.matrix_lines(R.node_matrix(g, evidence.support))


@_on_evidence
def node_split(g: G.Graph, evidence: W.PairEvidence, scratch: Scratch) -> DataFrame:
    return R.split_ports(g, evidence.support, PARAMS.cutoff, scratch)


@_on_evidence
def split_edges(g: G.Graph, evidence: W.PairEvidence, scratch: Scratch) -> DataFrame:
    return R.split_nodes(g, evidence.support, PARAMS.cutoff, scratch).edges


@_on_pairs
def resolved_edges(g: G.Graph, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    return R.resolve(pairs, g, PARAMS, scratch).edges


@_on_graph
def bubbles(g: G.Graph, scratch: Scratch) -> DataFrame:
    return G.parallel_bubbles(g)


@_register
def reference_missing_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are those of a FASTA text: a header and the sequence."""
    lines = S.sequences(_table(spark, sf_dir, "benchmark"), "item_id").select(F.explode(F.array(F.concat_ws("", F.lit(">"), F.col("seq_id").cast("string")), F.col("seq"))).alias("value"))
    return G.missing_kmers(_graph(spark, sf_dir), lines)


@_on_graph
def dot_lines(g: G.Graph, scratch: Scratch) -> DataFrame:
    return sinks.dot_lines(g)


@_on_graph
def fasta_lines(g: G.Graph, scratch: Scratch) -> DataFrame:
    return sinks.fasta(sinks.contigs(g, scratch))


@_on_graph
def graph_neighbours(g: G.Graph, scratch: Scratch) -> DataFrame:
    """The 20 nodes nearest to the node with most out-edges."""
    root = g.edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()
    return G.neighbours(g, root["src"] if root else "", 20, scratch)


@_on_graph
def invariants(g: G.Graph, scratch: Scratch) -> DataFrame:
    return G.broken_edges(g)


def _read_records(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """Documents with 72 bases or more as four-line records, written as text files and read back.

    After each G a T is written as N; A and G have quality 40, C 20 and T 2. Every third document's quality stops at 50.
    """
    seqs = _seqs(spark, sf_dir).where("seq_id is not null and length(seq) >= 72")
    bases, quality = F.left("seq", F.lit(72)), F.translate(F.left("seq", F.lit(72)), "ACGT", "I5I#")
    short = F.when(F.col("seq_id") % 3 == 0, F.left(quality, F.lit(50))).otherwise(quality)
    path = scratch.folder()
    seqs.select(F.concat(F.lit("@"), F.col("seq_id").cast("string"), F.lit("\n"), F.replace(bases, F.lit("GT"), F.lit("GN")), F.lit("\n+\n"), short).alias("value")).write.text(path)
    return readers.read_fastq(spark, path, scratch)


@_register
def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_records(spark, sf_dir, Scratch(spark, "fastq")).select("header", "bases", "qual")


@_register
def fastq_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both mates of each record, cut at 36, trimmed by quality after 10 bases, up to the first N."""
    records = _read_records(spark, sf_dir, Scratch(spark, "fastq-mates"))
    return readers.mates(records, 36, quality_from=10).join(records.select("pair_id", "header"), "pair_id").select("header", "mate1", "mate2")


@_register
def packed_pairs_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pairs of a document as one content, unpacked again; ``place`` counts them."""
    records = sinks.packed_pairs(_pairs(spark, sf_dir)).select(F.shiftright("pair_id", 32).cast("string").alias("path"), F.struct("pair_id", F.hex("record").alias("r")).alias("e"))
    scratch = Scratch(spark, "packed")
    files = scratch.keep(records.groupBy("path").agg(F.unhex(F.array_join(F.sort_array(F.collect_list("e"))["r"], "")).alias("content")))
    rows = readers.unpack_pairs(files, scratch)
    return rows.select("path", F.expr(f"pair_id & {(1 << readers.FILE_BITS) - 1}").alias("place"), "mate1", "mate2")


@_register
def packed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs written to packed files with an index and read back by several tasks a file; ``place`` counts them over all files."""
    path = Scratch(spark, "packed-files").folder()
    packed.write_packed(_pairs(spark, sf_dir), path, every=256)
    return packed.read_packed(spark, path, split=4096).select(F.col("pair_id").alias("place"), "mate1", "mate2")


@_register
def pair_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "meta").folder()
    sinks.write_pairs(_pairs(spark, sf_dir), path)
    pairs, meta = readers.read_pairs(spark, path)
    return meta.crossJoin(pairs.agg(F.min("pair_id").alias("first_id"), F.max("pair_id").alias("last_id"))).withColumnsRenamed({"count": "pairs", "insert": "insert_len"})  # one row each


@_register
def fasta_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of the benchmark, a file each, with a header and lines of 60."""
    path = Scratch(spark, "fasta").folder()
    seqs = S.sequences(_table(spark, sf_dir, "benchmark"), "item_id")
    seqs.select("seq_id", F.concat(F.lit(">item\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value")).write.partitionBy("seq_id").text(path)
    return readers.read_fasta(spark, path).select("seq")


@_on_graph
def fasta_lines_read(g: G.Graph, scratch: Scratch) -> DataFrame:
    path = scratch.folder()
    sinks.write_fasta(sinks.fasta(sinks.contigs(g, scratch)), path)
    return readers.read_fasta_lines(g.edges.sparkSession, path)


@_on_graph
def graph_read(g: G.Graph, scratch: Scratch) -> DataFrame:
    path = scratch.folder()
    sinks.write_graph(g, path)
    return G.edge_ends(readers.read_graph(g.edges.sparkSession, path, g.k))


@_on_graph
def histogram_read(g: G.Graph, scratch: Scratch) -> DataFrame:
    """The edge lengths' histogram as text, parsed again. One line, with an entry per length."""
    entry = F.concat_ws(" -> ", F.col("len").cast("string"), F.col("cnt").cast("string"))
    line = stats.length_histogram(stats.edge_lengths(g)).agg(F.concat(F.lit("Map("), F.array_join(F.collect_list(entry), ", "), F.lit(")")).alias("value"))
    path = scratch.folder()
    line.write.text(path)
    return readers.parse_histogram(g.edges.sparkSession.read.text(path))


@_on_pairs
def first_pair_positions(g: G.Graph, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Positions of the pairs below an id, the feature of ``take_first``."""
    flat = [F.col(f"pos{i}.{c}").alias(f"{c}{i}") for i in (1, 2) for c in ("kind", "id", "dist")]
    return W.pair_positions(pairs, g, PARAMS.but(take_first=TAKE_FIRST)).select("pair_id", "orient", *flat)


def _edited(g: G.Graph) -> G.Graph:
    """A node with a loop more; edges of one base end there; nodes without out-edges go."""
    more = G.with_edge(G.with_node(g, "extra", "A" * g.k), "extra", "extra", "ACGT")
    moved = G.replace_ends(more, g.edges.where(F.length("seq") == 1).select("edge_id", F.lit(None).cast("string").alias("new_src"), F.lit("extra").alias("new_dst")))
    return G.without_nodes(moved, G.node_degrees(moved).where("out_deg = 0").select("node_id"))


@_on_graph
def edited_edges(g: G.Graph, scratch: Scratch) -> DataFrame:
    return _edited(g).edges


@_on_graph
def edited_nodes(g: G.Graph, scratch: Scratch) -> DataFrame:
    return _edited(g).nodes


@_register
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.register_sql(spark)
    text = "SELECT s.seq_id, w.pos, w.kmer, revcomp(w.kmer) AS back, canonical_kmer(w.kmer) AS least, valid_prefix(concat(w.kmer, 'N', w.kmer)) AS prefix FROM {seqs} s, LATERAL kmers(s.seq, {k}) w"
    return spark.sql(text, seqs=_seqs(spark, sf_dir), k=PARAMS.k)


@_register
def restored_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare k-mers within four steps between solid ones."""
    scratch = Scratch(spark, "restored")
    return K.restore(scratch.keep(K.count_keys(_seqs(spark, sf_dir), PARAMS.k)), PARAMS.min_count, PARAMS.k, RESTORE_DEPTH, scratch)


@_register
def fasta_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one FASTA text with lines of 60, read in splits and counted by windows over its lines."""
    scratch = Scratch(spark, "fasta-kmers")
    path = scratch.folder()
    text = F.concat(F.lit(">"), F.coalesce(F.col("seq_id").cast("string"), F.lit("")), F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    _seqs(spark, sf_dir).select(text.alias("value")).write.text(path)
    return K.count_kmers(readers.read_fasta_chunks(spark, path, PARAMS.k, scratch, lines_each=512), PARAMS.k)


def _two_halves(spark: SparkSession, sf_dir: str) -> tuple[KmerStore, DataFrame]:
    """A store of the counts of every other document, and the counts of the rest as its delta."""
    scratch = Scratch(spark, "store")
    seqs = _seqs(spark, sf_dir)
    first = F.coalesce(F.col("seq_id") % 2, F.lit(0)) == 0
    return KmerStore(spark, scratch).create(K.count_kmers(seqs.where(first), SHORT_K)), K.count_kmers(seqs.where(~first), SHORT_K)


@_register
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, delta = _two_halves(spark, sf_dir)
    return store.merge(delta).rows()


@_register
def store_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, delta = _two_halves(spark, sf_dir)
    return store.overwrite(delta).rows()


@_register
def store_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, delta = _two_halves(spark, sf_dir)
    return store.insert(delta).rows()


@_on_graph
def broken_graph(g: G.Graph, scratch: Scratch) -> DataFrame:
    """The faults of a graph broken on purpose: nodes without out-edges are gone, edges of two bases or more end in another base."""
    ends = g.edges.select(F.col("src").alias("node_id")).distinct()
    base = F.when(F.length("seq") >= 2, F.concat(F.expr("left(seq, length(seq) - 1)"), S.complement(F.right("seq", F.lit(1))))).otherwise(F.col("seq"))
    return G.broken_edges(G.Graph(g.nodes.join(ends, "node_id", "left_semi"), g.edges.withColumn("seq", base), g.k))


@_register
def loaded_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra by parameters of a file that is written and read back: the k-mer length and least support are those of the file."""
    path = Scratch(spark, "params").folder()
    spark.createDataFrame([('{"k": 13, "min_count": 2}',)], "value string").coalesce(1).write.text(path)
    p = AssemblyParams.load(spark, path)
    return K.spectrum(K.solid_kmers(K.count_kmers(_seqs(spark, sf_dir), p.k), p.min_count))


@_register
def counted_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversion counters that the tasks which write the pairs keep, beside the count that the metadata then hold."""
    path = Scratch(spark, "counted").folder()
    told = sinks.write_pairs(_pairs(spark, sf_dir), path, k=PARAMS.k)
    _, meta = readers.read_pairs(spark, path)
    return meta.select(F.col("count").alias("stored"), *[F.lit(told[c]).cast("long").alias(c) for c in ("pairs", "kmers", "short_pairs")])
