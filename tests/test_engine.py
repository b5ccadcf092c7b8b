"""The sequence-graph engine: fixtures by hand, a plain model, properties, sources and sinks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixplan.functions import seq as S
from helixplan.operators import graph as G, kmers as K, resolve as R, sinks, stats, walk as W
from helixplan.params import AssemblyParams
from helixplan.plans.iterate import numbered, pointer_double
from helixplan.plans.runtime import Scratch
from helixplan.sources import readers

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(COMPLEMENT)


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def reads(spark, *seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id int, seq string")


def build(spark, scratch, k, *seqs, least=3):
    return G.build_graph(K.solid_kmers(K.count_kmers(reads(spark, *seqs), k), least), k, scratch)


def edges_of(g):
    return sorted((r.src, r.dst, r.seq) for r in g.edges.collect())


def model_graph(seqs, k, least):
    """Plain procedural build."""
    count = {}
    for s in seqs:
        for i in range(len(s) - k + 1):
            x = s[i : i + k]
            x = min(x, rc(x))
            count[x] = count.get(x, 0) + 1
    solid = {x for x, n in count.items() if n >= least}
    every = solid | {rc(x) for x in solid}
    nxt = lambda x: [x[1:] + c for c in "ACGT" if x[1:] + c in every]
    prv = lambda x: [c + x[:-1] for c in "ACGT" if c + x[:-1] in every]
    stop = {x for x in every if (len(prv(x)), len(nxt(x))) not in ((1, 1), (0, 0))}
    out = []
    for t in stop:
        for x in nxt(t):
            text = x[-1]
            while x not in stop:
                (x,) = nxt(x)
                text += x[-1]
            out.append((t, x, text))
    return stop, sorted(out)


def test_scalar_functions(spark):
    row = spark.createDataFrame([("AACGT", "ACGNAC", "ACGTA", "!!!", None)], "a string, b string, c string, q string, n string")
    a = F.col("a")
    got = row.select(
        S.revcomp(a), S.complement(a), S.canonical(F.lit("TTT")), S.valid_prefix(F.col("b")), S.valid_prefix(F.col("c"), F.col("q")), S.take(a, 2), S.drop(a, 2), S.subseq(a, -3, 2), S.subseq(a, 3, 99), S.base_at(a, 1), S.revcomp(F.col("n")), S.unpack(S.pack(a), 5), S.windows(a, 4), S.windows(a, 6), S.is_valid(F.col("b"))
    ).first()
    assert list(got) == ["ACGTT", "TTGCA", "AAA", "ACG", "ACG", "AA", "CGT", "AA", "GT", "A", None, "AACGT", ["AACG", "ACGT"], [], False]
    trimmed = spark.createDataFrame([("ACGTAC", "!!5555"), ("ACGTAC", "!!55!5"), ("AC", "5")], "b string, q string").select(S.quality_trim(F.col("b"), F.col("q"), 2))
    assert [r[0] for r in trimmed.collect()] == ["ACGTAC", "ACGT", "A"]


def test_sql_functions(spark):
    S.register_sql(spark)
    assert spark.sql("SELECT revcomp('AACGT'), canonical_kmer('TTT'), valid_prefix('ACN')").first()[:] == ("ACGTT", "AAA", "AC")
    assert [r.kmer for r in spark.sql("SELECT kmer FROM kmers('ACGTA', 3) ORDER BY pos").collect()] == ["ACG", "CGT", "GTA"]
    assert spark.sql("SELECT * FROM kmers('AC', 3)").count() == 0


def test_counts(spark):
    rows = reads(spark, "ACGTA", "AC", None, "", "TACGT")
    assert {r.kmer: r.cnt for r in K.count_kmers(rows, 3).collect()} == {"ACG": 4, "GTA": 2}
    assert K.distinct_kmers(rows, 3).first()[0] == 4
    counts = spark.createDataFrame([("AAA", 2), ("AAC", 3)], "kmer string, cnt bigint")
    assert [r.kmer for r in K.solid_kmers(counts, 3).collect()] == ["AAC"]
    pairs = spark.createDataFrame([(1, "ACGTA", "AC"), (2, "ACGT", "ACG")], "pair_id bigint, mate1 string, mate2 string")
    assert K.conversion_counters(pairs, 3).first()[:] == (2, 6, 1)


def test_palindrome_join(spark, scratch):
    g = build(spark, scratch, 5, *["AACGTTCAGGA"] * 3)
    assert edges_of(g) == [("TCCTG", "CAGGA", "AACGTTCAGGA")] and g.nodes.count() == 2
    assert G.positions(g).count() == 12
    assert K.oriented(K.count_kmers(reads(spark, "AACGTTCAGGA"), 5)).count() == 12


def test_fork(spark, scratch):
    g = build(spark, scratch, 5, *["TTACGCAGGAT", "TTACGCACCAT"] * 3)
    assert edges_of(g) == sorted([("TTACG", "ACGCA", "CA"), ("ACGCA", "AGGAT", "GGAT"), ("ACGCA", "ACCAT", "CCAT"), ("TGCGT", "CGTAA", "AA"), ("ATCCT", "TGCGT", "GCGT"), ("ATGGT", "TGCGT", "GCGT")])
    assert g.nodes.count() == 8 and G.positions(g).count() == 22
    sizes = stats.component_sizes(g, G.components(g, scratch))
    assert stats.component_histogram(sizes).collect()[0][:] == (4, 2)
    assert stats.largest_component(sizes).first().nodes == 4
    assert [r.node_id for r in G.neighbours(g, "ACGCA", 3, scratch).orderBy("hop", "node_id").collect()] == ["ACGCA", "ACCAT", "AGGAT"]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_model(spark, scratch, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ACGT") for _ in range(120))
    seqs = [text[i : i + 40] for i in range(0, 80, 4)] + [text[20:60] + text[10:40], "ACACACACACAC"]
    stop, want = model_graph(seqs, 5, 2)
    g = build(spark, scratch, 5, *seqs, least=2)
    assert {r.kmer for r in g.nodes.collect()} == stop and edges_of(g) == want
    assert G.broken_edges(g).isEmpty()
    total = sum(len(e[2]) for e in want)
    assert G.positions(g).count() == total + len(stop) - len(want)
    mirrored = {(rc(d), rc(s)) for s, d, _ in want}
    assert mirrored == {(s, d) for s, d, _ in want}


def graph(spark, nodes, edges, k=3):
    return G.Graph(spark.createDataFrame([(n, n[:k]) for n in nodes], "node_id string, kmer string"), spark.createDataFrame(edges, "edge_id string, src string, dst string, seq string"), k)


def test_simplify_chains_loops_cycles(spark, scratch):
    edges = [("1", "a", "b", "AC"), ("2", "b", "c", "G"), ("3", "c", "d", "TT"), ("4", "x", "x", "A"), ("5", "p", "q", "C"), ("6", "q", "p", "G"), ("7", "a", "e", "T")]
    g = G.simplify(graph(spark, "abcdexpqz", edges), scratch)
    assert sorted(map(tuple, g.edges.collect())) == [("1", "a", "d", "ACGTT"), ("7", "a", "e", "T")]
    assert {r.node_id for r in g.nodes.collect()} == {"a", "d", "e"}


def test_edits(spark, scratch):
    g = graph(spark, "abc", [("a:A", "a", "b", "A"), ("b:C", "b", "c", "C")])
    h = G.with_edge(G.with_node(g, "d", "ddd"), "a", "d", "AG")
    assert sorted((r.src, r.dst, r.seq) for r in h.edges.collect()) == [("a", "d", "AG"), ("b", "c", "C")] and h.nodes.count() == 4
    ids = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    assert G.without_nodes(g, ids("node_id", "b")).edges.count() == 2
    assert G.without_edges(g, ids("edge_id", "a:A")).edges.count() == 1
    moved = G.replace_ends(g, spark.createDataFrame([("a:A", None, "c")], "edge_id string, new_src string, new_dst string"))
    assert ("a", "c") in {(r.src, r.dst) for r in moved.edges.collect()}
    assert G.retain(g, ids("node_id", "a", "b")).edges.count() == 1
    adjacent = {r.node_id: r for r in G.adjacency(g).collect()}
    assert adjacent["b"].in_edges == ["a:A"] and adjacent["b"].out_edges == {"C": "b:C"} and adjacent["a"].in_edges is None
    lost = graph(spark, "a", [("a:A", "a", "b", "A")])
    assert [r.fault for r in G.broken_edges(lost).collect()] == ["end without node"]


def test_bubble(spark):
    edges = [("A", "a", "b", "A" * 100), ("G", "a", "b", "G" * 90), ("C", "a", "b", "C" * 50), ("T", "b", "a", "T")]
    g = graph(spark, "ab", edges)
    assert [r.edge_id for r in G.parallel_bubbles(g).collect()] == ["G"] and G.remove_bubbles(g).edges.count() == 3


@pytest.mark.parametrize(
    ("support", "clones", "left"),
    [
        ([("i1", "o1", 300), ("i2", "o2", 250)], 2, {"i1", "i2", "o1", "o2"}),
        ([("i1", "o1", 300), ("i2", "o2", 50)], 1, {"i1", "o1"}),
        ([("i1", "o1", 300), ("i1", "o2", 300), ("i2", "o2", 250)], 1, {"i1", "i2", "o1", "o2"}),
    ],
)
def test_split(spark, scratch, support, clones, left):
    g = graph(spark, "pqnrs", [("i1", "p", "n", "A"), ("i2", "q", "n", "C"), ("o1", "n", "r", "G"), ("o2", "n", "s", "T")])
    table = spark.createDataFrame(support, "e_in string, e_out string, support bigint")
    got = R.split_nodes(g, table, 200, scratch)
    assert {r.edge_id for r in got.edges.collect()} == left
    assert got.nodes.where("kmer = 'n'").count() == clones and G.broken_edges(got).where("fault = 'end without node'").isEmpty()
    if clones == 2:
        assert sorted(r.seq for r in G.simplify(got, scratch).edges.collect()) == ["AG", "CT"]
    line = sinks.matrix_lines(R.node_matrix(g, table)).first().line
    assert line.startswith("n -> [[300, ") and line.endswith("] [1, 1] [1, 1]")


def test_self_loop_has_two_ports(spark, scratch):
    g = graph(spark, "pnr", [("i", "p", "n", "A"), ("l", "n", "n", "C"), ("o", "n", "r", "G")])
    table = spark.createDataFrame([("i", "l", 9), ("l", "o", 9)], "e_in string, e_out string, support bigint")
    s = G.simplify(R.split_nodes(g, table, 5, scratch), scratch)
    assert [r.seq for r in s.edges.collect()] == ["ACG"]


def brute_walk(edges, target, low, high):
    u, du, e1, v, dv, e2 = target
    found, out = False, set()

    def go(node, dist, path):
        nonlocal found
        if dist + dv > high:
            return
        if node == v and low <= dist + dv:
            found = True
            whole = [e for e in [e1, *path, e2] if e is not None]
            out.update(zip(whole, whole[1:]))
        for i, s, d, q in edges:
            if s == node:
                go(d, dist + len(q), [*path, i])

    go(u, du, [])
    return found, out


def test_walk_against_search(spark, scratch):
    rng = random.Random(7)
    nodes = "abcdef"
    edges = [(f"e{i}", rng.choice(nodes), rng.choice(nodes), "A" * rng.randint(1, 4)) for i in range(11)]
    targets = [(f"t{i}", rng.choice(nodes), rng.randint(0, 2), rng.choice([None, "x1"]), rng.choice(nodes), rng.randint(0, 2), rng.choice([None, "x2"])) for i in range(25)]
    p = AssemblyParams(k=3, low=5, high=9)
    rows = spark.createDataFrame(targets, "tid string, u string, du bigint, e1 string, v string, dv bigint, e2 string")
    got = {}
    for r in W.walk(rows, graph(spark, nodes, edges), p, scratch).collect():
        got.setdefault(r.tid, set())
        if r.e_in is not None:
            got[r.tid].add((r.e_in, r.e_out))
    want = {}
    for t in targets:
        found, pairs = brute_walk(edges, t[1:], 5, 9)
        if found:
            want[t[0]] = pairs
    assert got == want
    near = {(r.target, r.node): r.dist for r in W.reach(graph(spark, nodes, edges), spark.createDataFrame([("a",), ("f",)], "target string"), 8, scratch).collect()}
    for goal in "af":
        dist = {goal: 0}
        for _ in range(9):
            for _, s, d, q in edges:
                if d in dist and dist[d] + len(q) <= 8:
                    dist[s] = min(dist.get(s, 99), dist[d] + len(q))
        assert {n: d for (t, n), d in near.items() if t == goal} == dist


def test_simulated_target(spark, scratch, tmp_path):
    rng = random.Random(11)
    target = "".join(rng.choice("ACGT") for _ in range(700))
    k, pairs = 15, []
    for i in range(0, 700 - 120 + 1):
        f = target[i : i + 120]
        pairs.append((i, f[:36], rc(f[-36:])))
    table = spark.createDataFrame(pairs, "pair_id bigint, mate1 string, mate2 string")
    both = table.select("mate1").union(table.select("mate2")).withColumnRenamed("mate1", "seq")
    g = G.build_graph(K.solid_kmers(K.count_kmers(both, k), 3), k, scratch)
    p = AssemblyParams(k=k, low=80, high=130, cutoff=2)
    done = R.resolve(table, g, p, scratch)
    contigs = sinks.contigs(done, scratch, with_prefix=True).collect()
    assert len(contigs) == 2 and all(c.seq in target or c.seq in rc(target) for c in contigs) and contigs[0].len > 680
    assert sinks.contigs(done, scratch, canonical_only=True).count() == 1
    lines = spark.createDataFrame([(">head",), (target[4:-4],), ("ACN",)], "value string")
    assert G.missing_kmers(done, lines).isEmpty()
    sinks.write_fasta(sinks.fasta(sinks.contigs(done, scratch)), f"{tmp_path}/fa")
    text = [r.value for r in spark.read.text(f"{tmp_path}/fa").collect()]
    assert len(text) == 4 and ">contig1" in text
    sinks.write_graph(done, f"{tmp_path}/g")
    assert edges_of(readers.read_graph(spark, f"{tmp_path}/g", k)) == edges_of(done)
    sinks.write_dot(done, f"{tmp_path}/dot")
    dot = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/dot").collect())
    assert dot.startswith("digraph g {") and dot.endswith("}")


def test_dot_label_limit(spark):
    g = graph(spark, "ab", [("1", "a", "b", "A" * 50), ("2", "b", "a", "C" * 51)])
    assert sorted(r.line for r in sinks.dot_lines(g).collect()) == ['"a" -> "b" [label="' + "A" * 50 + '"]', '"b" -> "a" [label="51"]']


def test_statistics(spark):
    hist = spark.createDataFrame([(10, 2), (30, 1), (50, 1)], "len bigint, cnt bigint")
    assert stats.n50(hist).first()[:] == (30, 1)
    lengths = spark.createDataFrame([(x,) for x in (201, 300, 500, 900, 200, 3)], "len bigint")
    assert stats.contig_stats(lengths).first()[:] == (4, 1901, 900, 500, 500)
    assert stats.contig_stats(lengths, 5000).first()[:] == (0, 0, None, None, None)
    assert stats.count_at_least(hist, 30).first()[0] == 2
    text = spark.createDataFrame([("log Map(10 -> 2, 30 -> 1, 50 -> 1)",)], "value string")
    assert sorted(map(tuple, readers.parse_histogram(text).collect())) == [(10, 2), (30, 1), (50, 1)]
    assert readers.parse_histogram(text, last=False).count() == 2


def test_fastq_over_splits(spark, scratch, tmp_path):
    records = [(f"@r{i}", "ACGT" * 2 + "AC" * 2, "I" * (3 if i == 5 else 12)) for i in range(300)]
    for name, part, end in (("a.fq", records[:200], ""), ("b.fq", records[200:], "@cut")):
        (tmp_path / name).write_text("".join(f"{h}\n{b}\n+\n{q}\n" for h, b, q in part) + end)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = readers.read_fastq(spark, f"{tmp_path}/*.fq", scratch)
        got = rows.orderBy("pair_id").collect()
        mates = readers.mates(rows, 8).orderBy("pair_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len({r.pair_id for r in got}) == 300 and got[200].pair_id == 1 << 40
    assert [(r.header, r.bases, r.qual) for r in got] == records
    assert mates[0][:] == (0, "ACGTACGT", "ACAC") and mates[5][:] == (5, "ACG", "")


def test_pairs_packed_and_parquet(spark, scratch, tmp_path):
    pairs = spark.createDataFrame([(0, "ACGTA", ""), (1, "T", "GGCC")], "pair_id bigint, mate1 string, mate2 string")
    packed = b"".join(bytes(r.record) for r in sinks.packed_pairs(pairs).orderBy("pair_id").collect())
    (tmp_path / "p.bin").write_bytes(packed)
    got = readers.read_packed_pairs(spark, f"{tmp_path}/p.bin", scratch).drop("path")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))
    (tmp_path / "q.bin").write_bytes(packed)
    two = readers.read_packed_pairs(spark, f"{tmp_path}/*.bin", scratch)
    assert two.count() == two.select("pair_id").distinct().count() == 4
    sinks.write_pairs(pairs, f"{tmp_path}/out", insert=250)
    again, meta = readers.read_pairs(spark, f"{tmp_path}/out")
    assert again.count() == 2 and meta.first()[:] == (2, 250)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one\nACG\nTA\n")
    assert readers.read_fasta(spark, f"{tmp_path}/a.fa").first().seq == "ACGTA"
    assert [r.value for r in readers.read_fasta_lines(spark, f"{tmp_path}/a.fa").collect()] == ["ACG", "TA"]
    (tmp_path / "b.fa").write_text(">one\nACN\n")
    with pytest.raises(Exception, match="not a sequence"):
        readers.read_fasta(spark, f"{tmp_path}/b.fa").collect()


def test_loops(spark, scratch):
    links = [(i, i - 1 if i % 40 else None) for i in range(160)] + [(1000, 1001), (1001, 1000)]
    got = {r.id: (r.root, r.dist) for r in pointer_double(spark.createDataFrame(links, "id bigint, up bigint"), scratch).collect()}
    assert got == {i: (i - i % 40, i % 40) for i in range(160)}
    rows = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 300)], "x bigint")
    order = [r.x for r in numbered(rows, [F.asc("x")], scratch).orderBy("n").collect()]
    assert order == sorted(order) and len(order) == 300


def test_empty_input(spark, scratch):
    g = build(spark, scratch, 5, "", None)
    assert g.nodes.isEmpty() and g.edges.isEmpty() and G.components(g, scratch).isEmpty() and G.positions(g).isEmpty()
    pairs = spark.createDataFrame([], "pair_id bigint, mate1 string, mate2 string")
    assert R.resolve(pairs, g, AssemblyParams(k=5), scratch).edges.isEmpty()


def test_stream_counts(spark, tmp_path):
    from helixplan.streaming.kmers import stream_counts

    reads(spark, "ACGTA", "TACGT").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq_id int, seq string").parquet(f"{tmp_path}/in")
    query = stream_counts(stream, 3).writeStream.outputMode("update").format("memory").queryName("kmers_now").start()
    query.processAllAvailable()
    query.stop()
    assert {r.kmer: r.cnt for r in spark.table("kmers_now").collect()} == {"ACG": 4, "GTA": 2}
