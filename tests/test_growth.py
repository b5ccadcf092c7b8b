"""What grows: components on packed keys, sparse rounds, rows numbered in one shuffle, pair ends and distinct k-mers as keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixplan.operators import graph as G, kmers as K, walk as W
from helixplan.params import AssemblyParams
from helixplan.plans import components as C, iterate
from helixplan.plans.iterate import numbered, pointer_double
from helixplan.plans.runtime import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "growth")


def least_nodes(edges):
    """Plain union of sets."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("seed", [0])
def test_contracted_components(spark, scratch, seed):
    rng = random.Random(seed)
    big = 1 << 62
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)]
    edges += [(big, big + i) for i in range(1, 400)]  # a hub
    edges += [(10_000 + i, 10_001 + i) for i in range(100)] + [(5_000, 5_000), (big, big)]  # a path and loops
    rows = spark.createDataFrame([*edges, (None, 1), (7_777, None)], "a bigint, b bigint")
    got = {r.node: r.component for r in C.contracted_components(rows, "a", "b", scratch).collect()}
    assert got == least_nodes(edges)
    assert C.contracted_components(rows.where("a = b"), "a", "b", scratch).count() == len({a for a, b in edges if a == b})
    assert C.contracted_components(rows.where("false"), "a", "b", scratch).count() == 0


def test_graph_components_on_keys_and_texts(spark, scratch, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(6)]
    rows = spark.createDataFrame([(i, a[:40] + b[20:]) for i, (a, b) in enumerate((a, b) for a in base[:3] for b in base[:3])] + [(99, base[5])], "seq_id int, seq string")
    g = G.build_graph(K.solid_kmers(K.count_keys(rows, 9), 1), 9, scratch)
    same = G.build_graph(K.solid_kmers(K.count_kmers(rows, 9), 1), 9, scratch)
    assert sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, same.edges.collect()))
    want = least_nodes([(r.src, r.dst) for r in g.edges.collect()])
    named = lambda found: {r.node_id: r.component for r in found.collect()}
    calls = []
    whole = C.contracted_components
    monkeypatch.setattr(G, "contracted_components", lambda *a: calls.append(a[0].dtypes) or whole(*a))
    assert named(G.components(g, scratch)) == want
    assert calls == [[("a", "bigint"), ("b", "bigint")]]
    # A node of another name than its k-mer: texts, as before.
    assert named(G.components(G.with_node(g, "extra", "A" * 9), scratch)) == want | {"extra": "extra"}
    assert len(calls) == 1


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_pointer_double_writes_open_rows_alone(spark, scratch, monkeypatch, few):
    monkeypatch.setattr(iterate, "BROADCAST_ROWS", few)
    links = [(i, None if i % 500 == 0 else i - 1) for i in range(500)]
    links += [(1000 + i, None) for i in range(3000)] + [(9000, 9001), (9001, 9000)]
    written, keep = [], scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df: written.append(keep(df).count()) or keep(df))
    got = {r.id: (r.root, r.dist) for r in pointer_double(spark.createDataFrame(links, "id bigint, up bigint"), scratch).collect()}
    assert got == {i: (0, i) for i in range(500)} | {1000 + i: (1000 + i, 0) for i in range(3000)}
    assert sum(written) < 3 * len(links)  # 10 rounds of all rows before


def test_numbered_shuffles_once(spark, scratch):
    rows = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("x"))
    got = numbered(rows, [F.desc("x")], scratch)
    assert {r.x: r.n for r in got.collect()} == {x: 2000 - x for x in range(2000)}
    assert "row_number" not in got._jdf.queryExecution().executedPlan().toString()  # no second shuffle by partition


def test_pair_ends_as_keys(spark, scratch):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(120))
    rows = spark.createDataFrame([(0, text)], "seq_id int, seq string")
    g = G.build_graph(K.solid_kmers(K.count_kmers(rows, 7), 1), 7, scratch)
    cut = [(i, text[i : i + 12], rc(text[i + 30 : i + 42])) for i in range(60)] + [(99, "NNNNNNNNN", text[:9]), (98, "A", "C")]
    pairs = spark.createDataFrame(cut, "pair_id bigint, mate1 string, mate2 string")
    p = AssemblyParams(k=7)
    got = W.pair_positions(pairs, g, p)
    assert dict(W.pair_ends(pairs, p, packed=True).dtypes)["kmer1"] == "bigint"
    where = G.positions(g).select("kmer", F.struct("kind", "id", "dist").alias("pos"))
    ends = W.pair_ends(pairs, p)
    want = ends.join(where.withColumnsRenamed({"kmer": "kmer1", "pos": "pos1"}), "kmer1").join(where.withColumnsRenamed({"kmer": "kmer2", "pos": "pos2"}), "kmer2")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("pair_id", "orient", "pos1", "pos2").collect())) and got.count() > 50
    odd = G.Graph(G.with_node(g, "x", "NNNNNNN").nodes, g.edges, g.k)
    assert not G.packable(odd) and G.packable(g)


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_distinct_kmers_as_keys(spark):
    rows = spark.createDataFrame([(0, "ACGTACGTNNACGTT"), (1, "TTTTTT"), (2, None), (3, ""), (4, "acgtACGT")], "seq_id int, seq string")
    for k in (3, 5, 33):
        texts = {s[i : i + k] for s in ("ACGTACGTNNACGTT", "TTTTTT", "acgtACGT") for i in range(len(s) - k + 1)}
        assert K.distinct_kmers(rows, k).collect()[0].kmers == len(texts)
    assert "bigint" in dict(K.keys(5).plain_windows(rows).dtypes)["key"]


def test_short_reference_goes_to_the_graph(spark, scratch):
    rows = spark.createDataFrame([(0, "ACGTTGCATTAGGACCA")], "seq_id int, seq string")
    g = G.build_graph(K.solid_kmers(K.count_kmers(rows, 5), 1), 5, scratch)
    lines = spark.createDataFrame([(">x",), ("ACGTTGCAAAAAN",)], "value string")
    got = G.missing_kmers(g, lines)
    held = {r.kmer for r in G.positions(g).collect()}
    asked = {"ACGTTGCAAAAAN"[i : i + 5] for i in range(9)} - {"AAAAN"}
    assert {r.kmer for r in got.collect()} == {x for x in asked if x not in held and "N" not in x}
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
