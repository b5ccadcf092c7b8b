"""k-mers as keys and bytes: restored in layers, decoded by look-ups, packed and cut without a walk over each text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixplan.functions import seq as S
from helixplan.functions.keys import keys
from helixplan.operators import kmers as K, sinks
from helixplan.plans.runtime import Scratch
from helixplan.sources import readers


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "bytes")


def kept_plans(scratch, monkeypatch):
    plans, tables, keep = [], [], scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df: plans.append(df._jdf.queryExecution().toString()) or tables.append(keep(df)) or tables[-1])
    return plans, tables


@pytest.mark.parametrize("depth", [3, 4, 6])
def test_restore_takes_keys_and_leaves_dead_ends(spark, scratch, monkeypatch, depth):
    rng = random.Random(depth)
    base = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(8)]
    seqs = [a[:20] for a in base] * 3 + [a[:20] + b[10 : 10 + depth] + c[:20] for a, b, c in zip(base, base[1:], base[2:])] + [a + b for a, b in zip(base, base[3:])]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id int, seq string")
    plans, tables = kept_plans(scratch, monkeypatch)
    got = K.restore(K.count_keys(rows, 5), 3, 5, depth, scratch)
    layers = [t.collect() for t in tables if "far" in t.columns]
    texts = K.restore(K.count_kmers(rows, 5), 3, 5, depth, Scratch(spark, "texts"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, texts.collect())) and got.count()
    coded = keys(5)
    back = {r.key: r.rc for r in spark.createDataFrame([(r.key,) for rows in layers for r in rows], "key bigint").select("key", coded.revcomp(F.col("key")).alias("rc")).collect()}
    near = {r.key: r.far for rows in layers for r in rows}
    # Beyond the middle a layer holds only what can still come to an end within the depth.
    assert all(near.get(back[k], depth) + far <= depth for k, far in near.items() if far > depth - far)


def test_decode_is_a_look_up(spark):
    for k in (1, 3, 4, 21, 31):
        rng = random.Random(k)
        texts = ["A" * k, "T" * k] + ["".join(rng.choice("ACGT") for _ in range(k)) for _ in range(50)]
        rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", keys(k).encode(F.col("t")).alias("key"))
        back = rows.select("t", keys(k).decode(F.col("key")).alias("b"))
        assert all(r.t == r.b for r in back.collect())
        assert "lpad" not in spark.range(9).select(keys(k).decode(F.col("id")))._jdf.queryExecution().optimizedPlan().toString()


def test_ends_of_fasta_chunks_need_no_pattern(spark, scratch, monkeypatch, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nACGT\nAC\n>b\n>c\nGGTT\nA\n")
    plans, _ = kept_plans(scratch, monkeypatch)
    got = K.count_kmers(readers.read_fasta_chunks(spark, str(tmp_path), 3, scratch, lines_each=2), 3)
    assert {r.kmer: r.cnt for r in got.collect()} == {"AAC": 1, "ACC": 1, "ACG": 2, "GTA": 2, "TAA": 1}
    assert plans and not any("regexp_extract" in p for p in plans)


def test_pairs_are_packed_in_batches(spark):
    rows = [(1, "ACGT", "A"), (2, None, "C"), (3, "ANñT", ""), (4, "", ""), (5, "T" * 255, "G")]
    packed = sinks.packed_pairs(spark.createDataFrame(rows, "pair_id bigint, mate1 string, mate2 string").repartition(2))
    got = {r.pair_id: r.record and bytes(r.record).hex() for r in packed.collect()}
    assert got == {1: "04d80100", 2: None, 3: "04c000", 4: "0000", 5: "ff" + "ff" * 63 + "3f" + "0101"}
    assert "MapInArrow" in packed._jdf.queryExecution().executedPlan().toString()


def test_unpacked_pairs_of_many_files(spark, scratch):
    rng = random.Random(4)
    some = [(f * 1000 + i, "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 7, 36]))), "ACG" * (i % 3)) for f in range(40) for i in range(f)]
    records = sinks.packed_pairs(spark.createDataFrame(some, "pair_id bigint, mate1 string, mate2 string")).collect()
    held = {}
    for r in sorted(records):
        held[f"{r.pair_id // 1000:03d}"] = held.get(f"{r.pair_id // 1000:03d}", b"") + bytes(r.record)
    files = spark.createDataFrame([*held.items(), ("none", b"")], "path string, content binary")
    got = readers.unpack_pairs(files, scratch).collect()
    names = sorted([*held, "none"])
    want = {(f"{i // 1000:03d}", (names.index(f"{i // 1000:03d}") << readers.FILE_BITS) + i % 1000, a, b) for i, a, b in some}
    assert set(map(tuple, got)) == want and len(got) == len(some)
    short = spark.createDataFrame([("cut", held["039"][:-1])], "path string, content binary")
    with pytest.raises(Exception, match="ends inside a pair"):
        readers.unpack_pairs(short, scratch).collect()


@pytest.mark.parametrize("k", [1, 3])
def test_sql_kmers_cut_bytes(spark, k):
    S.register_sql(spark)
    texts = spark.createDataFrame([(1, "ACGTA"), (2, "AC"), (3, None), (4, ""), (5, "AéGTñ€C")], "id int, s string")
    found = spark.sql("SELECT id, w.pos, w.kmer FROM {d} d, LATERAL kmers(d.s, {k}) w", d=texts, k=k)
    want = {(r.id, i, r.s[i : i + k]) for r in texts.collect() if r.s for i in range(len(r.s) - k + 1)}
    assert set(map(tuple, found.collect())) == want
    assert "as binary" in found._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7, 31, 32])
def test_junctions_give_degrees_and_steps(spark, scratch, monkeypatch, k):
    rng = random.Random(k)
    base = "".join(rng.choice("ACGT") for _ in range(90))
    rows = spark.createDataFrame([(0, base[:60]), (1, base[20:40] + base[50:]), (2, "ACGTACGT" * 5), (3, "GGATCC" + base[:40])], "seq_id int, seq string")
    solid = K.count_keys(rows, k)
    oriented = K.oriented_keys(solid, k)
    want = {r.key: (r.in_deg, r.out_deg, r.terminal) for r in K.key_degrees(oriented, k).collect()}
    one = K.canonical_degrees(solid, k)
    got = {r.key: (r.in_deg, r.out_deg, r.terminal) for r in one.collect()}
    assert got == {r.key: want[r.key] for r in solid.collect()}
    found = [tuple(r) for r in K.key_steps(one.select("key", "terminal"), k).collect()]
    coded = keys(k)
    left = oriented.select(F.col("key").alias("a"), coded.tail(F.col("key")).alias("o"))
    steps = left.join(oriented.select(F.col("key").alias("b"), coded.head(F.col("key")).alias("o")), "o").collect()
    assert sorted(found) == sorted((r.a, want[r.a][2], r.b, want[r.b][2]) for r in steps)
    assert "Join" not in K.key_steps(one, k)._jdf.queryExecution().optimizedPlan().toString()
