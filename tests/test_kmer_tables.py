"""The stored k-mer map, k-mer restore and FASTA over lines and splits."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from helixplan.operators import kmers as K
from helixplan.plans.runtime import Scratch
from helixplan.sources import readers
from helixplan.sources.kmer_store import KmerStore


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def counts(spark, table):
    return spark.createDataFrame(list(table.items()), "kmer string, cnt bigint")


def held(df):
    return {r.kmer: r.cnt for r in df.collect()}


def stored_side_exchanges(df):
    """Exchanges between the join and the scan of the store, by the physical plan."""
    text = df._jdf.queryExecution().sparkPlan().toString() and df._jdf.queryExecution().executedPlan().toString()
    lines = text.split("\n")
    scans = [i for i, line in enumerate(lines) if "kmer_store_" in line and "Scan" in line]
    assert scans
    found = 0
    for at in scans:
        depth = lines[at].index("Scan")
        for line in reversed(lines[:at]):
            place = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if place < depth:
                depth = place
                found += "Exchange" in line
                if "Join" in line:
                    break
    return found


def test_store(spark, tmp_path):
    scratch = Scratch(spark, "store-test")
    a, b = {"AAA": 3, "ACG": 1, "TTT": 5}, {"ACG": 7, "GGG": 2}
    store = KmerStore(spark, scratch, buckets=4).create(counts(spark, a))
    assert held(store.rows()) == a
    from pyspark.sql import functions as F

    assert stored_side_exchanges(store.changed(counts(spark, b), F.coalesce("new", "old"))) == 0
    assert stored_side_exchanges(store.get(counts(spark, b))) == 0
    store.merge(counts(spark, b))
    assert held(store.rows()) == {"AAA": 3, "ACG": 8, "GGG": 2, "TTT": 5}
    store.merge(spark.createDataFrame([("GGG", 1), ("GGG", 1)], "kmer string, cnt bigint"))
    assert held(store.rows())["GGG"] == 4
    writes = spark.createDataFrame([("AAA", 10, 1), ("AAA", 2, 3), ("AAA", 99, 2), ("CCC", 1, 1)], "kmer string, cnt bigint, at int")
    store.overwrite(writes, version="at")
    assert held(store.rows()) == {"AAA": 2, "ACG": 8, "CCC": 1, "GGG": 4, "TTT": 5}
    store.delete(counts(spark, {"CCC": 0, "GGG": 0, "CAT": 0}))
    assert held(store.rows()) == {"AAA": 2, "ACG": 8, "TTT": 5}
    assert held(store.get(counts(spark, {"ACG": 0, "CAT": 0}))) == {"ACG": 8}
    store.insert(counts(spark, {"ACG": 1, "CAT": 6}))
    assert Counter(map(tuple, store.rows().collect())) == Counter([("AAA", 2), ("ACG", 8), ("ACG", 1), ("TTT", 5), ("CAT", 6)])


def test_empty_store(spark):
    none = counts(spark, {"AAA": 1}).where("cnt > 1")
    store = KmerStore(spark, Scratch(spark, "store-none")).create(none).merge(none)
    assert store.rows().count() == 0
    assert held(store.merge(counts(spark, {"AAA": 1})).rows()) == {"AAA": 1}


def plain_restore(table, min_count, k, depth):
    """Depth-first over single steps, from every solid k-mer of either strand."""
    canonical = lambda x: min(x, revcomp(x))
    solid = {x for c, n in table.items() if n >= min_count for x in (c, revcomp(c))}
    rare = {x for c, n in table.items() if n < min_count for x in (c, revcomp(c))}
    found = {}

    def go(path):
        for base in "ACGT":
            x = path[-1][1:] + base
            if x in solid and len(path) > 1:
                for y in path[1:]:
                    found[canonical(y)] = min(found.get(canonical(y), 99), len(path))
            elif x in rare and len(path) < depth:
                go([*path, x])

    for s in solid:
        go([s])
    return found


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_restore_against_search(spark, depth):
    rng = random.Random(depth)
    k = 4
    words = {min(x, revcomp(x)) for x in ("".join(rng.choice("ACGT") for _ in range(k)) for _ in range(90))}
    table = {w: rng.choice([1, 1, 2, 5]) for w in words}
    got = K.restore(counts(spark, table), 3, k, depth, Scratch(spark, "restore-test"))
    want = plain_restore(table, 3, k, depth)
    assert {r.kmer: (r.cnt, r.steps) for r in got.collect()} == {x: (table[x], n) for x, n in want.items()}


@pytest.mark.parametrize("each", [1, 3, 4096])
@pytest.mark.parametrize("k", [1, 4, 9])
def test_fasta_over_lines_and_splits(spark, tmp_path, each, k):
    rng = random.Random(each * 10 + k)
    want = Counter()
    for name in "ab":
        lines = []
        for record in range(5):
            lines.append(f">record {record} > of {name}")
            seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 2, 30, 80])))
            want.update(min(w, revcomp(w)) for w in (seq[i : i + k] for i in range(len(seq) - k + 1)))
            at = 0
            while at < len(seq):
                step = rng.choice([0, 1, 2, 3, 20])  # short and empty lines
                lines.append(seq[at : at + step])
                at += step
        (tmp_path / f"{name}.fa").write_text("\n".join(lines) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        chunks = readers.read_fasta_chunks(spark, str(tmp_path), k, Scratch(spark, "fasta-test"), lines_each=each)
        assert {r.kmer: r.cnt for r in K.count_kmers(chunks, k).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pairs_are_counted_as_they_are_written(spark, tmp_path):
    from helixplan.operators import sinks

    made = spark.sparkContext.accumulator(0)

    def see(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([(k, "ACGT" * (k % 9), "GGTT" * 8) for k in range(50)], "pair_id bigint, mate1 string, mate2 string").mapInArrow(see, "pair_id bigint, mate1 string, mate2 string")
    told = sinks.write_pairs(pairs, str(tmp_path), k=21)
    assert made.value == 50  # one pass
    assert told == {"pairs": 50, "kmers": sum(max(4 * (k % 9) - 20, 0) + 12 for k in range(50)), "short_pairs": sum(4 * (k % 9) < 21 for k in range(50))}
    back, meta = readers.read_pairs(spark, str(tmp_path))
    assert back.count() == 50 and tuple(meta.first()) == (50, 200)
    assert sinks.write_pairs(pairs.limit(0), str(tmp_path / "none"))["pairs"] == 0
