"""Packed k-mer keys against texts, and the bytes that they save."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixplan.functions import keys as key_module, seq as S
from helixplan.functions.keys import PackedKeys, TextKeys, keys, rolled
from helixplan.operators import kmers as K


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_counts(seqs, k):
    windows = (s[i : i + k] for s in seqs if s for i in range(len(s) - k + 1))
    return Counter(min(w, revcomp(w)) for w in windows if set(w) <= set("ACGT"))


@pytest.fixture(scope="module")
def seqs():
    rng = random.Random(8)
    return ["".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(60)] + [None, "ACGTNACGTACGTACG", "acgtACGTACGTTTT", "T" * 70]


@pytest.mark.parametrize("k", [1, 2, 5, 16, 21, 31, 32, 40])
@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_counts(spark, seqs, monkeypatch, k, chunk):
    rows = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(2)
    if chunk < 10:
        if k not in (5, 31):
            pytest.skip("a small chunk is tried at two widths")
        # The workers take the module's own number, so the chunk is tried in this process.
        monkeypatch.setattr(key_module, "CHUNK", chunk)
        run = PackedKeys(k).canonical_windows
        got = Counter()
        frame = type("Frame", (), {"select": lambda self, c: self, "mapInArrow": lambda self, f, schema: f})()
        for batch in run(frame)([pa.RecordBatch.from_arrays([pa.array(seqs)], names=["seq"])]):
            got.update(batch.column(0).to_pylist())
        assert sum(got.values()) == sum(plain_counts(seqs, k).values()) and sorted(got.values()) == sorted(plain_counts(seqs, k).values())
        return
    assert {r.kmer: r.cnt for r in K.count_kmers(rows, k).collect()} == plain_counts(seqs, k)


@pytest.mark.parametrize("k", [1, 4, 21, 31])
def test_key_algebra(spark, k):
    rng = random.Random(k)
    kmers = sorted({"".join(rng.choice("ACGT") for _ in range(k)) for _ in range(60)} | {"A" * k, "T" * k})
    rows = spark.createDataFrame([(x,) for x in kmers], "kmer string")
    for coded in (PackedKeys(k), TextKeys(k)):
        key = coded.encode(F.col("kmer"))
        short = type(coded)(k - 1) if k > 1 else None
        got = rows.select("kmer", key.alias("key"), coded.decode(key).alias("back"), coded.decode(coded.revcomp(key)).alias("rc"), coded.last(key).alias("last"), *([short.decode(coded.head(key)).alias("head"), short.decode(coded.tail(key)).alias("tail")] if short else [])).collect()
        for r in got:
            assert (r.back, r.rc, r.last) == (r.kmer, revcomp(r.kmer), r.kmer[-1])
            assert not short or (r["head"], r["tail"]) == (r.kmer[:-1], r.kmer[1:])
        assert sorted(got, key=lambda r: r.key) == sorted(got, key=lambda r: r.kmer)  # keys order like texts


def test_rolled():
    codes = np.array([0, 1, 2, 3, 3, 1])
    for k in range(1, 7):
        assert rolled(codes, k).tolist() == [int("".join(map(str, codes[i : i + k])), 4) for i in range(len(codes) - k + 1)]
    assert not len(rolled(codes, 7))


def shuffled_bytes(df):
    """Bytes that the exchanges of an executed plan wrote, by its metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if node.nodeName() == "Exchange":
            found += node.metrics().apply("dataSize").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_keys_halve_the_shuffle(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(3000)),) for _ in range(20)], "seq string")
    texts = TextKeys(21).canonical_windows(rows).groupBy("key").agg(F.count("*").alias("cnt"))
    packed = K.count_keys(rows, 21)
    assert isinstance(keys(21), PackedKeys)
    a, b = shuffled_bytes(packed), shuffled_bytes(texts)
    assert 0 < a <= b / 2
