"""Packed pair files: coding, index, ranges, files without an index."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from helixplan.operators import sinks
from helixplan.sources import files, packed


def reads(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 3, 4, 36, 255]))) for _ in range(n)]


def test_pack_and_unpack():
    some = reads(60)
    data, size = packed.pack(pa.array(some))
    got, used = packed.unpack(data)
    assert got.to_pylist() == some and used == len(data)
    # A piece that ends anywhere gives its whole pairs.
    for end in range(0, len(data), 37):
        got, used = packed.unpack(data[:end])
        n = len(got)
        assert n % 2 == 0 and got.to_pylist() == some[:n] and used == size[:n].sum() and used + size[n : n + 2].sum() > end
    assert packed.pack(pa.array([None, ""]))[0].tolist() == [0, 0]
    for bad in ("ACGN", "acgt", "A" * 256):
        with pytest.raises(ValueError):
            packed.pack(pa.array([bad]))


@pytest.fixture(scope="module")
def pairs(spark):
    some = reads(2000, 2)
    return spark.createDataFrame([(3 * k, some[2 * k], some[2 * k + 1]) for k in range(1000)], "pair_id bigint, mate1 string, mate2 string").repartition(3)


def test_files_are_read_by_several_tasks(spark, pairs, tmp_path):
    path = str(tmp_path / "pairs")
    packed.write_packed(pairs, path, every=16)
    listed = files.committed(f"file://{path}")["files"]
    back = packed.read_packed(spark, path, split=64)
    assert back.rdd.getNumPartitions() == sum(-(-f["pairs"] // 64) for f in listed) > len(listed)
    want = sorted(map(tuple, pairs.collect()))
    assert [tuple(r) for r in back.orderBy("pair_id").select("pair_id", "mate1", "mate2").collect()] == [(k, a, b) for k, (_, a, b) in enumerate(want)]
    with pytest.raises(Exception, match="already holds"):
        packed.write_packed(pairs, path)


def test_bytes_are_those_of_the_format(spark, pairs, tmp_path):
    path = str(tmp_path / "pairs")
    packed.write_packed(pairs, path)
    held = b"".join((tmp_path / "pairs" / f["name"]).read_bytes() for f in files.committed(f"file://{path}")["files"])
    assert held == b"".join(bytes(r.record) for r in sinks.packed_pairs(pairs).orderBy("pair_id").collect())


def test_files_without_an_index(spark, pairs, tmp_path, monkeypatch):
    held = b"".join(bytes(r.record) for r in sinks.packed_pairs(pairs).orderBy("pair_id").collect())
    for name in ("a.bin", "b.bin"):
        (tmp_path / name).write_bytes(held)
    want = [(a, b) for _, a, b in sorted(map(tuple, pairs.collect()))]
    one = packed.read_packed(spark, str(tmp_path / "a.bin")).orderBy("pair_id")
    assert [(r.mate1, r.mate2) for r in one.collect()] == want
    two = packed.read_packed(spark, str(tmp_path)).orderBy("pair_id").collect()
    assert [(r.mate1, r.mate2) for r in two] == want * 2 and two[1000].pair_id == 1 << packed.FILE_BITS
    (tmp_path / "c.bin").write_bytes(held[:-1])
    with pytest.raises(Exception, match="ends inside a pair"):
        packed.read_packed(spark, str(tmp_path / "c.bin")).count()


def test_no_pairs(spark, pairs, tmp_path):
    path = str(tmp_path / "none")
    packed.write_packed(pairs.limit(0), path)
    assert packed.read_packed(spark, path).count() == 0


def test_a_long_file_is_read_in_pieces(monkeypatch):
    some = reads(400, 3)
    data = packed.pack(pa.array(some))[0]
    at, got = 0, []
    while at < len(data):
        part, used = packed.unpack(np.array(data[at : at + 1000]))
        got += part.to_pylist()
        at += used
    assert got == some
