"""Packed pair files: a Python data source that writes them with an index and reads ranges of them.

A pair is two reads, each a length byte and two bits a base, the first base in the lowest bits. A record
has no mark to begin from inside a file, so every task that writes a file also writes an index beside it: the offset
of every ``every``-th pair, eight bytes each. A reader makes a partition of each ``split`` pairs and reads
those bytes alone. Files that something else wrote have no index and no manifest; each is read by one task, a bounded
piece at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from helixplan.functions.seq import BASES
from helixplan.sources import files

#: Bits of a pair's id below the number of its file, where no manifest tells how many pairs lie before.
FILE_BITS = 40
#: Bytes of a file that a task holds at a time.
PIECE_BYTES = 4 << 20
_CODE = np.full(256, 255, dtype=np.uint8)
_CODE[np.frombuffer(BASES.encode(), dtype=np.uint8)] = range(4)
_LETTER = np.frombuffer(BASES.encode(), dtype=np.uint8)


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def pack(reads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of reads one behind the other, and how many each takes; null is an empty read."""
    reads = reads.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(reads.buffers()[1], dtype=np.int64)[reads.offset : reads.offset + len(reads) + 1]
    n = np.diff(ends)
    if len(n) and int(n.max()) > 255:
        raise ValueError("a packed read has 255 bases at most")
    letters = np.frombuffer(reads.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    codes = _CODE[letters]
    if (codes == 255).any():
        raise ValueError("a packed read has no other letters than A, C, G and T")
    cells = (n + 3) // 4
    four = np.zeros(int(cells.sum()) * 4, dtype=np.uint8)
    four[_ragged((np.cumsum(cells) - cells) * 4, n)] = codes
    size = cells + 1
    begin = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint8)
    out[begin] = n
    out[_ragged(begin + 1, cells)] = four.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    return out, size


def unpack(data: np.ndarray) -> tuple[pa.Array, int]:
    """Reads of all whole pairs at the beginning of ``data``, mates one behind the other, and the bytes that they take."""
    begin, at, told, end = [], 0, data.tobytes(), len(data)
    while at < end:
        begin.append(at)
        at += 1 + (told[at] + 3) // 4
    if begin and at > end:
        at = begin.pop()
    if len(begin) % 2:
        at = begin.pop()
    begin = np.array(begin, dtype=np.int64)
    n = data[begin].astype(np.int64)
    cells = (n + 3) // 4
    four = (data[_ragged(begin + 1, cells)][:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
    letters = _LETTER[four.reshape(-1)[_ragged((np.cumsum(cells) - cells) * 4, n)]]
    ends = np.concatenate([[0], np.cumsum(n)])
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)]), at


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str | None
    pairs: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, every: int):
        self.folder, self.every = folder, every

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        partition = TaskContext.get().partitionId()
        name, out, index, pairs, place = f"part-{partition:06d}-{uuid.uuid4().hex}.bin", None, None, 0, 0
        for batch in iterator:
            rows = batch.num_rows
            if not rows:
                continue
            if out is None:
                out, index = files.create(f"{self.folder}/{name}"), files.create(f"{self.folder}/{name}.index")
            mates = pa.concat_arrays([batch.column(batch.schema.get_field_index(c)).cast(pa.large_string()) for c in ("mate1", "mate2")])
            data, size = pack(mates.take(pa.array(np.arange(2 * rows).reshape(2, rows).T.reshape(-1))))
            begins = place + np.concatenate([[0], np.cumsum(size.reshape(-1, 2).sum(axis=1))])
            index.write(begins[:-1][(pairs + np.arange(rows)) % self.every == 0].astype("<u8").tobytes())
            out.write(data.tobytes())
            pairs, place = pairs + rows, int(begins[-1])
        if out is None:
            return _Written(partition, None, 0)
        out.close()
        index.close()
        return _Written(partition, name, pairs)

    def commit(self, messages: list[_Written | None]) -> None:
        if files.committed(self.folder) is not None:
            raise ValueError(f"{self.folder} already holds pairs")
        parts, before = [], 0
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.partition):
            parts.append({"name": m.name, "pairs": m.pairs, "start": before})
            before += m.pairs
        files.commit(self.folder, {"every": self.every, "files": parts})

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m is not None and m.name:
                files.remove(f"{self.folder}/{m.name}")
                files.remove(f"{self.folder}/{m.name}.index")


@dataclass
class _Range(InputPartition):
    """Pairs of a file from an entry of its index to another, or all of a file without one, or nothing without a path; ``start`` is the first one's id."""

    path: str | None
    first: int | None
    last: int | None
    start: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[_Range]:
        if files.is_file(self.path):
            return [_Range(self.path, None, None, 0)]
        listed = files.committed(self.path)
        if listed is None:
            return [_Range(f"{self.path}/{name}", None, None, k << FILE_BITS) for k, name in enumerate(n for n in files.names_in(self.path) if not n.endswith(".index"))]
        every, found = listed["every"], []
        step = max(self.split // every, 1)
        for f in listed["files"]:
            entries = -(-f["pairs"] // every)
            found += [_Range(f"{self.path}/{f['name']}", a, a + step if a + step < entries else None, f["start"] + a * every) for a in range(0, entries, step)]
        return found or [_Range(None, None, None, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.path is None:
            return
        begin, end = 0, files.size_of(part.path)
        if part.first is not None:
            with files.open_at(f"{part.path}.index") as index:
                begin = int(np.frombuffer(index.read_at(8, 8 * part.first), dtype="<u8")[0])
                if part.last is not None:
                    end = int(np.frombuffer(index.read_at(8, 8 * part.last), dtype="<u8")[0])
        place = part.start
        with files.open_at(part.path) as held:
            while begin < end:
                reads, used = unpack(np.frombuffer(held.read_at(min(PIECE_BYTES, end - begin), begin), dtype=np.uint8))
                if not used:
                    raise ValueError(f"{part.path} ends inside a pair")
                rows = len(reads) // 2
                mates = [reads.take(pa.array(np.arange(k, 2 * rows, 2))).cast(pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * rows), pa.array(np.arange(place, place + rows)), *mates], names=["path", "pair_id", "mate1", "mate2"])
                begin, place = begin + used, place + rows


class PackedPairs(DataSource):
    """``spark.read.format("packed_pairs")``: ``path, pair_id, mate1, mate2``; writes ``mate1, mate2`` of the rows in their order."""

    @classmethod
    def name(cls) -> str:
        return "packed_pairs"

    def schema(self) -> str:
        return "path string, pair_id bigint, mate1 string, mate2 string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"].rstrip("/"), int(self.options.get("split", 1 << 18)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"].rstrip("/"), int(self.options.get("every", 4096)))


def write_packed(pairs: DataFrame, path: str, every: int = 4096) -> None:
    """Writes the mates of ``pairs`` in ascending order of ``pair_id``: a file and an index a task, listed in a manifest."""
    spark = pairs.sparkSession
    spark.dataSource.register(PackedPairs)
    rows = pairs.repartitionByRange("pair_id").sortWithinPartitions("pair_id").select("mate1", "mate2")
    rows.write.format("packed_pairs").option("every", every).mode("append").save(files.qualified(spark, path))


def read_packed(spark: SparkSession, path: str, split: int = 1 << 18) -> DataFrame:
    """``path, pair_id, mate1, mate2``. What ``write_packed`` wrote is numbered from 0 over all files; else ids count in each file, above them its number."""
    spark.dataSource.register(PackedPairs)
    return spark.read.format("packed_pairs").option("split", split).load(files.qualified(spark, path))
