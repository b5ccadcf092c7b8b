"""Sources: paired reads, FASTA, graphs, histograms.

All of them go through Spark's readers, so any file system that Spark knows will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from helixplan.functions import seq as S
from helixplan.operators.graph import Graph
from helixplan.plans.iterate import numbered
from helixplan.plans.runtime import Scratch
from helixplan.sources import packed

#: Rows of files or splits that may be broadcast, and the bits of a pair's id below the number of its file.
BROADCAST_ROWS = 100_000
FILE_BITS = 40
#: Unpacked pieces of packed files are given on when one has so many pairs, or when there are so many.
GIVEN_ROWS, GIVEN_FILES = 10_000, 500


def numbered_lines(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """``file_no, line_no, value`` of text files (a file, a folder or a pattern); files count from 0 by path, their lines from 0.

    Lines are numbered inside each split as it is read, and a split's first number follows from the sizes of
    those before it, so splits of any number of files are read in parallel and no line passes through Python.
    """
    at = "_metadata.file_path as path", "_metadata.file_block_start as block", "monotonically_increasing_id() as at", "value"
    lines = scratch.keep(spark.read.text(path).selectExpr(*at))
    splits = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = _numbered_files(splits.select("path").distinct(), scratch)
    starts = scratch.keep(splits.select("path", "block", (before - F.col("first")).alias("shift")).join(files, "path"))
    return lines.join(_small(starts), ["path", "block"]).select("file_no", (F.col("at") + F.col("shift")).alias("line_no"), "value")


def _numbered_files(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """``path, file_no``: files from 0 in the order of their paths."""
    return numbered(paths, [F.col("path")], scratch).select("path", (F.col("n") - 1).alias("file_no"))


def _small(rows: DataFrame) -> DataFrame:
    """One row per file or split: broadcast up to ``BROADCAST_ROWS`` of them (counted), shuffled beyond."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _pair_id(at: str) -> Column:
    """Number of a record in its file, made unique over files."""
    return F.shiftleft("file_no", FILE_BITS) + F.col(at)


def read_fastq(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """``pair_id, header, bases, qual`` of the four-line records of one or more files; a record without its line of bases is dropped."""
    lines = numbered_lines(spark, path, scratch).withColumn("record", F.floor(F.col("line_no") / 4)).withColumn("part", F.col("line_no") % 4)
    pick = lambda k: F.max(F.when(F.col("part") == k, F.col("value")))
    records = lines.groupBy("file_no", "record").agg(pick(0).alias("header"), pick(1).alias("bases"), F.coalesce(pick(3), F.lit("")).alias("qual")).where("bases is not null")
    return records.select(_pair_id("record").alias("pair_id"), "header", "bases", "qual")


def mates(records: DataFrame, read_len: int = 36, quality_from: int | None = None) -> DataFrame:
    """``pair_id, mate1, mate2``: both mates stand in one line and are cut at ``read_len``; each keeps its longest valid start.

    With ``quality_from`` bases after the first so many are kept only up to the first of low quality.
    """
    (b1, b2), (q1, q2) = S.split_mates(F.col("bases"), read_len), S.split_mates(F.col("qual"), read_len)
    if quality_from is not None:
        b1, b2 = S.quality_trim(b1, q1, quality_from), S.quality_trim(b2, q2, quality_from)
    return records.select("pair_id", S.valid_prefix(b1, q1).alias("mate1"), S.valid_prefix(b2, q2).alias("mate2"))


def unpack_pairs(files: DataFrame, scratch: Scratch) -> DataFrame:
    """``path, pair_id, mate1, mate2`` of packed ``(path, content)``: per mate a length byte and two bits a base.

    Ids are unique over files. The format has no marks to start from inside a file, so a file is read by one
    task, a few megabytes at a time, and holds 2 GB at most; write large sets as many files. Files get their numbers before they
    are unpacked, and small ones are given on together. ``files`` is read twice, so it should be a table.
    """
    names = ["path", "file_no", "record", "mate1", "mate2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[pa.Array]] = []
            for path, no, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                content, at, record = np.frombuffer(data.as_buffer() or b"", dtype=np.uint8), 0, 0
                while at < len(content):
                    reads, used = packed.unpack(content[at : at + packed.PIECE_BYTES])
                    if not used:
                        raise ValueError(f"{path} ends inside a pair")
                    rows = len(reads) // 2
                    mates = [reads.take(pa.array(np.arange(k, 2 * rows, 2))).cast(pa.string()) for k in (0, 1)]
                    held.append([pa.repeat(pa.scalar(path, pa.string()), rows), pa.array(np.full(rows, no)), pa.array(np.arange(record, record + rows)), *mates])
                    at, record = at + used, record + rows
                    if rows >= GIVEN_ROWS or len(held) >= GIVEN_FILES:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names=names)
                        held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names=names)

    numbers = scratch.keep(_numbered_files(files.select("path").distinct(), scratch))
    told = files.join(_small(numbers), "path").select("path", "file_no", "content")
    rows = told.mapInArrow(run, "path string, file_no bigint, record bigint, mate1 string, mate2 string")
    return rows.select("path", _pair_id("record").alias("pair_id"), "mate1", "mate2")


def read_packed_pairs(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """``unpack_pairs`` of the files at ``path``."""
    return unpack_pairs(spark.read.format("binaryFile").load(path), scratch)


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pairs and their one-row metadata (``count, insert``) as ``write_pairs`` leaves them."""
    return spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/meta")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``path, seq``: the first line of each file dropped, the others joined; other letters than A, C, G, T are an error."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    return whole.select("path", F.when((F.col("seq") == "") | S.is_valid(F.col("seq")), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not a sequence of A, C, G and T: "), "path"))).alias("seq"))


def read_fasta_chunks(spark: SparkSession, path: str, k: int, scratch: Scratch, lines_each: int = 4096) -> DataFrame:
    """``file_no, chunk, seq``: stretches of the records of FASTA files whose windows of ``k`` are those of the records, each once.

    Files are read in splits and their numbered lines meet in chunks of ``lines_each``. A chunk begins with the
    last k-1 bases of its record that lie before it, over as many chunks as it takes; each chunk that has lines adds
    a base or a header, so the k-1 chunks before it are enough. Sequences are joined inside chunks only, so a record has
    no bound.
    """
    lines = numbered_lines(spark, path, scratch).where("value <> ''").withColumn("chunk", F.floor(F.col("line_no") / lines_each))
    # A header stands for a border between records.
    told = F.when(F.col("value").startswith(">"), F.lit(">")).otherwise(F.regexp_replace("value", r"\s", ""))
    chunks = lines.select("file_no", "chunk", F.struct("line_no", told.alias("t")).alias("l")).groupBy("file_no", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "").alias("text"))
    last = lambda c: F.right(F.substring_index(c, ">", -1), F.lit(k - 1))
    ends = scratch.keep(chunks.withColumn("end", F.concat(F.when(F.contains("text", F.lit(">")), F.lit(">")).otherwise(F.lit("")), last(F.col("text")))))
    # A row a chunk, without its text.
    before = Window.partitionBy("file_no").orderBy("chunk").rowsBetween(1 - k, -1) if k > 1 else None
    carried = last(F.array_join(F.collect_list("end").over(before), "")) if before is not None else F.lit("")
    carry = ends.select("file_no", "chunk", "end").select("file_no", "chunk", carried.alias("carry"))
    return ends.join(carry, ["file_no", "chunk"]).select("file_no", "chunk", F.explode(F.split(F.concat("carry", "text"), ">")).alias("seq"))


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: every line that is no header."""
    return spark.read.text(path).where(~F.col("value").startswith(">"))


def read_graph(spark: SparkSession, path: str, k: int) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), k)


def parse_histogram(lines: DataFrame, col: str = "value", last: bool = True) -> DataFrame:
    """``len, cnt`` out of text like ``Map(3 -> 5, 7 -> 1)``; without ``last`` an entry counts only if a comma follows."""
    pattern = r"[^\d](\d+) -> (\d+)" + ("" if last else ",")
    pairs = F.arrays_zip(F.regexp_extract_all(col, F.lit(pattern), 1).alias("l"), F.regexp_extract_all(col, F.lit(pattern), 2).alias("c"))
    return lines.select(F.explode(pairs).alias("p")).select(F.col("p").getField("l").cast("long").alias("len"), F.col("p").getField("c").cast("long").alias("cnt"))
