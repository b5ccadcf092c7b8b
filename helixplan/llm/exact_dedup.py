"""Exact deduplication by a tree-merge of sorted digest runs.

Every row gets a digest (SHA-256 of the normalised text) with two independent witnesses, its byte length
and a 64-bit hash of another family. Each partition of the digest table is a run: one entry per text with its
smallest and largest id and its rows, sorted by digest. Runs meet in binomial rounds: in round j run r and run
r + 2^j become one, so log2(runs) rounds leave a single run, and the number of runs follows the number of
partitions. A meeting is a full outer merge join of the two sorted runs on (run, digest, witnesses): both sides
are dealt by that key and sorted, so a run is held in sorted slices by key and every slice of every pair of runs
is merged in a task of its own, entry by entry. Entries unite only where digest and both witnesses agree (rows
with one digest and different witnesses stay apart), so every level holds verified ids: the smallest, the
largest and the row count of each text. Keys are unique in a run, so no key is hot at any level.

The way down is one equi-join on (digest, run) with the runs' own entries: a text that makes up a third of all
rows has one entry per run, so its rows never meet in one task.

Edge cases: a null text counts as the empty text; an empty table gives no rows; repeated rows and ties of
id are rows of their group each, and all rows that carry the kept id are marked as kept; a null id takes
part and stays only where its group has no other; a text of any length is digested where it lies; further
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixplan.llm.common import ascii_lower
from helixplan.plans.runtime import Scratch

KEY = ["__digest", "__witness", "__bytes"]
#: Keys of 50 bytes that may be broadcast.
BROADCAST_ROWS = 200_000


def digests(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Id, digest and witnesses of each row, and the partition that it lies in as its run; the only pass over the texts."""
    return (
        docs.select(F.col(id_col).alias("__id"), text.alias("__t"))
        .select("__id", F.unhex(F.sha2(F.col("__t").cast("binary"), 256)).alias("__digest"), F.xxhash64("__t").alias("__witness"), F.octet_length("__t").cast("long").alias("__bytes"))
        .withColumn("__run", F.spark_partition_id())
    )


def merge_runs(leaves: DataFrame, runs: int, scratch: Scratch) -> DataFrame:
    """``leaves``: one entry per run (numbered below ``runs``) and text. Returns one entry per text; each level is a table."""
    entry = ["__low", "__high", "__rows"]
    level, owned, left = leaves, False, runs
    while left > 1:
        half = F.shiftright("__run", 1).alias("__run")
        even = level.where("__run % 2 = 0").select(half, *KEY, *entry)
        odd = level.where("__run % 2 = 1").select(half, *KEY, *[F.col(c).alias(f"{c}_2") for c in entry])
        met = even.hint("merge").join(odd, ["__run", *KEY], "full_outer").select(
            "__run",
            *KEY,
            F.least("__low", "__low_2").alias("__low"),  # least and greatest pass over the side that has no entry
            F.greatest("__high", "__high_2").alias("__high"),
            (F.coalesce("__rows", F.lit(0)) + F.coalesce("__rows_2", F.lit(0))).alias("__rows"),
        )
        left = -(-left // 2)
        grown = scratch.keep(met)
        if owned:
            scratch.drop(level)
        level, owned = grown, True
    return level.drop("__run")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``; see the module's text."""
    scratch = scratch or Scratch(docs.sparkSession, "exact-dedup")
    rows = scratch.keep(digests(docs, id_col, ascii_lower(F.coalesce(F.col(text_col), F.lit("")))))
    runs = (rows.agg(F.max("__run")).first()[0] or 0) + 1
    leaves = scratch.keep(rows.groupBy("__run", *KEY).agg(F.min("__id").alias("__low"), F.max("__id").alias("__high"), F.count("*").alias("__rows")))
    top = merge_runs(leaves, runs, scratch).withColumn("__keep", F.col("__high" if keep == "largest" else "__low")).drop("__low", "__high")
    down = leaves.select("__run", *KEY).join(top, KEY)
    return rows.join(down, ["__run", *KEY]).select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__rows").cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text: the one with the largest id, and of rows that share id and text one.

    Only keys of rows that go meet the documents again. Up to ``BROADCAST_ROWS`` of them (counted) are
    broadcast and the texts stay where they are; more take one shuffled join.
    """
    scratch = Scratch(docs.sparkSession, "exact-drop")
    rows = exact_duplicates(docs, id_col, text_col, "largest", scratch)
    # One entry for each id and text: whether it goes, and how often a row that stays is there.
    keys = scratch.keep(rows.groupBy(F.col(id_col).alias("k"), F.unhex("text_sha256").alias("sha")).agg(F.max("kept").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    # The table's own columns are held in one, so that none of their names can clash with ours.
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("sha"))

    def listed(stays: bool) -> DataFrame:
        some = keys.where(F.col("stays") == stays).select("k", "sha")
        return F.broadcast(some) if some.count() <= BROADCAST_ROWS else some

    left = marked.join(listed(False), same, "left_anti")
    twice = listed(True)
    if not twice.isEmpty():
        left = left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["id", "digest"]))
    return left.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
