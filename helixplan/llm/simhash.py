"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has bit b set if more than half of its shingles' 64-bit hashes have. Two fingerprints that
differ in at most two bits differ, cut in two segments of 32 bits, by at most one bit in one of them. So
each distinct fingerprint is indexed under 64 variants: a segment with one bit made a wildcard. Fingerprints
that may be linked share a variant, an equality join finds them, and the whole fingerprints are verified.

The work is on distinct fingerprints, so copies cost one entry. Buckets are first counted with map-side
combining. A bucket of two gives its pair at once; buckets of up to ``bucket`` fingerprints are gathered and
their verified pairs given out. The fingerprints of larger buckets take an exact way without pairs: they are
indexed under all whole fingerprints with two wildcards, so that a bucket holds at most four, all linked to
each other, and each is tied to the bucket's smallest. No link is lost and rows grow in proportion to
fingerprints. Links become classes by star contractions in tables of the shared folder.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; with fewer words than
a shingle the whole sequence is one; repeated rows and ties share a class; a null id belongs to its class
but names one only if it has no other member; an empty table gives no rows; a text of any length is read whole, with about 100 bytes of
memory for each of its words; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixplan.llm.common import slices
from helixplan.plans.components import connected_components
from helixplan.plans.runtime import Scratch
from helixplan.plans.skew import dealt_join, hot_keys

BITS = 64
#: Crowded buckets and ids of rows that go, of under 20 bytes each, that may be broadcast.
BROADCAST_BUCKETS = 200_000
BROADCAST_IDS = 500_000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned integer."""
    from xxhash import xxh64_intdigest

    if not text:
        return 0
    # Bytes split and lower-case by ASCII alone.
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxh64_intdigest(b" ".join(w), seed)
    n = len(w) - words + 1
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    h = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id_col, __fp)``, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            found = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=[id_col, "__fp"])

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` as __text").mapInArrow(run, f"`{id_col}` {kind}, __fp bigint")


def _bit(i):
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def variants(prints: DataFrame) -> DataFrame:
    """``(fp, place, rest)``: wildcard bit and its segment without that bit."""
    low, high = F.lit(0xFFFFFFFF).cast("long"), F.lit(-(1 << 32)).cast("long")
    place = F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("place")
    segment = F.when(F.col("place") < 32, low).otherwise(high)
    return prints.select("fp", place).select("fp", "place", F.col("fp").bitwiseAND(segment).bitwiseAND(F.bitwise_not(_bit(F.col("place")))).alias("rest"))


def _differ(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def _dealt(prints: DataFrame, rows: int = 20_000) -> DataFrame:
    """A small table in enough parts that making 64 rows of each row is spread over the cluster."""
    return prints.repartition(max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() // rows)), "fp")


def links(prints: DataFrame, scratch: Scratch, distance: int = 2, bucket: int = 64) -> DataFrame:
    """Verified links ``(a, b)`` that tie together exactly what is within ``distance`` (2 at most) of each other, over chains of ``prints`` (distinct ``fp``)."""
    if not 0 <= distance <= 2:
        raise ValueError("two segments with one wildcard find fingerprints that differ in two bits at most")
    prints = _dealt(prints)
    found = variants(prints).groupBy("place", "rest").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    counted = scratch.keep(found)
    twos = counted.where("n = 2").select("a", "b").where(_differ(F.col("a"), F.col("b")) <= distance).distinct()
    many = counted.where("n > 2").select("place", "rest", "n")
    n = many.count()
    if not n:
        return twos
    # 20 bytes a bucket: a counted few MB spare the second shuffle of all variants, more buckets pay for it once.
    met = scratch.keep(variants(prints).join(F.broadcast(many) if n <= BROADCAST_BUCKETS else many, ["place", "rest"]))
    gathered = met.where(F.col("n") <= bucket).groupBy("place", "rest").agg(F.array_sort(F.collect_list("fp")).alias("all"))
    pair = F.flatten(
        F.transform(
            "all",
            lambda x, i: F.transform(F.filter(F.slice(F.col("all"), i + 2, F.size("all")), lambda y: _differ(x, y) <= distance), lambda y: F.struct(x.alias("a"), y.alias("b"))),
        )
    )
    some = gathered.select(F.explode(pair).alias("p")).select("p.a", "p.b").distinct()
    out = twos.unionByName(some)
    heavy = many.where(F.col("n") > bucket)
    if heavy.isEmpty():
        return out
    crowd = scratch.keep(met.where(F.col("n") > bucket).select("fp").distinct())
    return out.unionByName(_tied(crowd, distance))


def _tied(crowd: DataFrame, distance: int) -> DataFrame:
    """Stars over the buckets of all whole fingerprints with ``distance`` wildcards."""
    if distance == 0:
        return crowd.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    first = crowd.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i"))
    if distance == 1:
        keyed = first.select("fp", _bit(F.col("i")).alias("w"))
    else:
        keyed = first.where(F.col("i") < BITS - 1).select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(BITS - 1))).alias("j")).select("fp", _bit(F.col("i")).bitwiseOR(_bit(F.col("j"))).alias("w"))
    boxes = keyed.groupBy("w", F.col("fp").bitwiseAND(F.bitwise_not("w")).alias("rest")).agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return boxes.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, bucket: int = 64) -> DataFrame:
    """One row per input row: ``id_col, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, id_col, text_col, words))
    prints = scratch.keep(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).alias("__low")))
    classes = connected_components(links(prints.select("fp"), scratch, distance, bucket), "a", "b", scratch)
    grouped = prints.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("__class", F.coalesce("component", "fp"))
    least = grouped.groupBy("__class").agg(F.min("__low").alias("component_id"))
    named = scratch.keep(grouped.select("fp", "__class").join(least, "__class").select(F.col("fp").alias("__fp"), "component_id"))
    # A fingerprint may have a third of the rows; its rows are dealt by their ids.
    hot = hot_keys(rows, "__fp", rows.count())
    return dealt_join(rows, named, "__fp", hot, F.col(id_col)).select(id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one document of each class: the one whose id names it (rows that share that id stay together).

    Only ids that go meet the documents again: up to ``BROADCAST_IDS`` of them (counted) are broadcast and the
    texts stay where they are; more take one shuffled join.
    """
    scratch = Scratch(docs.sparkSession, "simhash-drop")
    classes = near_duplicates(docs, id_col, text_col, words, distance)
    gone = scratch.keep(classes.groupBy(F.col(id_col).alias("__k")).agg(F.max(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("__stays")).where("not __stays").select("__k"))
    # The table's own columns are held in one, so that none of their names can clash with ours.
    held = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(id_col).alias("id"))
    left = held.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col("id").eqNullSafe(F.col("__k")), "left_anti")
    return left.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
