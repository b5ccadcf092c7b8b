"""Near copies of documents by deletion-variant signatures, for a similarity instead of a number of bits.

A document is the set of 64-bit hashes of its shingles of ``words`` words; two are linked if their sets'
Jaccard similarity is ``least`` or more, and classes are what links tie together. The index is that of
``simhash``: a signature is cut into segments so that one differs in at most one place, every segment is indexed
under its variants with one place made a wildcard, an equality join finds what shares a variant, and candidates
are verified. Only the places differ: they hold min-hashes of the set instead of bits of a fingerprint. (Texts
of similarity 0.8 differ in ten of 64 bits on average and in up to 18; segments that stand so many changes leave
keys of five bits, under which all documents meet. A min-hash agrees with probability 0.8.) With nine segments
of six places a pair of similarity 0.8 has one that differs in at most one place with probability
1 - (1 - 0.655)^9 = 0.9999, and more similar pairs with more.

Beside it stands the index of SimHash itself: a set's fingerprint has the bits set in over half of its shingles' hashes, and
``simhash.links`` finds fingerprints that differ in two bits at most by its own deletion variants. Sets of fingerprints
so linked are candidates as well, and both kinds are verified alike on whole sets.

The work is on distinct sets, so copies cost one entry. Sets that share a variant fall into one group, found by
star contractions over one edge per set and variant; no table of pairs is made. In a group links are followed
from set to set, and a set that was reached is not compared again, so a group of near copies costs about one
comparison per set. A group of over ``crowd`` sets is first compared with one of its sets, wherever its
rows are; Jaccard distance is a metric, so a set at distance x from it, with x <= 1 - least, can have no
link to a set at distance y > x + 1 - least. What has no such link to any set that is not linked to the
first is done; only the rest is gathered.

Edge cases: null texts and texts without a word share one set; with fewer words than a shingle the whole
sequence is one; repeated rows and ties share a class; a null id belongs to its class but names one only if
it has no other member; an empty table gives no rows; a text of any length is read whole, with about 100 bytes of
memory for each of its words; further columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixplan.llm import simhash
from helixplan.llm.common import slices
from helixplan.plans.components import connected_components
from helixplan.plans.runtime import Scratch
from helixplan.plans.skew import dealt_join, hot_keys

#: Keys, ids and group names of under 40 bytes each that may be broadcast.
BROADCAST_ROWS = 200_000
#: First sets of crowded groups that may be sent to every task.
BROADCAST_SETS = 500
#: Shingles whose min-hashes are taken at a time.
BLOCK = 2048


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; never empty."""
    from xxhash import xxh64_intdigest

    # Bytes split and lower-case by ASCII alone.
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= words:
        return np.array([xxh64_intdigest(b" ".join(w), seed)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.unique(np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64, count=len(w) - words + 1))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _close(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    return min(len(a), len(b)) >= least * max(len(a), len(b)) and similarity(a, b) >= least


def _multipliers(n: int, seed: int = 5) -> np.ndarray:
    return np.random.RandomState(seed).randint(0, 2**63 - 1, size=n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least product of a shingle with each multiplier."""
    low = np.full(len(by), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), BLOCK):
        low = np.minimum(low, (shingles[at : at + BLOCK, None] * by).min(axis=0))
    return low


def variants(places: np.ndarray, segments: int) -> np.ndarray:
    """64-bit keys of every segment with each of its places made a wildcard."""
    cut = places.reshape(segments, -1)
    width = cut.shape[1]
    key = (np.arange(segments * width, dtype=np.uint64) + np.uint64(1)).reshape(segments, width) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(width):
        mixed = (key ^ cut[:, i : i + 1]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed[:, i] = key[:, i]
        key = mixed
    return key.ravel()


def set_print(shingles: np.ndarray) -> int:
    """SimHash fingerprint of a set: the bits set in over half of its hashes, as a signed long."""
    ones = np.zeros(simhash.BITS, dtype=np.int64)
    for at in range(0, len(shingles), 1 << 16):
        ones += np.unpackbits(shingles[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles), bitorder="little").tobytes(), "little", signed=True)


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, segments: int, width: int) -> DataFrame:
    """``(id_col, __set, __fp, __keys)``: name of the document's set, its fingerprint and its signature's variants."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers(segments * width)
        for part in slices(batches, "__text"):
            sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
            keys = pa.array([variants(signature(s, by), segments).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_name(s) for s in sets], pa.binary()), pa.array([set_print(s) for s in sets], pa.int64()), keys], names=[id_col, "__set", "__fp", "__keys"])

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` as __text").mapInArrow(run, f"`{id_col}` {kind}, __set binary, __fp bigint, __keys array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``(__set, __shingles)`` of rows ``(__text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            sets = [shingle_set(t, words) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["__set", "__shingles"])

    return docs.select("__text").mapInArrow(run, "__set binary, __shingles binary")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def follow(names: list[bytes], sets: list[np.ndarray], least: float) -> list[tuple[bytes, bytes]]:
    """``(first, name)`` for every set that is tied to an earlier one by links; each class has one first."""
    left, out = sorted(range(len(sets)), key=names.__getitem__), []
    while left:
        first, left = left[0], left[1:]
        reached = [first]
        while reached and left:
            at, stay = reached.pop(), []
            for i in left:
                if _close(sets[at], sets[i], least):
                    out.append((names[first], names[i]))
                    reached.append(i)
                else:
                    stay.append(i)
            left = stay
    return out


def _measured(sets: DataFrame, firsts: dict[int, tuple[bytes, bytes]]) -> DataFrame:
    """Sets of crowded groups with ``__first`` and their distance from it."""
    shared = sets.sparkSession.sparkContext.broadcast(firsts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {g: (n, np.frombuffer(s, dtype=np.uint64)) for g, (n, s) in shared.value.items()}
        for part in slices(batches, "__shingles"):
            mine = [of[g] for g in part.column(0).to_pylist()]
            far = [1 - similarity(f, np.frombuffer(s, dtype=np.uint64)) for (_, f), s in zip(mine, part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([n for n, _ in mine], pa.binary()), pa.array(far, pa.float64())], names=[*part.schema.names, "__first", "__far"])

    return sets.mapInArrow(run, "__group bigint, __set binary, __shingles binary, __first binary, __far double")


def links(sets: DataFrame, scratch: Scratch, least: float, crowd: int) -> DataFrame:
    """Links ``(a, b)`` that tie together exactly what links tie together in each group of ``(__group, __set, __shingles)``, sets once each."""

    def run(table):
        got = follow(table["__set"].to_pylist(), [np.frombuffer(s, dtype=np.uint64) for s in table["__shingles"].to_pylist()], least)
        return pa.table({"a": pa.array([a for a, _ in got], pa.binary()), "b": pa.array([b for _, b in got], pa.binary())})

    full = scratch.keep(sets.groupBy("__group").agg(F.count("*").alias("__n"), F.min("__set").alias("__first")).where(F.col("__n") > crowd))
    firsts = full.orderBy(F.desc("__n"), "__group").limit(BROADCAST_SETS)
    found = {r["__group"]: (bytes(r["__set"]), bytes(r["__shingles"])) for r in sets.join(F.broadcast(firsts.select(F.col("__first").alias("__set"))), "__set").select("__group", "__set", "__shingles").collect()}
    if not found:
        return sets.groupBy("__group").applyInArrow(run, "a binary, b binary")
    chosen = scratch.keep(firsts.select("__group"))
    far = scratch.keep(_measured(sets.join(F.broadcast(chosen), "__group"), found))
    # Rounding may not decide whether a set is looked at again.
    reach = 1 - least + 1e-9
    linked = F.col("__far") <= reach
    open_at = far.groupBy("__group").agg(F.min(F.when(~linked, F.col("__far"))).alias("__open"))
    rest = far.join(F.broadcast(open_at), "__group").where(F.col("__open").isNotNull() & (~linked | (F.col("__open") <= F.col("__far") + reach)))
    direct = far.where(linked & (F.col("__set") != F.col("__first"))).select(F.col("__first").alias("a"), F.col("__set").alias("b"))
    gathered = sets.join(F.broadcast(chosen), "__group", "left_anti").unionByName(rest.select("__group", "__set", "__shingles"))
    return direct.unionByName(gathered.groupBy("__group").applyInArrow(run, "a binary, b binary"))


def _print_edges(known: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: sets (short names) tied by equal fingerprints or by ones that differ in two bits at most; each fingerprint goes by its least set."""
    sets = scratch.keep(known.dropDuplicates(["__set"]).select(F.xxhash64("__set").alias("__at"), "__fp"))
    prints = scratch.keep(sets.groupBy("__fp").agg(F.min("__at").alias("a")))
    hot = hot_keys(sets, "__fp", sets.count())
    same = dealt_join(sets, prints, "__fp", hot, F.col("__at")).where(F.col("__at") != F.col("a")).select("a", F.col("__at").alias("b"))
    tied = scratch.keep(simhash.links(prints.select(F.col("__fp").alias("fp")), scratch).select(F.col("a").alias("x"), F.col("b").alias("y")))
    end = lambda key, name: prints.select(F.col("__fp").alias(key), F.col("a").alias(name))
    return same.unionByName(_few(tied).join(end("x", "a"), "x").join(end("y", "b"), "y").select("a", "b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, segments: int = 9, width: int = 6, crowd: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """``id_col, component_id`` of the rows of classes of several sets or rows: the smallest id reachable over links."""
    scratch = scratch or Scratch(docs.sparkSession, "near-copies")
    known = scratch.keep(sketches(docs, id_col, text_col, words, segments, width))
    named = scratch.keep(known.groupBy("__set").agg(F.min(id_col).alias("__low"), F.count("*").alias("__rows")).withColumn("__at", F.xxhash64("__set")))
    # A set's keys follow from the set, so only those of one of its rows count. Candidates go by a short name of
    # the set; two sets that share one by chance meet as candidates and are verified like others.
    keys = known.dropDuplicates(["__set"]).select(F.xxhash64("__set").alias("__at"), F.explode("__keys").alias("__key"))
    met = scratch.keep(keys.groupBy("__key").agg(F.min("__at").alias("a"), F.count("*").alias("n")).where("n > 1").select("__key", "a"))
    edges = scratch.keep(keys.join(_few(met), "__key").where(F.col("__at") != F.col("a")).select("a", F.col("__at").alias("b")).unionByName(_print_edges(known, scratch)).distinct())
    groups = scratch.keep(connected_components(edges, "a", "b", scratch).select(F.col("node").alias("__at"), F.col("component").alias("__group")))
    # The rows with a set's least id bring its text.
    asked = _few(scratch.keep(groups.join(named, "__at").select(F.col("__low").alias("__k")).distinct()))
    found = _sets(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(asked, F.col("__id").eqNullSafe(F.col("__k")), "left_semi"), words)
    sets = scratch.keep(found.withColumn("__at", F.xxhash64("__set")).join(_few(groups), "__at").drop("__at").dropDuplicates(["__set"]).select("__group", "__set", "__shingles"))
    classes = connected_components(links(sets, scratch, least, crowd), "a", "b", scratch)
    tied = named.join(classes.withColumnRenamed("node", "__set"), "__set", "left").where("component is not null or __rows > 1").withColumn("__class", F.coalesce("component", "__set"))
    low = tied.groupBy("__class").agg(F.min("__low").alias("component_id"))
    names = scratch.keep(tied.select("__set", "__class").join(low, "__class").select("__set", "component_id"))
    return known.select(id_col, "__set").join(_few(names), "__set").select(id_col, "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class: the one whose id names it (rows that share that id stay together).

    Only ids that go meet the documents again, as in ``simhash.drop_near_duplicates``.
    """
    scratch = Scratch(docs.sparkSession, "near-drop")
    classes = near_copies(docs, id_col, text_col, words, least, scratch=scratch)
    gone = scratch.keep(classes.groupBy(F.col(id_col).alias("__k")).agg(F.max(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("__stays")).where("not __stays").select("__k"))
    # The table's own columns are held in one, so that none of their names can clash with ours.
    held = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(id_col).alias("id"))
    left = held.join(_few(gone), F.col("id").eqNullSafe(F.col("__k")), "left_anti")
    return left.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
