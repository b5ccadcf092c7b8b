"""k-mer layer: windows, counts, minimum support, spectrum, degrees and terminals."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from helixplan.functions import seq as S
from helixplan.functions.keys import keys
from helixplan.plans.runtime import Scratch


def kmer_windows(seqs: DataFrame, k: int, seq_col: str = "seq", keep: tuple[str, ...] = (), with_pos: bool = False) -> DataFrame:
    """One row per window: ``keep`` columns, ``pos`` (from 0) if asked for, ``kmer``. Sequences shorter than ``k`` give none."""
    parts = [F.col(c) for c in keep]
    got = S.windows(F.col(seq_col), k)
    return seqs.select(*parts, F.posexplode(got).alias("pos", "kmer")) if with_pos else seqs.select(*parts, F.explode(got).alias("kmer"))


def count_keys(seqs: DataFrame, k: int, seq_col: str = "seq") -> DataFrame:
    """``(key, cnt)`` of canonical k-mers as ``keys(k)`` writes them; counts combine before the only shuffle, so a frequent k-mer is no hot key."""
    return keys(k).canonical_windows(seqs, seq_col).groupBy("key").agg(F.count("*").alias("cnt"))


def count_kmers(seqs: DataFrame, k: int, seq_col: str = "seq") -> DataFrame:
    """``(kmer, cnt)`` of canonical k-mers; what is shuffled are keys."""
    return count_keys(seqs, k, seq_col).select(keys(k).decode(F.col("key")).alias("kmer"), "cnt")


def solid_kmers(counts: DataFrame, min_count: int) -> DataFrame:
    return counts.where(F.col("cnt") >= min_count)


def spectrum(counts: DataFrame) -> DataFrame:
    """How many k-mers have each count."""
    return counts.groupBy("cnt").agg(F.count("*").alias("kmers"))


def distinct_kmers(seqs: DataFrame, k: int, seq_col: str = "seq", approximate: bool = False) -> DataFrame:
    """Number of distinct k-mers as they stand, without regard to strand. Those of A, C, G and T are told apart as keys, others as texts."""
    if approximate:
        return kmer_windows(seqs, k, seq_col).agg(F.approx_count_distinct("kmer").alias("kmers"))
    plain = keys(k).plain_windows(seqs, seq_col).distinct().select(F.lit(1).alias("one"))
    odd = kmer_windows(seqs.where(~S.is_valid(F.col(seq_col))), k, seq_col).where(~S.is_valid(F.col("kmer"))).distinct().select(F.lit(1).alias("one"))
    return plain.unionByName(odd).agg(F.count("*").alias("kmers"))


def oriented(solid: DataFrame) -> DataFrame:
    """Both strands of distinct canonical k-mers; a palindrome stands once. No shuffle."""
    return solid.select(F.explode(F.array_distinct(F.array("kmer", S.revcomp(F.col("kmer"))))).alias("kmer"))


def oriented_keys(solid: DataFrame, k: int) -> DataFrame:
    """``key`` of both strands of distinct canonical k-mers, given as ``key`` or as ``kmer``. No shuffle."""
    coded = keys(k)
    one = solid.select("key" if "key" in solid.columns else coded.encode(F.col("kmer")).alias("key"))
    return one.select(F.explode(F.array_distinct(F.array("key", coded.revcomp(F.col("key"))))).alias("key"))


def key_degrees(found: DataFrame, k: int) -> DataFrame:
    """``(key, in_deg, out_deg, terminal)`` of distinct oriented keys by counts of shared (k-1)-overlaps."""
    coded = keys(k)
    head, tail = coded.head(F.col("key")), coded.tail(F.col("key"))
    starts = found.groupBy(head.alias("overlap")).agg(F.count("*").alias("out_deg"))
    ends = found.groupBy(tail.alias("overlap")).agg(F.count("*").alias("in_deg"))
    met = found.withColumn("overlap", tail).join(starts, "overlap", "left").withColumn("overlap", head).join(ends, "overlap", "left")
    ins, outs = F.coalesce("in_deg", F.lit(0)).cast("long"), F.coalesce("out_deg", F.lit(0)).cast("long")
    odd = ((F.col("in_deg") != 1) | (F.col("out_deg") != 1)) & ((F.col("in_deg") != 0) | (F.col("out_deg") != 0))
    return met.select("key", ins.alias("in_deg"), outs.alias("out_deg")).withColumn("terminal", odd)


def junctions(rows: DataFrame, k: int, mark: Column) -> DataFrame:
    """``(overlap, mask)`` of the (k-1)-overlaps of canonical keys, in their lesser strand.

    Bit c of the mask stands for the k-mer with base c before the overlap, bit 4 + c for the one with base c behind it; on the other
    strand bit p is bit 7 - p. The bits eight places on are those of k-mers that ``mark`` holds for. A canonical k-mer gives two
    rows, which combine before the shuffle; both strands of every k-mer can be made of the masks.
    """
    coded = keys(k)
    key, (first, last) = F.col("key"), coded.ends(F.col("key"))
    bit = lambda p: F.call_function("shiftleft", F.lit(1), p)
    sides = F.array(F.struct(coded.head(key).alias("o"), (last + 4).alias("p")), F.struct(coded.tail(key).alias("o"), first.alias("p")))
    met = rows.select(mark.alias("marked"), F.explode(sides).alias("s")).select("marked", "s.o", "s.p").withColumn("r", coded.shorter().revcomp(F.col("o")))
    o, r, p = F.col("o"), F.col("r"), F.col("p")
    mask = F.when(o <= r, bit(p)).otherwise(F.lit(0)).bitwiseOR(F.when(r <= o, bit(7 - p)).otherwise(F.lit(0)))
    both = met.select(F.least(o, r).alias("overlap"), "marked", mask.alias("mask"))
    held = F.col("mask")
    return both.groupBy("overlap").agg(F.bit_or(F.when(F.col("marked"), held.bitwiseOR(F.shiftleft(held, 8))).otherwise(held)).alias("mask"))


def canonical_degrees(solid: DataFrame, k: int) -> DataFrame:
    """``(key, in_deg, out_deg, terminal)`` of distinct canonical keys; the other strand's degrees are these the other way round.

    Every junction tells its k-mers how many there are on its other side, so a k-mer hears from two and nothing is joined.
    """
    coded = keys(k)
    mask, p = F.col("mask"), F.col("p")
    bits = junctions(solid, k, F.lit(False)).select("overlap", "mask", F.explode(F.array(*map(F.lit, range(8)))).alias("p")).where(F.call_function("getbit", mask, p) == 1)
    before, behind = coded.grown(F.col("overlap"), p % 4)
    n = F.when(p < 4, F.bit_count(F.shiftright(mask, 4).bitwiseAND(F.lit(15)))).otherwise(F.bit_count(mask.bitwiseAND(F.lit(15))))
    met = bits.select(F.when(p < 4, before).otherwise(behind).alias("x"), (p >= 4).alias("ins"), n.alias("n")).withColumn("y", coded.revcomp(F.col("x")))
    x, y, ins = F.col("x"), F.col("y"), F.col("ins")
    told = lambda here: F.when((here & (x <= y)) | (~here & (y <= x)), F.col("n"))
    found = met.groupBy(F.least(x, y).alias("key")).agg(F.max(told(ins)).cast("long").alias("in_deg"), F.max(told(~ins)).cast("long").alias("out_deg"))
    odd = ((F.col("in_deg") != 1) | (F.col("out_deg") != 1)) & ((F.col("in_deg") != 0) | (F.col("out_deg") != 0))
    return found.withColumn("terminal", odd)


def key_steps(marked: DataFrame, k: int) -> DataFrame:
    """``(a, ta, b, tb)``: pairs of oriented keys that overlap in k-1 bases, each with whether it is terminal, from canonical keys with ``terminal``."""
    coded = keys(k)
    mask, c = F.col("mask"), F.col("c")
    has = lambda at: F.call_function("getbit", mask, at) == 1
    first, last = F.shiftright(c, 2), c.bitwiseAND(F.lit(3))
    pairs = junctions(marked, k, F.col("terminal")).select("overlap", "mask", F.explode(F.array(*map(F.lit, range(16)))).alias("c")).where(has(first) & has(last + 4))
    a, b = coded.grown(F.col("overlap"), first)[0], coded.grown(F.col("overlap"), last)[1]
    one = pairs.select("overlap", a.alias("a"), has(first + 8).alias("ta"), b.alias("b"), has(last + 12).alias("tb"))
    here = F.struct("a", "ta", "b", "tb")
    there = F.struct(coded.revcomp(F.col("b")).alias("a"), F.col("tb").alias("ta"), coded.revcomp(F.col("a")).alias("b"), F.col("ta").alias("tb"))
    # A junction that is its own other strand holds both directions already.
    every = F.when(F.col("overlap") == coded.shorter().revcomp(F.col("overlap")), F.array(here)).otherwise(F.array(here, there))
    return one.select(F.explode(every).alias("s")).select("s.*")


def degrees(kmers: DataFrame, k: int) -> DataFrame:
    """``(kmer, in_deg, out_deg, terminal)`` of distinct oriented k-mers."""
    coded = keys(k)
    return key_degrees(kmers.select(coded.encode(F.col("kmer")).alias("key")), k).select(coded.decode(F.col("key")).alias("kmer"), "in_deg", "out_deg", "terminal")


def successors(kmers: DataFrame, k: int) -> DataFrame:
    """``(kmer, next)``: pairs of distinct oriented k-mers that overlap in k-1 letters; at most four of each, so no key is hot."""
    left = kmers.select("kmer", F.substring("kmer", 2, k - 1).alias("overlap"))
    right = kmers.select(F.col("kmer").alias("next"), F.substring("kmer", 1, k - 1).alias("overlap"))
    return left.join(right, "overlap").select("kmer", "next")


def lookup(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``(kmer, cnt)`` of distinct k-mers of either strand; ``cnt`` is null where the table has none."""
    keys = asked.select("kmer").distinct().withColumn("__key", S.canonical(F.col("kmer")))
    return keys.join(counts.select(F.col("kmer").alias("__key"), "cnt"), "__key", "left").select("kmer", "cnt")


def conversion_columns(k: int) -> list[Column]:
    """Pairs, k-mer windows of both mates, and pairs with a mate shorter than ``k``, as aggregates."""
    n = lambda c: F.greatest(F.length(c) - (k - 1), F.lit(0)).cast("long")
    short = (F.length("mate1") < k) | (F.length("mate2") < k)
    return [F.count("*").alias("pairs"), F.coalesce(F.sum(n("mate1") + n("mate2")), F.lit(0)).alias("kmers"), F.count_if(short).alias("short_pairs")]


def conversion_counters(pairs: DataFrame, k: int) -> DataFrame:
    """One row of ``conversion_columns``."""
    return pairs.agg(*conversion_columns(k))


def restore(counts: DataFrame, min_count: int, k: int, depth: int, scratch: Scratch) -> DataFrame:
    """``(kmer, cnt, steps)``: rare k-mers on a path of at most ``depth`` steps from a solid k-mer to a solid one through rare ones.

    ``counts`` has ``kmer``, or ``key`` as ``count_keys`` gives it. ``far`` is a rare k-mer's least distance from the solid ones;
    its way on is its other strand's way there, so ``far`` of both strands serves both ends. ``steps`` is the least length of such a path.
    The first layer is a semi-join of (k-1)-overlaps, the only pass over both strands of all rare k-mers. A later one comes from
    the layer before it, four bases on: up to the middle of the depth it is looked up among the rare ones, and
    beyond it among the other strands of the layers that its way on may still lead through, so that it leaves no k-mer out that counts.
    """
    coded = keys(k)
    key = F.col("key")
    lesser = F.least(key, coded.revcomp(key))
    if "key" not in counts.columns:
        counts = scratch.keep(counts.select(coded.encode(F.col("kmer")).alias("key"), "cnt"))
    rare = counts.where(F.col("cnt") < min_count)
    strands = lambda rows: rows.select(F.explode(F.array_distinct(F.array("key", coded.revcomp(key)))).alias("key"), "cnt")
    behind = strands(counts.where(F.col("cnt") >= min_count)).select(coded.tail(key).alias("o")).distinct()
    layers: list[DataFrame] = []
    for far in range(1, depth):
        if not layers:
            every = strands(rare)
            met = every.join(behind, coded.head(every["key"]) == behind["o"], "left_semi")
        else:
            met = layers[-1].select(F.explode(coded.onward(key)).alias("key")).distinct()
            for layer in layers:
                met = met.join(layer.select("key"), "key", "left_anti")
            if far <= depth - far:
                met = met.select("key", lesser.alias("one")).join(rare.select(key.alias("one"), "cnt"), "one").select("key", "cnt")
            else:
                # What is left of the depth is less than a layer on: the other strand is in a layer already known.
                met = met.join(functools.reduce(DataFrame.unionByName, layers[: depth - far]).select(coded.revcomp(key).alias("key"), "cnt"), "key")
        layers.append(scratch.keep(met.select("key", "cnt", F.lit(far).alias("far"))))
        if layers[-1].isEmpty():
            break
    if not layers:
        return rare.where("false").select(coded.decode(key).alias("kmer"), "cnt", F.lit(0).alias("steps"))
    ahead = functools.reduce(DataFrame.unionByName, layers)
    onward = ahead.select(coded.revcomp(key).alias("key"), F.col("far").alias("back"))
    found = ahead.join(onward, "key").where(F.col("far") + F.col("back") <= depth)
    steps = found.groupBy(lesser.alias("key")).agg(F.first("cnt").alias("cnt"), F.min(F.col("far") + F.col("back")).alias("steps"))
    return steps.select(coded.decode(key).alias("kmer"), "cnt", "steps")
