"""Importance resampling towards a target text collection by hashed n-grams over an integer word dictionary.

A task maps distinct words to integers. An n-gram is the pair of the integer of its first n-1 words and of its last
word, so it is one 64-bit number at every n; distinct numbers get integers of their own in the same way. The
bytes of a distinct n-gram are put together once, from the words behind its integers, and hashed once into one of
``buckets``; occurrences take the bucket by their integer, which joins the counts back. A dictionary that is full
begins anew, which only costs time.

Features of a collection are counted in buckets by the tasks (``buckets`` numbers each, however large the input) and
added up by Spark. The gain of a bucket is ``floor(1000 ln(((t+1)(S+b)) / ((s+1)(T+b))))`` of its counts s and t of
S and T features in documents and target; a document's weight adds up the gains of its features. The gains, one
number a bucket, are the only thing that is sent to all tasks, and their number is a parameter.

Documents are drawn without replacement by the largest weight plus seeded Gumbel noise. They are numbered in
that order over range partitions, never in one task.

Edge cases: a null or empty text has no features, weight 0, and takes part in no draw unless ``least_words`` is 0; a
null id counts as the empty text in the noise and comes last among ties; repeated rows are documents of their own
and draw the same noise, ties going to the smaller id; an empty collection of documents gives no rows, an empty target
counts 0 of everything; a text of any length is read whole, a megabyte of words at a time; further columns are not
read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixplan.llm.common import slices, table
from helixplan.llm.words import BLOCK_BYTES, blocks, coded, runs
from helixplan.plans.iterate import numbered
from helixplan.plans.runtime import Scratch

BUCKETS = 10_000
#: Distinct words and n-grams that a task's dictionary holds.
REMEMBERED = 1_000_000
#: Bytes of words: digits, letters (A-Z are lowered) and all of characters beyond ASCII; all else separates.
_TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class GramDictionary:
    """Integers of words and n-grams, and the bucket of each n-gram."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets = n, buckets
        self._forget()

    def _forget(self) -> None:
        self.ids: list[dict] = [{} for _ in range(self.n)]
        self.spelled: list[list[bytes]] = [[] for _ in range(self.n)]
        self.bucket: list[list[int]] = [[] for _ in range(self.n)]
        self.hashed = 0

    def _enter(self, level: int, keys: list, spell) -> np.ndarray:
        """Integers of distinct keys; the bytes of new ones are made and hashed here, and nowhere else."""
        ids, spelled, bucket = self.ids[level], self.spelled[level], self.bucket[level]
        for key in keys:
            if key not in ids:
                ids[key] = len(spelled)
                text = spell(key)
                spelled.append(text)
                bucket.append(zlib.crc32(text) % self.buckets)
                self.hashed += 1
        return np.fromiter((ids[k] for k in keys), dtype=np.int64, count=len(keys))

    def grams(self, words: pa.Array, owner: np.ndarray, skip: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n the buckets of all runs of n words of one owner, and their owners; runs that end in the first ``skip`` words are left out."""
        if sum(map(len, self.spelled)) > REMEMBERED:
            self._forget()
        codes, distinct = coded(words)
        run = self._enter(0, distinct, lambda w: w)[codes]
        word, place = run, np.arange(len(run))
        for level in range(self.n):
            if level:
                # A run of one word more: the integer of its beginning, and the word that follows in the same text.
                follows = place + level < len(word)
                follows[follows] = owner[place[follows] + level] == owner[place[follows]]
                run, place = run[follows], place[follows]
                keys, back = np.unique(run << 32 | word[place + level], return_inverse=True)
                before, last = self.spelled[level - 1], self.spelled[0]
                run = self._enter(level, keys.tolist(), lambda k: before[k >> 32] + b" " + last[k & 0xFFFFFFFF])[back]  # noqa: B023
            told = place + level >= skip
            yield np.array(self.bucket[level], dtype=np.int64)[run[told]], owner[place[told]]


def _pieces(texts: list[str | None], n: int) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """Words of texts, the rows they are of, and how many at the beginning were there before; about a megabyte at a time.

    The next piece of a long text begins with the n-1 words before it once more, so that no run is lost.
    """
    parts: list[bytes] = []
    rows: list[int] = []
    held = skip = 0
    for row, text in enumerate(texts):
        for k, block in enumerate(blocks((text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS))):
            if k or held > BLOCK_BYTES:
                words, count = runs(parts)
                owner = np.repeat(np.array(rows), count)
                yield words, owner, skip
                skip = min(n - 1, int((owner == row).sum()))
                parts, rows, held = [b" ".join(words[len(words) - skip :].to_pylist())], [row], 0
            parts.append(block)
            rows.append(row)
            held += len(block)
    words, count = runs(parts)
    yield words, np.repeat(np.array(rows, dtype=np.int64), count), skip


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, features``: the features of all texts; each task gives one row a bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = GramDictionary(n, buckets), np.zeros(buckets, dtype=np.int64)
        for part in slices(batches, "__text"):
            for words, owner, skip in _pieces(part.column(0).to_pylist(), n):
                for bucket, _ in grams.grams(words, owner, skip):
                    total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "features"])

    each = docs.selectExpr(f"`{text_col}` as __text").mapInArrow(run, "bucket bigint, features bigint")
    return each.groupBy("bucket").agg(F.sum("features").alias("features"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of all ``buckets``."""
    spark = docs.sparkSession
    s, t = (bucket_counts(x, text_col, n, buckets).withColumnRenamed("features", name) for x, name in ((docs, "s"), (target, "t")))
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t")])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1.0) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row of sums


def weighed(docs: DataFrame, gains: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``id_col, n_words, n_features, weight`` of each row. ``gains`` has ``buckets`` rows and goes to every task."""
    gain = np.zeros(buckets, dtype=np.int64)
    for bucket, value in gains.collect():  # one number a bucket
        gain[bucket] = value
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = GramDictionary(n, buckets)
        for part in slices(batches, "__text"):
            rows = part.num_rows
            n_words, features, weight = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            for words, owner, skip in _pieces(part.column(1).to_pylist(), n):
                for level, (bucket, row) in enumerate(grams.grams(words, owner, skip)):
                    count = np.bincount(row, minlength=rows)
                    features += count
                    if level == 0:
                        n_words += count
                    weight += np.bincount(row, gain[bucket], rows).astype(np.int64)  # sums below 2^53 are exact
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (n_words, features, weight))], names=[id_col, "n_words", "n_features", "weight"])

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` as __text").mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: str) -> Column:
    """Gumbel noise of a key in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: str = "2024", scratch: Scratch | None = None
) -> DataFrame:
    """One row per document: ``id_col, n_words, n_features, weight, score, rank``; ``rank`` is null for those not drawn.

    ``percent`` of the documents with ``least_words`` words or more are drawn, rounded down.
    """
    scratch = scratch or Scratch(docs.sparkSession, "resample")
    gains = scratch.keep(bucket_gains(docs, target, text_col, n, buckets))
    rows = weighed(docs, gains, id_col, text_col, n, buckets).withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    scored = scratch.keep(rows.withColumn("__fit", F.col("n_words") >= least_words).withColumn("__row", F.monotonically_increasing_id()))
    fit = scored.where("__fit").count()
    order = [F.desc("__fit"), F.desc("score"), F.asc_nulls_last(id_col), F.desc("weight"), F.asc("n_features"), F.asc("__row")]
    ranked = numbered(scored, order, scratch, "__n")
    drawn = F.col("__fit") & (F.col("__n") <= fit * percent // 100)
    return ranked.select(id_col, "n_words", "n_features", "weight", "score", F.when(drawn, F.col("__n")).alias("rank"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH crc AS (SELECT list(e ORDER BY b) AS tab FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS e FROM range(256) AS t(b))),
d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
met AS (SELECT n, unnest(words) AS w FROM d UNION ALL SELECT -1, unnest(words) FROM b),
spelled AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM met)),
bytes AS (SELECT w, list_transform(range(1, length(h) + 1, 2), lambda i: ((strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)::BIGINT) AS l FROM spelled),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda c, x: xor(c >> 8, tab[(xor(c, x) % 256) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM bytes, crc),
counts AS (SELECT bucket, count(*) FILTER (n >= 0) AS s, count(*) FILTER (n < 0) AS t FROM met JOIN hashed USING (w) GROUP BY 1),
sums AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT AS gain FROM counts, sums),
weights AS (SELECT n, sum(gain)::BIGINT AS weight FROM met JOIN hashed USING (w) JOIN gains USING (bucket) WHERE n >= 0 GROUP BY 1),
noise AS (SELECT n, doc_id, len(words) AS n_features, substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS h FROM d),
scored AS (SELECT n, doc_id, n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(h, i, 1)) - 1)::BIGINT << (4 * (8 - i)))) + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM noise LEFT JOIN weights USING (n)),
ranked AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN ranked USING (n)
"""
