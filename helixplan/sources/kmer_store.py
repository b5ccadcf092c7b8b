"""A stored k-mer map: versions of a table that is bucketed by k-mer, changed by deltas.

A change joins the stored version, bucket by bucket where it lies, with the delta, which alone is shuffled, and
writes the next version in the same buckets. A version is complete before it is named the current one, so a lost
executor or driver leaves the one before. Of several writes to a k-mer in a delta the one with the largest version counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixplan.plans.runtime import Scratch


class KmerStore:
    """``kmer`` and one value column; tables of the session's catalog over files in the shared folder."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int = 8, value: str = "cnt"):
        self.spark, self.scratch, self.buckets, self.value = spark, scratch, buckets, value
        self.name = f"kmer_store_{uuid.uuid4().hex}"
        self.version = 0

    def rows(self) -> DataFrame:
        return self.spark.table(f"{self.name}_{self.version}")

    def _dealt(self, delta: DataFrame) -> DataFrame:
        return delta.select("kmer", self.value).repartition(self.buckets, "kmer")

    def _write(self, rows: DataFrame) -> None:
        rows.write.bucketBy(self.buckets, "kmer").sortBy("kmer").option("path", self.scratch.folder()).saveAsTable(f"{self.name}_{self.version + 1}")
        self.version += 1

    def create(self, rows: DataFrame) -> KmerStore:
        self._write(self._dealt(rows))
        return self

    def changed(self, delta: DataFrame, value: Column) -> DataFrame:
        """The stored rows changed by a delta of distinct k-mers; ``value`` is made of ``old`` and ``new``, null where one has none."""
        old, new = self.rows().withColumnRenamed(self.value, "old"), self._dealt(delta).withColumnRenamed(self.value, "new")
        return old.hint("merge").join(new, "kmer", "full_outer").select("kmer", value.alias(self.value))

    def merge(self, delta: DataFrame) -> KmerStore:
        """Adds the values of a delta."""
        once = delta.groupBy("kmer").agg(F.sum(self.value).alias(self.value))
        self._write(self.changed(once, F.coalesce(F.col("old"), F.lit(0)) + F.coalesce(F.col("new"), F.lit(0))))
        return self

    def overwrite(self, delta: DataFrame, version: str | None = None) -> KmerStore:
        """Replaces values; of several new ones the one with the largest ``version`` column, then the largest, stays."""
        newest = F.max_by(self.value, F.struct(*([version] if version else []), self.value)).alias(self.value)
        self._write(self.changed(delta.groupBy("kmer").agg(newest), F.coalesce("new", "old")))
        return self

    def insert(self, delta: DataFrame) -> KmerStore:
        """Adds rows beside those that a k-mer has: a map to many values. The stored files stay; the delta's join them."""
        self._dealt(delta).write.bucketBy(self.buckets, "kmer").sortBy("kmer").mode("append").saveAsTable(f"{self.name}_{self.version}")
        return self

    def delete(self, gone: DataFrame) -> KmerStore:
        """Drops k-mers."""
        self._write(self.rows().hint("merge").join(gone.select("kmer").distinct().repartition(self.buckets, "kmer"), "kmer", "left_anti"))
        return self

    def get(self, asked: DataFrame) -> DataFrame:
        """The stored rows of the asked k-mers; only the question is shuffled."""
        return self.rows().hint("merge").join(asked.select("kmer").distinct().repartition(self.buckets, "kmer"), "kmer", "left_semi")
