"""Sequence functions as Column expressions; all of them stay in generated code.

A sequence is a string over A, C, G and T. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The order of the bases, their two-bit codes (complement is ``code XOR 3``).
BASES = "AGCT"
CODES = {"A": 0, "G": 1, "C": 2, "T": 3}


def complement(s: Column) -> Column:
    return F.translate(s, "ACGT", "TGCA")


def revcomp(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGT", "TGCA")


def canonical(s: Column) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(s, revcomp(s))


def take(s: Column, n) -> Column:
    return F.substring(s, F.lit(1), _col(n))


def drop(s: Column, n) -> Column:
    return F.substr(s, _col(n) + 1)


def subseq(s: Column, left, right) -> Column:
    """Bases ``left`` to ``right`` (exclusive), both clamped to the sequence."""
    a = F.greatest(_col(left), F.lit(0))
    b = F.least(_col(right), F.length(s))
    return F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))


def base_at(s: Column, i) -> Column:
    return F.substring(s, _col(i) + 1, F.lit(1))


def prepend(base: Column, s: Column) -> Column:
    return F.concat(base, s)


def append(s: Column, base: Column) -> Column:
    return F.concat(s, base)


def is_valid(s: Column) -> Column:
    return s.rlike("^[ACGT]+$")


def valid_prefix(bases: Column, quality: Column | None = None) -> Column:
    """Longest valid start of the bases, no longer than the quality string."""
    cut = bases if quality is None else F.substring(bases, F.lit(1), F.least(F.length(bases), F.length(quality)))
    return F.regexp_extract(cut, "^[ACGT]*", 0)


def quality_trim(bases: Column, quality: Column, k: int, least: int = 20, zero: int = 33) -> Column:
    """The first ``k`` bases and after them all up to the first whose Phred quality is below ``least``."""
    n = F.least(F.length(bases), F.length(quality))
    later = F.when(n > k, F.sequence(F.lit(k + 1), n)).otherwise(F.array().cast("array<int>"))
    low = F.filter(later, lambda i: F.ascii(F.substring(quality, i, F.lit(1))) - zero < least)
    return F.substring(bases, F.lit(1), F.coalesce(F.get(low, F.lit(0)) - 1, n))


def split_mates(bases: Column, n: int) -> tuple[Column, Column]:
    return take(bases, n), drop(bases, n)


def windows(s: Column, k: int) -> Column:
    """All length-``k`` windows in order; none of a shorter sequence."""
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def pack(s: Column) -> Column:
    """Two bits a base, the first base in the lowest bits, for up to 31 bases."""
    code = lambda c: F.when(c == "A", 0).when(c == "G", 1).when(c == "C", 2).otherwise(3).cast("long")
    every = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(every, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", code(F.substring(s, i, F.lit(1))), (i - 1) * 2)))


def unpack(packed: Column, n) -> Column:
    n = _col(n)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(every, lambda i: F.substring(F.lit(BASES), F.call_function("shiftrightunsigned", packed, i * 2).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))), "")


def edge_label(seq: Column, limit: int = 50) -> Column:
    """A short sequence itself, the length of a long one."""
    return F.when(F.length(seq) <= limit, seq).otherwise(F.length(seq).cast("string"))


def register_sql(spark: SparkSession) -> None:
    """The same functions for SQL: ``revcomp``, ``canonical_kmer``, ``valid_prefix`` and the table function ``kmers``.

    A window of a text is found by reading it from its beginning, one of bytes at once, so ``kmers`` cuts bytes where each letter
    is one; places in a text with wider letters are handed on as negative numbers, -1 for the first, and cut as text.
    """
    for text in (
        "revcomp(s STRING) RETURNS STRING RETURN translate(reverse(s), 'ACGT', 'TGCA')",
        "canonical_kmer(s STRING) RETURNS STRING RETURN least(s, translate(reverse(s), 'ACGT', 'TGCA'))",
        "valid_prefix(s STRING) RETURNS STRING RETURN regexp_extract(s, '^[ACGT]*', 0)",
        "kmers(s STRING, k INT) RETURNS TABLE(pos INT, kmer STRING) RETURN SELECT if(i < 0, -1 - i, i), if(i < 0, substr(s, -i, k), cast(substr(cast(s AS BINARY), i + 1, k) AS STRING)) "
        "FROM explode(CASE WHEN length(s) < k THEN array() WHEN octet_length(s) = length(s) THEN sequence(0, length(s) - k) ELSE sequence(-1, k - length(s) - 1) END) AS t(i)",
    ):
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION " + text)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(seq_id, seq)``: the letters A, C, G and T of each text, upper-cased.

    An input of fewer partitions than cores (a single small file) is dealt out first, because windows multiply
    its bytes; a large input stays where it is.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.select(id_col, text_col)
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores)
    return docs.select(F.col(id_col).alias("seq_id"), F.upper(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[^ACGTacgt]+", "")).alias("seq"))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(int(x))
