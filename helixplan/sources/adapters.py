"""Sequences and read pairs out of text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixplan.functions import seq as S


def document_pairs(docs: DataFrame, fragment: int = 250, step: int = 10, read_len: int = 36) -> DataFrame:
    """``pair_id, mate1, mate2`` from fragments at every ``step``-th start of each document's sequence.

    The second mate is read from the fragment's end on the other strand. Documents without id give none.
    """
    seqs = S.sequences(docs).where(F.col("seq_id").isNotNull() & (F.length("seq") >= fragment))
    starts = seqs.select("seq_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - (fragment - 1), F.lit(step))).alias("at"))
    first = F.expr(f"substr(seq, at, {read_len})")
    second = F.expr(f"substr(seq, at + {fragment - read_len}, {read_len})")
    return starts.select((F.col("seq_id") * F.lit(1 << 32) + F.col("at")).alias("pair_id"), first.alias("mate1"), S.revcomp(second).alias("mate2"))
