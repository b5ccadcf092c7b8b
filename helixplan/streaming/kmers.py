"""Incremental k-mer counts over a stream of reads (an extension; batch counting is ``operators.kmers``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from helixplan.operators.kmers import count_kmers


def stream_counts(reads: DataFrame, k: int, seq_col: str = "seq") -> DataFrame:
    """Running canonical counts; write it in update mode. The state holds one count per k-mer."""
    if not reads.isStreaming:
        raise ValueError("reads is not a stream")
    return count_kmers(reads, k, seq_col)
