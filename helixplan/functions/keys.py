"""k-mers as integers: two bits a base, the first base in the highest, so that integers order like texts.

Up to 31 bases fit a positive long (``PackedKeys``); longer k-mers stay texts behind the same methods (``TextKeys``).
Windows of packed keys are rolled over the bases of many sequences at once: windows of width w shifted and joined to
those w further on give width 2w, so k needs log2(k) passes over an array, and both strands are rolled alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from helixplan.functions import seq as S

#: Bases in the order of their texts, and for reversing the two-bit groups of a long the widths and masks of its halves.
ORDER = "ACGT"
HALVES = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))
MOST = 31
#: Window starts that are rolled at a time.
CHUNK = 1 << 20
_CODE = np.full(256, -1, dtype=np.int64)
_CODE[np.frombuffer(ORDER.encode(), dtype=np.uint8)] = range(4)


class TextKeys:
    """A k-mer is its text."""

    kind = "string"

    def __init__(self, k: int):
        self.k = k

    def encode(self, kmer: Column) -> Column:
        return kmer

    def decode(self, key: Column) -> Column:
        return key

    def head(self, key: Column) -> Column:
        """The first k-1 bases."""
        return F.substring(key, 1, self.k - 1)

    def tail(self, key: Column) -> Column:
        """The last k-1 bases."""
        return F.substring(key, 2, self.k - 1)

    def last(self, key: Column) -> Column:
        return F.right(key, F.lit(1))

    def shorter(self) -> TextKeys:
        """Keys of k-1 bases as ``head`` and ``tail`` give them."""
        return type(self)(self.k - 1)

    def ends(self, key: Column) -> tuple[Column, Column]:
        """Codes (0 to 3) of the first and the last base."""
        return F.instr(F.lit(ORDER), F.left(key, F.lit(1))) - 1, F.instr(F.lit(ORDER), F.right(key, F.lit(1))) - 1

    def grown(self, overlap: Column, code: Column) -> tuple[Column, Column]:
        """Keys of a (k-1)-overlap with the base of a code before it, and behind it."""
        base = F.substring(F.lit(ORDER), code + 1, F.lit(1))
        return F.concat(base, overlap), F.concat(overlap, base)

    def onward(self, key: Column) -> Column:
        """The four keys that overlap this one's last k-1 bases with their first."""
        return F.array(*[F.concat(self.tail(key), F.lit(base)) for base in ORDER])

    def revcomp(self, key: Column) -> Column:
        return S.revcomp(key)

    def canonical_windows(self, seqs: DataFrame, seq_col: str = "seq") -> DataFrame:
        """``key``: the lesser strand of each window; windows with other letters than A, C, G and T give none."""
        return self.plain_windows(seqs, seq_col).select(S.canonical(F.col("key")).alias("key"))

    def plain_windows(self, seqs: DataFrame, seq_col: str = "seq") -> DataFrame:
        """``key``: each window as it stands, without those with other letters."""
        return seqs.select(F.explode(S.windows(F.col(seq_col), self.k)).alias("key")).where(S.is_valid(F.col("key")))


class PackedKeys(TextKeys):
    """A k-mer is a long."""

    kind = "bigint"

    def encode(self, kmer: Column) -> Column:
        return F.conv(F.translate(kmer, ORDER, "0123"), 4, 10).cast("long")

    def decode(self, key: Column) -> Column:
        # Four bases a look-up in a constant array of texts, which generated code indexes.
        parts = []
        for at in range(0, self.k, 4):
            n = min(4, self.k - at)
            texts = F.split(F.lit(",".join(map("".join, product(ORDER, repeat=n)))), ",")
            parts.append(F.get(texts, F.shiftrightunsigned(key, 2 * at).bitwiseAND(F.lit(4**n - 1)).cast("int")))
        return F.concat(*reversed(parts))

    def head(self, key: Column) -> Column:
        return F.shiftright(key, 2)

    def tail(self, key: Column) -> Column:
        return key.bitwiseAND(F.lit((1 << 2 * (self.k - 1)) - 1))

    def last(self, key: Column) -> Column:
        return F.substring(F.lit(ORDER), key.bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))

    def ends(self, key: Column) -> tuple[Column, Column]:
        return F.shiftrightunsigned(key, 2 * (self.k - 1)).bitwiseAND(F.lit(3)).cast("int"), key.bitwiseAND(F.lit(3)).cast("int")

    def grown(self, overlap: Column, code: Column) -> tuple[Column, Column]:
        code = code.cast("long")
        return overlap.bitwiseOR(F.shiftleft(code, 2 * (self.k - 1))), F.shiftleft(overlap, 2).bitwiseOR(code)

    def onward(self, key: Column) -> Column:
        return F.array(*[F.shiftleft(self.tail(key), 2).bitwiseOR(F.lit(code)) for code in range(4)])

    def revcomp(self, key: Column) -> Column:
        if not self.k:
            return key
        x = F.bitwise_not(key)
        for width, mask in HALVES:
            x = F.shiftrightunsigned(x, width).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), width))
        return F.shiftrightunsigned(x, 64 - 2 * self.k)

    def canonical_windows(self, seqs: DataFrame, seq_col: str = "seq") -> DataFrame:
        return self._windows(seqs, seq_col, lesser=True)

    def plain_windows(self, seqs: DataFrame, seq_col: str = "seq") -> DataFrame:
        return self._windows(seqs, seq_col, lesser=False)

    def _windows(self, seqs: DataFrame, seq_col: str, lesser: bool) -> DataFrame:
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(0).fill_null("").cast(pa.large_string())
                ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
                letters = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
                ends = ends[1:] - ends[0]
                for at in range(0, len(letters), CHUNK):
                    codes = _CODE[letters[at : at + CHUNK + k - 1]]
                    start = np.arange(at, at + max(len(codes) - k + 1, 0))
                    inside = start + k <= ends[np.searchsorted(ends, start, side="right")] if len(start) else np.zeros(0, dtype=bool)
                    if len(codes) and codes.min() < 0:
                        other = np.concatenate([[0], np.cumsum(codes < 0)])
                        inside &= other[k:] == other[: len(other) - k]
                        codes = np.maximum(codes, 0)
                    found = rolled(codes, k)
                    if lesser:
                        found = np.minimum(found, rolled(3 - codes[::-1], k)[::-1])
                    yield pa.RecordBatch.from_arrays([pa.array(found[inside])], names=["key"])

        return seqs.select(seq_col).mapInArrow(run, "key bigint")


def rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """Packed windows of ``k`` codes at every start."""
    if len(codes) < k:
        return np.zeros(0, dtype=np.int64)
    window, width = codes, 1
    for bit in f"{k:b}"[1:]:
        window = window[: len(window) - width] << (2 * width) | window[width:]
        width *= 2
        if bit == "1":
            window = window[: len(window) - 1] << 2 | codes[width:]
            width += 1
    return window


def keys(k: int) -> TextKeys:
    return PackedKeys(k) if k <= MOST else TextKeys(k)
