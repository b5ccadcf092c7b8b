"""Runs of words out of texts, cut where nothing crosses, and their integer codes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are held at a time.
BLOCK_BYTES = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Whether a byte is no ASCII white space.
SOLID = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, each cut before an ASCII space; a longer run without one stays whole."""
    at = 0
    while len(data) - at > size:
        gap = _GAP.search(data, at + size)
        if gap is None:
            break
        yield data[at : gap.start()]
        at = gap.start()
    yield data[at:]


def runs(parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The runs between ASCII white space of all parts in order, and how many each part has."""
    data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
    solid = SOLID[data]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size -= starts
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return _binary(data[solid], np.concatenate([[0], np.cumsum(size)])), np.diff(np.searchsorted(starts, begins))


def cut_at(data: bytes, begins: np.ndarray) -> pa.Array:
    """``data`` cut at ascending places, the first of which is 0."""
    return _binary(np.frombuffer(data, dtype=np.uint8), np.append(begins, len(data)))


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def coded(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Each word's place in the list of distinct words, and that list."""
    held = words.dictionary_encode()
    return held.indices.to_numpy(zero_copy_only=False), held.dictionary.to_pylist()


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``begin[i], begin[i] + 1, ...``, ``size[i]`` of them, for all i."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
