"""SentencePiece (merge type) encoding with seeded merge-dropout, and exact decoding.

The vocabulary is a public merge-type model read from a path that is a parameter. Encoding works on
stretches that no merge crosses: a run of space marks with the word after it, or a run of line feeds. In a
stretch every adjacent pair that is a piece is a candidate on an agenda; the best score goes first and the
leftmost among equals. With ``dropout > 0`` a candidate is skipped if a hash keyed by the seed, the
document's id, the stretch's place in the text, the candidate's span and its piece falls below the dropout
rate; a skipped candidate can return only as part of a wider one. So every occurrence of a word is drawn by
itself. Only the cut without dropout and its merges are remembered, in a table that is emptied when full: an
occurrence that skips none of these merges is cut like that, every other is cut anew.

Decoding is exact for every text: a space mark that stands in the text itself, and characters that the
vocabulary lacks, are spelled in byte pieces. The one space that encoding puts before a text is taken off.

Edge cases: a null text gives no ids and decodes to the empty text; the empty text gives no ids; repeated
rows and ties of id are encoded each by itself, alike if id and text are alike (with ``copies`` rows that are
alike are numbered and the number joins the key); a null id counts as the empty text; a text of
any length is cut whole, with about 100 bytes of memory for each of its words; further columns are not touched,
whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from helixplan.llm.common import slices
from helixplan.plans.runtime import Scratch

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Numbers of copies, two longs a row, that may be broadcast.
BROADCAST_ROWS = 200_000
#: Entries of a worker's table of cut words; reaching it only costs time.
REMEMBERED = 250_000
#: Characters of the rows that are cut in step; longer words are cut one by one.
WIDTHS = (4, 8, 12, 16, 24, 32, 48)
ROWS = 16384
SLOT_BITS = 20
FAR = np.int32(2**31 - 1)
#: Stretches whose merges are drawn, and pieces that are spelled, at a time.
BLOCK = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


class Pieces:
    """Cuts texts by the merges of a SentencePiece model; see the module's text."""

    def __init__(self, model: bytes, seed: int = 17, dropout: float = 0.1):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.seed = seed
        self.below = int(dropout * (1 << 32))
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {sp.id_to_piece(i): order[sp.get_score(i)] for i in plain if len(sp.id_to_piece(i)) > 1}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        spelled = [b""] * sp.get_piece_size()
        for piece, i in self.ids.items():
            spelled[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte):
            spelled[i] = bytes([b])
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.spelled_begin = np.cumsum([0, *map(len, spelled)])
        self.spelled_size = np.diff(self.spelled_begin)
        crossing = [p for p in self.ids if MARK in p.lstrip(MARK) or "\n" in p]
        if crossing:
            raise ValueError("pieces of this vocabulary run over word borders")
        self.stretch = re.compile(f"{MARK}+[^{MARK}\n\x00]*|\n+|\x00[\x01\x02]|[^{MARK}\n\x00]+")
        self._forget()
        self.latin = np.array([self.ids.get(chr(c), -1) for c in range(0x500)] + [-1], dtype=np.int32)
        pairs = sorted((self.ids[p[:i]] << 20 | self.ids[p[i:]], self.rank[p], self.ids[p]) for p in self.rank for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids)
        self.pair_key, self.pair_rank, self.pair_made = (np.array(x, dtype=t) for x, t in zip(zip(*pairs), (np.int64, np.int32, np.int32)))
        # A place in a table for each pair; the few that meet another's place are searched for.
        slot = self._slot(self.pair_key)
        self.slots = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        self.slots[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.shared = np.zeros(1 << SLOT_BITS, dtype=bool)
        self.shared[slot[self.slots[slot] != np.arange(len(slot))]] = True

    def _forget(self) -> None:
        """Empties the table of words: their places, characters, cuts without dropout, and where each one's merges begin."""
        self.known: dict[str, int] = {}
        self.held = 0
        #: Words that are cut one by one: long ones and those with signs that no piece has.
        self.alone: dict[int, str] = {}
        self.chars, self.cuts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.char_begin, self.cut_begin, self.begin = (np.zeros(1, dtype=np.int64) for _ in range(3))
        self.merge_rank = self.merge_place = np.zeros(0, dtype=np.uint32)

    def _salts(self, key: str, n: int) -> np.ndarray:
        """Salts of the stretches of one text."""
        start = int.from_bytes(hashlib.blake2b(f"{self.seed}:{key}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        x = np.uint64(start) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(32)).astype(np.uint32)

    def _skips(self, salt: int, start: int, end: int, rank: int) -> bool:
        x = ((salt ^ (rank * 0x9E3779B1)) + start * 0x85EBCA6B + end * 0xC2B2AE35) & 0xFFFFFFFF
        x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        x = ((x ^ (x >> 12)) * 0x297A2D39) & 0xFFFFFFFF
        return (x ^ (x >> 15)) < self.below

    def cut(self, word: str, salt: int | None, merges: list | None = None) -> list[int]:
        """Ids of one stretch, without dropout if ``salt`` is None; appends ``(start, end, rank)`` of what is merged."""
        if word[0] == "\x00":
            return [self.byte[b] for b in (b"\x00" if word[1] == "\x01" else MARK.encode())]
        return self._spell(self._agenda(word, salt, merges))

    def _agenda(self, word: str, salt: int | None, merges: list | None) -> list[str]:
        """The parts of one stretch: a heap of candidates and a linked list."""
        n, rank, below = len(word), self.rank.get, salt is not None and self.below
        end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int, j: int) -> None:
            if (r := rank(word[i : end[j]])) is not None and not (below and self._skips(salt, i, end[j], r)):
                heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = bytearray(n)
        while heap:
            r, i, j, stop = heapq.heappop(heap)
            if gone[i] or gone[j] or end[i] != j or end[j] != stop:
                continue
            gone[j], end[i] = 1, stop
            if merges is not None:
                merges.append((i, stop, r))
            if stop < n:
                before[stop] = i
                offer(i, stop)
            if before[i] >= 0:
                offer(before[i], i)
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = end[i]
        return out

    def _spell(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def _cut_rows(self, chars: np.ndarray, begin: np.ndarray, size: np.ndarray, salts: np.ndarray | None, merges: list | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Cuts rows of characters (ids, at ``begin`` in ``chars``) in step: in each round every row makes its best merge.

        Returns groups ``(rows, ids of all, ids in each)``; with ``merges`` also ``(row, start, end, rank)`` of what is merged.
        """
        out, low = [], 0
        for width in WIDTHS:
            some = np.flatnonzero((size > low) & (size <= width))
            low = width
            for at in range(0, len(some), ROWS):
                rows = some[at : at + ROWS]
                ids, kept = self._cut_group(chars, begin[rows], size[rows], None if salts is None else salts[rows], width, rows, merges)
                out.append((rows, ids[kept], kept.sum(axis=1)))
        return out

    def _cut_group(self, chars: np.ndarray, begin: np.ndarray, size: np.ndarray, salt: np.ndarray | None, width: int, rows: np.ndarray, merges: list | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(rows)
        column = np.arange(width, dtype=np.int32)
        inside = column < size[:, None]
        ids = np.where(inside, chars[np.minimum(begin[:, None] + column, len(chars) - 1)], 0)
        step = np.broadcast_to(column + 1, (n, width)).copy()
        back = np.broadcast_to(np.append(column, width) - 1, (n, width + 1)).copy()
        best = np.full((n, width), FAR, dtype=np.int32)
        made = np.zeros((n, width), dtype=np.int32)
        row, col = np.nonzero(inside[:, 1:])
        best[row, col], made[row, col] = self._pair(ids[row, col], ids[row, col + 1], salt, row, col, col + 2)
        every = np.arange(n)
        while True:
            # Rows that are done leave the rounds.
            at = best[every].argmin(axis=1) if len(every) < n else best.argmin(axis=1)
            some = best[every, at] < FAR
            row, a = every[some], at[some]
            if not len(row):
                break
            every = row
            b = step[row, a]
            c = step[row, b]
            if merges is not None:
                merges.append(np.stack([rows[row], a, c, best[row, a]]))
            ids[row, a] = made[row, a]
            ids[row, b] = -1
            best[row, b] = FAR
            best[row, a] = FAR
            step[row, a] = c
            back[row, c] = a
            k = np.flatnonzero(c < size[row])
            if len(k):
                r, x, y = row[k], a[k], c[k]
                best[r, x], made[r, x] = self._pair(ids[r, x], ids[r, y], salt, r, x, step[r, y])
            k = np.flatnonzero(a > 0)
            if len(k):
                r, y = row[k], a[k]
                x = back[r, y]
                best[r, x], made[r, x] = self._pair(ids[r, x], ids[r, y], salt, r, x, c[k])
        return ids, inside & (ids >= 0)

    def _learn(self, words: list[str]) -> None:
        """Remembers words: their characters, their cut without dropout and what is merged on the way."""
        first, n = len(self.known), len(words)
        self.known.update(zip(words, range(first, first + n)))
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        self.held += int(size.sum())
        begin = np.cumsum(size) - size
        chars = self._char_ids(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        odd = size > WIDTHS[-1]
        odd[np.repeat(np.arange(n), size)[chars < 0]] = True
        merges: list[np.ndarray] = []
        groups = self._cut_rows(chars, begin, np.where(odd, 0, size), None, merges)
        for k in np.flatnonzero(odd).tolist():
            self.alone[first + k] = words[k]
            made: list = []
            ids = np.array(self.cut(words[k], None, made), dtype=np.int32)
            groups.append((np.array([k]), ids, np.array([len(ids)])))
            if made:
                merges.append(np.array([(k, *m) for m in made], dtype=np.int64).T)
        many = np.zeros(n, dtype=np.int64)
        for rows, _, each in groups:
            many[rows] = each
        cuts = np.empty(int(many.sum()), dtype=np.int32)
        _put(cuts, np.cumsum(many) - many, groups)
        self.cut_begin = np.concatenate([self.cut_begin, self.cut_begin[-1] + np.cumsum(many)])
        self.cuts = np.concatenate([self.cuts, cuts])
        self.char_begin = np.concatenate([self.char_begin, self.char_begin[-1] + np.cumsum(size)])
        self.chars = np.concatenate([self.chars, chars])
        word, start, end, rank = np.concatenate(merges, axis=1) if merges else np.zeros((4, 0), dtype=np.int64)
        order = np.argsort(word, kind="stable")
        rank, start, end = (x[order].astype(np.uint32) for x in (rank, start, end))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.bincount(word, minlength=n))])
        self.merge_rank = np.concatenate([self.merge_rank, rank * np.uint32(0x9E3779B1)])
        self.merge_place = np.concatenate([self.merge_place, start * np.uint32(0x85EBCA6B) + end * np.uint32(0xC2B2AE35)])

    def _changed(self, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Which occurrences of known words skip a merge of the cut without dropout."""
        start = self.begin[at]
        many = self.begin[at + 1] - start
        each = np.repeat(np.arange(len(at)), many)
        merge = np.arange(len(each)) - np.repeat(np.cumsum(many) - many - start, many)
        x = _mixed((salt[each] ^ self.merge_rank[merge]) + self.merge_place[merge])
        out = np.zeros(len(at), dtype=bool)
        out[each[x < self.below]] = True
        return out

    def _char_ids(self, code: np.ndarray) -> np.ndarray:
        ids = self.latin[np.minimum(code, len(self.latin) - 1)]
        far = code >= len(self.latin) - 1
        if far.any():
            some, place = np.unique(code[far], return_inverse=True)
            ids[far] = np.array([self.ids.get(chr(c), -1) for c in some.tolist()], dtype=np.int32)[place]
        return ids

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def _pair(self, left: np.ndarray, right: np.ndarray, salt: np.ndarray | None, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each candidate; ``FAR`` where there is none or it is skipped."""
        key = (left.astype(np.int64) << 20) | right
        slot = self._slot(key)
        at = self.slots[slot]
        hit = self.pair_key[at] == key
        if (again := np.flatnonzero(~hit & self.shared[slot])).size:
            at[again] = np.minimum(np.searchsorted(self.pair_key, key[again]), len(self.pair_key) - 1)
            hit[again] = self.pair_key[at[again]] == key[again]
        rank = np.where(hit, self.pair_rank[at], FAR)
        if self.below and salt is not None:
            x = (salt[row] ^ (rank.astype(np.uint32) * np.uint32(0x9E3779B1))) + start.astype(np.uint32) * np.uint32(0x85EBCA6B) + end.astype(np.uint32) * np.uint32(0xC2B2AE35)
            rank[_mixed(x) < self.below] = FAR
        return rank, self.pair_made[at]

    def encode(self, text: str | None, key: str = "") -> list[int]:
        """Ids of a whole text."""
        return self.encode_many([text], [key])[0].tolist()

    def encode_many(self, texts: list[str | None], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin; words that are not remembered yet are cut together, and so are changed occurrences."""
        if len(self.known) > REMEMBERED or self.held > 20 * REMEMBERED:
            self._forget()
        work = [self.stretch.findall(MARK + self._marked(t)) if t else [] for t in texts]
        many = np.fromiter(map(len, work), dtype=np.int64, count=len(work))
        words = list(chain.from_iterable(work))
        if fresh := set(words).difference(self.known):
            self._learn(list(fresh))
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        salts = np.concatenate([np.zeros(0, np.uint32), *(self._salts(k, n) for k, n in zip(keys, many.tolist()))]) if self.below else None
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for block in range(0, len(words), BLOCK):
            ids, size = self._cut_known(at[block : block + BLOCK], None if salts is None else salts[block : block + BLOCK])
            parts.append(ids)
            sizes.append(size)
        end = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(parts), end[np.concatenate([[0], np.cumsum(many)])]

    def _cut_known(self, at: np.ndarray, salts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of occurrences of remembered words, one after the other, and how many each has."""
        size = self.cut_begin[at + 1] - self.cut_begin[at]
        groups = []
        changed = np.zeros(len(at), dtype=bool)
        if salts is not None:
            changed = self._changed(at, salts)
            where = np.flatnonzero(changed)
            word, salt = at[where], salts[where]
            length = self.char_begin[word + 1] - self.char_begin[word]
            if self.alone:
                single = np.isin(word, np.fromiter(self.alone, dtype=np.int64, count=len(self.alone)))
                for k in np.flatnonzero(single).tolist():
                    ids = np.array(self.cut(self.alone[int(word[k])], int(salt[k])), dtype=np.int32)
                    groups.append((where[k : k + 1], ids, np.array([len(ids)])))
                length[single] = 0
            groups += [(where[rows], ids, each) for rows, ids, each in self._cut_rows(self.chars, self.char_begin[word], length, salt)]
            for rows, _, each in groups:
                size[rows] = each
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=np.int32)
        same = np.flatnonzero(~changed)
        out[_ragged(begin[same], size[same])] = self.cuts[_ragged(self.cut_begin[at[same]], size[same])]
        _put(out, begin, groups)
        return out, size

    @staticmethod
    def _marked(text: str) -> str:
        """Spaces as marks; NUL and marks of the text's own as two-sign groups of NUL, which no piece has."""
        if "\x00" in text or MARK in text:
            text = text.replace("\x00", "\x00\x01").replace(MARK, "\x00\x02")
        return text.replace(" ", MARK)

    def decode(self, ids) -> str:
        """The text that ``encode`` was given."""
        return self.decode_bytes(np.asarray(ids, dtype=np.int32))[1:].decode("utf-8", "surrogatepass")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the pieces, with the one space that encoding put before a text."""
        out = []
        for at in range(0, len(ids), BLOCK):
            some = ids[at : at + BLOCK]
            out.append(self.spelled[_ragged(self.spelled_begin[some], self.spelled_size[some])].tobytes())
        return b"".join(out)


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``begin[i], begin[i] + 1, ...``, ``size[i]`` of them, for all i."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _put(out: np.ndarray, begin: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Writes each row's ids of ``(rows, ids, ids in each)`` at its ``begin``."""
    for rows, ids, each in groups:
        out[_ragged(begin[rows], each)] = ids


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = VOCABULARY, seed: int = 17, dropout: float = 0.1, check: bool = True, copies: bool = False
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_pieces``, ``ids`` and ``lossless``, whether the ids decode to the text.

    A map over the rows: no shuffle, memory of one slice of rows and the bounded table of cut words. The
    model (under 1 MB) goes with the task; the path is read on the driver. With ``copies`` rows alike in id and
    text are numbered over the whole table and the number joins the key of the hash, so that each is cut by itself, the
    same set of cuts however the table is split. Up to ``BROADCAST_ROWS`` numbers (counted) are broadcast; more
    take a join that moves the texts once.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model, seed, dropout)
        for part in slices(batches, "__text"):
            keys = part.column(0)
            texts = part.column(1).to_pylist()
            names = ["" if x is None else str(x) for x in keys.to_pylist()]
            if copies:
                names = [f"{name}\x00{n}" if n else name for name, n in zip(names, part.column(2).to_pylist())]
            ids, ends = pieces.encode_many(texts, names)
            spelled = pieces.decode_bytes(ids) if check else b""
            ok, place = [], 0
            for text, a, b in zip(texts, ends.tolist(), ends[1:].tolist()):
                # Each text's pieces spell it, after the one space that encoding put before it.
                told = b" " + text.encode("utf-8", "surrogatepass") if text else b""
                size = int(pieces.spelled_size[ids[a:b]].sum()) if check else 0
                ok.append(not check or spelled[place : place + size] == told)
                place += size
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(ends)), lists, pa.array(ok, pa.bool_())], names=[id_col, "n_pieces", "ids", "lossless"])

    rows = docs.selectExpr(f"`{id_col}` as __name", f"`{text_col}` as __text")
    if copies:
        scratch = Scratch(docs.sparkSession, "copies")
        rows = rows.withColumn("__at", F.monotonically_increasing_id())
        if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
            rows = scratch.keep(rows)  # only files are read in the same order again
        numbers = copy_numbers(rows, scratch)
        few = numbers.count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(numbers) if few else numbers, "__at", "left").select("__name", "__text", "__copy")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_pieces bigint, ids array<int>, lossless boolean")


def copy_numbers(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``__at, __copy`` of all but the first of rows alike in ``__name`` and ``__text``, numbered over the whole table; ``__at`` names rows and, in its high bits, their partitions.

    Rows are numbered in each partition and partitions by their sizes, so one text in a third of all rows meets
    nowhere, and no text is shuffled.
    """
    slim = rows.select("__at", F.xxhash64("__name", "__text").alias("__key"), F.shiftright("__at", 33).alias("__part"))
    sizes = slim.groupBy("__key", "__part").agg(F.count("*").alias("__n"))
    by_key = Window.partitionBy("__key")
    before = F.coalesce(F.sum("__n").over(by_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = sizes.select("__key", "__part", before.alias("__before"), F.sum("__n").over(by_key).alias("__all")).where("__all > 1").drop("__all")
    within = F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__at")) - 1
    return scratch.keep(slim.withColumn("__within", within).join(shared, ["__key", "__part"]).select("__at", (F.col("__before") + F.col("__within")).alias("__copy")).where("__copy > 0"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
