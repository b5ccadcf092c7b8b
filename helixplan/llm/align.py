"""Alignment of two tokenizers' tokens over the same bytes.

A text, with a space before it, is cut by a byte-level vocabulary A and by a piece vocabulary B. Two pointers
walk along the cumulative ends of both; where both end the text is cut into groups. Tokens of a group are
linked, each of A with each of B. Spark counts in how many documents a pair of ids is linked, takes the largest
count of each id on either side, and joins both back to the documents' links.

The work of a task goes by words: a text is cut before runs of ASCII white space, where neither vocabulary's tokens
reach over (checked on the vocabularies, tested on texts), so that both end there and no group spans it. What the two
libraries and the merge make of a distinct word is remembered in a bounded table of the worker. A text of which some
word isn't spelled by its tokens is judged as a whole.

A document's links are held as its distinct pairs with their numbers, not one by one. Pairs that most
documents share are few: of pairs with counts at or above a power of two as many as ``BROADCAST_PAIRS`` rows hold (counted) are
broadcast, and only rows of rarer pairs are shuffled for the join, each of which has a bounded part of all rows.

Edge cases: a null or empty text, and one that either vocabulary can't spell exactly, has no tokens and no
links; repeated rows are documents of their own in the counts; an empty table gives no rows; a null id is an id
like any other; a text of any length is aligned whole; further columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixplan.llm.common import table
from helixplan.llm.words import BLOCK_BYTES, SOLID, coded, cut_at, ragged
from helixplan.plans.runtime import Scratch

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs, one row each, that may be broadcast.
BROADCAST_PAIRS = 200_000
#: Distinct words that a worker remembers; reaching it only costs time.
REMEMBERED = 250_000
#: Texts that are put together at a time.
ROWS = 512
_MARK = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes for bytes: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def merged_groups(a_sizes: list[int], b_sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups ``(a_from, a_to, b_from, b_to)`` between the places where tokens of both sides end; sizes are in bytes and above 0."""
    groups = []
    i = j = at_a = at_b = from_a = from_b = 0
    while i < len(a_sizes) or j < len(b_sizes):
        if j >= len(b_sizes) or (i < len(a_sizes) and at_a <= at_b):
            at_a += a_sizes[i]
            i += 1
        else:
            at_b += b_sizes[j]
            j += 1
        if at_a == at_b:
            groups.append((from_a, i, from_b, j))
            from_a, from_b = i, j
    return groups


def borders(data: bytes) -> np.ndarray:
    """Places before runs of ASCII white space at which a text (after its first space) may be cut, and 0.

    A run begins with a space or line feed and follows something solid. It follows an ASCII character, or is a
    single one with an ASCII character after it, since white space beyond ASCII would be one run with it.
    """
    x = np.frombuffer(data, dtype=np.uint8)
    solid = SOLID[x]
    at = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    at = at[at + 1 < len(x)]
    fit = ((x[at] == 0x20) | (x[at] == 0x0A)) & ((x[at - 1] < 0x80) | (solid[at + 1] & (x[at + 1] < 0x80)))
    return np.concatenate([[0], at[fit]])


class Aligner:
    """Aligns texts by both vocabularies, word by word."""

    def __init__(self, a_model: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _byte_letters()
        spelled = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_MARK in p.lstrip(_MARK) or (len(p) > 1 and re.search("[\n ]", p)) for p in pieces):
            raise ValueError("pieces of vocabulary B run over word borders")
        self.mark = self.b.piece_to_id(_MARK)
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = [len(t) for t in self.a_bytes], [len(t) for t in self.b_bytes]
        self.known: dict[bytes, int] = {}
        self.text: list[str] = []
        self.counts = array("q")  # tokens of A, tokens of B, groups, links and whether the word is spelled, five a word
        self.pairs, self.times, self.ends = array("q"), array("q"), array("q", [0])

    def _aligned(self, a: list[int], b: list[int]) -> tuple[str, tuple[int, int, int, int], dict[int, int]]:
        """Groups as text, numbers of tokens, groups and links, and how often each pair is linked."""
        told, met, links = [], {}, 0
        groups = merged_groups([self.a_size[t] for t in a], [self.b_size[t] for t in b])
        for a0, a1, b0, b1 in groups:
            n = (a1 - a0) * (b1 - b0)
            links += n
            if n == 1:
                told.append(f"{a[a0]}|{b[b0]}")
                pair = a[a0] << 32 | b[b0]
                met[pair] = met.get(pair, 0) + 1
                continue
            some_a, some_b = a[a0:a1], b[b0:b1]
            told.append(",".join(map(str, some_a)) + "|" + ",".join(map(str, some_b)))
            # A long group may hold the same ids many times.
            one_by_one = n <= 64
            for x, k in ((x, 1) for x in some_a) if one_by_one else Counter(some_a).items():
                for y, m in ((y, 1) for y in some_b) if one_by_one else Counter(some_b).items():
                    pair = x << 32 | y
                    met[pair] = met.get(pair, 0) + k * m
        return ";".join(told), (len(a), len(b), len(groups), links), met

    def _spelled(self, a: list[int], b: list[int], told: bytes) -> bool:
        return b"".join([self.a_bytes[t] for t in a]) == told == b"".join([self.b_bytes[t] for t in b])

    def _learn(self, words: list[bytes]) -> None:
        """Words begin with white space; B puts a mark of its own before a text, which stands for a word's first space."""
        texts = [w.decode("utf-8", "replace") for w in words]
        firsts = self.a.encode_batch_fast(texts, add_special_tokens=False)
        seconds = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for word, a, b in zip(words, firsts, seconds):
            a = a.ids
            exact = True
            if word[0] != 0x20:
                exact = b[0] == self.mark
                b = b[1:]
            exact = exact and self._spelled(a, b, word)
            text, counts, met = self._aligned(a, b) if exact else ("", (0, 0, 0, 0), {})
            self.known[word] = len(self.text)
            self.text.append(text)
            self.counts.extend((*counts, exact))
            self.pairs.extend(met)
            self.times.extend(met.values())
            self.ends.append(len(self.pairs))

    def _forget(self, words: list[bytes], size: int) -> None:
        """Takes the words learned last back, so that ``size`` are left."""
        for w in words:
            del self.known[w]
        del self.text[size:], self.counts[5 * size :], self.ends[size + 1 :]
        del self.pairs[self.ends[size] :], self.times[self.ends[size] :]

    def align(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For at most ``ROWS`` texts: groups as text, four numbers a text, and pairs and times in the order of texts with where each text's begin."""
        rows = len(texts)
        numbers = np.zeros((rows, 4), dtype=np.int64)
        data, begins, count, base = [], [], np.zeros(rows, dtype=np.int64), 0
        for k, text in enumerate(texts):
            if text:
                data.append(b" " + text.encode("utf-8", "surrogatepass"))
                some = borders(data[-1])
                begins.append(some + base)
                count[k] = len(some)
                base += len(data[-1])
        if not data:
            return [""] * rows, numbers, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(rows + 1, dtype=np.int64)
        codes, distinct = coded(cut_at(b"".join(data), np.concatenate(begins)))
        had = len(self.text)
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        words = np.fromiter((self.known[w] for w in distinct), dtype=np.int64, count=len(distinct))[codes]
        owner = np.repeat(np.arange(rows), count)
        counts = np.array(self.counts, dtype=np.int64).reshape(-1, 5)[words]
        exact = np.bincount(owner, counts[:, 4], rows) == count
        for c in range(4):
            numbers[:, c] = np.bincount(owner, counts[:, c], rows)
        ends = np.array(self.ends, dtype=np.int64)
        # A word counts once a text, with its number; then pairs likewise.
        kinds, often = np.unique(owner << 40 | words, return_counts=True)
        row, word = kinds >> 40, kinds & ((1 << 40) - 1)
        size = ends[word + 1] - ends[word]
        where = ragged(ends[word], size)
        # Both ids of a pair in 53 bits, the text's number above them.
        pair = np.array(self.pairs, dtype=np.int64)[where]
        keys, place = np.unique(np.repeat(row, size) << 53 | (pair >> 32) << 26 | pair & 0x3FFFFFF, return_inverse=True)
        times = np.bincount(place, np.array(self.times, dtype=np.int64)[where] * np.repeat(often, size), len(keys)).astype(np.int64)
        firsts = np.searchsorted(keys >> 53, np.arange(rows + 1))
        pairs = ((keys >> 26) & 0x7FFFFFF) << 32 | keys & 0x3FFFFFF
        at = np.concatenate([[0], np.cumsum(count)]).tolist()
        listed = words.tolist()
        groups = [";".join([self.text[w] for w in listed[a:b]]) for a, b in zip(at, at[1:])]
        if not exact.all():
            groups, pairs, times, firsts = self._mend(texts, np.flatnonzero(~exact), groups, numbers, pairs, times, firsts)
        if len(self.text) > REMEMBERED:
            self._forget(new, had)
        return groups, numbers, pairs, times, firsts

    def _mend(self, texts, wrong, groups, numbers, pairs, times, firsts):
        """Texts with a word that its own tokens don't spell: both libraries cut them whole."""
        lists = [[pairs[a:b], times[a:b]] for a, b in zip(firsts, firsts[1:])]
        for k in wrong.tolist():
            a, b = self.a.encode(" " + texts[k], add_special_tokens=False).ids, self.b.encode(texts[k])
            spelled = self._spelled(a, b, b" " + texts[k].encode("utf-8", "surrogatepass"))
            groups[k], numbers[k], met = self._aligned(a, b) if spelled else ("", (0, 0, 0, 0), {})
            lists[k] = [np.array(list(x), dtype=np.int64) for x in (met, met.values())]
        return groups, *(np.concatenate([x[c] for x in lists]) for c in (0, 1)), np.concatenate([[0], np.cumsum([len(x[0]) for x in lists])])


@lru_cache(maxsize=1)
def _aligner(a_model: str, b_model: bytes) -> Aligner:
    """A worker's aligner; its tasks share what it remembers."""
    return Aligner(a_model, b_model)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = VOCABULARY_A, b_path: str = VOCABULARY_B) -> DataFrame:
    """One row per row: ``id_col, n_a, n_b, n_groups, n_links``, ``groups`` (``a1,a2|b1;a3|b2``) and the distinct linked ``pairs`` (``a << 32 | b``) with their ``times``."""
    with open(a_path, encoding="utf-8") as f:
        a_model = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(a_model, b_model)
        for frame in frames:
            texts = frame["__text"].tolist()
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held < BLOCK_BYTES) and end - at < ROWS:
                    held += len(texts[end] or "")
                    end += 1
                groups, numbers, pairs, times, firsts = aligner.align(texts[at:end])
                out = pd.DataFrame(numbers, columns=["n_a", "n_b", "n_groups", "n_links"])
                out.insert(0, "__id", frame["__id"].iloc[at:end].to_numpy())
                yield out.assign(groups=groups, pairs=np.split(pairs, firsts[1:-1]), times=np.split(times, firsts[1:-1]))
                at = end

    schema = "__id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"
    # As text an id may be null without turning into a fraction in pandas.
    found = docs.selectExpr(f"cast(`{id_col}` as string) as __id", f"`{text_col}` as __text").mapInPandas(run, schema)
    return found.select(F.col("__id").cast(kind).alias(id_col), *found.columns[1:])


def pair_counts(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``pair, docs, best_a, best_b``: how many rows hold a pair, and whether no pair of the same A id (B id) is held by more."""
    counted = scratch.keep(links.groupBy("pair").agg(F.count("*").alias("docs")).withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(0xFFFFFFFF)}))
    met = counted
    for side in ("a", "b"):
        met = met.join(counted.groupBy(side).agg(F.max("docs").alias(f"most_{side}")), side)
    return met.select("pair", "docs", *[(F.col("docs") == F.col(f"most_{s}")).alias(f"best_{s}") for s in ("a", "b")])


def link_scores(rows: DataFrame, scratch: Scratch, row_col: str = "__row") -> DataFrame:
    """``row_col, n_best, n_best_b, count_sum`` of the rows that have links; ``rows`` has unique ``row_col``, ``pairs`` and ``times``."""
    links = rows.select(row_col, F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    links = links.toDF(row_col, "pair", "times")
    counts = scratch.keep(pair_counts(links, scratch))
    sizes = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()  # a row per power of two
    floor, room = 64, BROADCAST_PAIRS
    for power, n in sorted(sizes, reverse=True):
        if n > room:
            break
        floor, room = power, room - n
    often = F.floor(F.log2("docs")) >= floor
    common = F.broadcast(counts.where(often))
    met = links.join(common, "pair")
    if any(power < floor for power, _ in sizes):
        met = met.unionByName(links.join(common.select("pair"), "pair", "left_anti").join(counts.where(~often), "pair"))
    best = lambda s: F.sum(F.when(F.col(f"best_{s}"), F.col("times")).otherwise(F.lit(0)))
    return met.groupBy(row_col).agg(best("a").alias("n_best"), best("b").alias("n_best_b"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "align")
    docs = table(spark, sf_dir, "documents")
    told = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    rows = scratch.keep(aligned(docs).withColumn("groups_sha256", told).drop("groups").withColumn("__row", F.monotonically_increasing_id()))
    scores = link_scores(rows, scratch)
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(scores, "__row", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
