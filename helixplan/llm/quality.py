"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of a language's common words (with one bin for
all other words) are compared with language references by Jensen-Shannon distance (base 2, 0 to 1). The
references are sums over all documents that carry a language; common words are a language's ``top`` most
frequent. A document is held to the language that it is nearest to, so its own label is not needed, and it
fails if the distance of its characters or of its words lies above a limit. Documents shorter than a guard are
not judged by that histogram.

Base rules come first: too few words, or too large a share of words in repeated windows of three.

Word counts are made and spilled by the engine; a Python worker holds one slice of rows (a single text may
be larger: then about 100 bytes for each of its words) and nothing that grows with the input.

Edge cases: null and empty texts have no words and fail the base rule; without any language only the base
rules decide; repeated rows and ties are judged row by row; of equally frequent words the first by its bytes is
common; a text of any length is judged whole; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from helixplan.llm.common import ascii_lower, slices
from helixplan.plans.runtime import Scratch

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Marks that are no part of a common word's ends.
MARKS = ".,;:!?'\"()-"
#: Classes of characters: lower, upper, other letters, digits, spaces, line feeds, sentence marks, symbols, other.
CLASSES = 9
#: Languages that get a reference: those with most characters.
MAX_LANGS = 1000


def _class_table() -> np.ndarray:
    out = np.empty(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if c == 10:
            k = 5
        elif s.isspace():
            k = 4
        elif s.islower():
            k = 0
        elif s.isupper():
            k = 1
        elif s.isalpha():
            k = 2
        elif s.isdigit():
            k = 3
        elif s in ".,;:!?'\"-()":
            k = 6
        elif s in SYMBOLS:
            k = 7
        else:
            k = 8
        out[c] = k
    return out


_TABLE: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_class_table())
    return np.bincount(_TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], minlength=CLASSES).astype(np.float64)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


def plain(word: bytes) -> bytes:
    return word.strip(MARKS.encode()).lower()


def numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words and the place of each word among them."""
    place: dict[bytes, int] = {}
    at = np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int64, count=len(words))
    return list(place), at


def repeat_words(at: np.ndarray) -> int:
    """Words in windows of three that occur twice or more; 8 bytes a word and array, whatever the length."""
    if len(at) < 4:
        return 0
    pair = np.unique(at[:-1] * (len(at) + 1) + at[1:], return_inverse=True)[1]
    _, window, count = np.unique(pair[:-1] * (len(at) + 1) + at[2:], return_inverse=True, return_counts=True)
    often = count[window] > 1
    if not often.any():
        return 0
    inside = np.zeros(len(at), dtype=bool)
    for k in range(3):
        inside[k : len(at) - 2 + k] |= often
    return int(inside.sum())


def base_counts(text: str, at: np.ndarray) -> tuple[int, int, int, int]:
    """``word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                dup += 1
            elif line.strip(SPACES):
                seen.add(line)
    return chars, symbols, dup, repeat_words(at)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the divergence in bits of ``p`` from each row of ``q``; both sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


@dataclass
class References:
    langs: list[str]
    classes: np.ndarray
    words: list[dict[bytes, int]]
    shares: list[np.ndarray]

    def distances(self, text: str, words: list[bytes], at: np.ndarray) -> tuple[float, float]:
        """Of characters and words (different ones and their places), to the language with the least sum."""
        if not self.langs:
            return 0.0, 0.0
        c = class_counts(text)
        chars = js_distance(c / max(c.sum(), 1), self.classes)
        count: Counter = Counter()
        for w, n in zip(words, np.bincount(at, minlength=len(words)).tolist()):
            count[plain(w)] += n
        apart = np.empty(len(self.langs))
        for j, (place, share) in enumerate(zip(self.words, self.shares)):
            bins = np.zeros(len(share))
            for w in place.keys() & count.keys():
                bins[place[w]] = count[w]
            bins[-1] = len(at) - bins.sum()
            apart[j] = js_distance(bins / max(len(at), 1), share)
        k = int((chars + apart).argmin())
        return float(chars[k]), float(apart[k])


def class_sums(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(l, k, n)``: characters of each class in each language, one row a task, language and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            rows = [(name, k, int(n)) for name, sums in held.items() for k, n in enumerate(sums.tolist())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["l", "k", "n"])

        for part in slices(batches, "t"):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text:
                    held[lang] = held.get(lang, 0) + class_counts(text)
            if len(held) > MAX_LANGS:
                yield out()
        yield out()

    return docs.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).mapInArrow(run, "l string, k int, n bigint").groupBy("l", "k").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(l, w, n)`` of all words of all texts. Aggregated by the engine, which spills what memory cannot hold."""
    words = docs.select(F.col(lang_col).alias("l"), F.explode(F.split(ascii_lower(F.col(text_col)), r"[ \t\n\x0B\f\r]+")).alias("w"))
    return words.where("w <> ''").select("l", F.btrim("w", F.lit(MARKS)).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 200) -> References:
    """References of all documents with a language; of over ``MAX_LANGS`` languages those with most characters."""
    scratch = Scratch(docs.sparkSession, "quality")
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chars = scratch.keep(class_sums(named, text_col, lang_col))
    langs = sorted(r["l"] for r in chars.groupBy("l").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGS).collect())
    at = {name: j for j, name in enumerate(langs)}
    classes = np.zeros((len(langs), CLASSES))
    kept = F.broadcast(docs.sparkSession.createDataFrame([(name,) for name in langs], "l string"))
    for r in chars.join(kept, "l").collect():
        classes[at[r["l"]], r["k"]] = r["n"]
    sums = scratch.keep(word_counts(named, text_col, lang_col))
    words: list[dict[bytes, int]] = [{} for _ in langs]
    counts: list[list[int]] = [[] for _ in langs]
    # The limit on the rank reaches the tasks before the shuffle: each hands on its own best words only.
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), F.col("w").cast("binary")))
    common = sums.withColumn("k", rank).where(F.col("k") <= top).join(kept, "l")
    for r in sorted(common.collect(), key=lambda r: (r["l"], r["k"])):
        words[at[r["l"]]][r["w"].encode("utf-8", "surrogatepass")] = len(counts[at[r["l"]]])
        counts[at[r["l"]]].append(r["n"])
    totals = {r["l"]: r["n"] for r in sums.groupBy("l").agg(F.sum("n").alias("n")).join(kept, "l").collect()}
    shares = []
    for j, name in enumerate(langs):
        all_words = max(totals.get(name, 0), 1)
        shares.append(np.array([*counts[j], all_words - sum(counts[j])], dtype=float) / all_words)
    scratch.clear()
    return References(langs, classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), words, shares)


def judge(docs: DataFrame, references: References, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: int = 50, far_chars: float = 0.28, far_words: float = 0.56, guard_chars: int = 300, guard_words: int = 60) -> DataFrame:
    """Counts, base rule and verdict of every row, with the two distances (null where a guard holds)."""
    shared = docs.sparkSession.sparkContext.broadcast(references)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            counts, failed, kept, far = [], [], [], []
            for text in part.column(1).to_pylist():
                text = text or ""
                words, at = numbered(words_of(text))
                n = len(at)
                base = (n, *base_counts(text, at))
                bad = n < least_words or 100 * base[4] > most_repeated * n
                chars = apart = None
                if len(text) >= guard_chars or n >= guard_words:
                    x, y = shared.value.distances(text, words, at)
                    chars, apart = x if len(text) >= guard_chars else None, y if n >= guard_words else None
                counts.append(base)
                failed.append(bad)
                far.append((chars, apart))
                kept.append(not bad and (chars is None or chars <= far_chars) and (apart is None or apart <= far_words))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array([f[0] for f in far], pa.float64()), pa.array([f[1] for f in far], pa.float64())], names=[id_col, *names, "base_failed", "kept", "js_chars", "js_words"])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, kept boolean, js_chars double, js_words double"
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, learn(docs))
