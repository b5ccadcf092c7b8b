"""Toxicity by class-conditional Kneser-Ney word models.

Two bigram models, one of toxic and one of ordinary texts. Both orders count distinct contexts, as
Kneser-Ney does below the top: a bigram counts the different words before it, a word the different words
before it. (With occurrences on top, a passage that is copied many times would tell most; its contexts are
the same in every copy and count once.) An absolute discount, n1 / (n1 + 2 n2) of the order's counts of
counts, is taken from every count, and all of a count of one. What is taken, with ``weight`` times the whole,
goes to shared backoff counts: the share that a bigram or word has in both classes, with a floor of ``floor``
discounts, as much more or less as what it backs off to is likelier in the class. A bigram backs off to its last
word, a word to its beginnings of ``STEMS`` characters, whose counts are those of all words that begin so: a rare
or unseen form of an insult is judged as its beginning is. Because of the weight, a rare expression, which one
class has by chance, says next to nothing, and words that both classes use cancel out; an expression with many
contexts in one class alone stands out. Weight and floor are those of a short list that predict held-back labels best.

A text's evidence is the difference of its two log-likelihoods, divided by its number of words; a logistic
curve, fitted on the held-back labels, turns it into a score.

The models are fitted on a bounded, documented sample: of each class up to ``per_class`` labelled documents,
those with the least keyed hash of their id, with their whole texts. It is counted in the cluster; the driver gets
words with two contexts or more, bigrams with three or more, beginnings with eight or more, of each up to
``TABLE_ROWS`` with most contexts, and one row for each held-back text. Held back is a quarter of each class's
distinct texts in the order of a hash, one at least; a class of one text is learned and held back with it. Scoring
reads every whole text, a slice of rows at a time.

Edge cases: null and empty texts and texts without a letter or digit get the share of toxic labels as score;
a null label counts as none, of several labels of a document the largest counts; a document without id has
no label and counts as held out; repeated rows and ties are scored row by row; a text of any length is
learned and scored whole, with memory in proportion to it; unless both classes have a labelled text with a letter or
digit every score is the share of toxic labels (0 without labels); further columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from helixplan.llm.common import fold, slices
from helixplan.plans.runtime import Scratch

WORDS = re.compile(r"\w+")
#: Contexts that a word, a bigram and a beginning of words have at least if they are to be more than their backoff.
LEAST_WORD, LEAST_PAIR, LEAST_STEM = 2, 3, 8
#: Words, bigrams and beginnings, each, that a model holds at most; those with most contexts.
TABLE_ROWS = 2_000_000
#: Lengths of the beginnings that longer words back off to, ascending.
STEMS = (5, 7)
#: Weights of the shared counts and their floors that the held-back labels choose from.
WEIGHTS, FLOORS = (100.0, 300.0, 1000.0), (1.0, 0.3, 0.1)


def _hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    # Signed, and never 0, which stands for the start of a text.
    return ((xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 3) >> 1) | 1) - (1 << 62)


class Vocabulary:
    """Places of words, from 1, and of beginnings behind them; 0 is every other word."""

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = words, stems
        self.place: dict[str, int] = {}
        self.stem_place: dict[str, int] = {}

    def __getstate__(self) -> tuple[list[str], list[str]]:
        return self.words, self.stems

    def __setstate__(self, state: tuple[list[str], list[str]]) -> None:
        self.__init__(*state)

    def prepare(self) -> Vocabulary:
        if not self.place:
            self.place.update((w, i + 1) for i, w in enumerate(self.words))
            self.stem_place.update((s, i + 1 + len(self.words)) for i, s in enumerate(self.stems))
        return self

    def begins(self, word: str) -> int:
        """Place of the longest known beginning of a word."""
        for k in reversed(STEMS):
            if len(word) > k:
                place = self.stem_place.get(word[:k])
                if place is not None:
                    return place
        return 0

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words of the texts, and the number of words of each."""
        self.prepare()
        get, begins = self.place.get, self.begins
        found = [[get(w) or begins(w) for w in WORDS.findall(t.lower())] if t else [] for t in texts]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter((i for x in found for i in x), dtype=np.int64, count=int(size.sum())), size


@dataclass
class Counts:
    """What is known of the two classes (0 ordinary, 1 toxic).

    ``contexts``: of each word, then of each beginning, in each class; ``pairs``: places of left and right word and
    contexts; ``after``: contexts of all bigrams that begin with a word; ``totals`` and ``discounts`` by order and class.
    """

    vocabulary: Vocabulary
    contexts: np.ndarray
    pairs: np.ndarray
    pair_contexts: np.ndarray
    after: np.ndarray
    totals: np.ndarray
    word_discount: np.ndarray
    pair_discount: np.ndarray


def _excess(counts: np.ndarray, discount: float) -> np.ndarray:
    return np.where(counts > 1, counts - discount, 0.0)


def _levels(v: Vocabulary) -> tuple[np.ndarray, list[np.ndarray]]:
    """The place that each place backs off to, and the places of each length of beginnings, then of words."""
    v.prepare()
    above = np.array([0, *map(v.begins, v.words), *map(v.begins, v.stems)], dtype=np.int64)
    first = len(v.words) + 1
    sizes = np.fromiter(map(len, v.stems), dtype=np.int64, count=len(v.stems))
    return above, [*(first + np.flatnonzero(sizes == k) for k in STEMS), np.arange(first)]


def ratios(c: Counts, weight: float, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log ratios toxic against ordinary: of each place's word (of an unseen word at a beginning's place), of backing off from it, and of each pair."""
    above, levels = _levels(c.vocabulary)
    n, stems = len(above), len(c.vocabulary.words) + 1
    counts, (left, right) = np.concatenate([np.zeros((2, 1)), c.contexts], axis=1), c.pairs
    totals, after = np.maximum(c.totals, 1), np.maximum(c.after, 1)
    # What both classes have of a word, and of a word after another, with a floor.
    shared = np.minimum(*(counts / totals[:, None])) + floor * c.word_discount.max() / totals.min()
    both = np.minimum(*(c.pair_contexts / after[:, left])) + floor * c.pair_discount.max() / after.min(axis=0)[left]
    word, back, pair = [], [], []
    for k in (0, 1):
        lift, like = np.ones(n), np.zeros(n)
        for level in levels:
            more = _excess(counts[k][level], c.word_discount[k])
            # What is discounted and the weight of the shared counts go to the backoff.
            rest = (1 - more.sum() / totals[k] + weight) / (1 + weight)
            like[level] = more / ((1 + weight) * totals[k]) + rest * shared[level] * lift[above[level]]
            lift[level] = like[level] / shared[level]
        like[stems:] = rest * lift[stems:]
        word.append(like)
        over = np.where(c.pair_contexts[k] >= LEAST_PAIR, _excess(c.pair_contexts[k], c.pair_discount[k]), 0.0)
        leave = (1 - np.bincount(left, weights=over, minlength=n) / after[k] + weight) / (1 + weight)
        back.append(leave)
        pair.append(over / ((1 + weight) * after[k][left]) + leave[left] * both * lift[right])
    return np.log(word[1] / word[0]), np.log(back[1] / back[0]), np.log(pair[1] / pair[0])


@dataclass
class ToxicModel:
    vocabulary: Vocabulary
    single: np.ndarray
    step: np.ndarray
    pair_key: np.ndarray
    pair: np.ndarray
    slope: float
    offset: float
    share: float

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio and number of words of each text."""
        ids, size = self.vocabulary.places(texts)
        return self.weigh(ids, size), size

    def weigh(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mean log ratios of texts that are given as places."""
        if not len(ids):
            return np.zeros(len(size))
        text = np.repeat(np.arange(len(size)), size)
        worth = self.single[ids]
        inside = np.flatnonzero(text[1:] == text[:-1]) + 1
        worth[inside] += self.step[ids[inside - 1]]
        if len(self.pair_key):
            key = (ids[inside - 1] << 32) | ids[inside]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            hit = self.pair_key[at] == key
            worth[inside[hit]] = self.pair[at[hit]]
        return np.bincount(text, weights=worth, minlength=len(size)) / np.maximum(size, 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        mean, size = self.evidence(texts)
        z = np.clip(self.slope * mean + self.offset, -60, 60)
        return np.where(size > 0, 1 / (1 + np.exp(-z)), self.share)


def model_of(c: Counts, weight: float, floor: float, share: float) -> ToxicModel:
    single, step, pair = ratios(c, weight, floor)
    key = (c.pairs[0] << 32) | c.pairs[1]
    order = np.argsort(key)
    return ToxicModel(c.vocabulary, single, step, key[order], pair[order], 1.0, 0.0, share)


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Weighted logistic fit of one feature by Newton steps."""
    if len(x) == 0 or y.min() == y.max():
        return 1.0, 0.0
    scale = x.std() or 1.0
    a, w = np.stack([x / scale, np.ones_like(x)], axis=1), w / w.sum()
    beta, penalty = np.zeros(2), np.diag([ridge, 1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (w * (p - y)) + penalty @ beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def grams(sample: DataFrame) -> DataFrame:
    """``(y, l, w, n)`` of ``(y, text)``: of each word ``w`` after the word of hash ``l`` (0: the start) the number of different words before both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for part in slices(batches, "text"):
            if len(known) > 200_000:
                known.clear()
            seen = set()
            for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = WORDS.findall(t.lower())
                for w in words:
                    if w not in known:
                        known[w] = _hash(w)
                at = [0, 0, *map(known.__getitem__, words)]
                seen.update(zip([y] * len(words), at, at[1:], words))
            if seen:
                y, first, left, word = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(first, pa.int64()), pa.array(left, pa.int64()), pa.array(word, pa.string())], names=["y", "f", "l", "w"])

    rows = sample.select("y", "text").mapInArrow(run, "y int, f long, l long, w string")
    return rows.distinct().groupBy("y", "l", "w").agg(F.count("*").alias("n"))


def _most(rows: DataFrame, n0: str, n1: str, *names: str) -> list:
    """Up to ``TABLE_ROWS`` rows, those with most contexts, ties by name."""
    return rows.orderBy(F.desc(F.greatest(n0, n1)), *names).limit(TABLE_ROWS).collect()


def count(sample: DataFrame, scratch: Scratch) -> Counts:
    """Counts of the sample ``(y, text)``; the driver gets what is more than its backoff."""
    pairs = scratch.keep(grams(sample))
    mine = [F.when(F.col("y") == k, F.col("n")).otherwise(0) for k in (0, 1)]
    one = [(F.col("y") == k).cast("long") for k in (0, 1)]
    words = scratch.keep(pairs.groupBy("w").agg(F.sum(one[0]).alias("t0"), F.sum(one[1]).alias("t1")))
    rows = _most(words.where((F.col("t0") >= LEAST_WORD) | (F.col("t1") >= LEAST_WORD)), "t0", "t1", "w")
    rows.sort()
    met = _most(pairs.where("l <> 0").groupBy("l", "w").agg(F.sum(mine[0]).alias("n0"), F.sum(mine[1]).alias("n1")).where((F.col("n0") >= LEAST_PAIR) | (F.col("n1") >= LEAST_PAIR)), "n0", "n1", "l", "w")
    starts = functools.reduce(DataFrame.unionAll, [words.where(F.length("w") > k).select(F.substring("w", 1, k).alias("s"), "t0", "t1") for k in STEMS])
    stems = sorted(_most(starts.groupBy("s").agg(F.sum("t0").alias("t0"), F.sum("t1").alias("t1")).where((F.col("t0") >= LEAST_STEM) | (F.col("t1") >= LEAST_STEM)), "t0", "t1", "s"))
    names = [r["w"] for r in rows]
    contexts = [[r["t0"] for r in rows], [r["t1"] for r in rows]]
    place = {w: i + 1 for i, w in enumerate(names)}
    for r in met:
        # A word with no more than one context anywhere has this one.
        if r["w"] not in place:
            names.append(r["w"])
            place[r["w"]] = len(names)
            contexts[0].append(int(r["n0"] > 0))
            contexts[1].append(int(r["n1"] > 0))
    at = {_hash(w): i for w, i in place.items()}
    # Three contexts of a bigram are three contexts of its left word, so that one is known.
    met = sorted((at[r["l"]], place[r["w"]], r["n0"], r["n1"]) for r in met if r["l"] in at)
    after = np.zeros((2, len(names) + len(stems) + 1))
    lefts = pairs.where("l <> 0").groupBy("l").agg(F.sum(mine[0]).alias("n0"), F.sum(mine[1]).alias("n1"), F.max("n").alias("m")).where(F.col("m") >= LEAST_PAIR).collect()
    for r in lefts:
        if r["l"] in at:
            after[:, at[r["l"]]] = r["n0"], r["n1"]
    told = words.agg(*[f(F.col(t)).alias(f"{name}{t}") for t in ("t0", "t1") for name, f in (("s", F.sum), ("a", lambda x: F.count_if(x == 1)), ("b", lambda x: F.count_if(x == 2)))]).first()
    twice = {(r["y"], r["n"]): r["c"] for r in pairs.where("n <= 2 and l <> 0").groupBy("y", "n").agg(F.count("*").alias("c")).collect()}
    discount = [(n1 or 0) / max((n1 or 0) + 2 * (n2 or 0), 1) for n1, n2 in [(told["at0"], told["bt0"]), (told["at1"], told["bt1"]), *((twice.get((k, 1)), twice.get((k, 2))) for k in (0, 1))]]
    table = np.array(met, dtype=np.int64).reshape(-1, 4).T
    return Counts(
        Vocabulary(names, [r["s"] for r in stems]), np.array([contexts[k] + [r[f"t{k}"] for r in stems] for k in (0, 1)], dtype=float).reshape(2, -1), table[:2], table[2:].astype(float), after, np.array([told["st0"] or 0, told["st1"] or 0], dtype=float),
        np.array([max(d, 0.1) for d in discount[:2]]), np.array([max(d, 0.1) for d in discount[2:]]),
    )


def choose(models: list[ToxicModel], held: DataFrame, weights: tuple[float, float]) -> ToxicModel:
    """The model that predicts the held-back ``(y, text)`` best, with its curve."""
    shared = held.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column(1).to_pylist()
            ids, size = shared.value[0].vocabulary.places(texts)
            got = [m.weigh(ids, size) for m in shared.value]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(list(np.stack(got, axis=1)), pa.list_(pa.float64()))], names=["y", "n", "e"])

    rows = sorted(map(tuple, held.select("y", "text").mapInArrow(run, "y int, n long, e array<double>").where("n > 0").collect()))
    y = np.array([r[0] for r in rows], dtype=float)
    w = np.where(y > 0, weights[1], weights[0])
    best, least = models[0], math.inf
    for i, model in enumerate(models):
        x = np.array([r[2][i] for r in rows])
        model.slope, model.offset = _curve(x, y, w)
        z = np.clip(model.slope * x + model.offset, -30, 30)
        loss = float((w * (np.log1p(np.exp(z)) - y * z)).sum())
        if loss < least:
            best, least = model, loss
    return best


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 8000, folds: int = 5) -> ToxicModel:
    """Learns from labelled rows whose fold is not 0; every fourth distinct text of a class is held back for the curve."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(fold(F.col(id_col), folds) != 0).groupBy(F.col(id_col).alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    share = n1 / (n0 + n1) if n0 + n1 else 0.0
    flat = ToxicModel(Vocabulary([], []), np.zeros(1), np.zeros(1), np.zeros(0, np.int64), np.zeros(0), 0.0, math.log(share / (1 - share)) if 0 < share < 1 else (60.0 if share else -60.0), share)
    if min(n0, n1) == 0:
        return flat
    # Ids only: at most twice per_class rows come to the driver.
    order = F.xxhash64(F.col("k").cast("string"), F.lit(7))
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(order, "k").limit(per_class).collect()]
    ids = spark.createDataFrame([(r["k"], r["y"]) for r in chosen], known.schema)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"(?U)\w"))
    found = scratch.keep(texts.join(F.broadcast(ids), "k").select("y", "text", F.xxhash64("text", F.lit(9)).alias("h")))
    ranks = found.select("y", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h")))  # at most a row a sampled text
    ranks = ranks.withColumn("alone", F.count("*").over(Window.partitionBy("y")) == 1)
    sides = F.when(F.col("alone"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("r") % 4 == 2))
    sample = scratch.keep(found.join(ranks, ["y", "h"]).select("y", "text", F.explode(sides).alias("back")))
    held = {(r["y"], r["back"]): r["n"] for r in sample.groupBy("y", "back").agg(F.count("*").alias("n")).collect()}
    if len(held) < 4:
        return flat
    found = count(sample.where("not back"), scratch)
    models = [model_of(found, weight, floor, share) for weight in WEIGHTS for floor in FLOORS]
    best = choose(models, sample.where("back"), (n0 / held[0, True], n1 / held[1, True]))
    scratch.clear()
    return best


def score_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", below: float | None = None) -> DataFrame:
    """``id_col`` and ``score`` of every row; with ``below`` all columns of the rows that score less."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    carry = [id_col] if below is None else docs.columns
    fields = [docs.schema[c] for c in carry]
    # Columns go by place, so no name of the table can clash with one of ours.
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, "text"):
            got = own.score(part.column(len(carry)).to_pylist())
            out = pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(got)], names=[*part.schema.names[: len(carry)], "score"])
            yield out if below is None else out.filter(pa.array(got < below))

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "score double"])
    scored = inner.mapInArrow(run, schema)
    if below is None:
        return scored.select(F.col("c0").alias(id_col), "score")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    return score_documents(docs, train(docs, labels, id_col, text_col), id_col, text_col, below=threshold)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
