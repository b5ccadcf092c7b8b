"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of ``order`` characters, interpolated down to single characters. An n-gram is
hashed to 64 bits; the n-grams of an order lie in one sorted array of hashes with a row of finished log
probabilities, one per language, so a text is scored by one binary search per character, and only an
n-gram that no language has is looked up again at the next lower order, after paying its context's backoff.
The language with the least cross-entropy per character wins. The score is the winner's share when the
languages' cross-entropies are weighed against each other at a temperature that is calibrated on held-back
sample texts; ``rejected`` marks texts whose cross-entropy lies above nearly all held-back texts of the
language they are given.

An n-gram never reaches over the start of its text: the characters there are scored by the orders that fit.
Log probabilities are multiples of 2^-16, so sums of them are exact and a prediction depends on nothing but its
own text, wherever the row lies. A long text is scored in pieces of ``PIECE`` characters that hand on their last
characters, so memory is bounded by a piece.

Models are fitted on a bounded, documented sample: of the ``MAX_LANGS`` languages with most documents up to
``per_lang`` documents each, with the least keyed hash of their id (and of their text, between equals), of longer
ones, which are taken last, the first ``longest`` characters; less where all languages together would pass
``SAMPLE_CHARS``. Predictions read every whole text.
Texts are lower-cased; what is not a letter counts as one space.

Edge cases: a null text and one without a letter give ``und`` with score 0 and are not rejected; null
languages teach nothing; a null id belongs to the fold of the empty text; ties go to the first language by
name; repeated rows are judged row by row; without any language every text is ``und``; further columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from helixplan.llm.common import fold, slices

DISCOUNT = 0.75
MAX_LANGS = 500
#: Characters of all languages' samples together, about.
SAMPLE_CHARS = 64_000_000
#: Characters of a text that are scored at a time, and (characters times languages) of a table of log probabilities.
PIECE = 1 << 20
CELLS = 1 << 22
SPACE = 32
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _letter_table() -> np.ndarray:
    return np.array([c if chr(c).isalpha() else SPACE for c in range(0x110000)], dtype=np.uint32)


_LETTERS: list[np.ndarray] = []


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each led in by a space, the text that each belongs to, and its place there."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    # A line feed leads each text in and cannot be inside, because it counts as a space there too.
    joined = "\n".join(["", *("" if t is None else t.lower().replace("\n", " ") for t in texts)])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lead = code == 10
    code = _LETTERS[0][code]
    keep = lead.copy()
    keep[1:] |= (code[1:] != SPACE) | (code[:-1] != SPACE)
    code, lead = code[keep], lead[keep]
    text = np.cumsum(lead, dtype=np.int32) - 1
    return code, text, np.arange(len(code)) - np.flatnonzero(lead)[text]


def grams(code: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1- to ``order``-grams that end at each character."""
    c = code.astype(np.uint64) + np.uint64(1)
    h, out = c.copy(), [c.copy()]
    back = c
    for n in range(1, order):
        back = np.concatenate([np.zeros(1, np.uint64), back[:-1]])
        h = h * MULTIPLIER + back
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def _rounded(logs: np.ndarray) -> np.ndarray:
    """To multiples of 2^-16: sums of a few fit 32-bit floats, sums of 2^30 of them 64-bit floats, without rounding."""
    return (np.round(logs * 65536) / 65536).astype(np.float32)


@dataclass
class LanguageModel:
    langs: list[str]
    order: int
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    context: list[np.ndarray]
    leave: list[np.ndarray]
    unseen: float
    sharpness: float = 1.0
    limit: np.ndarray | None = None

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy by text and language, and letters in each text."""
        n, width = len(texts), len(self.langs)
        sums, size, letters = np.zeros((n, width)), np.zeros(n), np.zeros(n)
        short = [i for i, t in enumerate(texts) if not t or len(t) <= PIECE]
        if short:
            code, text, at = characters([texts[i] for i in short])
            sums[short], size[short], letters[short] = self._sums(code, text, at, len(short))
        for i in set(range(n)).difference(short):
            tail, done, whole = np.zeros(0, np.uint32), 0, texts[i]
            for start in range(0, len(whole), PIECE):
                code = characters([whole[start : start + PIECE]])[0]
                # A further piece has no lead of its own, but its first character may be a space.
                if done and (tail[-1] == SPACE or whole[start].lower()[0].isalpha()):
                    code = code[1:]
                joined = np.concatenate([tail, code])
                got = self._sums(joined, np.zeros(len(joined), np.int32), np.arange(len(joined)) + done - len(tail), 1, len(tail))
                sums[i], size[i], letters[i] = sums[i] + got[0][0], size[i] + got[1][0], letters[i] + got[2][0]
                done += len(code)
                tail = joined[max(len(joined) - self.order, 0) :]
        return -sums / np.maximum(size, 1)[:, None], letters

    def _sums(self, code: np.ndarray, text: np.ndarray, at: np.ndarray, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities, characters and letters by text; the first ``skip`` characters are context only."""
        width = len(self.langs)
        sums, step = np.zeros((n, width)), max(CELLS // width, 1 << 12)
        hashes = grams(code, self.order)
        for start in range(skip, len(code), step):
            here = slice(start, min(start + step, len(code)))
            total = self._logs([h[here] for h in hashes], [h[np.arange(here.start, here.stop) - 1] for h in hashes[:-1]], at[here])
            sums += np.stack([np.bincount(text[here], weights=total[:, j], minlength=n) for j in range(width)], axis=1)
        return sums, np.bincount(text[skip:], minlength=n), np.bincount(text[skip:], weights=code[skip:] != SPACE, minlength=n)

    def _logs(self, hashes: list[np.ndarray], before: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        total = np.zeros((len(at), len(self.langs)), dtype=np.float32)
        left = np.arange(len(at))
        for k in range(self.order - 1, -1, -1):
            fits = at[left] >= k
            some, rest = left[fits], left[~fits]
            key = hashes[k][some]
            place = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            hit = self.keys[k][place] == key
            total[some[hit]] += self.logs[k][place[hit]]
            some = some[~hit]
            if k:
                context = before[k - 1][some]
                place = np.minimum(np.searchsorted(self.context[k], context), len(self.context[k]) - 1)
                known = self.context[k][place] == context
                total[some[known]] += self.leave[k][place[known]]
            else:
                total[some] += self.unseen
            left = np.concatenate([rest, some])
            if not len(left):
                break
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        entropy, letters = self.cross_entropy(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(texts)), best]
        share = 1 / np.exp(np.clip(-self.sharpness * (entropy - low[:, None]), -700, 0)).sum(axis=1)
        some = letters > 0
        names = [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())]
        over = some & (low > self.limit[best]) if self.limit is not None else np.zeros(len(texts), dtype=bool)
        return names, np.where(some, share, 0.0), over


def fit(texts: list[str], langs: list[str], order: int = 4) -> LanguageModel:
    """Fits models on five of six texts of each language and calibrates on the rest."""
    names = sorted(set(langs))
    turn, learn, rest = dict.fromkeys(names, 0), {n: [] for n in names}, []
    for t, l in zip(texts, langs):
        turn[l] += 1
        (rest.append((t, l)) if turn[l] % 6 == 0 else learn[l].append(t))
    if not names:
        return LanguageModel([], order, [], [], [], [], 0.0)
    # Counts: the highest order counts occurrences, lower ones the characters that come before.
    raw = []
    for name in names:
        code, _, at = characters(learn[name])
        raw.append((grams(code, order), at))
    keys, contexts, last = [], [], []
    for k in range(order):
        # The n-grams that don't reach over the start of their text, with their context and their end.
        fits = [np.flatnonzero(at >= k) for _, at in raw]
        every, first = np.unique(np.concatenate([g[k][x] for (g, _), x in zip(raw, fits)]), return_index=True)
        keys.append(every)
        contexts.append(np.concatenate([g[k - 1][x - 1] for (g, _), x in zip(raw, fits)])[first] if k else None)
        last.append(np.concatenate([g[k - 1][x] for (g, _), x in zip(raw, fits)])[first] if k else None)
    logs, context, leave = [], [], []
    width = len(names)
    lower = None
    for k in range(order):
        n = len(keys[k])
        prob = np.zeros((n, width))
        if k:
            ctx = np.unique(contexts[k])
            where = np.searchsorted(ctx, contexts[k])
            down = lower[np.searchsorted(keys[k - 1], last[k])]
            out = np.ones((len(ctx), width))
        for j, (g, at) in enumerate(raw):
            if k == order - 1:
                seen = g[k][at >= k]
            else:
                # Kneser-Ney: one for each distinct character before.
                longer = np.flatnonzero(at >= k + 1)
                seen = g[k][longer[np.unique(g[k + 1][longer], return_index=True)[1]]]
            count = np.bincount(np.searchsorted(keys[k], seen), minlength=n).astype(float)
            less = np.maximum(count - DISCOUNT, 0)
            gone = np.minimum(count, DISCOUNT)
            if not k:
                # Of what is discounted every known character gets a share, and one share is for all others.
                prob[:, j] = less / max(count.sum(), 1) + max(gone.sum(), DISCOUNT) / max(count.sum(), 1) / (n + 1)
                continue
            mass = np.bincount(where, weights=count, minlength=len(ctx))
            lam = np.where(mass > 0, np.bincount(where, weights=gone, minlength=len(ctx)) / np.maximum(mass, 1), 1.0)
            out[:, j] = lam
            prob[:, j] = less / np.maximum(mass, 1)[where] + lam[where] * down[:, j]
        lower = prob
        logs.append(_rounded(np.log(prob)))
        context.append(ctx if k else np.zeros(1, np.uint64))
        leave.append(_rounded(np.log(out)) if k else np.zeros((1, width), np.float32))
    model = LanguageModel(names, order, keys, logs, context, leave, float(_rounded(np.log(DISCOUNT / max(sum(len(at) for _, at in raw), 1)))))
    _calibrate(model, rest)
    return model


def _calibrate(model: LanguageModel, rest: list[tuple[str, str]], keep: float = 0.999) -> None:
    """Temperature with the best log-likelihood, and each language's limit of cross-entropy."""
    if not rest:
        return
    entropy, letters = model.cross_entropy([t for t, _ in rest])
    true = np.array([model.langs.index(l) for _, l in rest])
    use = letters > 0
    entropy, true = entropy[use], true[use]
    if not len(true):
        return
    gap = entropy - entropy.min(axis=1, keepdims=True)
    own = gap[np.arange(len(true)), true]
    model.sharpness = min(2.0 ** np.arange(-2, 7), key=lambda s: float((np.log(np.exp(-s * gap).sum(axis=1)) + s * own).mean()))
    model.limit = np.array([1.25 * np.quantile(entropy[true == j, j], keep) if (true == j).any() else np.inf for j in range(len(model.langs))])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300, longest: int = 50_000, folds: int = 4, held: int = 2, order: int = 4) -> LanguageModel:
    """Learns from rows with a language whose fold is not ``held``."""
    # Long documents are a language's last choice, and their first ``longest`` characters are learned.
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col), folds) != held)).select(F.col(lang_col).alias("l"), F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"))
    # Rows of the driver: one a language, MAX_LANGS at most.
    langs = [r["l"] for r in usable.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGS).collect()]
    if not langs:
        return fit([], [], order)
    longest = max(200, min(longest, SAMPLE_CHARS // (per_lang * len(langs))))
    named = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in langs], "l string"))
    # Long documents are a language's last choice, and their first ``longest`` characters are learned.
    place = F.struct((F.length("t") > longest).alias("long"), F.xxhash64("k", F.lit(11)).alias("id"), F.xxhash64("t", F.lit(12)).alias("text"))
    known = usable.join(named, "l", "left_semi").select("l", place.alias("o"), F.substring("t", 1, longest).alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("o"))
    least = known.select("l", "o").withColumn("n", rank).where(F.col("n") <= per_lang).groupBy("l").agg(F.max("o").alias("most"))
    # Rows alike in id and text may be more than the rank lets in, so it counts once more.
    bound = known.join(F.broadcast(least), "l").where("o <= most").withColumn("n", rank).where(F.col("n") <= per_lang).select("l", "n", "t")
    rows = sorted(map(tuple, bound.collect()))
    return fit([t for _, _, t in rows], [l for l, _, _ in rows], order)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, rejected`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            names, score, over = shared.value.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(over)], names=[id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
