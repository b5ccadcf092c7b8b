"""Token files, importance resampling and alignment of tokenizers against the libraries and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

SCHEMA = "doc_id bigint, text string, id string, start int, ids string, pair int, rank string"
ROWS = [
    (7, "The quick brown fox jumps over the lazy dog."),
    (None, "No id; İstanbul ße 12 34"),
    (3, None),
    (3, ""),
    (5, "tie one two"),
    (5, "tie two one"),
    (5, "tie two one"),
    (9, "it's <|endoftext|> and 'S\tend\n\n x  y <s> ▁ café é"),
    (2, "word " * 3000 + "x" * 5000),
    (11, "中文 文字 abc… “quoted” 😀 don't"),
]
ALPHABET = [*" ab  \n\tcd'▁.<>0", "é", "中", " ́", "\u0085", " ", "İ", "ß", "ﬁ", "\x1c", "　", "the", "'s", "'S", "\r", " and", "\n\n", "<|endoftext|>", "<|ENDOFTEXT|>", "<s>", "<0x41>", "😀", "1́"]


def random_texts(n, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, length))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in ROWS], SCHEMA).repartition(3)


# Token files


def library_ids(texts):
    from tokenizers import Tokenizer

    from helixplan.llm.token_files import VOCABULARY

    return [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_encoder_equals_the_library(monkeypatch):
    from helixplan.llm import token_files, words

    with open(token_files.VOCABULARY, encoding="utf-8") as f:
        encoder = token_files.WordEncoder(f.read())
    assert encoder.by_words
    monkeypatch.setattr(token_files, "REMEMBERED", 200)
    monkeypatch.setattr(token_files, "GROUP_BYTES", 100)
    monkeypatch.setattr(words.blocks, "__defaults__", (50,))
    texts = random_texts(1500, 25, 6) + random_texts(50, 400, 7)
    for at in range(0, len(texts), 3):
        some = texts[at : at + 3]
        assert [g.tolist() for g in encoder.encode(some)] == library_ids(some)


def test_other_vocabularies_are_cut_whole():
    from tokenizers import Tokenizer

    from helixplan.llm.token_files import WordEncoder

    path = "/opt/tokenizers/byte_bpe_50k.json"
    with open(path, encoding="utf-8") as f:
        encoder = WordEncoder(f.read())
    texts = random_texts(50, 30, 1)
    assert not encoder.by_words
    assert [g.tolist() for g in encoder.encode(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, docs, tmp_path):
    from helixplan.llm.token_files import read_documents, read_sequences, sequence_at, write_sequences
    from helixplan.sources import files

    path = str(tmp_path / "tokens")
    write_sequences(docs, path, length=16, rows=4)
    back = read_documents(spark, path).orderBy("start").collect()
    # Ascending ids, null first; of ties any order, but the same rows.
    assert [r.id for r in back] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    want = Counter((i, *ids, 2) for (i, _), ids in zip(ROWS, library_ids([t for _, t in ROWS])))
    assert Counter((r.id, *np.frombuffer(r.ids, "<u4").tolist()) for r in back) == want
    stream, start = [], 0
    for r in back:
        assert r.start == start
        stream += np.frombuffer(r.ids, "<u4").tolist()
        start = len(stream)
    sequences = read_sequences(spark, path).orderBy("sequence").collect()
    assert [s.sequence for s in sequences] == list(range(len(sequences)))
    assert all(len(s.ids) == len(s.mask) == 16 for s in sequences)
    assert [i for s in sequences for i, m in zip(s.ids, s.mask) if m] == stream
    listed = files.committed(f"file://{path}")
    assert listed["dtype"] == "uint16" and sum(f["tokens"] for f in listed["files"]) == len(stream)
    for s in (sequences[0], sequences[len(sequences) // 2], sequences[-1]):
        ids, mask = sequence_at(f"file://{path}", s.sequence)
        assert ids.tolist() == s.ids and mask.tolist() == s.mask


def test_sequences_are_views_of_the_file(spark, tmp_path):
    from helixplan.llm.token_files import sequence_at, write_sequences

    path = str(tmp_path / "tokens")
    write_sequences(spark.createDataFrame([(k, "some words " * 300) for k in range(20)], "doc_id bigint, text string"), path, length=64)
    before = pa.total_allocated_bytes()
    ids, _ = sequence_at(f"file://{path}", 5)
    assert not ids.flags.owndata and pa.total_allocated_bytes() == before


def test_token_files_keep_what_is_there(spark, docs, tmp_path):
    from helixplan.llm.token_files import read_documents, write_sequences

    path = str(tmp_path / "tokens")
    write_sequences(docs, path, length=8)
    with pytest.raises(Exception, match="already holds"):
        write_sequences(docs.limit(2), path, length=8)
    assert read_documents(spark, path).count() == len(ROWS)
    with pytest.raises(ValueError):
        write_sequences(docs, str(tmp_path / "odd"), length=12)


def test_op11_brute(spark, docs, tmp_path):
    from helixplan.llm.token_files import op11_token_files

    one_each = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    one_each.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect())
    want, start = [], 0
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows])):
        ids = [*ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, op11_token_files(spark, str(tmp_path)).collect())) == want


# Importance resampling


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_grams(text, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_gram_dictionary_brute(monkeypatch, n):
    from helixplan.llm import resample, words

    monkeypatch.setattr(resample, "BLOCK_BYTES", 60)
    monkeypatch.setattr(resample, "REMEMBERED", 100)
    monkeypatch.setattr(words.blocks, "__defaults__", (40,))
    rng = random.Random(n)
    grams = resample.GramDictionary(n, 997)
    for _ in range(100):
        texts = ["".join(rng.choice([*"aB 9é_中 \n.", "the ", "of "]) for _ in range(rng.choice([0, 5, 30, 300]))) for _ in range(4)]
        got = Counter()
        for some, owner, skip in resample._pieces(texts, n):
            for bucket, row in grams.grams(some, owner, skip):
                got.update(zip(row.tolist(), bucket.tolist()))
        assert got == Counter((r, zlib.crc32(g.encode()) % 997) for r, t in enumerate(texts) for g in plain_grams(t, n))


def test_each_gram_is_hashed_once():
    from helixplan.llm.resample import GramDictionary, _pieces

    grams = GramDictionary(2, 50)
    for _ in range(3):
        for some, owner, skip in _pieces(["a b a b", "b a"], 2):
            list(grams.grams(some, owner, skip))
    assert grams.hashed == 4  # a, b, "a b", "b a"


def plain_resample(rows, target, n, buckets, percent, least):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(place(g) for text in texts for g in plain_grams(text, n)) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets)))) for k in range(buckets)]
    found = []
    for i, text in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(g)] for g in plain_grams(text, n))
        found.append([i, len(plain_grams(text, 1)), len(plain_grams(text, n)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((f for f in found if f[1] >= least), key=lambda f: (-f[4], f[0] is None, f[0] or 0))
    for k, f in enumerate(fit[: percent * len(fit) // 100]):
        f[5] = k + 1
    return found


@pytest.mark.parametrize("n", [1, 2])
def test_resample_brute(spark, n):
    from helixplan.llm.resample import resample

    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["Élan", "naïve", "the"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 20, 60])))) for i in range(150)] + [(None, "the " * 30), (200, None), (3, "the w1 " * 15)]
    target = [" ".join(rng.choices(words[:20], k=40)) for _ in range(10)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, score int, bucket string").repartition(4)
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=300, percent=25, least_words=10).collect()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, plain_resample(rows, target, n, 300, 25, 10)), key=order)


def test_op12_brute(spark, docs, tmp_path):
    from helixplan.llm.resample import op12_resample

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    target = ["the lazy dog", None, "two tie word"]
    spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = Counter((i, n, w, s, r) for i, _, n, w, s, r in plain_resample(ROWS, target, 1, 10_000, 10, 20))
    assert Counter(map(tuple, op12_resample(spark, str(tmp_path)).collect())) == want


# Alignment


@pytest.fixture(scope="module")
def aligner():
    from helixplan.llm.align import VOCABULARY_A, VOCABULARY_B, Aligner

    with open(VOCABULARY_A, encoding="utf-8") as a, open(VOCABULARY_B, "rb") as b:
        return Aligner(a.read(), b.read())


def plain_alignment(aligner, text):
    """Groups, numbers and links of a text that the libraries cut whole, by sets of ends."""
    if not text:
        return "", (0, 0, 0, 0), Counter()
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    told = (" " + text).encode()
    if b"".join(aligner.a_bytes[t] for t in a) != told or b"".join(aligner.b_bytes[t] for t in b) != told:
        return "", (0, 0, 0, 0), Counter()
    ends = [np.cumsum([len(spelled[t]) for t in ids]).tolist() for ids, spelled in ((a, aligner.a_bytes), (b, aligner.b_bytes))]
    common = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in common]
    for side, ids in enumerate((a, b)):
        for t, at in zip(ids, np.searchsorted(common, ends[side])):
            groups[at][side].append(t)
    links = Counter(x << 32 | y for g in groups for x in g[0] for y in g[1])
    return ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups), (len(a), len(b), len(groups), sum(links.values())), links


def aligned_texts(aligner, texts):
    groups, numbers, pairs, times, firsts = aligner.align(texts)
    return [(groups[k], tuple(numbers[k].tolist()), Counter(dict(zip(pairs[a:b].tolist(), times[a:b].tolist())))) for k, (a, b) in enumerate(zip(firsts, firsts[1:]))]


def test_alignment_by_words_equals_whole_texts(aligner, monkeypatch):
    from helixplan.llm import align

    monkeypatch.setattr(align, "REMEMBERED", 300)
    texts = random_texts(1500, 30, 5) + [t for _, t in ROWS]
    for at in range(0, len(texts), 5):
        some = texts[at : at + 5]
        assert aligned_texts(aligner, some) == [plain_alignment(aligner, t) for t in some]


def test_merged_groups():
    from helixplan.llm.align import merged_groups

    assert merged_groups([1, 2, 3], [3, 1, 2]) == [(0, 2, 0, 1), (2, 3, 1, 3)]
    assert merged_groups([2, 2], [1, 3]) == [(0, 2, 0, 2)]
    assert merged_groups([], []) == []


@pytest.mark.parametrize("room", [200_000, 3, 0])
def test_op13_brute(spark, docs, aligner, tmp_path, monkeypatch, room):
    from helixplan.llm import align

    monkeypatch.setattr(align, "BROADCAST_PAIRS", room)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plain = [(i, plain_alignment(aligner, t)) for i, t in ROWS]
    held = Counter(p for _, (_, _, links) in plain for p in links)
    most = {}
    for p, n in held.items():
        most[p >> 32] = max(most.get(p >> 32, 0), n)
    want = Counter()
    for i, (groups, numbers, links) in plain:
        best = sum(m for p, m in links.items() if held[p] == most[p >> 32])
        want[i, *numbers, best, sum(m * held[p] for p, m in links.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else ""] += 1
    assert Counter(map(tuple, align.op13_align(spark, str(tmp_path)).collect())) == want
    assert any(not groups and t for (_, (groups, _, _)), (_, t) in zip(plain, ROWS))  # one text has a mark of its own


@pytest.mark.parametrize("name", ["op11_token_files", "op12_resample", "op13_align"])
def test_empty_tables(spark, tmp_path, name):
    from helixplan.llm import registry

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert registry.QUERIES[name](spark, str(tmp_path)).collect() == []
