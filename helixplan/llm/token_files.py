"""Token ids in Arrow stream files of equal-length sequences.

Documents are encoded, each closed by an end id, and put one behind the other in ascending order of their
ids. The stream of ids is cut into sequences of ``length``; a file holds a range of documents, and its last
sequence is filled up. A file is in Arrow's file format: record batches of ``rows`` sequences each, with
``ids`` (fixed-size lists of the smallest unsigned type that holds the vocabulary), ``mask`` (bits: a token or
filling) and ``ends`` (bits: a document's last token). All batches but the last have one size, so sequence i is row
``i % rows`` of batch ``i // rows``, and a reader of a mapped file takes it as a view of the file, without a copy.
Beside it lies an index of its documents, ids and numbers of tokens, in the same format.

Writing is a range partitioning by document id (the texts move once) and a Python data source whose tasks encode
and write a file each; the manifest lists the files of successful tasks in order (``sources.files``). Ties of
id are ordered by a hash of the text, and rows alike in both are dealt by their place, so no id is a hot key.

Encoding calls the tokenizers library for each distinct word, once while a bounded table of a worker remembers
it: splits, merges and normalisation of the vocabulary named here don't reach over ASCII spaces, nor from an ASCII
letter to a sign, so the ids are those of the whole text (tested). Other vocabularies encode text by text.

Edge cases: a null or empty text has the end id alone; a null document id sorts first; repeated rows are
documents of their own; an empty table gives a manifest without files and no rows; a text of any length is
encoded whole, a megabyte of words at a time; further columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from helixplan.llm.common import slices, table
from helixplan.llm.words import blocks, coded, ragged, runs
from helixplan.plans.runtime import Scratch
from helixplan.sources import files

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 2
#: Rows and bytes of text whose words are looked up together.
SLICE_ROWS, GROUP_BYTES = 1024, 3 << 20
#: Distinct words whose ids a worker remembers; reaching it only costs time.
REMEMBERED = 300_000
#: Fixed value: the split of vocabularies whose words can be encoded one by one.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes: 1 ASCII letters and digits, 2 ASCII signs, 3 the apostrophe, 0 all else.
_KINDS = np.array([3 if b == 0x27 else 0 if not 0x20 < b < 0x7F else 1 if chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)


class WordEncoder:
    """Ids of texts by a tokenizer, distinct word by distinct word where its splits allow that, else text by text."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        told = json.loads(model)
        split = [p["pattern"].get("Regex") for p in (told.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        normal = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
        self.by_words = split == [WORD_SPLIT] and normal == ["NFC", "Replace", "Lowercase"]
        self.added = [t["content"].lower().encode() for t in told.get("added_tokens", [])]
        #: By id, whether a token ends a word.
        self.closes = None
        if (suffix := told["model"].get("end_of_word_suffix")) and self.by_words:
            self.closes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.known: dict[bytes, int] = {}
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new words: those of ASCII small letters, which are neither normalised nor split, in one text, told apart by the tokens that end a word."""
        size, at = np.zeros(len(words), dtype=np.int64), np.arange(len(words))
        plain = np.fromiter((self.closes is not None and w.isalpha() and w.islower() for w in words), dtype=bool, count=len(words))
        flat = [np.zeros(0, dtype=np.uint32)]
        if plain.any():
            ids = np.array(self._encoded([b" ".join([w for w, p in zip(words, plain) if p])])[0], dtype=np.uint32)
            each = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
            if len(each) != plain.sum():
                raise ValueError("words and their ends disagree")
            size[plain] = each
            flat.append(ids)
        got = self._encoded([w for w, p in zip(words, plain) if not p])
        size[~plain] = [len(g) for g in got]
        flat.append(np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=sum(map(len, got))))
        order = np.concatenate([at[plain], at[~plain]])
        begin = np.empty(len(words), dtype=np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.begin = np.concatenate([self.begin, len(self.flat) + begin])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *flat])

    def _encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _words(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of each part. Words beyond ``REMEMBERED`` are forgotten again."""
        words, count = runs(parts)
        codes, distinct = coded(words)
        had, flat = len(self.size), len(self.flat)
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        unknown = np.flatnonzero(at < 0)
        new = [distinct[k] for k in unknown.tolist()]
        if new:
            self._learn(new)
            at[unknown] = np.arange(had, had + len(new))
        at = at[codes]
        size = self.size[at]
        ids = self.flat[ragged(self.begin[at], size)]
        if len(self.size) > REMEMBERED:
            for w in new:
                del self.known[w]
            self.begin, self.size, self.flat = self.begin[:had].copy(), self.size[:had].copy(), self.flat[:flat].copy()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *count])].tolist()
        return [ids[x:y] for x, y in zip(ends, ends[1:])]

    def _split(self, block: bytes) -> bytes:
        """The block lowered and with a space between ASCII letters or digits and ASCII signs, where the vocabulary splits itself.

        An apostrophe stays with what follows. A block that may hold an added token is left as it is.
        """
        low = block.lower()  # bytes: A-Z only
        if any(t in low for t in self.added):
            return block
        data = np.frombuffer(low, dtype=np.uint8)
        kind = _KINDS[data]
        left, right = kind[:-1], kind[1:]
        border = np.flatnonzero(((left == 1) & (right >= 2)) | ((left == 2) & (right == 1))) + 1
        return np.insert(data, border, 0x20).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids a text."""
        if not self.by_words:
            return [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype=np.uint32) for t in texts]
        found: list[list[np.ndarray]] = [[] for _ in texts]
        parts: list[bytes] = []
        owners: list[int] = []
        held = 0
        for who, text in enumerate(texts):
            for block in blocks((text or "").encode("utf-8", "surrogatepass")):
                parts.append(self._split(block))
                owners.append(who)
                held += len(block)
                if held > GROUP_BYTES:
                    for k, ids in zip(owners, self._words(parts)):
                        found[k].append(ids)
                    parts, owners, held = [], [], 0
        for k, ids in zip(owners, self._words(parts) if parts else []):
            found[k].append(ids)
        return [f[0] if len(f) == 1 else np.concatenate(f) for f in found]


@lru_cache(maxsize=1)
def _encoder(model: str) -> WordEncoder:
    """A worker's encoder; its tasks share what it remembers."""
    return WordEncoder(model)


def _encoded_rows(batches: Iterator[pa.RecordBatch], model: str, end_id: int | None) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids of the rows and of their texts of ``(id, __text)``, a few megabytes at a time."""
    encoder, end = _encoder(model), np.array([] if end_id is None else [end_id], dtype=np.uint32)
    for part in slices(batches, "__text", SLICE_ROWS):
        yield part.column(0), [np.concatenate([ids, end]) for ids in encoder.encode(part.column(1).to_pylist())]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = VOCABULARY, end_id: int | None = END_ID) -> DataFrame:
    """``id_col, ids``: the ids of each row's whole text, closed by ``end_id``; a map over the rows in their order."""
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, got in _encoded_rows(batches, model, end_id):
            ends = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got).view(np.int32)))], names=[id_col, "ids"])

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` as __text").mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id, __text`` in ascending order of ids over partitions and in them; nulls first, ties by a hash of the text."""
    keys = [F.col(id_col).asc_nulls_first(), F.col("__tie"), F.col("__place")]
    rows = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(text_col)).alias("__tie"), F.monotonically_increasing_id().alias("__place"))
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))


# Files


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str | None
    documents: int
    tokens: int
    sequences: int


class _Packer:
    """Cuts a stream of ids into batches of equal sequences and writes them."""

    def __init__(self, out: pa.NativeFile, length: int, rows: int, dtype: np.dtype):
        self.length, self.rows, self.dtype = length, rows, dtype
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])
        self.sink = pa.ipc.new_file(out, self.schema)
        self.ids, self.ends = np.zeros(length * rows, dtype=dtype), np.zeros(length * rows, dtype=bool)
        self.have = self.tokens = self.sequences = 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError("an id is above the vocabulary's size")
        at = 0
        while at < len(ids):
            step = min(len(ids) - at, len(self.ids) - self.have)
            self.ids[self.have : self.have + step] = ids[at : at + step]
            self.have, at = self.have + step, at + step
            if at == len(ids):
                self.ends[self.have - 1] = True
            if self.have == len(self.ids):
                self._flush()
        self.tokens += len(ids)

    def _flush(self) -> None:
        if not self.have:
            return
        n = -(-self.have // self.length)
        size = n * self.length
        real = np.arange(size) < self.have
        bits = [pa.Array.from_buffers(pa.bool_(), size, [None, pa.py_buffer(np.packbits(x, bitorder="little"))]) for x in (real, self.ends[:size])]
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(self.ids[:size]), *bits)]
        self.sink.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += n
        self.ids[:], self.ends[:], self.have = 0, False, 0

    def close(self) -> None:
        self._flush()
        self.sink.close()


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, length: int, rows: int, dtype: str, model_path: str, end_id: int):
        self.folder, self.length, self.rows, self.dtype, self.end_id = folder, length, rows, np.dtype(dtype), end_id
        with open(model_path, encoding="utf-8") as f:  # on the driver
            self.model = f.read()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        partition = TaskContext.get().partitionId()
        name = f"part-{partition:06d}-{uuid.uuid4().hex}.arrow"
        packer = index = names = out = beside = None
        documents = 0
        for keys, got in _encoded_rows(iterator, self.model, self.end_id):
            if packer is None:
                out, beside = files.create(f"{self.folder}/{name}"), files.create(f"{self.folder}/{name}.docs")
                packer = _Packer(out, self.length, self.rows, self.dtype)
                names = pa.schema([("id", keys.type), ("tokens", pa.int64())])
                index = pa.ipc.new_file(beside, names)
            for ids in got:
                packer.add(ids)
            index.write_batch(pa.RecordBatch.from_arrays([keys, pa.array([len(g) for g in got], pa.int64())], schema=names))
            documents += len(got)
        if packer is None:
            return _Written(partition, None, 0, 0, 0)
        packer.close()
        index.close()
        out.close()
        beside.close()
        return _Written(partition, name, documents, packer.tokens, packer.sequences)

    def commit(self, messages: list[_Written | None]) -> None:
        if files.committed(self.folder) is not None:
            raise ValueError(f"{self.folder} already holds sequences")
        parts, before, first = [], 0, 0
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.partition):
            parts.append({"name": m.name, "documents": m.documents, "tokens": m.tokens, "sequences": m.sequences, "start": before, "first": first})
            before, first = before + m.tokens, first + m.sequences
        files.commit(self.folder, {"length": self.length, "rows": self.rows, "dtype": self.dtype.name, "files": parts})

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m is not None and m.name:
                files.remove(f"{self.folder}/{m.name}")
                files.remove(f"{self.folder}/{m.name}.docs")


@dataclass
class _Span(InputPartition):
    """Sequences ``begin`` to ``end`` of a file, or all its documents; without a name nothing."""

    name: str | None
    start: int
    begin: int
    end: int


class _Reader(DataSourceReader):
    #: Batches of sequences in one partition of the sequence view.
    BATCHES = 64

    def __init__(self, folder: str, view: str):
        self.folder, self.view = folder, view
        self.listed = files.committed(folder)
        if self.listed is None:
            raise FileNotFoundError(f"no manifest in {folder}")

    def partitions(self) -> list[_Span]:
        if not self.listed["files"]:
            return [_Span(None, 0, 0, 0)]
        if self.view == "documents":
            return [_Span(f["name"], f["start"], 0, f["sequences"]) for f in self.listed["files"]]
        step = self.listed["rows"] * self.BATCHES
        return [_Span(f["name"], f["first"], a, min(a + step, f["sequences"])) for f in self.listed["files"] for a in range(0, f["sequences"], step)]

    def read(self, span: _Span) -> Iterator[pa.RecordBatch]:
        if span.name is None:
            return
        path = f"{self.folder}/{span.name}"
        with files.open_at(path) as held:
            stream = pa.ipc.open_file(held)
            yield from self._documents(path, stream, span) if self.view == "documents" else self._sequences(stream, span)

    def _sequences(self, stream: pa.RecordBatchFileReader, span: _Span) -> Iterator[pa.RecordBatch]:
        rows, kind = self.listed["rows"], (pa.list_(pa.int32()), pa.list_(pa.bool_()))
        for k in range(span.begin // rows, -(-span.end // rows)):
            b = stream.get_batch(k)
            number = pa.array(np.arange(b.num_rows, dtype=np.int64) + span.start + k * rows)
            yield pa.RecordBatch.from_arrays([number, b.column(0).cast(kind[0]), b.column(1).cast(kind[1])], names=["sequence", "ids", "mask"])

    def _documents(self, path: str, stream: pa.RecordBatchFileReader, span: _Span) -> Iterator[pa.RecordBatch]:
        start, batch, at = span.start, -1, 0
        ids = ends = np.zeros(0)
        with files.open_at(f"{path}.docs") as beside:
            index = pa.ipc.open_file(beside)
            for k in range(index.num_record_batches):
                docs = index.get_batch(k)
                starts, got, bytes_, first = [], [], 0, 0
                for row, n in enumerate(docs.column(1).to_pylist()):
                    parts, left, closed = [], n, False
                    while left:
                        if at == len(ids):
                            batch, at = batch + 1, 0
                            b = stream.get_batch(batch)
                            ids, ends = (b.column(c).flatten().to_numpy(zero_copy_only=c == 0) for c in (0, 2))
                        step = min(left, len(ids) - at)
                        parts.append(ids[at : at + step].astype("<u4").tobytes())
                        at, left = at + step, left - step
                        closed = bool(ends[at - 1])
                    if n and not closed:
                        raise ValueError(f"{path} and its index disagree")
                    starts.append(start)
                    got.append(b"".join(parts))
                    start, bytes_ = start + n, bytes_ + 4 * n
                    if bytes_ > 4 << 20 or row + 1 == docs.num_rows:
                        yield pa.RecordBatch.from_arrays([docs.column(0).slice(first, len(got)), pa.array(starts, pa.int64()), pa.array(got, pa.binary())], names=["id", "start", "ids"])
                        starts, got, bytes_, first = [], [], 0, row + 1


class TokenSequences(DataSource):
    """``spark.read.format("token_sequences")`` and its writer of ``__id, __text``; option ``view`` is ``sequences`` (``sequence, ids, mask``) or ``documents`` (``id, start, ids``, little-endian 32-bit)."""

    @classmethod
    def name(cls) -> str:
        return "token_sequences"

    def _view(self) -> str:
        return self.options.get("view", "sequences")

    def schema(self) -> str:
        if self._view() == "sequences":
            return "sequence bigint, ids array<int>, mask array<boolean>"
        return f"id {self.options.get('id_type', 'bigint')}, start bigint, ids binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"].rstrip("/"), self._view())

    def writer(self, schema, overwrite: bool) -> _Writer:
        told = self.options
        return _Writer(told["path"].rstrip("/"), int(told.get("length", 2048)), int(told.get("rows", 64)), told.get("dtype", "uint32"), told.get("model", VOCABULARY), int(told.get("end", END_ID)))


def write_sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", model_path: str = VOCABULARY, end_id: int = END_ID, length: int = 2048, rows: int = 64) -> None:
    """Encodes ``docs`` in ascending order of ids and writes the files; ``length`` is a multiple of 8."""
    if length % 8:
        raise ValueError("sequences have a multiple of 8 ids, so that masks begin at a byte")
    spark = docs.sparkSession
    spark.dataSource.register(TokenSequences)
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_file(model_path).get_vocab_size(with_added_tokens=True) - 1, end_id)
    wanted = {"length": length, "rows": rows, "dtype": np.min_scalar_type(top).name, "model": model_path, "end": end_id}
    in_order(docs, id_col, text_col).write.format("token_sequences").options(**wanted).mode("append").save(files.qualified(spark, path))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``sequence, ids, mask`` of equal-length sequences, numbered over all files; split by batches."""
    spark.dataSource.register(TokenSequences)
    return spark.read.format("token_sequences").option("view", "sequences").load(files.qualified(spark, path))


def read_documents(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``id, start, ids`` of each document; ``start`` counts the ids of all documents before it."""
    spark.dataSource.register(TokenSequences)
    return spark.read.format("token_sequences").option("view", "documents").option("id_type", id_type).load(files.qualified(spark, path))


def sequence_at(folder: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence: the ids as a view of the mapped file, the mask unpacked from its bits."""
    listed = files.committed(folder)
    part = next(f for f in listed["files"] if f["first"] <= number < f["first"] + f["sequences"])
    stream = pa.ipc.open_file(files.open_at(f"{folder}/{part['name']}"))
    batch = stream.get_batch((number - part["first"]) // listed["rows"])
    row, length = (number - part["first"]) % listed["rows"], listed["length"]
    ids = batch.column(0).values.to_numpy(zero_copy_only=True)[row * length : (row + 1) * length]
    bits = np.frombuffer(batch.column(1).values.buffers()[1], dtype=np.uint8)[row * length // 8 : (row + 1) * length // 8]
    return ids, np.unpackbits(bits, bitorder="little").astype(bool)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = Scratch(spark, "token-files").folder()
    write_sequences(docs, path)
    back = read_documents(spark, path, docs.schema["doc_id"].dataType.simpleString())
    return back.select(F.col("id").alias("doc_id"), "start", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
