"""Token-ID files: independent zstandard frames with a trailing seek table and per-frame checksums.

Layout of a file, all of it legal zstandard:

* data frames, each with whole documents' ids as little-endian unsigned 32-bit
  integers, at most ``FRAME_BYTES`` unless one document is larger;
* a skippable frame with the document index (ids and lengths, compressed);
* a skippable frame with the seek table: for each data frame its compressed
  size, its size and the low 32 bits of the XXH64 of its content, then the
  number of frames, a descriptor byte and the magic number.

A reader fetches the tail, then only the frames that hold what it is asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.arrow import RangeReader, small_batches, written
from gneiss.llm.common import fresh_path, table

TOKENIZER, END_ID = "word_bpe_49k.json", 1
FRAME_BYTES, LEVEL = 1 << 18, 3
#: Entries of a worker's word cache; beyond, it starts anew. Bounds memory, not results.
CACHE_WORDS = 1_000_000
SKIPPABLE, SKIPPABLE_INDEX, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80


def tokenizer_path(name: str) -> str:
    """A name without a slash is a file of the public_tokenizers package."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Texts to ids, equal to encoding the whole text with the tokenizer.

    The tokenizer normalises white space away and never lets a token cross it,
    so the ids of a text are those of its white-space separated parts in turn.
    Each part is encoded once for each worker. Parts made of letters and
    trailing marks are encoded many at once, and cut where a token ends a word.
    Texts that may hold a special token's string are encoded whole.
    """

    def __init__(self, name: str = TOKENIZER):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.parts: dict[bytes, bytes] = {}

    def _learn(self, misses: list[bytes]) -> None:
        plain, words, odd = [], [], []
        for part in misses:
            text = part.decode()
            core = text.rstrip(".,;:!?%$#*&")
            if core.isalpha():
                plain.append(text)
                words.append(1 + (core != text))
            else:
                odd.append(text)
        for at in range(0, len(plain), 500):
            some, counts = plain[at : at + 500], words[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != sum(counts):  # a part that isn't cut as expected: one by one
                odd += some
                continue
            cuts = [0, *stops[np.cumsum(counts) - 1]]
            for text, a, b in zip(some, cuts, cuts[1:], strict=False):
                self.parts[text.encode()] = ids[a:b].tobytes()
        for at in range(0, len(odd), 500):
            some = odd[at : at + 500]
            for text, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.parts[text.encode()] = np.array(got.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is the empty text."""
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        split: list[list[bytes] | None] = []
        for text in texts:
            special = text and any(x in text for x in self.specials)
            split.append(None if special else (text or "").encode().lower().split())
        misses = {part for parts in split if parts for part in parts}.difference(self.parts)
        self._learn(list(misses))
        get = self.parts.__getitem__
        return [
            b"".join(map(get, parts)) if parts is not None else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            for text, parts in zip(texts, split, strict=True)
        ]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    """This worker's encoder; its cache lasts over tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(name)
    return _ENCODERS[name]


class FrameWriter:
    """Writes one file to a binary stream, document by document."""

    def __init__(self, out):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=LEVEL)
        self.pending: list[bytes] = []
        self.pending_bytes = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.pending_bytes and self.pending_bytes + len(ids) > FRAME_BYTES:
            self._flush()
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)

    def _flush(self) -> None:
        raw = b"".join(self.pending)
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.pending_bytes = [], 0

    def close(self) -> None:
        if self.pending:
            self._flush()
        known = np.array([x is not None for x in self.ids], "u1").tobytes()
        index = self.zip.compress(struct.pack("<Q", len(self.ids)) + known + np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes())
        self.out.write(struct.pack("<III", SKIPPABLE_INDEX, len(index) + 4, len(self.frames)) + index)
        table_ = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table_)) + table_)


class FrameReader:
    """Documents of one file by position; decompresses only the frames that hold them."""

    def __init__(self, uri: str):
        self.file = RangeReader(uri)
        size = self.file.size
        n, flags, magic = struct.unpack("<IBI", self.file.read(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table")
        table_at = size - 9 - 12 * n - 8
        entries = np.frombuffer(self.file.read(table_at + 8, 12 * n), "<u4").reshape(-1, 3).astype("u8")
        self.checksums = entries[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(entries[:, 0])]).astype(int)
        self.sizes = entries[:, 1].astype(int)
        self.raw_starts = np.concatenate([[0], np.cumsum(self.sizes)])
        at = int(self.starts[-1])
        magic, length, _ = struct.unpack("<III", self.file.read(at, 12))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"{uri}: no document index")
        index = zstandard.ZstdDecompressor().decompress(self.file.read(at + 12, length - 4))
        (m,) = struct.unpack_from("<Q", index)
        known, ids = np.frombuffer(index, "u1", m, 8), np.frombuffer(index, "<i8", m, 8 + m)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.lengths = np.frombuffer(index, "<u8", m, 8 + 9 * m).astype(int)
        self.doc_starts = np.concatenate([[0], np.cumsum(self.lengths)]) * 4
        self._frame: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._frame[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k])), max_output_size=int(self.sizes[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checksums[k]:
                raise ValueError(f"frame {k}: checksum differs")
            self._frame = (k, raw)
        return self._frame[1]

    def document(self, i: int) -> bytes:
        """The ids of document i as bytes."""
        a, b = int(self.doc_starts[i]), int(self.doc_starts[i + 1])
        if a == b:
            return b""
        k = int(np.searchsorted(self.raw_starts, a, "right")) - 1
        at = a - int(self.raw_starts[k])
        return self.frame(k)[at : at + b - a]

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        for i, doc_id in enumerate(self.doc_ids):
            yield doc_id, self.document(i)


def write_token_files(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> tuple[str, list[tuple[int, str, int, int]]]:
    """Writes (doc_id, text) in ascending doc_id order; returns the folder and (part, path, documents, ids) of each file.

    Null doc_ids come first; rows with one doc_id are ordered by a hash of their
    text, so that one id may fill many files; repeated rows are documents of
    their own; a null text is empty and keeps its end id. An empty table writes
    no files.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small_batches(spark)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, encode = f"{folder}/part-{part:06d}.zst", encoder(tokenizer).encode
        rows = (batch.slice(at, 1024) for batch in batches for at in range(0, batch.num_rows, 1024))
        first = next((x for x in rows if x.num_rows), None)
        if first is None:
            return
        n = total = 0
        with written(path) as out:
            writer = FrameWriter(out)
            for batch in (y for some in ([first], rows) for y in some):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, ids + end)
                    n, total = n + 1, total + len(ids) // 4 + 1
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n], "n_ids": [total]})

    files = dealt.mapInArrow(write, "part long, path string, n_docs long, n_ids long").collect()  # a row for each file
    return folder, sorted((x.part, x.path, x.n_docs, x.n_ids) for x in files)


def read_token_files(spark: SparkSession, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read back from the files; start counts the ids of all documents before."""
    starts = accumulate((x[3] for x in files), initial=0)
    todo = spark.createDataFrame([(path, start) for (_, path, _, _), start in zip(files, starts, strict=False)], "path string, start long")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = FrameReader(path)
                lengths = reader.lengths.astype("i8")
                crcs = [zlib.crc32(ids) for _, ids in reader.documents()]
                reader.file.close()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(reader.doc_ids, pa.int64()), "start": start + np.cumsum(lengths) - lengths, "n_tokens": lengths, "ids_crc32": pa.array(crcs, pa.int64())})

    return todo.repartition(max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) encoded, written, and read back."""
    return read_token_files(spark, write_token_files(docs)[1])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_files of documents: nulls, ties, repeats, long texts and empty tables as in write_token_files."""
    return token_files(spark, table(spark, sf_dir, "documents"))
