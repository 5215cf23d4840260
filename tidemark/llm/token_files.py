"""Token ids in binary shards whose document boundaries are Elias-Fano encoded.

A shard holds the ids of consecutive documents as one array of 16 or 32 bit integers. Where document i begins is not a
table of 64-bit offsets: the n + 1 boundaries up to N are a monotone sequence, whose low l = log2(N / n) bits are
packed and whose high parts are unary in a bit vector of about 2 n bits. ``select(i)`` finds the i-th set bit from a
sample of every 512th and gives the boundary back. The ids of the documents, as far as they are not null, are a second
such sequence. All numbers are little-endian.

    magic "TMTOKEN1"; u4 bytes an id; u4 documents with a null id; u8 documents; u8 ids; i8 least document id
    boundaries, then document ids, each: u8 values; u8 l; u8 bytes of low bits, high bits, samples; those three
    the ids

Writing: documents are range-partitioned and sorted by id (equal ids by a hash of the text), each task writes its
rows in shards of at most ``SHARD_IDS`` ids (one longer document alone), under a temporary name first, so a task that is
run again replaces its shards by the same. The manifest, a row for each shard, gets the number of ids before it from a
running sum over shards. Reading takes one shard at a time. Paths go through pyarrow.fs, so the folder may be
any store that it knows; it must be one that all executors share.

Defined results: null and empty texts have the end id alone; null document ids come first; rows that are repeated are
repeated in the file; an empty table has no shards; other columns are never read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from ..functions.shared import new_path, settle
from .byte_bpe import byte_characters
from .memo import Memo

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SHARD_IDS = 8_000_000
#: Bytes that each generation of the memo of pieces may hold, and that of words.
MEMO = 45_000_000
EVERY = 512
#: Shards are read by at most so many tasks, each one shard at a time.
MOST_READERS = 20_000
MAGIC = b"TMTOKEN1"
_HEAD, _PART = struct.Struct("<8sIIQQq"), struct.Struct("<QQQQQ")

#: White space as the vocabulary's normalizer knows it: Python's, but for U+001C to U+001F.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WORDS = re.compile(r"[\S\x1c-\x1f]+")
#: The pre-tokenizer's matches in lower-cased plain text, whose letters and numbers are listed.
_LATIN = re.compile(r"[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|'(?:[stmd]|re|ve|ll)|[^\sa-zªµºß-öø-ſ0-9²³¹¼½¾]+")
#: Plain text holds white space and printable characters below U+0180, but for the one letter there whose lower case is not
#: a single letter, and no special string.
_NOT_PLAIN = re.compile("[^\t-\r -~¡-¬®-įı-ſ]")
_SPECIAL = "<|"


class EliasFano:
    """A monotone sequence of unsigned integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8), bitorder="little") if low_bits else np.zeros(0, np.uint8)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) + 1 if n else 0), np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), at[::EVERY].astype(np.uint32))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low_bits)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left, width = int(self.samples[i // EVERY]), i % EVERY, 4 * EVERY
        while True:
            bits = np.unpackbits(self.high[start // 8 : (start + width) // 8 + 1], bitorder="little")[start % 8 :]
            ones = np.flatnonzero(bits)
            if len(ones) > left:
                return ((start + int(ones[left]) - i) << self.low_bits) | int(self._low(i, i + 1)[0])
            width *= 4

    def values(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(0, self.n)

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]
        return _PART.pack(self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def read(cls, file) -> EliasFano:
        n, low_bits, *sizes = _PART.unpack(file.read(_PART.size))
        low, high, samples = (np.frombuffer(file.read(s), np.uint8) for s in sizes)
        return cls(n, low_bits, low, high, samples.view("<u4"))


class Shard:
    """A shard opened for reading: the ids of document i are ``ids(i)``, without reading the others."""

    def __init__(self, file):
        self.file = file
        magic, self.width, self.nulls, self.n_docs, self.n_ids, self.least = _HEAD.unpack(file.read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError("no token shard")
        self.bounds, self.doc_ids = EliasFano.read(file), EliasFano.read(file)
        self.begin = file.tell()

    def document(self, i: int) -> int | None:
        return None if i < self.nulls else self.doc_ids.select(i - self.nulls) + self.least

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        self.file.seek(self.begin + a * self.width)
        return np.frombuffer(self.file.read((b - a) * self.width), f"<u{self.width}").astype(np.uint32)


def write_shard(file, doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> None:
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    sizes = [len(x) for x in ids]
    file.write(_HEAD.pack(MAGIC, width, len(doc_ids) - len(known), len(doc_ids), sum(sizes), least))
    file.write(EliasFano.of(np.concatenate([[0], np.cumsum(sizes)])).to_bytes())
    file.write(EliasFano.of(known.astype(np.uint64) - np.array([least], np.int64).astype(np.uint64)).to_bytes())
    for x in ids:
        file.write(x.astype(f"<u{width}").tobytes())


def _is_plain(text: str) -> bool:
    return _SPECIAL not in text and not _NOT_PLAIN.search(text)


class WordEncoder:
    """Ids of texts by a vocabulary that drops white space. Plain texts are cut into the pre-tokenizer's matches, others into
    words; both are encoded apart and kept in bounded memos."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.characters = dict(enumerate(byte_characters()))
        self.pieces, self.words = Memo(self._piece, MEMO), Memo(self._word, MEMO)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.characters)
        return array("i", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _of_plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _LATIN.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        if _is_plain(word):
            return self._of_plain(word)
        return array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if _is_plain(text):
            return np.frombuffer(self._of_plain(text), np.int32)
        if text.isascii() and _SPECIAL not in text:
            text = text.lower()  # as the normalizer does, so that fewer words are new
        words = _WORDS.findall(text) if _SEPARATORS.search(text) else text.split()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(path)


def _store(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the shards; the stored manifest: part, seq, file, docs, ids, start (ids of all documents before)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        fs, top = _store(folder)
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        made: list[dict] = []

        held = 0

        def close() -> None:
            nonlocal docs, ids, seq, held
            fs.create_dir(top, recursive=True)
            name, hidden = f"shard-{part:06d}-{seq:05d}.tok", f"{top}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(hidden) as out:
                write_shard(out, docs, ids, own.width)
            fs.move(hidden, f"{top}/{name}")
            made.append({"part": part, "seq": seq, "file": name, "docs": len(docs), "ids": held})
            docs, ids, seq, held = [], [], seq + 1, 0

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.append(own.encode(t.as_py() or ""), np.int32(end_id)).astype(f"u{own.width}")
                if docs and held + len(got) > SHARD_IDS:
                    close()
                docs.append(d)
                ids.append(got)
                held += len(got)
        if docs:
            close()
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    manifest = settle(dealt.mapInArrow(write, "part int, seq int, file string, docs bigint, ids bigint"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return settle(manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the shards: id, start, n_tokens, ids_crc32 (of its ids as unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{top}/{row['file']}") as file:
                    shard = Shard(file)
                    bounds = shard.bounds.values().astype(np.int64)
                    file.seek(shard.begin)
                    ids = np.frombuffer(file.read(shard.n_ids * shard.width), f"<u{shard.width}").astype("<u4")
                known = (shard.doc_ids.values() + np.array([shard.least], np.int64).astype(np.uint64)).view(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * shard.nulls + known.tolist(), pa.int64()), pa.array(bounds[:-1] + row["start"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    names=[id_col, "start", "n_tokens", "ids_crc32"],
                )

    # A number of partitions, as adaptive execution would else put these small rows into one task.
    shards = manifest.select("file", "start").repartition(max(1, min(manifest.count(), MOST_READERS)), "file")
    return shards.mapInArrow(read, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def through_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards into the shared folder and read them back."""
    spark = df.sparkSession
    folder = new_path(spark, "tokens")
    return read_token_files(spark, folder, write_token_files(df, folder, id_col, text_col), id_col)
