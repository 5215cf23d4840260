"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary file of ranks (base64 token and rank a line) becomes a model of the library: bytes are written in the
library's 256 printable characters, and the merge that makes a token is found by merging its bytes with lower ranks
only, which leaves two parts. Text is cut where no match of the pattern can cross: before a blank or newline that a
character other than white space follows. Such a piece has the same ids wherever it stands, so each worker keeps a
memo of pieces (``MEMO`` bytes a generation) and calls the library for new ones only.

Ids have byte and character offsets: a token that holds only part of a character has the offsets of that whole
character. Decoding looks each id up in the reversed byte table and joins bytes, so split characters come back whole;
only ``decode_text`` has to choose what to do with bytes that are no UTF-8.

Defined results: null and empty texts have no ids and decode to no bytes; special strings inside texts are ordinary
text; unknown ids raise KeyError; rows that are repeated get equal results; other columns are passed on or never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .memo import Memo
from .tables import free_name

RANKS = "byte_bpe_50k.tiktoken"
MEMO = 36_000_000

#: White space as the pattern knows it: Python's, but for the four separators U+001C to U+001F.
_SPACE = r"[^\S\x1c-\x1f]"
_OTHER = r"[\S\x1c-\x1f]"
#: Pieces in general, and texts where cutting before every blank and newline would be wrong.
_PIECES = re.compile(f"{_SPACE}?{_OTHER}+|{_SPACE}+(?={_SPACE}{_OTHER})|{_SPACE}+")
_UNSAFE = re.compile(f"^{_SPACE}|[ \n](?:{_SPACE}|$)")
#: The pattern's matches in printable ASCII.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)


@lru_cache(1)
def byte_characters() -> list[str]:
    """The library's character of each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [rest.get(b, chr(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def two_parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The pair whose merge is the token: what lower ranks alone make of its bytes. None if that isn't a pair."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], limit))
        if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


class Codec:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        chars = byte_characters()
        text = lambda token: "".join(chars[b] for b in token)
        merges = []
        for token in sorted(ranks, key=ranks.get):
            if len(token) > 1 and (parts := two_parts(token, ranks)):
                merges.append((text(parts[0]), text(parts[1])))
        self.model = models.BPE(vocab={text(t): r for t, r in ranks.items()}, merges=merges)
        self.tokenizer = Tokenizer(self.model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {i: bytes(byte[c] for c in t) for t, i in self.tokenizer.get_vocab().items()}
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.lengths[i] = len(b)
        self._map = {ord(" "): chars[0x20], ord("\n"): chars[0x0A]}
        self.spaced, self.bare = (Memo(lambda piece, before=before: np.array(self.encode_piece(before + piece), np.int32).tobytes(), MEMO) for before in (" ", ""))

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a text, by the library."""
        if piece.isascii() and piece.lstrip(" \n").isprintable():
            return [t.id for m in _ASCII.findall(piece) for t in self.model.tokenize(m.translate(self._map))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, by its pieces."""
        found: list[bytes] = []
        if text and _UNSAFE.search(text):
            found = [self.bare[p] for p in _PIECES.findall(text)]
        elif text:
            first = ""
            for line in text.split("\n"):
                words = line.split(" ")
                found.append(self.bare[first + words[0]])
                found.extend(map(self.spaced.__getitem__, words[1:]))
                first = "\n"
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode_text(self, ids: np.ndarray, errors: str = "replace") -> str:
        return self.decode(ids).decode("utf-8", errors)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """First byte, end byte, first character and end character of each token (n x 4)."""
        end = np.cumsum(self.lengths[ids])
        start = end - self.lengths[ids]
        data = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # the character that each byte is part of
        if not len(ids):
            return np.zeros((0, 4), np.int64)
        return np.stack([start, end, char[start], char[end - 1] + 1], 1)


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(path, pattern)


def digest_udf(path: str, pattern: str):
    """Arrow UDF: text to number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded bytes."""

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digest(texts: pa.Array) -> pa.Array:
        own, n, ids_sha, text_sha = codec(path, pattern), [], [], []
        for t in texts:
            ids = own.encode(t.as_py() or "")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest())
            text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def encode_udf(path: str, pattern: str):
    """Arrow UDF: text to ids and offsets (bytes and characters, end exclusive)."""
    names = ["byte_start", "byte_end", "char_start", "char_end"]

    @F.arrow_udf("struct<ids: array<int>, " + ", ".join(f"{n}: array<int>" for n in names) + ">")
    def encode(texts: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        ids = [own.encode(t.as_py() or "") for t in texts]
        at = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
        spans = np.concatenate([np.zeros((0, 4), np.int64), *[own.offsets(i) for i in ids]]).astype(np.int32)
        columns = [np.concatenate([np.zeros(0, np.int32), *ids]), *[np.ascontiguousarray(spans[:, j]) for j in range(4)]]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(c, pa.int32())) for c in columns], names=["ids", *names])

    return encode


def decode_udf(path: str, pattern: str):
    """Arrow UDF: ids to the bytes they stand for."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([own.decode(np.array(i.as_py() or [], np.int64)) for i in ids], pa.binary())

    return decode


def _where(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN


def with_ids(df: DataFrame, text_col: str = "text", into: str = "tokens", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All rows and columns, and a struct of ids and offsets."""
    return df.withColumn(free_name(df, into), encode_udf(*_where(path, pattern))(F.col(text_col)))


def decoded(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    return decode_udf(*_where(path, pattern))(ids)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256."""
    made = df.select(F.col(id_col), digest_udf(*_where(path, pattern))(F.col(text_col)).alias("d"))
    return made.select(id_col, "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
