"""Token counts from a tokenizer compiled to finite-state transducers.

Two machines run over the bytes, in numpy, many texts at once.

*Splitter.* The pattern that cuts text into pieces is a machine of ten states over eleven classes of characters; each
transition says whether a piece begins at this character or at the one before. The characters of a block are cut into
chunks; each chunk is the map from the state at its start to the state at its end, the maps are composed by a
parallel prefix scan (log2 steps over all chunks), and a second pass emits the pieces. Most maps become constant after
a few characters and then cost one state. Classes come from the library itself, asked once per new character.

*Counter.* Within a piece the state is all that merges to come can depend on: for each suffix of what was read that
begins some token, the place in the token trie, the token before that suffix, and how many tokens fewer there were.
The last token of a prefix is the one suffix token that may follow the token before it, and two tokens may be
neighbours exactly if the merges leave their joined bytes as these two. So a transition is annotated with the
change in the number of tokens, and the sum along a piece is its count. The states form a finite machine, compiled as it
is met, kept by each worker, and dropped at ``STATES`` states to bound the memory.

Special strings of the file inside texts count as one token each and end the pieces around them, as the library does
by default. Defined results: null and empty texts have no bytes and no tokens; rows that are repeated get equal results;
other columns are never read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .blocks import blocks
from .byte_bpe import byte_characters

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
STATES = 250_000
CHUNK = 256
#: Steps for which a chunk is run from all states before those with a constant map go on with one.
PROBE = 12
#: Pieces run side by side for so many bytes; what is left of longer ones is run alone.
ABREAST = 48

# Classes of characters, and states of the splitter after a character.
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, E, L = range(11)
CLASSES = 11
START, WORD, DIGITS, MARKS, BLANK, BLANK_OTHER, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(10)
N_STATES = 10
_LETTERS = {LETTER, STMD, R, V, E, L}
_ASCII_CLASS = {" ": SPACE, "'": QUOTE, "s": STMD, "t": STMD, "m": STMD, "d": STMD, "r": R, "v": V, "e": E, "l": L}
_ENDS = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}


def _fresh(c: int) -> int:
    """State after a character that begins a piece."""
    if c in _LETTERS:
        return WORD
    return {SPACE: BLANK, WHITE: BLANK_OTHER, NUMBER: DIGITS, OTHER: MARKS, QUOTE: QUOTED}[c]


def _step(state: int, c: int) -> tuple[int, bool, bool]:
    """Next state; whether a piece begins at this character, and at the one before."""
    white = c in (SPACE, WHITE)
    if state in _ENDS:
        if c == _ENDS[state]:
            return START, False, False
        to, here, _ = _step(WORD, c)
        return to, here, True
    if state == WORD and c in _LETTERS or state == DIGITS and c == NUMBER or state == MARKS and c in (OTHER, QUOTE):
        return state, False, False
    if state in (BLANK, BLANK_OTHER) and white:
        return _fresh(c), False, False
    if state == BLANK:  # the last blank goes with what follows; a quote there begins no contraction
        return (MARKS if c == QUOTE else _fresh(c)), False, True
    if state == BLANK_OTHER:
        return _fresh(c), True, True
    if state == QUOTED:
        if c == STMD:
            return START, False, False
        if c in (R, V, L):
            return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], False, False
        if c in (OTHER, QUOTE):
            return MARKS, False, False
    return _fresh(c), True, False


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, begins here, begins one before; by state and symbol. A symbol over CLASSES begins a text."""
    to = np.zeros((N_STATES, 2 * CLASSES + 1), np.uint8)
    here, before = np.zeros_like(to, bool), np.zeros_like(to, bool)
    for s in range(N_STATES):
        for c in range(CLASSES):
            to[s, c], here[s, c], before[s, c] = _step(s, c)
            to[s, CLASSES + c], here[s, CLASSES + c], before[s, CLASSES + c] = _fresh(c), True, s in _ENDS
        before[s, 2 * CLASSES] = s in _ENDS  # behind the last character
    return to, here, before


def chunk_maps(symbols: np.ndarray) -> np.ndarray:
    """State map of each chunk (rows of ``symbols``): state at its end by state at its start."""
    to = splitter()[0].ravel()
    width = np.uint16(2 * CLASSES + 1)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint16)[None, :], len(symbols), 0)
    for j in range(min(PROBE, symbols.shape[1])):
        maps = to[maps * width + symbols[:, j, None]].astype(np.uint16)
    constant = (maps == maps[:, :1]).all(1)
    one, all_states = maps[constant, 0], maps[~constant]
    a, b = symbols[constant], symbols[~constant]
    for j in range(PROBE, symbols.shape[1]):
        one = to[one * width + a[:, j]].astype(np.uint16)
        if len(b):
            all_states = to[all_states * width + b[:, j, None]].astype(np.uint16)
    maps[constant] = one[:, None]
    maps[~constant] = all_states
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Map from the very start to the end of each chunk: maps composed over doubling distances."""
    done, gap = maps.copy(), 1
    while gap < len(done):
        done[gap:] = np.take_along_axis(done[gap:], done[:-gap].astype(np.int64), 1)
        gap *= 2
    return done


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Where pieces begin, from the symbols of a block."""
    to, here, before = splitter()
    n, width = len(symbols), 2 * CLASSES + 1
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, 2 * CLASSES, np.uint16)
    grid[:n] = symbols
    grid = grid.reshape(rows, CHUNK)
    ends = prefix_scan(chunk_maps(grid))
    state = np.concatenate([[START], ends[:-1, START]]).astype(np.uint16)
    states = np.empty((rows, CHUNK), np.uint16)
    flat_to = to.ravel()
    for j in range(CHUNK):
        states[:, j] = state
        state = flat_to[state * np.uint16(width) + grid[:, j]].astype(np.uint16)
    at = (states * np.uint16(width) + grid).ravel()[:n]
    begins = here.ravel()[at]
    begins[:-1] |= before.ravel()[at[1:]]
    begins[-1] |= before[to[states.ravel()[n - 1], symbols[-1]], 2 * CLASSES]
    return np.flatnonzero(begins)


class Counter:
    """The transducer that counts the tokens of a piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_characters())}
        raw = lambda text: bytes(byte[c] for c in text)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.rank = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw(a), raw(b)] = i
        self.next: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        special = set(self.specials)
        for text in spec["model"]["vocab"]:
            if text not in special:
                self._insert(raw(text))
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.classes = np.full(0x110000, 255, np.uint8)
        self.may_follow: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def _insert(self, token: bytes) -> None:
        node = 0
        for b in token:
            if b not in self.next[node]:
                self.next[node][b] = len(self.next)
                self.next.append({})
                self.token.append(None)
            node = self.next[node][b]
        self.token[node] = token

    def clear(self) -> None:
        """Forget all compiled states but the first, that of an empty piece."""
        self.states: list[tuple] = [((0, b"", 0),)]
        self.number = {self.states[0]: 0}
        self.known: dict[int, int] = {}
        self.bits = 16
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)

    def merge(self, data: bytes) -> list[bytes]:
        """What the merges make of a few bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether b can be the next token after a (or the first, after no token)."""
        key = (a, b)
        if key not in self.may_follow:
            if len(self.may_follow) >= 4 * STATES:
                self.may_follow.clear()
            self.may_follow[key] = self.merge(a + b) == ([a, b] if a else [b])
        return self.may_follow[key]

    def compile(self, key: int) -> int:
        """Transition of state ``key >> 8`` on byte ``key & 255``: next state << 8 | change in tokens + 200."""
        state, b = self.states[key >> 8], key & 255
        last, change, going = b"", 0, []
        for node, before, fewer in state:
            child = self.next[node].get(b)
            if child is None:
                continue
            token = self.token[child]
            if token is not None and not last and self.follows(before, token):
                last, change = token, fewer + 1
            if self.next[child]:
                going.append((child, before, fewer))
        new = ((0, last, 0), *((node, before, fewer - change) for node, before, fewer in going))
        number = self.number.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        value = number << 8 | (change + 200)
        self.known[key] = value
        if 2 * len(self.known) > len(self.keys):
            self.bits += 1
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
            for k, v in self.known.items():
                self._put(k, v)
        else:
            self._put(key, value)
        return value

    def _put(self, key: int, value: int) -> None:
        mask = len(self.keys) - 1
        slot = (key * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> (64 - self.bits)
        while self.keys[slot] != -1:
            slot = (slot + 1) & mask
        self.keys[slot], self.values[slot] = key, value

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Transitions of many keys at once; -1 where not compiled."""
        mask = len(self.keys) - 1
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        off = np.flatnonzero((there != keys) & (there != -1))
        while len(off):
            slot[off] = (slot[off] + 1) & mask
            there = self.keys[slot[off]]
            same = there == keys[off]
            out[off[same]] = self.values[slot[off[same]]]
            off = off[~same & (there != -1)]
        return out

    def transitions(self, keys: np.ndarray) -> np.ndarray:
        out = self.look_up(keys)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            unique, back = np.unique(keys[missing], return_inverse=True)
            made = np.array([self.known[k] if k in self.known else self.compile(k) for k in unique.tolist()], np.int64)
            out[missing] = made[back]
        return out

    def count(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of tokens of each piece."""
        if len(self.states) >= STATES:
            self.clear()
        order = np.argsort(-sizes, kind="stable")
        at, size = starts[order], sizes[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = len(at)
        for j in range(ABREAST):
            live = int(np.searchsorted(-size, -j, "left"))  # pieces of more than j bytes come first
            if not live:
                break
            got = self.transitions(state[:live] << 8 | data[at[:live] + j])
            total[:live] += (got & 255) - 200
            state[:live] = got >> 8
        for i in range(int(np.searchsorted(-size, -ABREAST, "left"))):
            s, n = int(state[i]), 0
            for b in data[at[i] + ABREAST : at[i] + size[i]].tolist():
                value = self.known.get(s << 8 | b)
                if value is None:
                    if len(self.states) >= 2 * STATES:
                        here = self.states[s]
                        self.clear()
                        s = self.number.setdefault(here, len(self.states))
                        if s == len(self.states):
                            self.states.append(here)
                    value = self.compile(s << 8 | b)
                n += (value & 255) - 200
                s = value >> 8
            total[i] += n
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out

    def class_of(self, char: str) -> int:
        if char in _ASCII_CLASS:
            return _ASCII_CLASS[char]
        for c, lead in ((LETTER, "x"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.pre.pre_tokenize_str(lead + char)) == 1:
                return c
        return WHITE

    def symbols(self, points: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Classes of code points, raised by CLASSES where a text begins."""
        out = self.classes[points]
        if len(new := np.unique(points[out == 255])):
            self.classes[new] = [self.class_of(chr(p)) for p in new.tolist()]
            out = self.classes[points]
        out = out.astype(np.uint16)
        out[texts] += CLASSES
        return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[at].astype(np.int32)
    points = first.copy()
    for size, lead in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
        mine = np.flatnonzero((first >= lead) & (first < (0xE0, 0xF0, 0x100)[size - 2]))
        value = first[mine] & (0xFF >> (size + 1))
        for j in range(1, size):
            value = value << 6 | data[at[mine] + j] & 0x3F
        points[mine] = value
    return points, at


def count_block(own: Counter, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of tokens of each text of a block."""
    n = len(offsets) - 1
    tokens = np.zeros(n, np.int64)
    doc = np.arange(n)
    special = [s.encode() for s in own.specials if s]
    raw = data.tobytes()
    if special and any(s in raw for s in special):
        parts, doc_of = [], []
        cut = re.compile(b"|".join(map(re.escape, special)))
        for i in range(n):
            pieces = cut.split(raw[offsets[i] : offsets[i + 1]])
            tokens[i] += len(pieces) - 1
            parts += pieces
            doc_of += [i] * len(pieces)
        data = np.frombuffer(b"".join(parts), np.uint8)
        offsets, doc = np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.array(doc_of)
    if not len(data):
        return tokens
    points, at = code_points(data)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    begins = np.searchsorted(at, offsets[filled])
    starts = at[piece_starts(own.symbols(points, begins))]
    sizes = np.diff(np.append(starts, len(data)))
    owner = doc[filled[np.searchsorted(offsets[filled], starts, "right") - 1]]
    return tokens + np.bincount(owner, weights=own.count(data, starts, sizes), minlength=n).astype(np.int64)


@lru_cache(2)
def counter(path: str) -> Counter:
    """One compiled tokenizer a worker process."""
    return Counter(path)


def counts_udf(path: str):
    """Arrow UDF: text to its UTF-8 bytes and tokens."""

    @F.arrow_udf("struct<n_bytes: bigint, n_tokens: bigint>")
    def count(texts: pa.Array) -> pa.Array:
        own, sizes, tokens = counter(path), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, data, at in blocks(texts):
            sizes.append(np.diff(at))
            tokens.append(count_block(own, data, at))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(sizes)), pa.array(np.concatenate(tokens))], names=["n_bytes", "n_tokens"])

    return count


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit."""
    made = df.select(F.col(id_col), counts_udf(path or public_tokenizers.path(VOCABULARY))(F.col(text_col)).alias("c"))
    return made.select(id_col, "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"))
