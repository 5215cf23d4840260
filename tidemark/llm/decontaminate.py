"""Benchmark decontamination by winnowing: shared fingerprints are joined and every hit is extended.

Words are runs of ASCII letters and digits and of anything that is not ASCII, with A-Z lower-cased. Of each window of
``w`` consecutive k-grams the one with the least hash (the last of equals) is a fingerprint. A span of w + k - 1
words that a document shares with an item has the same k-grams in both, so both pick the same one: with k = 5 and
w = 6 no shared span of ten words is missed. An item of fewer than ten words is a single window; for each such
length that occurs, w and k are chosen so that w + k - 1 is that length, and the same guarantee holds.

Fingerprints of documents pass a bitmap of the items' fingerprints first: its size is fixed by ``BITMAP_BITS``
(8 MB), whatever the number of items, and a false pass only costs a row in the join. Fingerprints that pass carry the
few words around them that a window can reach, are joined with the items' on the hash, and are extended word by
word to both sides; the words themselves are compared, not their hashes.

Defined results: a null or empty text has no words, no hits and no items; an empty benchmark contaminates nothing; rows
that are repeated get equal results; copies of an item are each listed; null item ids are not listed, though their
words count as hit. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.shared import settle
from .blocks import ALNUM, LOWER, blocks, counts, kgrams, mix, word_hashes, word_spans
from .tables import free_name, once

WINDOW = 10
K = 5
BITMAP_BITS = 26

_FINGERPRINTS = "array<struct<key: bigint, pos: int, n: int, ctx: array<string>>>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shape(n: int) -> tuple[int, int]:
    """k and w that guarantee a shared span of n words."""
    k = min(K, n)
    return k, n - k + 1


def winnow(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and key, of each fingerprint that guarantees spans of n words."""
    k, w = shape(n)
    grams, at = kgrams(h, doc, k)
    full = np.zeros(len(h), np.uint64)
    full[at] = grams
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, where = full[:m].copy(), np.arange(m)
    for j in range(1, w):
        other = full[j : j + m]
        less = other <= best
        best[less] = other[less]
        where[less] += j - (where[less] - np.flatnonzero(less))
    where = np.unique(where[doc[:m] == doc[n - 1 : n - 1 + m]])
    return where, mix(full[where] + np.full(1, n, np.uint64) * _STEP)


def _context(words, doc: np.ndarray, i: int, k: int, w: int) -> list[str | None]:
    """The words from w - 1 before a fingerprint to w - 1 behind it; null outside the document."""
    return [words(j) if 0 <= j < len(doc) and doc[j] == doc[i] else None for j in range(i - w + 1, i + k + w - 1)]


def fingerprint_block(data: np.ndarray, offsets: np.ndarray, lengths: list[int] | None, bitmap: np.ndarray | None) -> tuple[np.ndarray, list[list[dict]]]:
    """Number of words, and fingerprints, of each text. Without ``lengths`` each text is an item and has its own."""
    data = LOWER[data]
    n_texts = len(offsets) - 1
    starts, ends, doc = word_spans(data, offsets, ALNUM)
    h = word_hashes(data, starts, ends)
    n_words = counts(doc, n_texts)
    first = np.concatenate([[0], np.cumsum(n_words)])
    found: list[list[dict]] = [[] for _ in range(n_texts)]

    def word(j: int) -> str:
        return data[starts[j] : ends[j]].tobytes().decode()

    wanted = lengths if lengths is not None else sorted({min(int(x), WINDOW) for x in n_words if x})
    for n in wanted:
        k, w = shape(n)
        at, keys = winnow(h, doc, n)
        if lengths is None:
            own = np.minimum(n_words[doc[at]], WINDOW) == n
            at, keys = at[own], keys[own]
        if bitmap is not None:
            slot = keys >> np.uint64(64 - BITMAP_BITS)
            hit = (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at, keys = at[hit], keys[hit]
        for i, key in zip(at.tolist(), keys.view(np.int64).tolist(), strict=True):
            d = int(doc[i])
            found[d].append({"key": key, "pos": i - int(first[d]), "n": n, "ctx": _context(word, doc, i, k, w)})
    return n_words, found


def _udf(lengths: list[int] | None, shared=None):
    """Arrow UDF: text to its number of words and its fingerprints. See ``tables.once``."""
    kind = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("ctx", pa.list_(pa.string()))]))

    @F.arrow_udf(f"struct<n_words: bigint, prints: {_FINGERPRINTS}>")
    def prints(texts: pa.Array) -> pa.Array:
        bitmap = shared.value if shared is not None else None
        words, found = [np.zeros(0, np.int64)], []
        for _, _, data, at in blocks(texts):
            n, rows = fingerprint_block(data, at, lengths, bitmap)
            words.append(n)
            found += rows
        return pa.StructArray.from_arrays([pa.array(np.concatenate(words)), pa.array(found, kind)], names=["n_words", "prints"])

    return once(prints)


def item_prints(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored fingerprints by item class (key, n, pos, ctx, class), and the items of each class (class, item).

    Items of equal text are one class, so copies of an item add no rows to the join.
    """
    texts = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"), F.sha2(text_col, 256).alias("class"))
    members = settle(texts.select("class", "item").distinct())
    classes = texts.groupBy("class").agg(F.min("text").alias("text"))
    stored = settle(classes.select("class", _udf(None)(F.col("text")).alias("p")).select("class", F.explode("p.prints").alias("x")).select("class", "x.*"))
    return stored, members


def bitmap_of(prints: DataFrame) -> np.ndarray:
    """Bits of all fingerprints. At most 2 ** BITMAP_BITS / 32768 rows of 4 KB come to the driver."""
    slot = f"shiftrightunsigned(key, {64 - BITMAP_BITS}) + 1"
    rows = prints.groupBy(F.expr(f"bitmap_bucket_number({slot})").alias("b")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({slot}))").alias("bits")).collect()
    bits = np.zeros(2**BITMAP_BITS // 8, np.uint8)
    for r in rows:
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def fingerprint_column(items: DataFrame, text: Column) -> Column:
    """n_words and the fingerprints of a text that may be among those of the stored items."""
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most WINDOW values
    shared = items.sparkSession.sparkContext.broadcast(bitmap_of(items))
    return _udf(lengths, shared)(text)


def matches(found: DataFrame, items: DataFrame) -> DataFrame:
    """row, lo, hi, class: runs of words (inclusive) that lie in occurrences of windows of an item.

    ``found`` has row and prints.
    """
    doc = found.select("row", F.explode("prints").alias("x")).select("row", "x.*")
    item = items.select("key", F.col("n").alias("item_n"), F.col("ctx").alias("item_ctx"), "class")
    k, w = f"least({K}, n)", f"(n - least({K}, n) + 1)"
    same = "zip_with(ctx, item_ctx, (a, b) -> a IS NOT NULL AND b IS NOT NULL AND a = b)"
    joined = doc.join(item, "key").where("n = item_n").select("row", "pos", "n", "class", F.expr(same).alias("same"))
    middle = f"forall(slice(same, {w}, {k}), e -> e)"
    left = f"array_position(reverse(slice(same, 1, {w} - 1)), false)"
    right = f"array_position(slice(same, {w} + {k}, {w} - 1), false)"
    run = joined.where(middle).selectExpr("row", "pos", "n", "class", f"if({left} = 0, {w}, {left}) - 1 AS l", f"if({right} = 0, {w}, {right}) - 1 AS r")
    return run.where(f"l + r + {k} >= n").selectExpr("row", "class", "CAST(pos - l AS INT) AS lo", f"CAST(pos + {k} - 1 + r AS INT) AS hi").distinct()


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    prints, members = item_prints(items, item_col, item_text_col)
    rows = settle(
        df.select(F.col(id_col).alias("id"), fingerprint_column(prints, F.col(text_col)).alias("p"))
        .select("id", "p.n_words", F.expr("if(size(p.prints) > 0, p.prints, NULL)").alias("prints"), F.monotonically_increasing_id().alias("row"))
    )
    hit = settle(matches(rows.where("prints IS NOT NULL"), prints))
    union = "aggregate(array_sort(runs), struct(0L AS n, -1 AS last), (a, x) -> struct(a.n + greatest(0, x.hi - greatest(x.lo, a.last + 1) + 1) AS n, greatest(a.last, x.hi) AS last), a -> a.n)"
    words = hit.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")).select("row", F.expr(union).alias("n_hit"))
    listed = (
        hit.select("row", "class").distinct().join(members, "class").groupBy("row")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
        .select("row", F.size("items").cast("long").alias("n_items"), F.concat_ws(",", "items").alias("items"))
    )
    return rows.select("row", "id", "n_words").join(words.join(listed, "row", "left"), "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without an occurrence of an item's window, with all their columns.

    The verdict depends on the text alone, so rows are matched by the text's SHA-256; a null text stays.
    """
    prints, _ = item_prints(items, item_col, item_text_col)
    found = df.where(F.col(text_col).isNotNull()).select(F.sha2(text_col, 256).alias("row"), fingerprint_column(prints, F.col(text_col)).alias("p"))
    hit = settle(matches(settle(found.selectExpr("row", "p.prints AS prints").where("size(prints) > 0")), prints).select("row").distinct())
    row = free_name(df, "row")
    return df.withColumn(row, F.sha2(text_col, 256)).join(hit.withColumnRenamed("row", row), row, "left_anti").drop(row)
