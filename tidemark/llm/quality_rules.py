"""Quality rules whose cutoffs come with a proven limit on false rejections.

Each text is measured once (words, symbols, repeated lines and windows, capitals, punctuation). Labelled rows are
split in two halves by a hash of their id. The first half only *proposes*: for each stratum and signal the cutoff
that best parts bad from good rows. The proposals of a stratum form one path, all its cutoffs times a common factor
from lenient to strict. The second half *certifies*: the path is walked from its lenient end, and a factor holds if
the exact binomial tail P(Bin(n, alpha) <= false rejections) is at most delta / number of strata. Walking a fixed
path needs no further correction, the division by the number of strata (Bonferroni) covers all of them. So with
probability 1 - delta no stratum loses more than a share ``alpha`` of its good rows to the cutoffs. A stratum
with too few good rows to prove anything keeps all rows that pass the base rules.

Defined results: a null text has no words, so the base rules reject it; a null stratum is a stratum of its own; rows
that are repeated are judged alike; an id labelled both good and bad, or with a null label, teaches nothing; without
labels only the base rules apply. Other columns of the input are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.shared import settle
from .blocks import ALNUM, NOT_BLANK, blocks, byte_table, counts, kgrams, mix, word_hashes, word_spans
from .labelled import teaching_labels
from .tables import free_name, once

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED = 30

#: Share of good rows of a stratum that cutoffs may reject, and the chance that this fails for any stratum.
ALPHA, DELTA = 0.05, 0.05
#: A proposal must reject this share of the bad rows, and weighs one rejected good row as so many bad ones.
LEAST_GAIN, GOOD_WEIGHT = 0.01, 20.0
#: Candidate cutoffs of every signal, and factors of the path from strict to lenient.
GRID = np.geomspace(0.01, 100.0, 64)
PATH = np.array([1.0, 1.1, 1.25, 1.5, 2.0, 3.0, 5.0, 10.0])

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SIGNALS = ["symbols_per_word", "dup_lines", "repeated_words", "capitals", "punctuation", "word_length"]

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_FIRST_BYTE = ~byte_table((0x80, 0xBF))
_CAPITAL = byte_table((0x41, 0x5A))
_LETTER = byte_table((0x41, 0x5A), (0x61, 0x7A))
_PUNCTUATION = NOT_BLANK & ~ALNUM
_NOT_NEWLINE = ~byte_table((0x0A, 0x0A))
_ONE = np.uint64(0x9E3779B97F4A7C15)


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one document."""
    return mix(h + doc.astype(np.uint64) * _ONE)


def _repeated_words(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words inside windows that are found twice or more in their document."""
    grams, at = kgrams(h, doc, WINDOW)
    key = _own(grams, doc[at])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    step = np.zeros(len(h) + WINDOW, np.int64)
    step[at[again]] += 1
    step[at[again] + WINDOW] -= 1
    return counts(doc[np.cumsum(step[: len(h)]) > 0], n)


def measure_block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures (documents x 5) and signals (documents x 6) of a block."""
    n = len(offsets) - 1
    starts, ends, doc = word_spans(data, offsets, NOT_BLANK)
    n_words = counts(doc, n)
    word_chars = _per_doc((NOT_BLANK & _FIRST_BYTE)[data], offsets)
    n_symbols = _per_doc(_SYMBOL[data], offsets)
    repeated = _repeated_words(word_hashes(data, starts, ends), doc, n)
    ls, le, ldoc = word_spans(data, offsets, _NOT_NEWLINE)
    filled = np.concatenate([[0], np.cumsum(NOT_BLANK[data], dtype=np.int64)])
    has_word = filled[le] > filled[ls]
    ls, le, ldoc = ls[has_word], le[has_word], ldoc[has_word]
    lines = counts(ldoc, n)
    _, first = np.unique(_own(word_hashes(data, ls, le), ldoc), return_index=True)
    dup_lines = lines - counts(ldoc[first], n)
    words = np.maximum(n_words, 1)
    signals = [
        n_symbols / words,
        dup_lines / np.maximum(lines, 1),
        repeated / words,
        _per_doc(_CAPITAL[data], offsets) / np.maximum(_per_doc(_LETTER[data], offsets), 1),
        _per_doc(_PUNCTUATION[data], offsets) / np.maximum(word_chars, 1),
        word_chars / words,
    ]
    return np.stack([n_words, word_chars, n_symbols, dup_lines, repeated], 1), np.stack(signals, 1)


def measure_udf() -> Column:
    """Arrow UDF: text to the five measures and the array of signals. See ``tables.once``."""

    @F.arrow_udf("struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ", signals: array<double>>")
    def measure(texts: pa.Array) -> pa.Array:
        parts = [measure_block(data, at) for _, _, data, at in blocks(texts)]
        measures = np.concatenate([m for m, _ in parts] or [np.zeros((0, len(MEASURES)), np.int64)])
        signals = np.concatenate([s for _, s in parts] or [np.zeros((0, len(SIGNALS)))])
        at = pa.array(np.arange(len(signals) + 1, dtype=np.int32) * len(SIGNALS))
        columns = [pa.array(np.ascontiguousarray(measures[:, i])) for i in range(len(MEASURES))]
        return pa.StructArray.from_arrays([*columns, pa.ListArray.from_arrays(at, pa.array(signals.ravel()))], names=[*MEASURES, "signals"])

    return once(measure)


def base_failed(m: str) -> Column:
    """The fixed rules, over a struct of measures named ``m``."""
    return F.expr(f"{m}.n_words < {MIN_WORDS} OR 100 * {m}.n_repeat_words > {MAX_REPEATED} * {m}.n_words")


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly in log space."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i])
    logs += i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(logs - logs.max()).sum() * math.exp(logs.max())))


def propose(cells: pd.DataFrame) -> pd.DataFrame:
    """Of one stratum: the best grid index of each signal, -1 where none is worth it.

    ``cells`` counts rows by (signal, bucket, good); a bucket is the number of grid points below the value.
    """
    picks = []
    for s in range(len(SIGNALS)):
        own = cells[cells["signal"] == s]
        share = []
        for good in (True, False):
            side = own[own["good"] == good]
            hist = np.bincount(side["bucket"], weights=side["rows"], minlength=len(GRID) + 1)
            above = hist[::-1].cumsum()[::-1][1:]  # rows over grid point j
            share.append(above / max(hist.sum(), 1))
        gain = share[1] - GOOD_WEIGHT * share[0]
        best = int(np.argmax(gain))
        picks.append(best if gain[best] >= LEAST_GAIN and share[1][best] >= LEAST_GAIN else -1)
    return pd.DataFrame({"stratum": [cells["stratum"].iloc[0]], "picks": [picks]})


def certify(cells: pd.DataFrame, strata: int, alpha: float, delta: float) -> pd.DataFrame:
    """Of one stratum: the cutoffs that the held-out good rows prove safe; no row if none are.

    ``cells`` counts good rows by level, the number of path factors that the row exceeds.
    """
    hist = np.bincount(cells["level"], weights=cells["rows"], minlength=len(PATH) + 1)
    n, rejected = int(hist.sum()), hist[::-1].cumsum()[::-1][1:].astype(int)
    factor = None
    for j in range(len(PATH) - 1, -1, -1):
        if tail(n, int(rejected[j]), alpha) > delta / strata:
            break
        factor = PATH[j]
    if factor is None:
        return pd.DataFrame({"stratum": pd.Series([], dtype=str), "cutoffs": pd.Series([], dtype=object)})
    cutoffs = [float(GRID[p] * factor) if p >= 0 else None for p in cells["picks"].iloc[0]]
    return pd.DataFrame({"stratum": [cells["stratum"].iloc[0]], "cutoffs": [cutoffs]})


def fit_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Cutoffs by stratum, as a small stored table (stratum, cutoffs).

    ``measured``: id, stratum, m (measures); ``labels``: id, label (1 good, 0 bad).
    """
    rows = (
        measured.where(~base_failed("m")).join(labels, "id")
        .select("stratum", (F.col("label") == 1).alias("good"), F.col("m.signals").alias("signals"), F.expr("pmod(crc32(CAST(id AS STRING)), 2)").alias("half"))
    )
    rows = settle(rows)
    grid = "array(" + ", ".join(f"{g!r}D" for g in GRID.tolist()) + ")"
    bucket = F.expr(f"size(filter({grid}, g -> g < value))")
    cells = (
        rows.where("half = 0").select("stratum", "good", F.posexplode("signals").alias("signal", "value"))
        .groupBy("stratum", "signal", bucket.alias("bucket"), "good").agg(F.count("*").alias("rows"))
    )
    picks = settle(cells.groupBy("stratum").applyInPandas(propose, "stratum string, picks array<int>"))
    picks = picks.where("exists(picks, p -> p >= 0)")
    strata = max(picks.count(), 1)
    excess = f"array_max(transform(picks, (p, i) -> if(p >= 0, signals[i] / {grid}[p], 0D)))"
    path = "array(" + ", ".join(f"{t!r}D" for t in PATH.tolist()) + ")"
    held = (
        rows.where("half = 1 AND good").join(picks, "stratum").select("stratum", "picks", F.expr(excess).alias("excess"))
        .groupBy("stratum", "picks", F.expr(f"size(filter({path}, t -> t < excess))").alias("level")).agg(F.count("*").alias("rows"))
    )
    certified = held.groupBy("stratum").applyInPandas(lambda c: certify(c, strata, alpha, delta), "stratum string, cutoffs array<double>")
    return settle(certified)


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add base_failed and kept to rows with ``m`` and ``stratum``. The cutoffs have one row per stratum."""
    over = "exists(arrays_zip(m.signals, __cutoffs), x -> x.signals > x.__cutoffs)"
    return (
        measured.join(cutoffs.select(F.col("stratum").alias("__stratum"), F.col("cutoffs").alias("__cutoffs")), F.col("stratum") == F.col("__stratum"), "left")
        .withColumn("base_failed", base_failed("m"))
        .withColumn("kept", F.expr(f"NOT base_failed AND NOT coalesce({over}, false)"))
        .drop("__stratum", "__cutoffs")
    )


def measure_texts(df: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """id, stratum and m of every row."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), measure_udf()(F.col(text_col)).alias("m"))


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per input row: id, the five measures, base_failed, kept."""
    measured = settle(measure_texts(df, id_col, text_col, stratum_col))
    cutoffs = fit_cutoffs(measured, teaching_labels(labels, id_col, label_col), alpha, delta)
    judged = judge(measured, cutoffs)
    return judged.select(F.col("id").alias(id_col), *[F.col(f"m.{m}").alias(m) for m in MEASURES], "base_failed", "kept")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    cutoffs = fit_cutoffs(settle(measure_texts(df, id_col, text_col, stratum_col)), teaching_labels(labels, id_col, label_col))
    row = free_name(df, "row")
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), measure_udf()(F.col(text_col)).alias("m"))
    return judge(packed, cutoffs).where("kept").select(f"`{row}`.*")
