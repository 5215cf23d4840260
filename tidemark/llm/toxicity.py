"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words and word beginnings of ``PREFIX`` bytes, hashed into 2 ** ``BITS`` buckets. The
score is the logistic of w0 + sum w_i + sum over pairs <v_i, v_j>: every term has a weight and a short vector, so a
pair of terms that is toxic only together (an insult and the group it is aimed at) gets a weight of its own, which an
additive model cannot give. The pair sum costs one pass, as half of (sum v)^2 - sum v^2 in each dimension.

Learning: labelled rows outside the held-out fold, at most ``SAMPLE`` of them (those with the least hash of their id; all
if there are fewer), each as its buckets, are fitted on the driver by AdaGrad with weight decay, in two parts. First
the weights alone, of buckets whose share of toxic texts is ``LEAST_Z`` standard errors or more from the rest. Then the vectors of
*every* bucket in at least ``LEAST_TEXTS`` texts, neutral ones included, along with the weights: they begin near zero, and
a text whose error is at most ``EASY`` moves nothing, so vectors grow where weights leave errors, and ``FLOOR`` keeps
the first steps as small as the gradients. The model has (1 + ``RANK``) floats a bucket, 9 MB whatever the data, and is
broadcast. Scoring is one pass over whole texts, without a shuffle.

Defined results: a null or empty text has no terms and gets the score of the bias; without labels, or with labels of
one value only, every text gets the share of toxic labels (0 without any); ids with null or contradicting labels are
not learned from; a null id is not held out; rows that are repeated get equal scores; labels, languages, sources and
ids never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .blocks import ALNUM, blocks, word_hashes, word_spans
from .labelled import held_out, training_rows

BITS = 18
RANK = 8
PREFIX = 5
SAMPLE = 16_000
LEAST_TEXTS, LEAST_Z = 4, 4.0
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.2, 1e-3
PAIR_EPOCHS, PAIR_RATE, SPREAD, FLOOR, EASY = 6, 0.1, 0.003, 1e-2, 0.01
CUTOFF = 0.3
FOLDS, HELD_OUT = 4, 2


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text, each once, and where each text's begin (one entry more than texts)."""
    n = len(offsets) - 1
    starts, ends, doc = word_spans(data, offsets, ALNUM)
    whole = word_hashes(data, starts, ends) >> np.uint64(64 - BITS)
    long = np.flatnonzero(ends - starts > PREFIX)
    begun = word_hashes(data, starts[long], starts[long] + PREFIX)
    begun = (begun * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    keys = np.unique(np.concatenate([doc, doc[long]]).astype(np.int64) << BITS | np.concatenate([whole, begun]).astype(np.int64))
    return (keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << BITS)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each run; 0 for empty ones."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[full], axis=0)
    return out


class Machine:
    """Weights w (buckets), vectors v (buckets x RANK) and bias."""

    def __init__(self, w: np.ndarray, v: np.ndarray, bias: float):
        self.w, self.v, self.bias = w, v, bias

    def margin(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each text, and the sums of its vectors."""
        v = self.v[ids]
        total = _sums(v, at)
        pairs = 0.5 * ((total**2).sum(1) - _sums((v**2).sum(1), at))
        return self.bias + _sums(self.w[ids], at) + pairs, total

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(ids, at)[0], -30, 30)))


def associated(ids: np.ndarray, label: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Buckets in enough texts whose share of toxic texts differs from that of all texts by ``LEAST_Z`` standard errors."""
    n, toxic = len(labels), labels.sum()
    seen, hits = np.bincount(ids, minlength=1 << BITS), np.bincount(ids, weights=label, minlength=1 << BITS)
    p = seen / n
    error = np.sqrt(p * (1 - p) * (1 / toxic + 1 / (n - toxic))) + 1e-12
    return (seen >= LEAST_TEXTS) & (np.abs(hits / toxic - (seen - hits) / (n - toxic)) >= LEAST_Z * error)


def fit(ids: np.ndarray, at: np.ndarray, labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine fitted to texts given as buckets."""
    size = 1 << BITS
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    flat = Machine(np.zeros(size, np.float32), np.zeros((size, RANK), np.float32), max(-30.0, min(30.0, bias)))
    if not 0 < share < 1:
        return flat
    random = np.random.default_rng(seed)
    linear = associated(ids, np.repeat(labels, np.diff(at)), labels)
    paired = np.bincount(ids, minlength=size) >= LEAST_TEXTS
    seen_w, seen_v = np.full(size, 1e-6, np.float32), np.full(size, FLOOR, np.float32)
    seen_b = _fit_part(flat, _of(linear, ids, at), labels, random, EPOCHS, linear, False, seen_w, seen_v, 1e-6)
    flat.v[paired] = (random.standard_normal((int(paired.sum()), RANK)) * SPREAD).astype(np.float32)
    _fit_part(flat, _of(linear | paired, ids, at), labels, random, PAIR_EPOCHS, linear, True, seen_w, seen_v, seen_b)
    return flat


def _of(keep: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with the buckets of ``keep`` only."""
    own = keep[ids]
    return ids[own], np.concatenate([[0], np.cumsum(own)])[at]


def _rows_of(ids: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = at[rows + 1] - at[rows]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.repeat(at[rows] - begin[:-1], sizes) + np.arange(begin[-1])], begin


def _fit_part(m: Machine, texts: tuple[np.ndarray, np.ndarray], labels: np.ndarray, random, epochs: int, linear: np.ndarray, pairs: bool, seen_w: np.ndarray, seen_v: np.ndarray, seen_b: float) -> float:
    """Epochs of AdaGrad over weights, and with ``pairs`` over vectors; texts already right to ``EASY`` are passed over."""
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            margin, total = m.margin(*_rows_of(*texts, rows))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]).astype(np.float32)
            grad_b = float(error.mean())
            seen_b += grad_b**2
            m.bias -= RATE * grad_b / seen_b**0.5
            wrong = np.flatnonzero(np.abs(error) > EASY)
            mine, begin = _rows_of(*texts, rows[wrong])
            of = np.repeat(wrong, np.diff(begin))
            by = np.argsort(mine, kind="stable")
            bucket, first = np.unique(mine[by], return_index=True)
            if not len(bucket):
                continue
            each = error[of]
            grad_w = (np.add.reduceat(each[by], first) + DECAY * m.w[bucket]) / len(rows) * linear[bucket]
            if pairs:
                grad_v = (np.add.reduceat((each[:, None] * (total[of] - m.v[mine]))[by], first, axis=0) + DECAY * m.v[bucket]) / len(rows)
                seen_v[bucket] += (grad_v**2).sum(1)
                m.v[bucket] -= (PAIR_RATE / np.sqrt(seen_v[bucket]))[:, None] * grad_v
            seen_w[bucket] += grad_w**2
            m.w[bucket] -= RATE * grad_w / np.sqrt(seen_w[bucket])
    return seen_b


def buckets_udf():
    """Arrow UDF: text to its buckets, as bytes of 32-bit integers."""

    @F.arrow_udf("binary")
    def buckets(texts: pa.Array) -> pa.Array:
        out: list[bytes] = []
        for lo, hi, data, offsets in blocks(pc.utf8_lower(texts)):
            ids, at = terms(data, offsets)
            out += [ids[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
        return pa.array(out, pa.binary())

    return buckets


def score_udf(model):
    """Arrow UDF: text to score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        machine, out = model.value, [np.zeros(0)]
        for _, _, data, offsets in blocks(pc.utf8_lower(texts)):
            out.append(machine.score(*terms(data, offsets)).astype(np.float64))
        return pa.array(np.concatenate(out))

    return score


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    rows = training_rows(df, labels, id_col, text_col, label_col, lambda c: held_out(c, FOLDS, HELD_OUT), sample, buckets_udf())
    ids = [np.frombuffer(r["x"], np.int32) for r in rows]
    at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    machine = fit(np.concatenate([np.zeros(0, np.int32), *ids]), at, np.array([float(r["label"] == 1) for r in rows]))
    model = df.sparkSession.sparkContext.broadcast(machine)
    scored = df.select(F.col(id_col), held_out(id_col, FOLDS, HELD_OUT).alias("held_out"), score_udf(model)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
