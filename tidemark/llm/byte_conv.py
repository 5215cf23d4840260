"""Quality classifier: a convolutional network over the bytes of a text, in numpy.

A text is cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP``, to its very end. Every byte has a learned
vector; ``FILTERS`` learned filters look at ``WIDTH`` bytes each, every ``STRIDE`` bytes; of each filter the largest
response in a chunk stays (max pooling). The mean and the maximum over all chunks of a text then give one
probability by logistic regression. Chunks meet only in that mean and maximum, so a text of any length needs the memory
of a few chunks at a time.

Learning: labelled rows outside the held-out fold, in order of the hash of their id, at most ``SAMPLE`` of them and no
more than hold ``SAMPLE_BYTES`` of text together, are fitted on the driver by Adam. Each is learned from whole, all its
chunks pooled as they are in scoring. The model has a few thousand floats. Scoring reads whole texts, in one pass
without a shuffle.

Defined results: a null or empty text is one chunk of padding; without labels, or with labels of one value only,
every text gets the share of good labels (0 without any); ids with null or contradicting labels are not learned from; a
null id is not held out; rows that are repeated get equal scores; labels, languages, sources and ids never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import blocks
from .labelled import held_out, training_rows

CHUNK, OVERLAP = 512, 64
VECTOR, WIDTH, STRIDE, FILTERS = 6, 8, 2, 24
SAMPLE, SAMPLE_BYTES = 6_000, 32_000_000
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.01, 1e-4
#: Chunks that are in memory as windows at a time.
ABREAST = 128
CUTOFF = 0.3
FOLDS, HELD_OUT = 5, 0

_AT = np.arange(0, CHUNK - WIDTH + 1, STRIDE)


def n_chunks(size: np.ndarray) -> np.ndarray:
    """Chunks that cover texts of so many bytes; one at least."""
    return np.maximum(1, -(-(np.asarray(size) - OVERLAP) // (CHUNK - OVERLAP)))


def chunk_bytes(data: np.ndarray, offsets: np.ndarray, first: int, last: int, n: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Chunks ``first`` to ``last`` of a block, padded by zeros. n, begin: chunks of each text, and before it."""
    k = np.arange(first, last)
    text = np.searchsorted(begin, k, "right") - 1
    start = offsets[text] + (k - begin[text]) * (CHUNK - OVERLAP)
    at = start[:, None] + np.arange(CHUNK)
    inside = at < offsets[text + 1][:, None]
    return np.where(inside, np.append(data, np.uint8(0))[np.where(inside, at, len(data))], 0)


def all_chunks(text: np.ndarray) -> np.ndarray:
    """The chunks of one text."""
    at = np.array([0, len(text)])
    n = n_chunks(np.diff(at))
    return chunk_bytes(text, at, 0, int(n[0]), n, np.array([0, int(n[0])])).astype(np.uint8)


class Network:
    """Byte vectors, filters with thresholds, and the weights of the pooled responses."""

    def __init__(self, seed: int = 11):
        random = np.random.default_rng(seed)
        self.vectors = random.standard_normal((256, VECTOR)).astype(np.float32) * 0.5
        self.filters = (random.standard_normal((WIDTH * VECTOR, FILTERS)) / np.sqrt(WIDTH * VECTOR)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weights = (random.standard_normal(2 * FILTERS) * 0.1).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.share: float | None = None

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.shift, self.weights, self.bias]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Byte vectors seen by each filter position (chunks x positions x WIDTH * VECTOR)."""
        seen = self.vectors[chunks].reshape(len(chunks), -1)
        return np.lib.stride_tricks.sliding_window_view(seen, WIDTH * VECTOR, axis=1)[:, :: STRIDE * VECTOR][:, : len(_AT)]

    def pooled(self, chunks: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each chunk, and on request its position."""
        response = np.ascontiguousarray(self.windows(chunks)) @ self.filters
        at = response.argmax(1) if where else None
        top = np.take_along_axis(response, at[:, None, :], 1)[:, 0] if where else response.max(1)
        return np.maximum(top + self.shift, 0), at

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each text of a block."""
        n = n_chunks(np.diff(offsets))
        begin = np.concatenate([[0], np.cumsum(n)])
        texts = len(n)
        if self.share is not None:
            return np.full(texts, self.share)
        total, most = np.zeros((texts, FILTERS), np.float64), np.zeros((texts, FILTERS), np.float32)
        for lo in range(0, int(begin[-1]), ABREAST):
            hi = min(lo + ABREAST, int(begin[-1]))
            h, _ = self.pooled(chunk_bytes(data, offsets, lo, hi, n, begin))
            of = np.searchsorted(begin, np.arange(lo, hi), "right") - 1
            mine, first = np.unique(of, return_index=True)
            total[mine] += np.add.reduceat(h, first, axis=0)
            most[mine] = np.maximum(most[mine], np.maximum.reduceat(h, first, axis=0))
        z = np.concatenate([total / n[:, None], most], 1) @ self.weights.astype(np.float64) + float(self.bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Network:
    """A network fitted to texts given as bytes."""
    net = Network(seed)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        net.share = share
        return net
    net.bias[0] = np.log(share / (1 - share))
    random = np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            n = n_chunks(np.array([len(texts[r]) for r in rows]))
            begin = np.concatenate([[0], np.cumsum(n)])
            chunks = np.concatenate([all_chunks(texts[r]) for r in rows])
            h, at = (np.concatenate(x) for x in zip(*[net.pooled(chunks[k : k + ABREAST], where=True) for k in range(0, len(chunks), ABREAST)], strict=True))
            mean = np.add.reduceat(h, begin[:-1], axis=0) / n[:, None]
            most = np.maximum.reduceat(h, begin[:-1], axis=0)
            pooled = np.concatenate([mean, most], 1)
            z = pooled @ net.weights + net.bias[0]
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)).astype(np.float32)
            of = np.repeat(np.arange(len(rows)), n)
            back = error[:, None] * net.weights
            best = h == most[of]
            best = best / np.maximum(np.add.reduceat(best, begin[:-1], axis=0), 1)[of]
            dh = (back[of, :FILTERS] / n[of][:, None] + back[of, FILTERS:] * best) * (h > 0)
            seen = chunks[np.arange(len(chunks))[:, None, None], _AT[at][:, :, None] + np.arange(WIDTH)]  # chunk, filter, WIDTH bytes
            windows = net.vectors[seen].reshape(len(chunks), FILTERS, -1)
            d_filters = np.einsum("cf,cfw->wf", dh, windows)
            d_seen = (dh[:, :, None] * net.filters.T[None]).reshape(-1, VECTOR)
            d_vectors = np.stack([np.bincount(seen.ravel(), weights=d_seen[:, v], minlength=256) for v in range(VECTOR)], 1)
            grads = [d_vectors, d_filters + DECAY * net.filters, dh.sum(0), pooled.T @ error + DECAY * net.weights, error.sum(keepdims=True)]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def score_udf(model):
    """Arrow UDF: text to score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        net, out = model.value, [np.zeros(0)]
        for _, _, data, offsets in blocks(texts):
            out.append(net.score(data, offsets).astype(np.float64))
        return pa.array(np.concatenate(out))

    return score


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    whole = lambda text: F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = training_rows(df, labels, id_col, text_col, label_col, lambda c: held_out(c, FOLDS, HELD_OUT), sample, whole, SAMPLE_BYTES)
    net = fit([np.frombuffer(r["x"], np.uint8) for r in rows], np.array([float(r["label"] == 1) for r in rows]))
    model = df.sparkSession.sparkContext.broadcast(net)
    scored = df.select(F.col(id_col), held_out(id_col, FOLDS, HELD_OUT).alias("held_out"), score_udf(model)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
