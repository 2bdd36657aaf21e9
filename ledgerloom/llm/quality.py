"""Quality rules: base counts, and a logistic regression on hashed word and character n-grams with calibrated probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, LOWER, SPACED, _ODD, blocks, materialize, mix, per_text, small_batches, span_hashes, table_of, text_columns, window_hashes, words

#: Labelled rows of each class that the model is fitted on at most: those with the smallest hashed ids.
SAMPLE_ROWS = 1500
#: Buckets for character 3-grams, words and word pairs, each.
BUCKETS = 2048
#: A document is kept if its calibrated probability of good quality is at least this.
KEEP = 0.5
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
_SYMBOLS = table_of(*b"#*$%&|<>")
_NEWLINE = table_of(10)
_KINDS = 3


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The base rules' counts of each text (see `score_quality`)."""
    n = len(at) - 1
    starts, ends, doc = words(data, at, SPACED)
    inside = SPACED[data]
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": per_text(inside & ((data & 0xC0) != 0x80), at), "n_symbols": per_text(_SYMBOLS[data], at)}
    line_starts, line_ends, line_doc = words(data, at, ~_NEWLINE)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    real = filled[line_ends] > filled[line_starts]
    keys = span_hashes(data, line_starts[real], line_ends[real]) ^ mix(line_doc[real].astype(np.uint64) + _ODD)
    own, first = line_doc[real], np.unique(keys, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(own, minlength=n) - np.bincount(own[first], minlength=n)
    h = span_hashes(data, starts, ends)
    w = window_hashes(h, REPEAT_WINDOW)
    within = doc[: len(w)] == doc[REPEAT_WINDOW - 1 :] if len(w) else np.zeros(0, bool)
    place = np.flatnonzero(within)
    keys = w[place] ^ mix(doc[place].astype(np.uint64) + _ODD)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    repeated = np.zeros(n, np.int64)
    if len(twice):
        hit = place[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + REPEAT_WINDOW, -1)
        repeated = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    out["n_repeat_words"] = repeated
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * out["n_words"])
    return out


def _grams(data: np.ndarray, at: np.ndarray):
    """(bucket of each n-gram, its text) for each kind of n-gram."""
    low = LOWER[data].astype(np.uint32)
    if len(low) >= 3:
        code = (low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        fits = owner[:-2] == owner[2:]
        yield (code >> np.uint32(21)).astype(np.int64)[fits], owner[:-2][fits]
    else:
        yield np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, doc = words(data, at, SPACED)
    h = span_hashes(data, starts, ends, BYTE_VALUES[LOWER])
    yield (h >> np.uint64(53)).astype(np.int64) + BUCKETS, doc
    pairs = window_hashes(h, 2)
    fits = doc[: len(pairs)] == doc[1 : len(pairs) + 1] if len(pairs) else np.zeros(0, bool)
    yield (pairs[fits] >> np.uint64(53)).astype(np.int64) + 2 * BUCKETS, doc[: len(pairs)][fits]


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of each bucket among the n-grams of its kind; one row a text."""
    n = len(at) - 1
    out = np.zeros((n, _KINDS * BUCKETS), np.float32)
    for bucket, doc in _grams(data, at):
        total = np.maximum(1, np.bincount(doc, minlength=n))
        counts = np.bincount(doc * (_KINDS * BUCKETS) + bucket, minlength=n * _KINDS * BUCKETS).reshape(n, -1)
        out += counts / total[:, None]
    return out


class Classifier:
    """Weights over bucket shares, and a logistic curve fitted on rows that the weights have not seen."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean weight of each kind's n-grams, without building features."""
        n = len(at) - 1
        logit = np.full(n, self.bias)
        for bucket, doc in _grams(data, at):
            logit += np.bincount(doc, self.weights[bucket], minlength=n) / np.maximum(1, np.bincount(doc, minlength=n))
        return _logistic(self.slope * logit + self.shift)


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Classifier:
    """Fits on at most `rows` labelled documents of each class; every fifth of them only calibrates.

    Rows without a label, text or id are not learned from; with one class alone every probability is that class's.
    """
    small_batches(documents)
    docs = text_columns(documents, doc_id=doc_id, text=text).where("doc_id is not null and text is not null")
    known = text_columns(labels, doc_id=doc_id, label=label).where("doc_id is not null and label is not null")
    order = F.xxhash64("doc_id")
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(order, "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    picked = materialize(picked)

    def make(batches):
        for batch in batches:
            for piece, data, at in blocks(batch, "text"):
                for i in range(0, piece.num_rows, 64):
                    stop = min(piece.num_rows, i + 64)
                    x = features(data[at[i] : at[stop]], at[i : stop + 1] - at[i]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([piece.column(0).slice(i, stop - i), piece.column(2).slice(i, stop - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    sample = docs.join(picked, "doc_id").select("doc_id", "text", "label").mapInArrow(make, "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "x"])  # 2 * rows of 12 kB
    if not len(sample):
        return Classifier(np.zeros(_KINDS * BUCKETS), 0.0, 1.0, 0.0)
    x = np.stack([np.frombuffer(r, np.float16) for r in sample["x"]]).astype(np.float32)
    y = sample["label"].to_numpy().astype(np.float32)
    if y.min() == y.max():
        return Classifier(np.zeros(_KINDS * BUCKETS), 0.0, 0.0, 20.0 * (2 * float(y[0]) - 1))
    held = np.arange(len(y)) % 5 == 0
    scale = np.sqrt((x[~held] ** 2).mean(axis=0)) + 1e-3
    weights, bias = _train(x[~held] / scale, y[~held])
    weights = weights / scale
    logit = x[held] @ weights + bias if held.any() and len(set(y[held])) == 2 else x @ weights + bias
    slope, shift = _calibrate(logit, y[held] if len(logit) == held.sum() else y)
    return Classifier(weights.astype(np.float64), float(bias), slope, shift)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _train(x: np.ndarray, y: np.ndarray, steps: int = 150, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Class-balanced logistic loss by Adam on all rows at once."""
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, steps + 1):
        error = (_logistic(x @ w + b) - y) * share
        g = np.append(error.astype(np.float32) @ x + decay * w, error.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def _calibrate(logit: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's curve by Newton steps, with his smoothed targets and equal class weights."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t, share = np.where(y == 1, high, low), np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    z = np.stack([logit, np.ones_like(logit)], 1).astype(np.float64)
    a = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _logistic(z @ a)
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (share * (p - t)))
        a = a - np.clip(step, -2, 2)
    return float(a[0]), float(a[1])


def score_quality(documents: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """Base counts of every whole text and the model's verdict.

    n_words (runs without ASCII white space), word_chars (code points in them), n_symbols, n_dup_lines (lines with a word
    that equal an earlier line), n_repeat_words (words in 8-word windows found twice or more), base_failed, kept (false
    if base_failed, else probability >= keep), probability.  Lines, words and windows are compared by 64-bit hashes within
    a text.  Null texts count as empty and fail; rows are independent, so ties and repeated rows need no order; an empty
    table gives an empty result.
    """
    small_batches(documents)
    docs = text_columns(documents, doc_id=doc_id, text=text)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches):
        for batch in batches:
            for piece, data, at in blocks(batch, "text"):
                base = base_counts(data, at)
                p = shared.value.probability(data, at)
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(base[x], pa.int64()) for x in names), pa.array(base["base_failed"]), pa.array(~base["base_failed"] & (p >= keep)), pa.array(p)], names=["doc_id", *names, "base_failed", "kept", "probability"])

    return docs.mapInArrow(score, "doc_id long, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean, probability double")


