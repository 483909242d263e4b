"""FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed features: words, the stems of longer words (their first four, five and seven characters,
so that rare compounds share a weight), bigrams, and skip-grams over one word. Words are lower-cased (A-Z) and stripped of the
punctuation around them. FTRL-proximal has a rate for each coordinate and an L1 penalty that leaves most weights at zero;
the weights that remain are a table of at most ``2**BITS`` entries, which is what is broadcast.

The model is fitted on at most ``max_fit`` labelled texts (a documented bound; those with the smallest hash of the id),
in one task; ``passes`` orders are drawn from a fixed seed. Scores are then shifted and scaled by a logistic calibration on
the last part of the same rows (every fifth), which the first fit leaves out.

Nulls: a null text is an empty one, and an empty text gets the score of the bias. A label that is null counts as no label.
Repeated ids are scored each; a document with several labels is fitted once for each. Without two kinds of labels every
score is the share of toxic labels (0.5 without any). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.common import byte_chunks, crc32_of_id, text_or_empty
from hedgerow.llm.rolling import IS_SPACE, RangeHash, mixed, word_ranges

BITS = 20
STEMS = (4, 5, 7)
MAX_FIT = 12_000
PASSES = 3
ALPHA = 0.3
BETA = 1.0
L1 = 4.0
L2 = 0.5

#: Punctuation and symbols that don't belong to a word.
_EDGE = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()[]{}<>|*#$%&+=~^_-/\\`@", np.uint8))


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs of (text, feature) as two arrays."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts, ends, words = word_ranges(~(IS_SPACE | _EDGE)[data], offsets)
    hashed = RangeHash(data)
    text = np.repeat(np.arange(len(words)), words)
    whole = hashed.of(starts, ends)
    kinds = [(text, mixed(whole, 1))]
    letter = (data & 0xC0) != 0x80  # the first byte of each character
    place = np.r_[0, np.cumsum(letter)]
    letters = np.r_[np.flatnonzero(letter), len(data)]
    for size in STEMS:
        longer = place[ends] - place[starts] > size
        at = starts[longer]
        kinds.append((text[longer], mixed(hashed.of(at, letters[place[at] + size]), size + 8)))
    for apart in (1, 2):
        same = text[apart:] == text[:-apart]
        pair = mixed(mixed(whole[:-apart], apart) + whole[apart:], apart + 2)
        kinds.append((text[apart:][same], pair[same]))
    rows = np.concatenate([k[0] for k in kinds]).astype(np.int64)
    codes = np.concatenate([k[1] for k in kinds]) >> np.uint64(64 - BITS)
    both = rows << BITS | codes.astype(np.int64)
    both.sort()
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return both >> BITS, both & ((1 << BITS) - 1)


def _by_text(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    rows, codes = features_of(data, offsets)
    return np.split(codes.astype(np.int32), np.searchsorted(rows, np.arange(1, len(offsets) - 1)))


@dataclass
class Model:
    """The weights that are not zero, by sorted feature, and the calibrated bias and scale."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.codes] = self.weights
        return out


class Ftrl:
    """FTRL-proximal; the state of a coordinate is its z and n."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        penalty = np.where(i == 1 << BITS, 0.0, L1)  # the bias is not penalised
        return np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, codes: np.ndarray, label: int) -> None:
        i = np.append(codes, 1 << BITS)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def _calibrated(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Bias and scale of a logistic fit, by damped Newton steps from (0, 1)."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))
        r, q = p - labels, p * (1 - p)
        g = np.array([(r * raw).sum() + 0.5 * (a - 1), r.sum()])
        h = np.array([[(q * raw * raw).sum() + 0.5, (q * raw).sum()], [(q * raw).sum(), q.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -1, 1)
    return float(b), float(max(a, 0.05))


def fit(texts: list[np.ndarray], labels: np.ndarray, passes: int = PASSES) -> Model:
    """A model from the features of the texts and their labels."""
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), float(np.log(share / (1 - share))), 1.0)
    random = np.random.Generator(np.random.PCG64(5))
    held = np.arange(len(labels)) % 5 == 4
    if min(labels[held].sum(), (1 - labels[held]).sum()) < 3:
        held[:] = False

    def learned(rows: np.ndarray) -> Ftrl:
        own = Ftrl()
        for _ in range(passes):
            for k in random.permutation(rows):
                own.learn(texts[k], int(labels[k]))
        return own

    bias, scale = 0.0, 1.0
    if held.any():
        first = learned(np.flatnonzero(~held))
        w = first.weights(np.arange((1 << BITS) + 1))
        bias, scale = _calibrated(np.array([w[texts[k]].sum() + w[-1] for k in np.flatnonzero(held)]), labels[held])
    w = learned(np.arange(len(labels))).weights(np.arange((1 << BITS) + 1))
    codes = np.flatnonzero(w[:-1])
    return Model(codes, (w[codes] * scale).astype(np.float32), float(w[-1] * scale + bias), scale)


def fit_labelled(docs: DataFrame, marks: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """A model from the texts of ``docs`` (doc_id, text without nulls) with a mark (doc_id, label 0 or 1).

    At most ``max_fit`` marks are chosen, before any text is read; of a repeated id the smallest text counts.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    n = marks.count()
    if n > max_fit:  # about a quarter more than needed, so that the sort is over few rows
        marks = marks.where(order.bitwiseAND(0xFFFFFF) < int(1 + (1 << 24) * 1.25 * max_fit / n))
    chosen = marks.distinct().orderBy(order, "doc_id", "label").limit(max_fit)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def own(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(["order", "label"])
        table = pa.record_batch({"text": pa.array(parts["text"].tolist(), pa.string())})
        texts = [x for _, d, o in byte_chunks(iter([table]), "text") for x in _by_text(d, o)]
        m = fit(texts, parts["label"].to_numpy())
        return pd.DataFrame({"codes": [m.codes.tolist()], "weights": [m.weights.tolist()], "bias": [m.bias], "scale": [m.scale]})

    found = rows.select(F.lit(0).alias("k"), order.alias("order"), "text", "label").groupBy("k").applyInPandas(own, "codes array<long>, weights array<float>, bias double, scale double").collect()
    if not found:
        return fit([], np.empty(0, int))
    r = found[0]
    return Model(np.array(r["codes"], np.int64), np.array(r["weights"], np.float32), r["bias"], r["scale"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) to the id and the held_out column of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = m.dense()
        for part, data, offsets in byte_chunks(batches, "text"):
            rows, codes = features_of(data, offsets)
            z = np.bincount(rows, weights[codes], minlength=len(part)) + m.bias
            yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": 1 / (1 + np.exp(-np.clip(z, -35, 35)))})

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "held_out", "text").mapInArrow(own, f"doc_id {id_type}, held_out boolean, score double")


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, max_fit: int = MAX_FIT) -> DataFrame:
    """Fit on the labelled documents outside the held fold, and score all documents."""
    own = docs.select("doc_id", (crc32_of_id() % folds == held_fold).alias("held_out"), text_or_empty().alias("text"))
    marks = labels.where(F.col("toxic").isNotNull() & (crc32_of_id() % folds != held_fold)).select("doc_id", (F.col("toxic") > 0).cast("int").alias("label"))
    model = fit_labelled(own.select("doc_id", "text"), marks, max_fit)
    return score(own, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
