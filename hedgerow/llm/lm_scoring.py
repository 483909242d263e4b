"""Hashed maximum-entropy language model with a class-factored softmax.

``P(token | history) = P(class | history) * P(slot | class, history) * P(token | slot)``

* The class of a token is a hash of its last three bytes, so it needs no table; the end of a text is a class of its own.
* The frequent words of a class have a slot each; the last slot holds all others, whose share in it is their smoothed count.
* Both softmaxes are maximum-entropy models over hashed features: the word before, the pair of classes before, and the skip
  features of the word and the pair of classes one further back. They start from the counted priors, so that a model without
  training is the unigram model.

Training is distributed, in ROUNDS synchronised rounds; a hash of the text says in which round it is learned from. In each, every partition starts from the shared weights and
makes sparse AdaGrad updates over its texts of the round; then the changes meet in a tree of shuffled steps, of FAN_IN partitions at a time. The changes of a row that partitions have seen a few times each add up; those
of a row that each has seen often enough to know its weights by itself are averaged (TRUST). So rare features use the whole corpus. The model still depends on
the split into partitions, less with each round. Word counts cover all training texts and are shuffled by word. What is sent
to every executor is bounded: the weights, and the words with a frequency of at least ``1 / MAX_COMMON`` (at most MAX_COMMON).
The counts of rarer words reach the texts by a join on the word's 64-bit hash, an outer join that adaptive execution can split: a word that only held-out texts
have is not counted and may be frequent there. A class has SLOTS - 1 words with a softmax slot of their own; the others share the last slot by their counts.

Nulls: a null text is an empty one, a null id is the id '' for the split. Repeated rows and ids are scored each, ties alike. Long texts are scored as a whole. An empty
table gives an empty result; without a training text every count is zero. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.common import byte_chunks, crc32_of_id, cut, text_or_empty
from hedgerow.llm.rolling import IS_SPACE, LOWER, HashTable, RangeHash, mixed, word_ranges

CLASSES = 32
SLOTS = 32
WORD_ROWS = 1 << 14
MAX_COMMON = 1 << 20
BATCH = 8192
RATE = 0.12
BOUND = 12.0
BLOCK = 1024
ROUNDS = 2
FAN_IN = 64
#: Visits of a row after which a partition half trusts its own weights.
TRUST = 64.0
#: Bytes of a word that is hashed by XXH64; long words can be made to collide in the polynomial hash.
LONG_WORD = 64
FLOOR = 0.5

_ROWS1 = 2 * WORD_ROWS + 2 * CLASSES * CLASSES
_W1_BUCKETS = 512
_ROWS2 = CLASSES * (_W1_BUCKETS + CLASSES)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token of the texts, the end of each included, and the tokens of each text.

    ``data`` holds the UTF-8 bytes of all texts, ``offsets`` where each begins and the last ends. A word's hash is the mixed
    polynomial of its lower-case bytes modulo 2**64; the end's hash is 0.
    """
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts, ends, words = word_ranges(~IS_SPACE[data], offsets)
    own = RangeHash(data).of(starts, ends) | np.uint64(1)
    sizes = ends - starts
    for i in np.flatnonzero(sizes > LONG_WORD):
        own[i] = np.uint64(xxhash.xxh64_intdigest(LOWER[data[starts[i] : ends[i]]], 11) | 1)
    code = np.zeros(len(own), np.uint32)
    for back in range(1, 4):
        code = code * np.uint32(257) + np.where(sizes >= back, LOWER[data[ends - np.minimum(back, sizes)]], np.uint8(0))
    kind = 1 + (code * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(CLASSES - 1)
    at = np.arange(len(own)) + np.repeat(np.arange(len(words)), words)
    hashes, classes = np.zeros(len(own) + len(words), np.uint64), np.zeros(len(own) + len(words), np.int32)
    hashes[at], classes[at] = own, kind
    return hashes, classes, words + 1


def _shifted(x: np.ndarray, place: np.ndarray, by: int) -> np.ndarray:
    """What stands ``by`` tokens earlier in the same text, or 0."""
    out = np.zeros_like(x)
    out[by:] = x[:-by]
    out[place < by] = 0
    return out


def features_of(hashes: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class model (4 x tokens) and of the slot model (2 x tokens)."""
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(hashes)) - starts
    short = (mixed(hashes, 1) >> np.uint64(40)).astype(np.int32)
    w1, w2 = _shifted(short, place, 1), _shifted(short, place, 2)
    c1, c2, c3 = (_shifted(classes, place, k) for k in (1, 2, 3))
    f1 = np.empty((4, len(hashes)), np.int32)
    f1[0] = w1 & (WORD_ROWS - 1)
    f1[1] = WORD_ROWS + (w2 & (WORD_ROWS - 1))
    f1[2] = 2 * WORD_ROWS + c1 * CLASSES + c2
    f1[3] = 2 * WORD_ROWS + CLASSES * CLASSES + c2 * CLASSES + c3
    f2 = np.empty((2, len(hashes)), np.int32)
    f2[0] = classes * _W1_BUCKETS + (w1 & (_W1_BUCKETS - 1))
    f2[1] = CLASSES * _W1_BUCKETS + classes * CLASSES + c2
    return f1, f2


@dataclass
class Lexicon:
    """What is counted: the common words (hash, count, slot), the smoothed mass of each class's last slot, and the priors."""

    hashes: np.ndarray
    counts: np.ndarray
    slots: np.ndarray
    rest_log: np.ndarray
    prior1: np.ndarray
    prior2: np.ndarray
    n: int
    v: int

    def __post_init__(self) -> None:
        self.look_up = HashTable(self.hashes).look_up

    def slot_of(self, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, self.slots[at], SLOTS - 1) if len(self.slots) else np.full(len(at), SLOTS - 1, np.int8)


@dataclass
class Weights:
    class_rows: np.ndarray
    slot_rows: np.ndarray

    @staticmethod
    def zero() -> Weights:
        return Weights(np.zeros((_ROWS1, CLASSES), np.float32), np.zeros((_ROWS2, SLOTS), np.float32))


def potentials(table: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Sums of weights and log priors, tokens x outcomes. ``prior`` is one row, or one for each token."""
    z = np.take(table, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(table, r, axis=0)
    z += prior
    return z


def log_probability(table: np.ndarray, rows: np.ndarray, prior: np.ndarray, outcome: np.ndarray) -> np.ndarray:
    """Natural-log probability of each token's outcome. The weights are bounded, so nothing overflows."""
    z = potentials(table, rows, prior)
    own = z[np.arange(len(outcome)), outcome]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], np.float32))


class Trainer:
    """Sparse AdaGrad: a token raises the weights of its outcome and lowers those of an outcome drawn from the model.

    The expected step is the gradient of the log-likelihood, and it touches two weights for each feature, not a whole row.
    """

    def __init__(self, start: np.ndarray, seen: float):
        self.table, self.visits = start.copy(), np.zeros(len(start), np.float32)
        self.seen = np.full(start.size, seen, np.float32)
        self.random = np.random.Generator(np.random.PCG64(3))

    def step(self, rows: np.ndarray, prior: np.ndarray, outcome: np.ndarray) -> None:
        z = potentials(self.table, rows, prior)
        np.exp(z, out=z)
        np.cumsum(z, axis=1, out=z)
        drawn = (z < (self.random.random(len(outcome), np.float32) * z[:, -1])[:, None]) @ np.ones(z.shape[1], np.float32)
        drawn = np.minimum(drawn, z.shape[1] - 1).astype(np.int64)
        wide = rows.astype(np.int64) * z.shape[1]
        moved = drawn != outcome
        up, down = (wide + outcome)[:, moved].ravel(), (wide + drawn)[:, moved].ravel()
        np.add.at(self.seen, up, np.float32(1))
        np.add.at(self.seen, down, np.float32(1))
        flat = self.table.reshape(-1)
        np.add.at(flat, up, RATE / np.sqrt(self.seen[up]))
        np.add.at(flat, down, -RATE / np.sqrt(self.seen[down]))

    def visited(self, rows: np.ndarray) -> None:
        self.visits += np.bincount(rows.ravel(), minlength=len(self.visits))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in byte_chunks(batches, "text", 4 << 20):
        hashes, classes, _ = tokens_of(data, offsets)
        found, at, n = np.unique(hashes, return_index=True, return_counts=True)
        yield pa.record_batch({"word": found.view(np.int64), "class": classes[at], "n": n})


def count_words(texts: DataFrame) -> DataFrame:
    """(word, class, c): the count of every distinct token of ``texts``, a column ``text`` without nulls."""
    partial = texts.select("text").mapInArrow(_count, "word long, class int, n long")
    return partial.groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("c"))


def lexicon_of(counts: DataFrame) -> Lexicon:
    """The bounded part of the counts that every executor gets."""
    by_class = {r["class"]: r for r in counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    n, v = sum(r["c"] for r in by_class.values()), sum(r["v"] for r in by_class.values())
    common = counts.where(F.col("c") * MAX_COMMON >= n).toPandas().sort_values(["c", "word"], ascending=[False, True]) if n else pd.DataFrame({"word": [], "class": [], "c": []})
    own = common.groupby("class").cumcount().to_numpy()
    slots = np.where(own < SLOTS - 1, own, SLOTS - 1).astype(np.int8)
    counted = np.zeros((CLASSES, SLOTS))
    classes = common["class"].to_numpy().astype(int)
    np.add.at(counted, (classes, slots), common["c"].to_numpy().astype(float))
    kinds = np.zeros(CLASSES)
    for k, r in by_class.items():
        counted[k, -1] = r["c"] - counted[k, :-1].sum()
        kinds[k] = r["v"] - (slots[classes == k] < SLOTS - 1).sum()
    taken = counted[:, :-1] > 0
    # the last slot also holds one unseen word; slots without a word get no probability worth naming
    rest = counted[:, -1] + FLOOR * (kinds + 1)
    mass = np.where(taken, counted[:, :-1] + FLOOR, 1e-9)
    every = np.concatenate([mass, rest[:, None]], axis=1)
    by_hash = np.argsort(common["word"].to_numpy().astype(np.int64).view(np.uint64))
    return Lexicon(
        common["word"].to_numpy().astype(np.int64).view(np.uint64)[by_hash], common["c"].to_numpy().astype(np.int64)[by_hash], slots[by_hash], np.log(rest),
        np.log(every.sum(axis=1) / every.sum()).astype(np.float32), np.log(every / every.sum(axis=1, keepdims=True)).astype(np.float32), int(n), int(v),
    )


def _parts(n: int) -> Iterator[slice]:
    for i in range(0, n, BATCH):
        yield slice(i, min(n, i + BATCH))


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """The summed changes of a block, and how far the partitions trust their own."""
    trust = changes = 0
    for w, n in zip(rows["changes"], rows["trust"], strict=True):
        own = np.frombuffer(n, np.float32)
        trust = trust + own
        changes = changes + np.frombuffer(w, np.float16 if rows["who"].iloc[0] >= 0 else np.float32).astype(np.float32).reshape(len(own), -1)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "who": [-1], "group": [rows["group"].iloc[0] // FAN_IN], "changes": [changes.tobytes()], "trust": [np.float32(trust).tobytes()]})


def train(texts: DataFrame, lexicon, rounds: int = ROUNDS) -> Weights:
    """Weights learned from ``texts`` (a column ``text`` without nulls); ``lexicon`` is a broadcast Lexicon."""
    spark, out = texts.sparkSession, Weights.zero()
    shape = "block long, who long, group long, changes binary, trust binary"
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(out)
        own = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r)
        found = own.mapInArrow(lambda x, shared=shared, r=r: _updates(x, lexicon.value, shared.value, 1e-3 if r == 0 else 8.0), shape)
        for _ in range(3):  # FAN_IN partitions, blocks of FAN_IN of those, and all of these
            found = found.groupBy("block", "group").applyInPandas(_meet, shape)
        found = found.groupBy("block").applyInPandas(_meet, shape)
        new = Weights(out.class_rows.copy(), out.slot_rows.copy())
        for row in found.select("block", "changes", "trust").collect():
            table = (new.class_rows, new.slot_rows)[row["block"] >> 20]
            b = (row["block"] & 0xFFFFF) * BLOCK
            own = table[b : b + BLOCK]
            own += np.frombuffer(row["changes"], np.float32).reshape(own.shape) / np.maximum(np.frombuffer(row["trust"], np.float32), 1)[:, None]
            np.clip(own, -BOUND, BOUND, out=own)
        out = new
        shared.unpersist()
    return out


def _updates(batches: Iterator[pa.RecordBatch], lex: Lexicon, start: Weights, seen: float) -> Iterator[pa.RecordBatch]:
    """What a partition's texts change in each block of rows that they visit."""
    tables = (start.class_rows, start.slot_rows)
    models = [Trainer(t, seen) for t in tables]
    for _, data, offsets in byte_chunks(batches, "text"):
        hashes, classes, lengths = tokens_of(data, offsets)
        f1, f2 = features_of(hashes, classes, lengths)
        slots = lex.slot_of(*lex.look_up(hashes))
        models[0].visited(f1)
        models[1].visited(f2)
        for s in _parts(len(hashes)):
            models[0].step(f1[:, s], lex.prior1, classes[s])
            models[1].step(f2[:, s], lex.prior2[classes[s]], slots[s])
    who = TaskContext.get().partitionId()
    for kind, (m, t) in enumerate(zip(models, tables, strict=True)):
        for b in range(0, len(t), BLOCK):
            visits = m.visits[b : b + BLOCK]
            if visits.any():
                changes = (m.table[b : b + BLOCK] - t[b : b + BLOCK]).clip(-BOUND, BOUND).astype(np.float16)
                yield pa.record_batch({"block": [kind << 20 | b // BLOCK], "who": [who], "group": [who // FAN_IN], "changes": [changes.tobytes()], "trust": [(visits / (visits + np.float32(TRUST))).tobytes()]})


def _scored(data: np.ndarray, offsets: np.ndarray, lex: Lexicon, weights: Weights) -> tuple[np.ndarray, ...]:
    """For each text: tokens, known common tokens, base and model sums (log10) without the rarer words' counts, and those words."""
    hashes, classes, lengths = tokens_of(data, offsets)
    f1, f2 = features_of(hashes, classes, lengths)
    at, there = lex.look_up(hashes)
    slots = lex.slot_of(at, there)
    own = np.where(there, np.log(lex.counts[at] + FLOOR), 0.0) if len(lex.counts) else np.zeros(len(at))
    model = np.empty(len(hashes))
    for s in _parts(len(hashes)):
        model[s] = log_probability(weights.class_rows, f1[:, s], lex.prior1, classes[s])
        model[s] += log_probability(weights.slot_rows, f2[:, s], lex.prior2[classes[s]], slots[s])
    base = own - np.log(lex.n + FLOOR * (lex.v + 1))
    model += np.where(slots == SLOTS - 1, own - lex.rest_log[classes], 0.0)
    starts = np.cumsum(lengths) - lengths
    sums = [np.add.reduceat(x, starts) for x in (there.astype(np.int64), base / np.log(10), model / np.log(10))]
    return lengths, *sums, hashes[~there], np.add.reduceat((~there).astype(np.int64), starts)


def score(docs: DataFrame, counts: DataFrame, lexicon, weights) -> DataFrame:
    """Scores of ``docs`` (doc_id, held_out, text without nulls); ``lexicon`` and ``weights`` are broadcasts.

    Adds n_tokens, n_known, train_tokens, base_score and score.
    """

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in byte_chunks(batches, "text"):
            n, known, base, model, rare, rares = _scored(data, offsets, lexicon.value, weights.value)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rares)].astype(np.int32)), pa.array(rare.view(np.int64)))
            keys = [xxhash.xxh64_intdigest(data[i:j], seed=7) - (1 << 63) for i, j in itertools.pairwise(offsets)]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "key": keys, "n_tokens": n, "known": known, "base": base, "model": model, "rare": lists})

    id_type = dict(docs.dtypes)["doc_id"]
    own = cut(docs.select("doc_id", "held_out", "text").mapInArrow(partly, f"doc_id {id_type}, held_out boolean, key long, n_tokens long, known long, base double, model double, rare array<long>"), "lm-scored")
    uncommon = counts.where(F.col("c") * MAX_COMMON < F.lit(lexicon.value.n)).select("word", "c")
    # the key is a hash of the text: equal texts share a sum, of which each row then takes its part
    looked = own.select("key", F.explode("rare").alias("word")).join(uncommon, "word", "left")
    sums = looked.groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + FLOOR)).alias("more"), F.count("c").alias("more_known"), F.count("*").alias("times"))
    out = own.withColumn("own_rare", F.size("rare")).drop("rare").join(sums, "key", "left")
    share = F.when(F.col("own_rare") > 0, F.col("own_rare") / F.col("times")).otherwise(0.0)
    more = F.coalesce(F.col("more") * share, F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce(F.round(F.col("more_known") * share), F.lit(0.0))).cast("long").alias("n_known"),
        F.lit(lexicon.value.n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """Train on the texts outside the held fold and score all texts."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), (crc32_of_id(id_col) % folds == held_fold).alias("held_out"), text_or_empty(text_col).alias("text"))
    learned = own.where(~F.col("held_out"))
    counts = cut(count_words(learned), "lm-counts")
    lexicon = spark.sparkContext.broadcast(lexicon_of(counts))
    weights = spark.sparkContext.broadcast(train(learned, lexicon))
    return score(own, counts, lexicon, weights)
