"""SimHash near-duplicates, found with vantage-point trees.

1. A text's fingerprint has a bit where over half of its shingles' XXH64 hashes have it (Arrow batches, numpy).
2. Texts with the same fingerprint are one class, represented by its smallest id: exact copies are never compared.
3. The distinct fingerprints are dealt into shards. Two fingerprints within ``radius`` bits agree in at least one of
   ``radius + 1`` blocks of bits, so a shard is a block and its value: Hamming distance zero in that block. Each fingerprint
   goes to every shard it touches, which makes the boundaries overlap. A shard with over ``LEAF`` members is dealt again on
   the bits that its block leaves over, as often as needed; all of its members then agree in more bits, so the parts shrink.
4. In every shard a vantage-point tree finds the near pairs (``vantage``): a node splits the others at the median distance from its vantage
   point, and of the pairs across the middle only those in the overlap that the triangle inequality leaves are compared. A shard gives
   the links of a spanning forest of its near pairs, so that a group of n copies has fewer than n links.
5. Components come from the links, up to ONE_TASK of them in one task, more by rounds of label propagation with pointer jumping over shuffled tables, cut in the
   shared folder; no links, fingerprints or components are collected on the driver.

Nulls: a null text is an empty one; texts without words have fingerprint zero and are linked like any others. Rows with a
null id are returned without a component unless ids share the class. Repeated rows share a component. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.common import cut, discard, text_chunks, text_or_empty
from hedgerow.llm.vantage import Forest, near_pairs

SHINGLE = 4
RADIUS = 4
LEAF = 2048
SEED = 42
#: Links that one task joins; more are joined by label propagation.
ONE_TASK = 1_000_000
#: Blocks of 64 row numbers that are broadcast as bits; more kept rows are joined by a shuffle.
MAX_BLOCKS = 500_000

_LANES = (1 << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text, given as UTF-8."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, t in enumerate(texts):
        words = t.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
        if len(words) <= shingle:
            hashes.append(digest(joined, SEED))
            sizes[k] = 1
            continue
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
        sizes[k] = len(starts)
    out = np.zeros(len(texts), np.uint64)
    all_hashes = np.fromiter(hashes, np.uint64, len(hashes))
    full = np.flatnonzero(sizes)
    # one pass for each text: bits of 8-byte little-endian rows, summed in columns
    at = np.cumsum(sizes) - sizes
    for k in full:
        own = all_hashes[at[k] : at[k] + sizes[k]]
        total = np.zeros(64, np.int64)
        for i in range(0, len(own), 1 << 16):
            bits = np.unpackbits(own[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.uint32)
        out[k] = _LANES[total * 2 > sizes[k]].sum(dtype=np.uint64)
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of ``docs`` (doc_id, text without nulls); fp is the signed 64-bit pattern."""
    id_type = dict(docs.dtypes)["doc_id"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text"):
            yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": fingerprints(texts, shingle).view(np.int64)})

    return docs.select("doc_id", "text").mapInArrow(own, f"doc_id {id_type}, fp long")


def _shard_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the shards in a sorted partition; a shard that goes on in the next batch waits for it."""
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def found(path: np.ndarray, value: np.ndarray, fp: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        new = np.r_[True, (path[1:] != path[:-1]) | (value[1:] != value[:-1])] if len(path) else np.empty(0, bool)
        firsts = np.flatnonzero(new)
        stop = len(fp) if last or not len(firsts) else firsts[-1]
        waiting[:] = [(path[stop:], value[stop:], fp[stop:])]
        if stop:
            forest = Forest(stop)
            for a, b, _ in near_pairs(fp[:stop, None], firsts[firsts < stop], radius, forest):
                forest.join(a, b)
            a, b = forest.links()
            yield pa.record_batch({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    for batch in batches:
        own = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "value", "fp"))
        waiting.append((own[0], own[1], own[2].view(np.uint64)))
        if sum(len(w[2]) for w in waiting) >= 1 << 16:
            yield from found(*(np.concatenate(x) for x in zip(*waiting, strict=True)), last=False)
    if waiting:
        yield from found(*(np.concatenate(x) for x in zip(*waiting, strict=True)), last=True)


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def _picked(bits: list[int]) -> Column:
    """The value of these bits of fp."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(mask - (1 << 64) if mask >> 63 else mask)


def links_of(distinct: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``distinct`` (fp) that join all pairs within ``radius``."""
    # A shard is told by the blocks that were chosen so far (path, its digits in the base radius + 2) and the values there.
    base = radius + 2
    todo = [(distinct.select("fp", F.lit(0).cast("long").alias("value")), list(range(64)), 0)]
    done: list[DataFrame] = []
    while todo:
        members, bits, path = todo.pop()
        blocks = _blocks(bits, radius + 1)
        names = [path * base + k + 1 for k in range(len(blocks))]
        own = [F.struct(F.lit(n).cast("long").alias("path"), F.col("value").bitwiseOR(_picked(b)).alias("value")) for n, b in zip(names, blocks, strict=True)]
        dealt = members.select("fp", F.explode(F.array(*own)).alias("x")).select("fp", "x.path", "x.value")
        again: list[int] = []
        if len(bits) - max(map(len, blocks)) > radius:
            crowded = cut(dealt.groupBy("path", "value").agg(F.count("*").alias("n")).where(F.col("n") > leaf), "crowded")
            again = [r["path"] for r in crowded.select("path").distinct().collect()]  # radius + 1 at most
        if not again:
            done.append(dealt)
            continue
        marked = dealt.join(crowded.select("path", "value", F.lit(True).alias("again")), ["path", "value"], "left")
        done.append(marked.where(F.col("again").isNull()).select("fp", "path", "value"))
        for n, b in zip(names, blocks, strict=True):
            if n in again:
                part = marked.where(F.col("again") & (F.col("path") == n)).select("fp", "value")
                todo.append((cut(part, "crowded-shards"), [x for x in bits if x not in b], n))
    shards = functools.reduce(DataFrame.unionByName, done)
    return shards.repartition("path", "value").sortWithinPartitions("path", "value").mapInArrow(lambda x: _shard_links(x, radius), "a long, b long")


def components(links: DataFrame, names: DataFrame) -> DataFrame:
    """(fp, component): the smallest name reachable from each fingerprint. ``names`` has fp and name, one row for each fp.

    Up to ONE_TASK links are joined in one task. More take rounds of label propagation over shuffled tables: every round
    gives each linked fingerprint the smallest label around it, and then the label of its label's holder.
    """
    links = cut(links.distinct(), "links")
    if links.limit(ONE_TASK + 1).count() <= ONE_TASK:
        roots = cut(links.coalesce(1).mapInArrow(_rooted, "fp long, root long"), "roots")
        named = roots.join(names.select("fp", "name"), "fp")
        return roots.join(named.groupBy("root").agg(F.min("name").alias("component")), "root").select("fp", "component")
    return _propagated(links, names)


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, root) of every fingerprint of the links, root being a fingerprint of its component."""
    every = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if every:
        a, b = (np.concatenate(x) for x in zip(*every, strict=True))
        found, at = np.unique(np.r_[a, b], return_inverse=True)
        forest = Forest(len(found))
        forest.join(at[: len(a)], at[len(a) :])
        yield pa.record_batch({"fp": found, "root": found[forest.root]})


def _propagated(links: DataFrame, names: DataFrame) -> DataFrame:
    """``components`` by label propagation."""
    both = cut(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(names.select("fp", "name", F.col("name").alias("label")).join(both.select(F.col("a").alias("fp")).distinct(), "fp", "left_semi"), "labels")
    while True:
        around = both.join(labels.select(F.col("fp").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(around, F.col("fp") == F.col("a"), "left").select("fp", "name", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = step.alias("s").join(step.select(F.col("name").alias("label"), F.col("label").alias("beyond")).alias("t"), "label", "left")
        new = cut(jumped.select("fp", "name", "old", F.least("label", "beyond").alias("label")), "labels")
        done = new.where(F.col("old") != F.col("label")).isEmpty()
        discard(labels)
        labels = new
        if done:
            discard(both)
            return labels.select("fp", F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    own = cut(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), shingle), "fingerprints")
    names = cut(own.groupBy("fp").agg(F.min("doc_id").alias("name")), "classes")
    linked = components(links_of(names.select("fp"), radius), names.where(F.col("name").isNotNull()))
    classes = names.join(linked, "fp", "left").select("fp", F.coalesce("component", "name").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(classes, "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Of each component the row with the smallest id, as it is; of rows with that id one. Null ids come last."""
    return smallest_of_each(docs, lambda rows: near_duplicates(rows, "row", "text", shingle, radius).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), id_col, text_col)


def smallest_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """Of each group the row with the smallest id; ``grouped`` gives (row, component) of (row, text). A row's columns are kept apart, so no name clashes.

    The kept rows are told by a bit each, 64 numbers to a block, so that texts aren't shuffled.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = cut(packed, "numbered")  # a row's number stands once it is written
    found = grouped(rows.select("row", text_or_empty("doc", text_col).alias("text")))
    own = rows.select("row", F.col("doc").getField(id_col).alias("id")).join(found, "row")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    kept = own.groupBy("component").agg(first.alias("x")).select("x.row")
    block, bit = F.shiftright("row", 6), F.col("row").bitwiseAND(63).cast("int")
    bits = cut(kept.groupBy(block.alias("block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")), "kept")
    if bits.limit(MAX_BLOCKS + 1).count() > MAX_BLOCKS:
        every = F.explode(F.sequence(F.lit(0), F.lit(63)))
        kept = bits.select("block", "bits", every.alias("bit")).where("getbit(bits, bit) = 1").select((F.col("block") * 64 + F.col("bit")).alias("row"))
        return rows.join(kept, "row", "left_semi").select("doc.*")
    found = rows.withColumn("block", block).join(F.broadcast(bits), "block")
    return found.where(F.getbit("bits", bit) == 1).select("doc.*")
