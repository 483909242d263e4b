"""Near-duplicates of a given Jaccard similarity, by wide SimHash fingerprints, vantage-point trees and an exact check.

A text's fingerprint has WORDS * 64 bits over its distinct shingles: the share of differing bits estimates the angle between the
shingle sets, and so their Jaccard similarity, to a few hundredths.

1. Texts with the same shingles are one class.
2. Classes are dealt into shards by bands: shards are balls of radius 0 around a band's value, and a class goes to all that it touches. A band has
   MIN_BAND bits, more for many classes, so that shards stay small; there are as many bands as let a pair of the given similarity
   share one with a probability of RECALL.
3. As each class goes to many shards, they get the first HEAD words of its fingerprint only. In every shard a vantage-point tree (``vantage``) finds the pairs
   that differ there by HEAD_DEVIATIONS standard deviations at most more than a pair of the given similarity has on average. Pairs of as many fewer are
   clear: they are linked, by a spanning forest for each shard. The members of the other pairs are told, if the shard's clear links don't join them; they go to
   their shards again with all WORDS, and the same is done: pairs that differ by up to ``far`` bits (DEVIATIONS more than the average) are looked at, clear ones linked,
   and the members of doubtful ones told.
4. For doubtful pairs between the components of the clear links the exact similarity decides. The members of doubtful pairs go to their shards again, with
   their shingles. A pair belongs to the first shard that both share, and is checked there unless the links found so far in the shard join its members, so
   that a group of n near copies needs about n checks in a shard, not n * n; only links leave a shard. No pair is left out.

Single links make a group. Nulls are empty texts; texts without words are one class. Repeated rows are in one group. Empty tables give empty results.
Long texts are one fingerprint like any other. Extra columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.common import cut, discard, text_chunks
from hedgerow.llm.rolling import mixed
from hedgerow.llm.simhash_dedup import components, smallest_of_each
from hedgerow.llm.vantage import Forest, near_pairs

WORDS = 8
BITS = 64 * WORDS
MIN_BAND = 14
#: Classes that a shard has on average, as a power of two, before bands get wider.
CROWD = 10
RECALL = 0.99
DEVIATIONS = 3
#: Words that shards get first, and the deviations that decide there. Random pairs are five of their own farther.
HEAD = 2
HEAD_DEVIATIONS = 4
ROWS = 64
MAX_BROADCAST = 1_000_000


def shingles_of(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text with fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS numbers of 64 bits, each bit the majority of the shingles' own bits."""
    out = np.zeros(WORDS, np.uint64)
    if not len(hashes):
        return out
    for k in range(WORDS):
        own = mixed(mixed(hashes, 101 + k), 7)
        total = np.zeros(64, np.int64)
        for i in range(0, len(own), 1 << 15):
            total += np.unpackbits(own[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out[k] = np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def _share(similarity: float) -> float:
    """Differing bits of a pair of this Jaccard similarity, on average, as a share."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radii(similarity: float, words: int = WORDS, deviations: int = DEVIATIONS) -> tuple[int, int, int]:
    """Differing bits of so many words up to which a pair is clearly similar, beyond which it clearly is not, and the latter for the first word alone."""
    share, bits = _share(similarity), 64 * words
    deviation = math.sqrt(bits * share * (1 - share))
    first = 64 * share + 5 * math.sqrt(64 * share * (1 - share))
    return max(0, int(bits * share - deviations * deviation)), int(bits * share + deviations * deviation), int(first)


def bands_of(classes: int, similarity: float) -> np.ndarray:
    """The bits of each band, bands x bits; bands take their bits in turn from permutations of all bits."""
    width = max(MIN_BAND, math.ceil(math.log2(max(classes, 2))) - CROWD)
    n = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - _share(similarity)) ** width)) if similarity < 1 else 1
    random = np.random.Generator(np.random.PCG64(17))
    fit = BITS // width
    return np.concatenate([random.permutation(BITS)[: fit * width].reshape(fit, width) for _ in range(-(-n // fit))])[:n]


def band_values(points: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """The value of each band of each point, points x bands."""
    n, width = bands.shape
    bits = np.unpackbits(points.view(np.uint8).reshape(len(points), -1), axis=1, bitorder="little")
    return bits[:, bands.ravel()].reshape(len(points), n, width) @ (1 << np.arange(width))


def _whole_shards(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], size: int, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of about ``size`` rows at a time, and the bits as n x words; a shard is never in two parts. The batches are sorted by shard."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        own = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)
        held.append((*own, np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, words)))
        n += len(batch)
        if n >= size:
            every = tuple(np.concatenate(v) for v in zip(*held, strict=True))
            last = int(np.searchsorted(every[0], every[0][-1]))
            held, n = [tuple(v[last:] for v in every)], n - last
            if last:
                yield tuple(v[:last] for v in every)
    if n:
        yield tuple(np.concatenate(v) for v in zip(*held, strict=True))


_FOUND = "a long, b long, shard long"


def _clear_links(batches: Iterator[pa.RecordBatch], near: int, far: int, first: int, words: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of a spanning forest of each shard's clear links, and (a, shard) of the members of doubtful pairs between its components."""
    for shard, fp, points in _whole_shards(batches, ("shard", "fp"), 1 << 15, words):
        forest, told = Forest(len(fp)), np.zeros(len(fp), bool)
        firsts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        for a, b, d in near_pairs(points, firsts, far, forest, first):
            forest.join(a[d <= near], b[d <= near])
            apart = forest.root[a] != forest.root[b]
            told[a[apart]] = told[b[apart]] = True
        a, b = forest.links()
        who = np.flatnonzero(told)
        yield pa.record_batch({"a": fp[a], "b": fp[b], "shard": pa.nulls(len(a), pa.int64())})
        yield pa.record_batch({"a": fp[who], "b": pa.nulls(len(who), pa.int64()), "shard": shard[who]})


def _checked_links(batches: Iterator[pa.RecordBatch], far: int, similarity: float, bands: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b) of components by the clear links (own) that a pair within ``far`` of the given similarity joins, a forest for each shard.

    Of two members only their first common shard checks the similarity.
    """
    for shard, own, sets, points in _whole_shards(batches, ("shard", "own", "shingles"), 1 << 13, WORDS):
        values, band = band_values(points, bands), shard >> bands.shape[1]
        firsts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        found = []
        for start, stop in zip(firsts[:-1], firsts[1:], strict=True):
            names, label = np.unique(own[start:stop], return_inverse=True)
            forest, earlier = Forest(len(names)), np.arange(len(bands)) < band[start]
            for i in range(0, stop - start, ROWS):
                rows = np.arange(i, min(i + ROWS, stop - start))
                d = np.bitwise_count(points[start + rows, None, :] ^ points[None, start + i : stop, :]).sum(axis=2, dtype=np.int32)
                x, y = np.nonzero(d <= far)
                d, x, y = d[x, y], rows[x], i + y
                apart = (x < y) & (forest.root[label[x]] != forest.root[label[y]])
                d, x, y = d[apart], x[apart], y[apart]
                other = ((values[start + x] == values[start + y]) & earlier).any(axis=1)
                d, x, y = d[~other], x[~other], y[~other]
                for k in np.argsort(d, kind="stable").tolist():
                    la, lb = label[x[k]], label[y[k]]
                    if forest.root[la] != forest.root[lb] and similar(np.frombuffer(sets[start + x[k]], np.uint64), np.frombuffer(sets[start + y[k]], np.uint64), similarity):
                        forest.join(np.array([la]), np.array([lb]))
            a, b = forest.links()
            found.append((names[a], names[b]))
        yield pa.record_batch({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have this Jaccard similarity; those without elements have it."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def groups(rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(row, component) of ``rows`` (row, text without nulls), row being a unique long."""
    near, far, first = radii(similarity)
    head_near, head_far, _ = radii(similarity, HEAD, HEAD_DEVIATIONS)

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text"):
            own = [shingles_of(t, shingle) for t in texts]
            fp = [xxhash.xxh64_intdigest(h) - (1 << 63) for h in own]
            yield pa.record_batch({"row": part.column("row"), "fp": fp, "bits": [wide_fingerprint(h).tobytes() for h in own]})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text"):
            own = [shingles_of(t, shingle) for t in texts]
            yield pa.record_batch({"fp": part.column("fp"), "shingles": [h.tobytes() for h in own], "bits": [wide_fingerprint(h).tobytes() for h in own]})

    own = cut(rows.select("row", "text").mapInArrow(fingerprinted, "row long, fp long, bits binary"), "wide")
    names = cut(own.groupBy("fp").agg(F.min("row").alias("name"), F.first("bits").alias("bits")), "wide-classes")
    bands = bands_of(names.count(), similarity)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, width = bands.shape
        for batch in batches:
            points = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(batch), WORDS)
            shards = band_values(points, bands) + (np.arange(n) << width)
            at = pa.array(np.repeat(np.arange(len(batch)), n))
            heads = pa.array([x.tobytes() for x in points[:, :HEAD]], pa.binary())
            yield pa.record_batch({"shard": shards.ravel().astype(np.int64), "fp": batch.column("fp").take(at), "bits": heads.take(at)})

    shards = names.select("fp", "bits").mapInArrow(banded, "shard long, fp long, bits binary")
    heads = cut(shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda x: _clear_links(x, head_near, head_far, first, HEAD), _FOUND), "wide-heads")
    again = heads.where(F.col("shard").isNotNull()).select("shard", F.col("a").alias("fp")).join(names.select("fp", "bits"), "fp").select("shard", "fp", "bits")
    found = cut(again.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda x: _clear_links(x, near, far, first, WORDS), _FOUND), "wide-links")
    plain = names.select("fp", "name")
    clear = components(heads.unionAll(found).where(F.col("b").isNotNull()).select("a", "b").distinct(), plain)
    last = cut(plain.join(clear, "fp", "left").select("fp", F.coalesce("component", "name").alias("own")), "wide-groups")
    # the members of doubtful pairs, with their component by the clear links
    told = cut(found.where(F.col("shard").isNotNull()).select("shard", F.col("a").alias("fp")).join(last, "fp"), "wide-doubtful")
    several = told.groupBy("shard").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least <> most").select("shard")
    left = cut(told.join(several, "shard", "left_semi"), "wide-doubtful")
    discard(heads, found, told)
    wanted = left.select("fp").distinct().join(plain, "fp")
    if wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    shingles = cut(rows.join(wanted, F.col("row") == F.col("name")).select("fp", "text").mapInArrow(sets, "fp long, shingles binary, bits binary"), "wide-shingles")
    members = left.join(shingles, "fp").select("shard", "own", "shingles", "bits").repartition("shard").sortWithinPartitions("shard")
    good = members.mapInArrow(lambda x: _checked_links(x, far, similarity, bands), "a long, b long")
    names_left = left.select(F.col("own").alias("fp"), F.col("own").alias("name")).distinct()
    met = cut(components(good, names_left).select(F.col("fp").alias("own"), "component"), "wide-met")
    return own.select("row", "fp").join(last, "fp").join(met, "own", "left").select("row", F.coalesce("component", "own").alias("component"))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group the row with the smallest id, as it is; of rows with that id one. Null ids come last."""
    return smallest_of_each(docs, lambda rows: groups(rows, similarity, shingle), id_col, text_col)
