"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments (22, 21, 21 bits). Of at most three
differing bits, two segments have at most one each (pigeonhole). The binary Golay code
of length 23 is perfect: each segment, padded with zeros, has one codeword at distance
3 or less, and where that is 3, five more at distance 4. If two segments differ in one
bit at most, the nearest codeword of one is among those of the other. So a fingerprint
is filed under each pair of segments and each pair of nearby codeword indices (at most
3 x 36 keys of 26 bits), and fingerprints under one key are verified by their distance.

Documents with one fingerprint are one class before any key is made, so copies never
meet in a task. Under a key each fingerprint is linked to the least of its connected
group: every pair of linked fingerprints ends up connected, and a dense group becomes as
many rows as it has members. Long runs of a key compare only what agrees in a part.

Edge cases: a null or empty text, or one of white space alone, has fingerprint zero
and is linked like any other; fewer words than a shingle has make one shingle; repeated
rows have one class; a null id is linked like any other and never names a component, which
is null only if no row of it has an id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import map_rows, slices, texts_of, written
from quirelake.llm.components import components

#: Fixed value: the seed of the shingle hash.
SEED = 42

#: Fixed value: the Golay code's generator polynomial, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011

#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

#: Fingerprints of a key that are still compared as all their pairs at once, and beyond
#: which only those are that have an equal part of so many bits of their two segments.
SMALL_RUN = 5
LONG_RUN = 256
PART = 15


# -- fingerprints --------------------------------------------------------------


def shingle_hashes(text: str, width: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is set if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp LONG): the fingerprint of each whole text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint_of(shingle_hashes(t, width)) for t in texts_of(b)], np.uint64)
            yield pa.record_batch([b.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, kernel, "id long, fp long").withColumnRenamed("id", id_col)


# -- the code ------------------------------------------------------------------


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


@lru_cache(maxsize=1)
def cosets() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns that lead to a codeword at distance 3 or
    less (first) and 4 (up to five), and how many there are."""
    patterns = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << k for k in c) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(syndromes(errors), errors):
            patterns[s, count[s]] = e
            count[s] += 1
    return patterns, count


def near_codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords near each 23-bit word: (n, 6) and how many."""
    patterns, count = cosets()
    s = syndromes(segment)
    return (segment[:, None] ^ patterns[s]) >> 11, count[s]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of every key of unsigned 64-bit fingerprints."""
    near = [near_codewords((fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)) for at, width in SEGMENTS]
    rows, keys = [], []
    six = np.arange(6)
    for tag, (a, b) in enumerate(combinations(range(3), 2)):
        (x, nx), (y, ny) = near[a], near[b]
        key = (tag << 24) | (x[:, :, None] << 12) | y[:, None, :]
        there = (six[None, :, None] < nx[:, None, None]) & (six[None, None, :] < ny[:, None, None])
        rows.append(np.nonzero(there)[0])
        keys.append(key[there])
    return np.concatenate(rows), np.concatenate(keys)


# -- links ---------------------------------------------------------------------


def tree_links(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """For distinct fingerprints, ascending, the groups that differences of ``most`` bits
    or fewer connect: (least of the group, other member), one link a member."""
    left, out = fps.copy(), []
    while len(left):
        root, frontier, left = int(left[0]), [left[0]], left[1:]
        while frontier and len(left):
            close = np.bitwise_count(left ^ frontier.pop()) <= most
            if close.any():
                found, left = left[close], left[~close]
                out += [(root, x) for x in found.tolist()]
                frontier.extend(found)
    return out


def long_run_links(fps: np.ndarray, tag: int, most: int) -> list[tuple[int, int]]:
    """Links of a long run: what meets under a pair of segments differs in two bits of
    them at most, so one of three parts of the pair is equal, and only fingerprints with
    an equal part are compared. Unlike fingerprints that fill a key cost no square."""
    (a, na), (b, nb) = (SEGMENTS[k] for k in tuple(combinations(range(3), 2))[tag])
    mask = lambda n: np.uint64((1 << n) - 1)
    pair = (fps >> np.uint64(a) & mask(na)) | (fps >> np.uint64(b) & mask(nb)) << np.uint64(na)
    out = set()
    for at in range(0, na + nb, PART):
        part = pair >> np.uint64(at) & mask(PART)
        order = np.argsort(part, kind="stable")  # keeps the fingerprints ascending in a part
        cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if e - s > 1:
                out.update(tree_links(fps[order[s:e]], most))
    return list(out)


def run_links(keys: np.ndarray, fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links inside the runs of equal keys, fewer than the members; the keys are sorted."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[starts, len(keys)])
    run = np.repeat(np.arange(len(starts)), size)
    small = (size <= SMALL_RUN)[run]
    hit = np.zeros(len(starts), np.int64)
    single: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(1, min(SMALL_RUN, len(keys))):
        same = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        close = same[np.bitwise_count(fps[same] ^ fps[same + d]) <= most]
        hit += np.bincount(run[close], minlength=len(starts))
        single.append((run[close], fps[close], fps[close + d]))
    out: list[tuple[int, int]] = []
    for r, a, b in single:
        alone = hit[r] == 1
        out += zip(a[alone].tolist(), b[alone].tolist())
    for k in np.flatnonzero((hit > 1) | (size > SMALL_RUN)).tolist():
        own = np.unique(fps[starts[k] : starts[k] + size[k]])
        if len(own) <= LONG_RUN:
            out += tree_links(own, most)
        else:
            out += long_run_links(own, int(keys[starts[k]]) >> 24, most)
    return out


def links_of(classes: DataFrame, most: int = 3) -> DataFrame:
    """(fp_u, fp_v): links that connect all fingerprints at ``most`` bits or fewer."""
    if most > 3:
        raise ValueError("the keys find at most 3 differing bits")

    def file_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                fps = batch.column("fp").to_numpy()[at : at + 1000]
                row, key = keys_of(fps.view(np.uint64))
                yield pa.record_batch([pa.array(key.astype(np.int32)), pa.array(fps[row])], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int32), np.zeros(0, np.uint64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[tuple[int, int]] = set()

        def out(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            fresh = [x for x in {(min(x), max(x)) for x in run_links(k, f, most)} if x not in seen]
            if len(seen) > 200_000:
                seen.clear()
            seen.update(fresh)
            if fresh:
                pairs = np.array(fresh, np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["fp_u", "fp_v"])

        for b in batches:
            if not b.num_rows:
                continue
            k, f = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            waiting.append((k, f))
            if k[0] == k[-1] and (len(waiting) == 1 or waiting[-2][0][-1] == k[0]):
                continue  # a long run: wait for its end
            keys, fps = (np.concatenate(x) for x in zip(*waiting))
            cut = np.searchsorted(keys, keys[-1])
            yield from out(keys[:cut], fps[:cut])
            waiting = [(keys[cut:], fps[cut:])]
        if waiting:
            keys, fps = (np.concatenate(x) for x in zip(*waiting))
            yield from out(keys, fps)

    filed = map_rows(classes.select("fp"), file_keys, "key int, fp long")
    parts = max(8, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = filed.repartition(parts, "key").sortWithinPartitions("key")
    return map_rows(dealt, verify, "fp_u long, fp_v long").distinct()


def near_duplicates(
    docs: DataFrame, width: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp LONG, component_id): every row with the smallest id that links reach."""
    marked = written(fingerprints(docs, width, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprint-classes")
    roots = components(links_of(classes, most).select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v")))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    grouped = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(grouped, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_of(fp: str):
    """16 lowercase hex digits of a LONG column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
