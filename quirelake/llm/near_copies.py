"""Near copies of whole texts: SimHash candidates and their complement, verified exactly.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity
of 0.8 or more. Candidates are

- what ``simhash`` links: fingerprints over the same shingles, three differing bits or
  fewer, by Golay-code keys;
- what shares a band of min-hashes. At a similarity of 0.8 two fingerprints differ in some
  ten bits, so the keys alone find only the closest copies; a band is shared with a
  probability of 1 - (1 - 0.8^6)^32 = 0.99994.

Texts of one shingle set are one class first, so exact copies never meet. Then

1. each class is verified against one leader, the least class that it shares a band with,
   and against what its fingerprint is linked to: at most two rows a class;
2. classes that are linked so far are one group, and only bands that still hold several
   groups are left. There all classes of different groups are compared, in blocks of at
   most BLOCK classes, and those that connect groups are linked: fewer than the classes.

No band, leader or group is held whole by a task: a leader's followers are dealt in parts
of BLOCK, and a large band in pairs of blocks. Links are exact counts; of connected texts
one row stays: that of the smallest id.

Edge cases: null and empty texts and those of white space alone have the empty set and are
copies of each other; a text of fewer words than a shingle has is one shingle; rows are
told apart by their place, not by their id, so repeated rows, shared ids and null ids are
each judged by their text (an id beats a null; of rows with one id any one stays); an empty
table stays empty; all columns pass through, but for those named ``__copy_...``, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import map_rows, release, slices, texts_of, written
from quirelake.llm.components import components
from quirelake.llm.simhash import SEED, fingerprint_of, links_of, shingle_hashes

#: Near copies share 4/5 of their shingles of so many words.
WIDTH = 5

#: Bands of the min-hashes and min-hashes in each.
BANDS, BAND_ROWS = 32, 6

#: Classes that a task compares at a time.
BLOCK = 256

#: Odd factors, each of which orders the hashes in another way.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# -- sets ------------------------------------------------------------------------


def bands_of(shingles: np.ndarray) -> list[int]:
    """A signed key for each band of a set's min-hashes; none for the empty set."""
    if not len(shingles):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, np.multiply.outer(FACTORS, shingles[at : at + 512]).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def alike(common: int, a: int, b: int) -> bool:
    """Whether sets of ``a`` and ``b`` members, ``common`` shared, are near copies."""
    return 9 * common >= 4 * (a + b)


def block_links(groups: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions) between near copies of different groups that connect all groups
    that any such pair connects."""
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    there = np.zeros(len(flat) + 1, bool)
    group = np.unique(np.array(groups), return_inverse=True)[1]
    out = []
    for f in range(len(sets)):
        if (group == group[0]).all():
            break
        own = flat[starts[f] : starts[f] + size[f]]
        there[own] = True
        common = np.add.reduceat(there[flat], starts, dtype=np.int64)
        there[own] = False
        for x in np.flatnonzero((9 * common >= 4 * (size[f] + size)) & (group != group[f])).tolist():
            if group[x] != group[f]:
                out.append((f, x))
                group[group == group[x]] = group[f]
    return out


# -- over tables -----------------------------------------------------------------


def mark(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__copy_row`` (unique), ``__copy_code`` (of the shingle set),
    ``__copy_fp`` and ``__copy_bands``."""
    rows = docs.drop("__copy_row", "__copy_code", "__copy_fp", "__copy_bands").withColumn("__copy_row", F.monotonically_increasing_id())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            codes, fps, bands = [], [], []
            for t in texts_of(b, text_col):
                hashes = shingle_hashes(t, WIDTH)
                own = np.unique(hashes)
                codes.append(xxhash.xxh128_digest(own.tobytes(), SEED))
                fps.append(fingerprint_of(hashes))
                bands.append(bands_of(own))
            new = [pa.array(codes, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "__copy_code", "__copy_fp", "__copy_bands"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return written(map_rows(rows, kernel, f"{fields}, __copy_code binary, __copy_fp long, __copy_bands array<long>"), "copy-marks")


def _parts(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, shingles) of the classes in ``nodes`` (id)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, WIDTH)).tobytes() for t in texts_of(b)]
            yield pa.record_batch([b.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    # A merge join at every size: candidates grow with the input and are not broadcast.
    return written(map_rows(texts.join(nodes.hint("merge"), "id", "left_semi"), cut, "id long, shingles binary"), "copy-sets")


def followers(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): the candidates of step 1; v is a leader, and less than u."""
    least = shared.groupBy("band").agg(F.min("id").alias("v"))
    led = shared.join(least, "band").where("id <> v").groupBy(F.col("id").alias("u")).agg(F.min("v").alias("v"))
    kinds = written(classes.groupBy("fp").agg(F.min("id").alias("v")), "copy-fingerprints")
    same = classes.join(kinds, "fp").where("id <> v").select(F.col("id").alias("u"), "v")
    side = lambda end, to: kinds.select(F.col("fp").alias(end), F.col("v").alias(to))
    near = links_of(kinds).join(side("fp_u", "a"), "fp_u").join(side("fp_v", "b"), "fp_v")
    near = near.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return led.unionAll(same).unionAll(near).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): the ``pairs`` that are near copies. A leader's followers come in parts of
    about BLOCK, each with the leader's set in front."""
    parts = pairs.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    dealt = pairs.join(parts, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("n")).cast("int").alias("part"))
    heads = parts.select(F.col("v").alias("u"), "v", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    rows = dealt.unionAll(heads).join(sets.withColumnRenamed("id", "u"), "u")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for b in batches:
            found = []
            for u, v, x in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), b.column("shingles")):
                other = np.frombuffer(x.as_py(), np.uint64)
                if u == v:
                    leader, own = v, other
                    continue
                assert leader == v, "a leader stands before its followers"
                if 5 * min(len(own), len(other)) >= 4 * max(len(own), len(other)) and alike(len(np.intersect1d(own, other, True)), len(own), len(other)):
                    found.append((u, v))
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])

    grouped = rows.repartition(_parts(pairs), "v", "part").sortWithinPartitions("v", "part", F.col("u") != F.col("v"))
    return map_rows(grouped.select("u", "v", "shingles"), kernel, "u long, v long")


def open_blocks(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(block, id, grp): the members of bands that hold several groups, in blocks such that
    each two members of different groups meet in one; bands of equal members count once."""
    own = shared.join(groups, shared.id == groups.node, "left").select("band", "id", F.coalesce("root", "id").alias("grp"))
    own = written(own, "copy-bands")
    bands = own.groupBy("band").agg(F.count("*").alias("n"), F.min("grp").alias("a"), F.max("grp").alias("z"), F.bit_xor(F.xxhash64("id")).alias("mark"))
    bands = written(bands.where("a < z").groupBy("n", "mark").agg(F.min("band").alias("band")).select("band", "n"), "copy-open")
    held = own.join(bands, "band")
    large = held.where(F.col("n") > BLOCK)
    sizes = large.groupBy("band", "grp").agg(F.count("*").alias("own"))
    large = large.join(sizes, ["band", "grp"])
    # A group above the block size has blocks of its own; the others share mixed blocks.
    pure = F.col("own") > BLOCK
    salt = F.when(pure, F.pmod(F.xxhash64("id"), F.ceil(F.col("own") / BLOCK))).otherwise(F.pmod(F.xxhash64("grp"), F.ceil(2 * F.col("n") / BLOCK)))
    large = large.select("band", "id", "grp", F.when(pure, F.col("grp")).alias("of"), salt.alias("salt"))
    large = written(large.withColumn("side", F.xxhash64("of", "salt")), "copy-large")
    sides = large.groupBy("band", "side").agg(F.first("of").alias("of"))
    left, right = (sides.select("band", F.col("side").alias(f"side_{x}"), F.col("of").alias(f"of_{x}")) for x in "ab")
    met = left.join(right, "band").where("side_a <= side_b and not coalesce(of_a = of_b, false)")
    met = written(met.select("band", "side_a", "side_b"), "copy-met")
    ends = met.select("band", F.col("side_a").alias("side"), "side_a", "side_b").unionAll(
        met.where("side_a <> side_b").select("band", F.col("side_b").alias("side"), "side_a", "side_b")
    )
    whole = held.where(F.col("n") <= BLOCK).select(F.xxhash64("band").alias("block"), "id", "grp")
    return whole.unionAll(large.join(ends, ["band", "side"]).select(F.xxhash64("band", "side_a", "side_b").alias("block"), "id", "grp"))


def connecting(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): groups that near copies in a block connect."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, groups, members = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            found = [(groups[a], groups[b]) for a, b in block_links(groups, members)] if len(members) > 1 else []
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])

        for b in batches:
            for k, g, x in zip(b.column("block").to_pylist(), b.column("grp").to_pylist(), b.column("shingles")):
                if k != block:
                    yield from out()
                    block, groups, members = k, [], []
                groups.append(g)
                members.append(np.frombuffer(x.as_py(), np.uint64))
        yield from out()

    rows = blocks.join(sets, "id").select("block", "grp", "shingles")
    return map_rows(rows.repartition(_parts(blocks), "block").sortWithinPartitions("block"), kernel, "u long, v long")


def copy_groups(marked: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, grp), written: the classes of shingle sets, near copies under one number."""
    least = marked.groupBy(F.col("__copy_code").alias("code")).agg(
        F.min("__copy_row").alias("id"), F.first("__copy_fp").alias("fp"), F.first("__copy_bands").alias("bands")
    )
    classes = written(least, "copy-classes")
    keys = classes.select("id", F.explode("bands").alias("band"))
    several = keys.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("band")
    shared = written(keys.join(several, "band", "left_semi"), "copy-shared")
    pairs = written(followers(shared, classes.where(F.size("bands") > 0)), "copy-pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("id")).unionAll(shared.select("id")).distinct()
    sets = _sets(marked.select(F.col("__copy_row").alias("id"), F.col(text_col).alias("text")), nodes)
    first = components(verified(pairs, sets))
    links = written(connecting(open_blocks(shared, first), sets), "copy-links")
    release(shared, pairs, sets)
    second = components(links).select(F.col("node").alias("first_grp"), "root")
    grouped = classes.join(first.withColumnRenamed("root", "first_root"), classes.id == F.col("node"), "left")
    grouped = grouped.select("code", F.coalesce("first_root", "id").alias("first_grp")).join(second, "first_grp", "left")
    grouped = written(grouped.select("code", F.coalesce("root", "first_grp").alias("grp")), "copy-groups")
    release(classes)
    return grouped


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with ``__copy_row``, ``__copy_group`` and ``__copy_kept``: of
    each group the row of the smallest id is kept."""
    marked = mark(docs, text_col)
    groups = copy_groups(marked, text_col)
    grouped = groups.withColumnRenamed("code", "__copy_code")
    place = F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), F.col("__copy_row").alias("row"))
    told = written(marked.select("__copy_row", "__copy_code", place.alias("place")).join(grouped, "__copy_code"), "copy-told")
    release(groups)
    firsts = told.groupBy("grp").agg(F.min("place")["row"].alias("first"))
    gone = told.join(firsts, "grp").select(F.col("__copy_row").alias("row"), F.col("grp").alias("__copy_group"), (F.col("__copy_row") == F.col("first")).alias("__copy_kept"))
    # A merge join at every size: one side has a row for each text.
    gone = written(gone, "copy-rows")
    release(told)
    found = marked.join(gone.hint("merge"), marked["__copy_row"] == F.col("row"))
    return found.drop("row", "__copy_code", "__copy_fp", "__copy_bands")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of each group one row stays."""
    return near_copies(docs, id_col, text_col).where("__copy_kept").drop("__copy_row", "__copy_group", "__copy_kept")
