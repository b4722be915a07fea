"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations.

Words are lower-cased and hashed. A seed is a mask over a few following words that
ignores some of them (``MASKS``), so a hit survives words that were replaced there. The
benchmark's seeds are joined with those of every document; a hit names a document, an
item and how far the item is shifted in it. Each such alignment is then verified word
by word: an item is in a document if, aligned, some WINDOW following words of the item
(all of it, if it has fewer) agree in at least AGREE of them, whatever the others are.

Of WINDOW words with as many replaced as AGREE allows, one mask at least is untouched, so
nothing is missed. Items of fewer words than WINDOW are cut into one part more than words
may be replaced; one part is untouched, and each part is a seed (a run of one to five
words). Such runs are hashed only if the benchmark has items of that kind.

The main path is DataFrame operations only. The benchmark's seeds are broadcast if they
are at most BROADCAST_ROWS rows, which is counted first; beyond, both sides are salted
SALTS ways, so that a seed of a third of all documents is dealt over many tasks. No
document is shuffled before its hits are known; a hit is three numbers, and an item's
words come to it only when the document's own words are cut to that place.

Edge cases: null and empty texts, on either side, match nothing; an item given twice is
found under both ids; rows are told apart by id and text, so repeated rows are each judged
and rows that share an id, or have none, by their own text; empty tables give no hit;
other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import written

#: Fixed masks: the positions that count, from a window's first word.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 7, 8))

#: An alignment is verified on so many following words, and this share must agree.
WINDOW = 13
AGREE = 0.8

#: Rows of benchmark seeds, and of items, that may be broadcast; salts beyond that.
BROADCAST_ROWS = 500_000
BROADCAST_ITEMS = 20_000
SALTS = 16


def words_of(text: str = "text") -> Column:
    """The lower-cased words of a text; null gives none."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+")
    return F.array_remove(parts, "")


def needed_of(n: int) -> int:
    """How many of ``n`` aligned words must agree."""
    return ceil(AGREE * n)


def parts_of(n: int) -> list[tuple[int, int]]:
    """(first word, size) of the parts of an item of ``n`` words: one more than may differ."""
    k = n - needed_of(n) + 1
    edges = [n * i // k for i in range(k + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:])]


def with_key(texts: DataFrame, id_col: str) -> DataFrame:
    """``texts`` with ``key``, a struct of id and text hash that tells unlike rows apart."""
    return texts.withColumn("key", F.struct(F.col(id_col).alias("id"), F.xxhash64("text").alias("h")))


def _windows(hashed: DataFrame, masks: list[tuple[int, ...]], *ids: str) -> DataFrame:
    """(ids, at, seed): every mask at every place of ``w``, the hashed words."""
    span = 1 + max(max(m) for m in masks)
    n = F.greatest(F.size("w"), F.lit(1))
    shifted = F.arrays_zip(*(F.slice("w", k + 1, n).alias(f"w{k}") for k in range(span)))
    windows = hashed.select(*ids, F.posexplode(shifted).alias("at", "s"))
    kinds = []
    for mask in masks:
        # The last word there means all are; a null then tells a window cut short.
        named = F.lit(MASKS.index(mask) if mask in MASKS else -len(mask))
        kinds.append(F.when(F.col(f"s.w{mask[-1]}").isNotNull(), F.xxhash64(named, *(F.col(f"s.w{k}") for k in mask))))
    out = windows.select(*ids, "at", F.explode(F.array(*kinds)).alias("seed"))
    return out.where(F.col("seed").isNotNull())


def hashed_words(texts: DataFrame, *ids: str) -> DataFrame:
    return texts.select(*ids, F.transform(words_of(), lambda w: F.xxhash64(w)).alias("w"))


def seeds(texts: DataFrame, masks: list[tuple[int, ...]], *ids: str) -> DataFrame:
    """(ids, at, seed): every seed of every window of every text."""
    return _windows(hashed_words(texts, *ids), masks, *ids)


def known_seeds(benchmark: DataFrame) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(item_id, item_at, seed) of the benchmark, and the masks that documents need."""
    items = written(hashed_words(benchmark, "item_id").withColumn("n", F.size("w")).where("n > 0"), "benchmark-words")
    # At most one row for each length under WINDOW.
    short = sorted(r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())
    long = items.where(F.col("n") >= WINDOW)
    masks = [] if long.isEmpty() else list(MASKS)
    found = _windows(long, masks, "item_id") if masks else None
    runs: set[int] = set()
    for n in short:
        for first, size in parts_of(n):
            runs.add(size)
            part = F.transform(F.sequence(F.lit(first + 1), F.lit(first + size)), lambda k: F.get("w", k - 1))
            seed = F.xxhash64(F.lit(-size), *(F.get(part, F.lit(k)) for k in range(size)))
            own = items.where(F.col("n") == n).select("item_id", F.lit(first).alias("at"), seed.alias("seed"))
            found = own if found is None else found.unionAll(own)
    masks += [tuple(range(size)) for size in sorted(runs)]
    if found is None:
        found = items.select("item_id", F.lit(0).alias("at"), F.lit(0).cast("long").alias("seed")).limit(0)
    return written(found.select("item_id", F.col("at").alias("item_at"), "seed"), "benchmark-seeds"), masks


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, shift): the alignments of ``docs`` (key, text) that share a seed."""
    known, masks = known_seeds(benchmark)
    own = seeds(docs, masks or [(0,)], "key")
    if known.count() <= BROADCAST_ROWS:
        found = own.join(F.broadcast(known), "seed")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = own.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"])
    return found.select("key", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def verified(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id): the items that each document of ``docs`` (key, text) holds."""
    items = benchmark.select("item_id", words_of().alias("item")).withColumn("n", F.size("item")).where("n > 0")
    items = written(items.distinct(), "benchmark-items")
    small = items.count() <= BROADCAST_ITEMS
    near = F.broadcast if small else (lambda x: x)
    sizes = items.groupBy("item_id").agg(F.max("n").alias("n"))
    found = hits(docs, benchmark).join(near(sizes), "item_id")
    per_doc = found.groupBy("key").agg(F.collect_list(F.struct("item_id", "shift", "n")).alias("found"))
    per_doc = written(per_doc.select(F.col("key").alias("hit"), "found"), "benchmark-hits")
    # A merge join at every size: the hits grow with the input and are not broadcast.
    same = F.col("key").eqNullSafe(F.col("hit"))
    texts = docs.select("key", "text").join(per_doc.hint("merge"), same).select("key", words_of().alias("words"), "found")
    # Words stand below the explode, so that they are cut once a document.
    rows = texts.select("key", "words", F.explode("found").alias("c")).select("key", "c.item_id", "c.shift", F.slice("words", F.greatest(F.col("c.shift"), F.lit(0)) + 1, F.col("c.n")).alias("own"))
    rows = rows.join(near(items), "item_id")
    theirs = F.slice("item", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.col("n"))
    agree = F.array_compact(F.transform(F.zip_with("own", theirs, lambda x, y: x == y), lambda e, k: F.when(e, k)))
    rows = rows.select("key", "item_id", agree.alias("same"), F.least("n", F.lit(WINDOW)).alias("width"))
    # The k-th and the (k + needed - 1)-th agreeing word lie within one window.
    needed = F.ceil(F.lit(AGREE) * F.col("width")).cast("int")
    close = F.zip_with("same", F.slice("same", needed, F.greatest(F.size("same"), F.lit(1))), lambda x, y: y - x < F.col("width"))
    return rows.where(F.exists(close, lambda e: e)).select("key", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, items): for every document, the items that it holds."""
    keyed = with_key(docs.select("doc_id", "text"), "doc_id")
    found = verified(keyed, benchmark).groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = written(found.withColumnRenamed("key", "hit"), "benchmark-found")
    joined = keyed.select("doc_id", "key").join(found.hint("merge"), F.col("key").eqNullSafe(F.col("hit")), "left")
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that hold an item."""
    keyed = with_key(docs.select("doc_id", "text"), "doc_id").select("key", "text")
    gone = written(verified(keyed, benchmark).select(F.col("key").alias("__hit")).distinct(), "contaminated")
    own = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    return docs.join(gone.hint("merge"), own.eqNullSafe(F.col("__hit")), "left_anti")


#: The same rows by brute force in DuckDB's SQL: all alignments that share a word.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM benchmark
), dw AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS at FROM d
), bw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS at FROM b
), same AS (SELECT doc_id, item_id, n, bw.at AS k, dw.at - bw.at AS shift FROM dw JOIN bw USING (w)
), dense AS (SELECT * FROM same QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= {AGREE} * least(n, {WINDOW})
), sums AS (
  SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k RANGE BETWEEN CURRENT ROW AND least({WINDOW}, 99) - 1 FOLLOWING) AS agreed FROM dense
), found AS (SELECT DISTINCT doc_id, item_id FROM sums WHERE agreed >= {AGREE} * least(n, {WINDOW}))
SELECT doc_id, count(item_id) > 0 AS contaminated, coalesce(list_sort(list(item_id) FILTER (WHERE item_id IS NOT NULL)), []) AS items
FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id
"""
