"""Quality rules: fixed base rules, then robust multivariate outliers.

Each text gives base statistics; their ratios, on log scales, make a vector, rounded to
1/GRID. For every (lang, source) group the minimum-covariance-determinant estimate of
centre and scatter is found by concentration steps from three deterministic starts:
medians with median deviations, the scatter of spatial signs, and the half of the rows that
lies nearest to the median. A step averages the share CORE of the rows that lie closest; of
the starts the one with the least determinant is kept after STEPS, made consistent for a
normal core, and reweighted once. A row is rejected if its squared Mahalanobis distance
exceeds CUTOFF, or if a base rule fails.

Scatters are regularised towards TARGET_SD, as small or equal groups have no inverse: with a
weight of TARGET_ROWS rows, and of LEAST_TARGET at least.

All rows of a group take part in its estimate. Equal vectors are counted once as a cell;
medians, cuts and sums are taken over cells, in whole numbers, so that no result depends on
how rows are dealt. Sums are partial, and a hot group is added up where its rows lie. The
models, a row per group, are broadcast if they are at most BROADCAST_GROUPS; beyond, both
sides are salted SALTS ways.

Edge cases: null and empty texts have no word and fail the base rule; a null lang or
source is a group of its own; groups of few or of equal rows lean on the target scatter;
repeated rows count as often as they occur; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import map_rows, slices, texts_of, written

#: Share of a group's rows that its estimate rests on, concentration steps, and the share
#: of a normal group that the reweighting keeps.
CORE = 0.75
STEPS = 4
REWEIGHT = 0.975

#: Squared distance beyond which a row is rejected: the chi-square quantile of four
#: degrees of freedom at about 1 - 1e-9, as the statistics' tails are long.
CUTOFF = 47.0

#: The scatter that groups lean on, and how much.
TARGET_SD = (0.12, 0.30, 0.25, 0.25)
TARGET_ROWS = 30.0
LEAST_TARGET = 0.25

#: Steps of a vector's coordinates in a unit, and of the logarithm of a distance.
GRID = 100
DISTANCE_GRID = 2000

BROADCAST_GROUPS = 10_000
SALTS = 16

DIMS = len(TARGET_SD)
QS = [f"q{i}" for i in range(DIMS)]
CS = [f"c{i}" for i in range(DIMS)]
UPPER = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
BASE = "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_WORD = regex.compile(rb"[^\x20\x09-\x0D]+")
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))


def repeat_words(words: list) -> int:
    """Words in windows of five that occur twice or more in the text."""
    n = len(words)
    if n < 6:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    two = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
    five, counts = np.unique(four[:-1] * n + ids[4:], return_inverse=True, return_counts=True)[1:]
    starts = np.flatnonzero(counts[five] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + 5, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics_of(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    joined = b"".join(words)
    chars = len(joined) - (0 if joined.isascii() else len(joined) - len(joined.translate(None, _CONTINUED)))
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()] if words else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines) of every whole text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            stats = np.array([statistics_of(t) for t in texts_of(b)], np.int64).reshape(-1, 5)
            yield pa.record_batch(
                [b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(np.ascontiguousarray(c)) for c in stats.T)],
                ["doc_id", "lang", "source", *NAMES],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    return map_rows(rows, kernel, f"doc_id long, lang string, source string, n_words long, {BASE}")


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def vectors(stats: DataFrame) -> DataFrame:
    """Adds ``grp`` and ``q0`` to ``q3``: logs of word length, symbol share, repeated lines
    and repeated words, each ratio lifted by what a clean text may have by chance."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    ratios = (chars / words, F.col("n_symbols") / chars + 0.02, F.col("n_dup_lines") / words + 0.02, F.col("n_repeat_words") / words + 0.10)
    return stats.withColumns({"grp": F.to_json(F.struct("lang", "source"))} | {q: F.round(F.log(r) * GRID).cast("int") for q, r in zip(QS, ratios)})


# -- estimates ---------------------------------------------------------------------


def chi_square(x: float, k: int) -> float:
    """The distribution function of chi-square with 2k degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(k):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def quantile_of(share: float) -> float:
    """The chi-square quantile of DIMS degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, DIMS // 2) < share else (low, mid)
    return low


def consistency(share: float) -> float:
    """What the scatter of the closest ``share`` of a normal group must be multiplied by."""
    return share / chi_square(quantile_of(share), DIMS // 2 + 1)


def model_of(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, inverse scatters and log determinants from counts, sums and sums of
    products, one row a group; in units of the grid."""
    target = np.diag(np.square(np.array(TARGET_SD) * GRID))
    m = np.maximum(n, 1)[:, None, None]
    centre = sums / m[:, :, 0]
    scatter = squares / m - centre[:, :, None] * centre[:, None, :]
    lean = np.maximum(TARGET_ROWS / (n + TARGET_ROWS), LEAST_TARGET)[:, None, None]
    scatter = (1 - lean) * consistency(share) * scatter + lean * target
    return centre, np.linalg.inv(scatter), np.linalg.slogdet(scatter)[1]


MODEL = ", ".join(["grp string", "start int", *(f"{c} double" for c in CS), *(f"p{i}{j} double" for i, j in UPPER), "size double"])


def _model_frame(keys: pd.DataFrame, centre: np.ndarray, inverse: np.ndarray, size: np.ndarray) -> pd.DataFrame:
    out = keys.copy()
    for i in range(DIMS):
        out[f"c{i}"] = centre[:, i]
    for i, j in UPPER:
        out[f"p{i}{j}"] = inverse[:, i, j] * (1 if i == j else 2)
    return out.assign(size=size)


def _moments(cells: DataFrame, weight: str = "n") -> DataFrame:
    """(grp, start, n, sums, sums of products), whole numbers."""
    n = F.col(weight).cast("long")
    return cells.groupBy("grp", "start").agg(
        F.sum(n).alias("n"),
        *(F.sum(n * F.col(q)).alias(c) for q, c in zip(QS, CS)),
        *(F.sum(n * F.col(QS[i]) * F.col(QS[j])).alias(f"s{i}{j}") for i, j in UPPER),
    )


def _models(moments: DataFrame, share: float) -> DataFrame:
    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            squares = np.zeros((len(b), DIMS, DIMS))
            for i, j in UPPER:
                squares[:, i, j] = squares[:, j, i] = b[f"s{i}{j}"].to_numpy(float)
            yield _model_frame(b[["grp", "start"]], *model_of(b["n"].to_numpy(float), b[CS].to_numpy(float), squares, share))

    return moments.mapInPandas(invert, MODEL)


def _quantiles(values: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, value): the least ``value`` that ``share`` of the weight ``n`` does not exceed.
    The window holds a row for each value of the grid, not for each document."""
    counts = values.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys)
    cum, total = F.sum("n").over(by.orderBy("value")), F.sum("n").over(by)
    return counts.select(*keys, "value", (cum >= share * total).alias("far")).where("far").groupBy(*keys).agg(F.min("value").alias("value"))


def _per_dim(cells: DataFrame, *columns) -> DataFrame:
    """(grp, dim, value, n) from one column for each coordinate."""
    return cells.select("grp", "n", F.posexplode(F.array(*columns)).alias("dim", "value"))


def _wide(quantiles: DataFrame, name: str) -> DataFrame:
    return quantiles.groupBy("grp").agg(*(F.max(F.when(F.col("dim") == i, F.col("value"))).alias(f"{name}{i}") for i in range(DIMS)))


def starts(cells: DataFrame) -> DataFrame:
    """The first models of every group: 0 medians and deviations, 1 spatial signs; 2 is 0
    again, of which the first step takes the nearest half."""
    medians = written(_wide(_quantiles(_per_dim(cells, *QS), ["grp", "dim"], 0.5), "c"), "quality-medians")
    off = cells.join(medians, "grp")
    spread = _wide(_quantiles(_per_dim(off, *(F.abs(F.col(q) - F.col(c)) for q, c in zip(QS, CS))), ["grp", "dim"], 0.5), "d")
    spread = written(medians.join(spread, "grp"), "quality-spreads")
    off = cells.join(spread, "grp")
    # In parts of a thousand, rounded: whole numbers add up alike in every order.
    z = [(F.col(QS[i]) - F.col(CS[i])) / F.sqrt(F.pow(1.48 * F.col(f"d{i}"), 2) + LEAST_TARGET * (GRID * TARGET_SD[i]) ** 2) for i in range(DIMS)]
    far = F.sqrt(sum(x * x for x in z))
    off = off.select("grp", "n", *(F.when(far > 0, F.round(1000 * x / far)).otherwise(0).cast("long").alias(f"u{i}") for i, x in enumerate(z)))
    signs = off.groupBy("grp").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(f"u{i}") * F.col(f"u{j}")).alias(f"s{i}{j}") for i, j in UPPER))

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sd = np.sqrt(np.square(1.48 * b[[f"d{i}" for i in range(DIMS)]].to_numpy(float)) + LEAST_TARGET * np.square(GRID * np.array(TARGET_SD)))
            sign = np.zeros((len(b), DIMS, DIMS))
            for i, j in UPPER:
                sign[:, i, j] = sign[:, j, i] = b[f"s{i}{j}"].to_numpy(float) / b["n"].to_numpy(float) / 1e6 * DIMS
            even = np.broadcast_to(np.eye(DIMS), sign.shape)
            for start, core in ((0, even), (1, 0.9 * sign + 0.1 * even), (2, even)):
                scatter = sd[:, :, None] * core * sd[:, None, :]
                yield _model_frame(b[["grp"]].assign(start=start), b[CS].to_numpy(float), np.linalg.inv(scatter) if len(b) else scatter, np.zeros(len(b)))

    return spread.join(signs, "grp").mapInPandas(shape, MODEL)


def _distance():
    """Squared distance by a model's centre and inverse scatter (upper triangle)."""
    terms = [F.col(f"p{i}{j}") * (F.col(QS[i]) - F.col(CS[i])) * (F.col(QS[j]) - F.col(CS[j])) for i, j in UPPER]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def models(points: DataFrame) -> DataFrame:
    """One row per grp: the robust centre and inverse scatter."""
    cells = written(points.groupBy("grp", *QS).agg(F.count("*").alias("n")), "quality-cells")
    model = written(starts(cells), "quality-models")
    for step in range(STEPS):
        placed = cells.join(model, "grp").select("grp", "start", *QS, "n", F.round(F.log1p(_distance()) * DISTANCE_GRID).cast("int").alias("value"))
        half = F.col("start") == 2 if step == 0 else F.lit(False)
        cuts = _quantiles(placed.where(~half), ["grp", "start"], CORE)
        if step == 0:
            cuts = cuts.unionAll(_quantiles(placed.where(half), ["grp", "start"], 0.5))
        cuts = written(cuts.withColumnRenamed("value", "cut"), "quality-cuts")
        model = written(_models(_moments(placed.join(cuts, ["grp", "start"]).where("value <= cut")), CORE), "quality-models")
    best = model.groupBy("grp").agg(F.min(F.struct("size", "start"))["start"].alias("start"))
    model = written(model.join(best, ["grp", "start"]), "quality-models")
    near = cells.join(model, "grp").where(_distance() <= quantile_of(REWEIGHT))
    final = written(_models(_moments(near), REWEIGHT), "quality-final")
    # A group of which no row lies near keeps the model it has.
    lone = model.join(final.select("grp"), "grp", "left_anti")
    return written(final.unionByName(lone), "quality-models").drop("start", "size")


def with_distance(points: DataFrame, model: DataFrame) -> DataFrame:
    """``points`` with ``d2``, the squared distance from their group's centre."""
    if model.count() <= BROADCAST_GROUPS:
        placed = points.join(F.broadcast(model), "grp")
    else:
        salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = points.withColumn("salt", F.pmod(F.xxhash64("doc_id", *QS), F.lit(SALTS)).cast("int")).join(salted, ["grp", "salt"])
    return placed.select(*points.columns, _distance().alias("d2"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Every document with its statistics, ``base_failed``, ``d2`` and ``kept``."""
    points = written(vectors(base_statistics(docs)), "quality-statistics")
    placed = with_distance(points, models(points))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return placed.select(
        "doc_id", "lang", "source", *NAMES, "d2", failed.alias("base_failed"), (~failed & (F.col("d2") <= CUTOFF)).alias("kept")
    )
