"""Toxicity by multiple-instance learning.

Only documents have labels, but sentences offend. A sentence's probability is a
logistic function of its hashed words; a document's is the noisy-or of its sentences,
``1 - prod(1 - p)``. The weights are fitted to document labels through the noisy-or, so
they find out which sentences of a toxic document made it so; ``spans`` names them.

The fit uses SAMPLE_ROWS labelled ids at most, chosen by a hash of the id, and of those
the whole texts. Scores are computed on every whole text, of the
probabilities above that of a sentence without evidence: such a sentence adds nothing,
however many a text has.

Edge cases: a null or empty text has no sentence, and so the score 0; without any
labelled row, or with labels of one kind only, every score is 0 or 1 as the labels
say (0 if there are none); rows whose label or id is null are not learned from; an id
labelled or given several times is learned from once; every row is scored by its own text;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import map_rows, slices, texts_of, written

#: Bits of the hashed vocabulary.
BITS = 18

#: Labelled ids that a fit uses, at most.
SAMPLE_ROWS = 6_000

#: The bias, or its negative, where all labels are of one kind.
SURE = 40.0

#: Passes over the sample; the weight of the squared weights; a word counts only if so
#: many of the sample's documents hold it.
EPOCHS = 60
RIDGE = 1e-5
LEAST_DOCS = 12

#: Lengths of the word beginnings that count beside the words.
PREFIXES = (4, 5)

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")

#: Words whose slot a worker remembers.
_CACHE = 500_000


def sentences(text: str) -> list[tuple[int, int]]:
    """Where each sentence with a word begins and ends, in characters."""
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(m[0])]


class Slots(dict):
    """word -> slots of the hashed vocabulary: the word's own and those of its first
    PREFIXES letters, which inflected and compound forms share."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _CACHE:
            self.clear()
        keys = [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]
        slots = self[word] = tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for k in keys)
        return slots

    def of(self, sentence: str) -> list[int]:
        """The distinct slots of a sentence, ascending."""
        return sorted({x for w in set(_WORD.findall(sentence.lower())) for x in self[w]})


def sample(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` of the labelled ids, by a hash: (id, y). An id that is labelled
    more than once counts once, with its greatest label. A share a little smaller than
    ``rows`` is drawn where the labels lie, so nothing is sorted."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    ids = known.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = ids.count()
    share = int(0.97 * rows / n * 1_000_000_000) if n > rows else 1_000_000_000
    return ids.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000_000)) < share).limit(rows)


def bags(docs: DataFrame, labelled: DataFrame) -> list:
    """The sample's sentences as slots. ``labelled`` is bounded, so it is broadcast and
    ``docs`` is not shuffled; of rows with one id the text least in order of bytes counts,
    so what comes to the driver is bounded by the ids."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for b in slices(batches):
            ys, words, sizes = [], [], []
            for y, text in zip(b.column("y").to_pylist(), texts_of(b)):
                own = [slots.of(text[s:e]) for s, e in sentences(text)]
                if any(own):
                    ys.append(y)
                    words.append(np.array([x for o in own for x in o], np.int32).tobytes())
                    sizes.append(np.fromiter(map(len, own), np.int32, len(own)).tobytes())
            yield pa.record_batch([pa.array(ys, pa.int32()), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], ["y", "words", "sizes"])

    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(written(labelled, "toxic-sample")), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")
    found = map_rows(rows, kernel, "y int, words binary, sizes binary").toArrow()
    return [dict(zip(found.column_names, x)) for x in zip(*(c.to_pylist() for c in found.columns))]


def fit(rows: list, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights by slot, bias) from rows of (y, words, sizes)."""
    weights = np.zeros(1 << BITS, np.float32)
    y = np.array([r["y"] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return weights, SURE if len(y) and y[0] > 0 else -SURE
    held = np.zeros(1 << BITS, np.int32)
    for r in rows:
        held[np.unique(np.frombuffer(r["words"], np.int32))] += 1
    used = np.flatnonzero(held >= LEAST_DOCS)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    column = place[np.concatenate([np.frombuffer(r["words"], np.int32) for r in rows])]
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in rows])
    per_doc = np.array([len(r["sizes"]) // 4 for r in rows])
    n, bag_starts = len(sizes), np.cumsum(per_doc) - per_doc
    sentence = np.repeat(np.arange(n, dtype=np.int32), sizes)[column >= 0]
    column = column[column >= 0]
    w, rate = np.zeros(len(used)), y.mean()
    bias = np.log(rate / per_doc.mean())
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    label, mass = np.repeat(y, per_doc), len(y)
    for step in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, w[column], n) + bias, -30, 30)))
        clear = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), bag_starts)  # log of "no sentence offends"
        q = np.exp(clear)
        pull = np.where(label > 0, -np.repeat(q / np.maximum(1 - q, 1e-6), per_doc), 1.0) * p
        slope = np.r_[np.bincount(column, pull[sentence], len(w)) / mass + RIDGE * w, pull.sum() / mass]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        w = np.maximum(w - move[:-1], 0)  # a harmless word doesn't excuse its sentence
        bias -= move[-1]
    weights[used] = w
    return weights, float(bias)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans): the noisy-or of each whole text, and the sentences of a
    probability of 0.5 or more with where they begin and end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for b in slices(batches):
            scores, spans = zip(*(score_of(t, *shared.value, slots) for t in texts_of(b)))
            yield pa.record_batch([b.column("id"), pa.array(scores, pa.float64()), pa.array(spans, SPANS)], ["id", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, kernel, "id long, score double, spans array<struct<start:int,stop:int,p:double>>").withColumnRenamed("id", id_col)


def score_of(text: str, weights: np.ndarray, bias: float, slots: Slots) -> tuple[float, list[dict]]:
    """Score of a text, and its offending sentences."""
    at = sentences(text)
    if not at:
        return 0.0, []
    own = [slots.of(text[s:e]) for s, e in at]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    words = np.fromiter((x for o in own for x in o), np.int64, int(sizes.sum()))
    z = np.add.reduceat(weights[words].astype(np.float64), np.cumsum(sizes) - sizes) + bias
    p = 1 / (1 + np.exp(-np.clip(z, -SURE, SURE)))
    if bias < SURE:
        none = 1 / (1 + np.exp(-np.clip(bias, -SURE, SURE)))
        p = np.maximum(p - none, 0) / (1 - none)  # what its words add
    score = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
    return score, [{"start": at[k][0], "stop": at[k][1], "p": float(p[k])} for k in np.flatnonzero(p >= 0.5)]


def keep_below(docs: DataFrame, model: tuple[np.ndarray, float], most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores less than ``most``; rows pass
    through where they are, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for b in slices(batches):
            clean = [score_of(t, *shared.value, slots)[0] < most for t in texts_of(b)]
            yield b.filter(pa.array(clean, pa.bool_()))

    return map_rows(docs, kernel, docs.schema)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))


def held_out(id_col: str = "doc_id"):
    """Whether a document's label must not be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    return fit(bags(docs, sample(labels.where(~held_out()), "toxic")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, spans) of every document, learned from the labels that are not
    held out."""
    return score(docs, train(docs, labels))
