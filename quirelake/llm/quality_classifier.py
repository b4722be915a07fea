"""Quality classifier without labels: weak labellers, EM, a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on each text. How often each
pattern of votes occurs is counted over all documents (3 to the power of the number of
labellers at most). Expectation-maximisation on those counts estimates, for good texts and
for each of as many kinds of bad texts as there are labellers, their share and each
labeller's accuracy; bad texts have kinds, as what makes one bad seldom meets in another.
A pattern's posterior of "good" is the label of its documents, from which a logistic scorer
on hashed features is trained; it sees the words and their shapes, not the votes.

Every text is read once, for its votes and its features. The EM counts every document. The
scorer is fitted on SAMPLE_ROWS documents at most, chosen by a hash of id and features; of
each of them all features count.

Edge cases: a null or empty text draws the vote of the length labeller alone and gets a
score like any other; an empty table gives an empty result; repeated rows count as
often as they occur; null and shared ids are no matter; other columns are ignored.
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

#: Bits of the hashed features, documents of a fit (at most), passes, rounds.
BITS = 16
SAMPLE_ROWS = 8_000
EPOCHS = 40
EM_ROUNDS = 60

#: Frequent function words of the four languages.
COMMON = frozenset(
    "the of and to in a is that it for on was with as be by this are at from or an not but which he they have"
    " der die und das den von zu ist mit sich auf für im nicht ein eine dem des auch es an als"
    " le la les de des et un une du en que qui dans est pour pas sur par plus au"
    " el los las y una por con para del se su al lo como más es no".split()
)

_SYMBOLS = re.compile(r"[#*$%&|<>]")


# -- labellers -----------------------------------------------------------------


def _bands(x: float, bad_below: float, good_from: float) -> int:
    return -1 if x < bad_below else 1 if x >= good_from else 0


def votes_of(text: str) -> tuple[int, ...]:
    """The votes: 1 good, -1 bad, 0 none."""
    words = text.split()
    n = len(words)
    if not n:
        return (-1, 0, 0, 0, 0, 0, 0)
    chars = sum(map(len, words))
    letters = sum(map(str.isalpha, words))
    upper = sum(map(str.isupper, words))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    ended = sum(x.rstrip()[-1] in ".!?\"'»" for x in lines)
    known = sum(w.lower().strip(".,;:!?") in COMMON for w in words)
    return (
        -1 if n < 5 else 1,
        1 if 3 <= chars / n <= 10 else -1,
        -_bands(len(_SYMBOLS.findall(text)) / chars, 0.01, 0.05),
        -_bands(upper / n, 0.2, 0.5) if n >= 5 else 0,
        _bands(pairs / (n - 1), 0.5, 0.8) if n >= 20 else 0,
        _bands(ended / len(lines), 0.3, 0.7),
        _bands(known / n, 0.02, 0.08) if n >= 20 and letters else 0,
    )


LABELLERS = ("length", "word_length", "symbols", "capitals", "variety", "endings", "common_words")


def pattern_of(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = 3 * code + v + 1
    return code


# -- expectation-maximisation ---------------------------------------------------


def expectation_maximisation(counts: dict[int, int], rounds: int = EM_ROUNDS) -> dict:
    """Posterior of "good" by pattern, the share of good texts, and by labeller the
    chance that a vote it gives is "good", for bad and for good texts. A vote not given
    says nothing. Class 0 is good and begins with the texts that no labeller condemns;
    class j begins with those that labeller j condemns."""
    k = len(LABELLERS)
    codes = np.array(sorted(counts), np.int64)
    if not len(codes):
        return {"posterior": {}, "share": 0.5, "votes": np.full((k, 2), 0.5)}
    n = np.array([counts[c] for c in codes.tolist()], float)
    votes = np.stack([codes // 3 ** (k - 1 - j) % 3 - 1 for j in range(k)], axis=1)
    yes, no = votes > 0, votes < 0
    bad = no.sum(axis=1, keepdims=True)
    kind = np.hstack([np.where(bad > 0, 0.1, 0.9), np.where(bad > 0, 0.9 * no / np.maximum(bad, 1), 0.1 / k)])
    for _ in range(rounds):
        weight = n[:, None] * kind
        share = weight.sum(axis=0) + 0.5
        share /= share.sum()
        good_votes, bad_votes = weight.T @ yes + 0.5, weight.T @ no + 0.5
        table = good_votes / (good_votes + bad_votes)
        like = np.log(share) + yes @ np.log(table).T + no @ np.log(1 - table).T
        kind = np.exp(like - like.max(axis=1, keepdims=True))
        kind /= kind.sum(axis=1, keepdims=True)
    good = kind[:, 0]
    weight = n * (1 - good)
    said = (weight @ yes + 0.5) / (weight @ yes + weight @ no + 1)
    return {"posterior": dict(zip(codes.tolist(), good.tolist())), "share": float(share[0]), "votes": np.stack([said, table[0]], axis=1)}


# -- the scorer ------------------------------------------------------------------


class Features(dict):
    """word -> hashed slots of its shape, its last letters and whether it is common."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        core = word.strip(".,;:!?\"'()")
        low = core.lower()
        shape = "A" if core.isupper() and len(core) > 1 else "a" if core.isalpha() else "0" if core.isalnum() else "-" if not core else "#"
        keys = ("s" + shape, "l" + str(min(len(core), 20)), "w" + low if low in COMMON else "e" + low[-3:], "p" + word[len(word.rstrip(".,;:!?*#$%&")) :][:2])
        slots = self[word] = tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for k in keys)
        return slots


def features_of(text: str, known: Features) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: shares of the words that have a feature, and of word pairs
    that came before (as the two last slots)."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    slots, counts = np.unique(np.fromiter((x for w in words for x in known[w]), np.int64, 4 * n), return_counts=True)
    again = 1 - len(set(zip(words, words[1:]))) / max(n - 1, 1)
    short = 1.0 if n < 5 else 0.0
    values = np.r_[np.sqrt(counts / n), again, short].astype(np.float32)
    return np.r_[slots, 1 << BITS, (1 << BITS) + 1].astype(np.int32), values


WIDTH = (1 << BITS) + 2


def fit_scorer(rows: list, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic scorer of soft labels, from (y, slots, values)."""
    w, bias = np.zeros(WIDTH), 0.0
    if not rows:
        return w.astype(np.float32), bias
    y = np.array([r["y"] for r in rows], float)
    slots = [np.frombuffer(r["slots"], np.int32) for r in rows]
    sizes = np.array([len(s) for s in slots])
    slots, values = np.concatenate(slots), np.concatenate([np.frombuffer(r["vals"], np.float32) for r in rows]).astype(float)
    owner = np.repeat(np.arange(len(y)), sizes)
    used, column = np.unique(slots, return_inverse=True)
    u = np.zeros(len(used))
    m, v = np.zeros(len(u) + 1), np.zeros(len(u) + 1)
    for step in range(1, epochs + 1):
        z = np.bincount(owner, u[column] * values, len(y)) + bias
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.r_[np.bincount(column, gap[owner] * values, len(u)) / len(y) + 1e-5 * u, gap.mean()]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        u, bias = u - move[:-1], bias - move[-1]
    w[used] = u
    return w.astype(np.float32), float(bias)


# -- over tables -------------------------------------------------------------------


def read(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, slots, vals) of every document."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for b in slices(batches):
            texts = texts_of(b)
            codes = [pattern_of(votes_of(t)) for t in texts]
            slots, values = zip(*(features_of(t, known) for t in texts)) if texts else ((), ())
            columns = [pa.array(codes, pa.int32()), pa.array([x.tobytes() for x in slots], pa.binary()), pa.array([x.tobytes() for x in values], pa.binary())]
            yield pa.record_batch([b.column("doc_id"), *columns], ["doc_id", "pattern", "slots", "vals"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), kernel, "doc_id long, pattern int, slots binary, vals binary")


def training_rows(features: DataFrame, n: int, posterior: dict[int, float]) -> list:
    """Soft labels and features of SAMPLE_ROWS of the ``n`` documents at most. A share a
    little smaller than that is drawn where the rows lie; nothing is sorted or gathered
    but what is drawn, and a row that is repeated very often can't exceed the bound."""
    share = int(min(1.0, 0.97 * SAMPLE_ROWS / max(n, 1)) * 1_000_000_000) if n > SAMPLE_ROWS else 1_000_000_000
    drawn = F.pmod(F.xxhash64("doc_id", "slots", F.lit("quality")), F.lit(1_000_000_000)) < share
    some = features.where((F.length("slots") > 0) & drawn).select("pattern", "slots", "vals").limit(SAMPLE_ROWS).collect()
    return sorted(({"y": posterior[r.pattern], "slots": r.slots, "vals": r.vals} for r in some), key=lambda r: (r["slots"], r["vals"]))


def quality_classifier(docs: DataFrame) -> DataFrame:
    """(doc_id, posterior, score, kept) of every document: the label model's posterior,
    the scorer's probability of "good", and whether that is 0.5 or more."""
    features = written(read(docs), "quality-features")
    counts = {r.pattern: r.n for r in features.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior = expectation_maximisation(counts)["posterior"]
    shared = docs.sparkSession.sparkContext.broadcast((posterior, fit_scorer(training_rows(features, sum(counts.values()), posterior))))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, (weights, bias) = shared.value
        for b in batches:
            z = []
            for slots, values in zip(b.column("slots"), b.column("vals")):
                own = np.frombuffer(slots.as_py(), np.int32)
                z.append(float(weights[own] @ np.frombuffer(values.as_py(), np.float32)) + bias if len(own) else -30.0)
            scores = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
            own = [posterior[p] for p in b.column("pattern").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(own, pa.float64()), pa.array(scores, pa.float64())], ["doc_id", "posterior", "score"])

    scored = map_rows(features, kernel, "doc_id long, posterior double, score double")
    return scored.withColumn("kept", F.col("score") >= 0.5)
