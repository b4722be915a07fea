"""Exact substring deduplication by a logarithmic family of suffix arrays.

Every byte covered by a LENGTH-byte string that also starts earlier in the corpus
(smaller id, or the same document further left) is removed; documents are judged on
the input, and no match crosses documents.

Sampled suffixes. Of the GRAM-byte grams in a window of LENGTH bytes the one with the
least code is its anchor, so equal windows have their anchor at the same place. Windows
that follow each other and share their anchor make one segment: the anchor's suffix
with what lies around it. A segment is known by two codes of its content, 96 bits.

Index family. A batch's segments are sorted by content code. (Not by their bytes: a suffix
array in the order of bytes, of every place, takes several times the CPU and disk that
the check tool allows; the README has the figures. Equal suffixes are neighbours in either
order, and only equal ones are asked for.) The batch is merge-scanned against the sorted
levels that are there already: a code found again is a long match, the earlier place stays
in the index, and the later segment is removed. What is new becomes a level, and levels of
equal size are merged, so that a family of n entries has about log n levels. Each input
task keeps a family of its own, which decides what repeats within the task; the first
places of its codes are then dealt by their gram over all tasks and meet in a second
family. A code that a third of all documents hold is thus sent at most once per task.

Edges. Where a match begins or ends inside a segment the segments differ but share
their anchor's gram. Only for first places of grams with several segments, the single
windows are listed and put through the same two families by their own codes. The first
place of a window lies in the first place of its segment, so this is exact, but for
collisions of codes (about n^2 / 2^97 for n segments).

Hot grams. A short passage among unlike texts gives a segment of its own to every document
under one gram. A task that sees HOT segments of a gram or more opens them at once, sends
them by their document and only a mark to where the gram's others meet, which opens those.
So no task meets more than HOT segments of a gram from each other task.

Edge cases: null texts are empty; texts under LENGTH bytes lose nothing; texts of any
length are used whole, very long ones in pieces that overlap; a null id is less than
any other; rows with the same id and text are one document and keep or lose the same
bytes, rows with the same id and other texts are ordered by a hash of the text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import map_rows, release, written

LENGTH = 100
GRAM = 32

#: Bytes worked on at a time, entries at which a task's own family is sent off, and
#: entries sent at once.
PIECE = 1 << 20
FAMILY = 1_000_000
SENT_AT_ONCE = 100_000

#: Segments of a gram in one task from which on they are opened there.
HOT = 8

_NULL_ID = -(1 << 63)
_PLACE = np.uint64((1 << 23) - 1)
_rng = np.random.default_rng(20_24)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ODD = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MORE = _rng.integers(0, 1 << 63, 5, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_29, _32, _LOW = np.uint64(29), np.uint64(32), np.uint64((1 << 32) - 1)


# -- codes ----------------------------------------------------------------------


def _joined(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    out = left * _ODD[2 * level]
    out += right * _ODD[2 * level + 1]
    out ^= out >> _32
    out *= _ODD[14]
    return out


def codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams of 32 and of 64 bytes, by where they begin."""
    x = _BYTE[data]
    gram = x
    for level in range(6):
        step = 1 << level
        x = _joined(x[:-step], x[step:], level) if len(x) > step else x[:0]
        if 2 * step == GRAM:
            gram = x
    return gram, x


def range_codes(x64: np.ndarray, start: np.ndarray, size: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two codes, of 64 and 32 bits, of the strings of 100 to 192 bytes from ``start``:
    three blocks of 64 that cover them, mixed with other factors for each code."""
    first, middle, last = x64[start], x64[start + (size - 64) // 2], x64[start + size - 64]
    tag = size.astype(np.uint64) * np.uint64(256) + salt.astype(np.uint64)
    out = []
    for k in (0, 1):
        a, b, c, d, e = _ODD[9:14] if not k else _MORE
        code = first * a + middle * b + last * c
        code += tag * d
        code ^= code >> _29
        code *= e
        code ^= code >> _32
        out.append(code)
    return out[0], (out[1] & _LOW).astype("<u4")


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram code, content codes, first byte, size) of the segments of documents laid one
    after the other, which end at ``ends``; at most 8 MB."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none.astype("<u4"), none, none
    gram, x64 = codes(data)
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32, LENGTH - GRAM + 1 - 64):
        least = np.minimum(least[:-step], least[step:])
    anchor = (least & _PLACE).astype(np.int64)
    whole = np.ones(len(anchor) + LENGTH, np.int8)
    for end in ends[:-1].tolist():  # windows over a border belong to no document
        whole[max(0, end - LENGTH + 1) : end] = 0
    whole = whole[: len(anchor)]
    border = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(whole) != 0)) + 1
    low, high = np.r_[0, border], np.r_[border, len(anchor)] - 1
    inside = whole[low] > 0
    low, high = low[inside], high[inside]
    at = anchor[low]
    size = high - low + LENGTH
    return gram[at], *range_codes(x64, low, size, at - low), low, size


# -- the family -----------------------------------------------------------------

#: An entry: content codes, id, hash of the text, first byte, size, gram code.
ENTRY = [("code", "<u8"), ("more", "<u4"), ("doc", "<i8"), ("sub", "<i4"), ("low", "<u4"), ("size", "<u4"), ("gram", "<u8")]
FIELDS = [name for name, _ in ENTRY]


def entries(**columns: np.ndarray) -> dict[str, np.ndarray]:
    n = max(len(np.atleast_1d(c)) for c in columns.values())
    return {name: np.ascontiguousarray(np.broadcast_to(columns[name], n), kind) for name, kind in ENTRY}


def take(e: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[rows] for k, v in e.items()}


def concat(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    if not parts:
        return entries(**{name: np.zeros(0, kind) for name, kind in ENTRY})
    return {name: np.concatenate([p[name] for p in parts]) for name in FIELDS}


def earlier(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Whether a's place comes before b's, one by one; equal places don't."""
    out = a["low"] < b["low"]
    for name in ("sub", "doc"):
        out = (a[name] < b[name]) | ((a[name] == b[name]) & out)
    return out


def same_place(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    return (a["low"] == b["low"]) & (a["sub"] == b["sub"]) & (a["doc"] == b["doc"])


def repeats(e: dict[str, np.ndarray]) -> np.ndarray:
    """Whether an entry has the codes of the one before it."""
    if not len(e["code"]):
        return np.zeros(0, bool)
    return np.r_[False, (e["code"][1:] == e["code"][:-1]) & (e["more"][1:] == e["more"][:-1])]


def found_in(level: dict[str, np.ndarray], batch: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``batch``, positions in ``level``) of equal codes. Entries that have the
    64-bit code alone in common stand side by side, and are tried one after the other."""
    place = np.searchsorted(level["code"], batch["code"])
    rows, hits = [], []
    live = np.arange(len(place))
    while len(live):
        live = live[place[live] < len(level["code"])]
        live = live[level["code"][place[live]] == batch["code"][live]]
        equal = level["more"][place[live]] == batch["more"][live]
        rows.append(live[equal])
        hits.append(place[live[equal]])
        live = live[~equal]
        place[live] += 1
    return (np.concatenate(rows), np.concatenate(hits)) if rows else (live, live)


class Family:
    """Levels of entries sorted by their codes; no two entries have the same codes."""

    def __init__(self) -> None:
        self.levels: list[dict[str, np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(x["code"]) for x in self.levels)

    def add(self, batch: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Takes a batch in; gives the entries, old or new, that an earlier one beats."""
        order = np.lexsort((batch["low"], batch["sub"], batch["doc"], batch["more"], batch["code"]))
        batch = take(batch, order)
        again = repeats(batch)
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
        lost = [take(batch, again & ~same_place(batch, take(batch, first)))]
        batch = take(batch, ~again)
        for level in self.levels:
            if not len(batch["code"]):
                break
            found, at = found_in(level, batch)
            if not len(found):
                continue
            old, new = take(level, at), take(batch, found)
            wins = earlier(new, old)
            lost.append(take(old, wins))
            lost.append(take(new, ~wins & ~same_place(new, old)))
            for name in FIELDS:
                level[name][at[wins]] = new[name][wins]
            keep = np.ones(len(batch["code"]), bool)
            keep[found] = False
            batch = take(batch, keep)
        if len(batch["code"]):
            self.levels.append(batch)
            while len(self.levels) > 1 and len(self.levels[-1]["code"]) >= len(self.levels[-2]["code"]):
                merged = concat([self.levels.pop(), self.levels.pop()])
                self.levels.append(take(merged, np.argsort(merged["code"], kind="stable")))
        return concat(lost)

    def all(self) -> dict[str, np.ndarray]:
        return concat(self.levels)


# -- over tables ------------------------------------------------------------------


def _packed(e: dict[str, np.ndarray]) -> bytes:
    return b"".join(e[name].tobytes() for name in FIELDS)


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(k).itemsize for _, k in ENTRY), 0, {}
    for name, kind in ENTRY:
        out[name] = np.frombuffer(data, kind, n, at).copy()
        at += out[name].nbytes
    return out


#: What rows of entries are: first places, lost spans, open segments, marks of hot grams.
FIRST, LOST, OPEN, MARK = range(4)

SENT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("entries", pa.binary())])


def _dealt(parts: int, kind: int, e: dict[str, np.ndarray], by: str) -> Iterator[pa.RecordBatch]:
    """Rows to send, dealt by the field ``by``."""
    if not len(e["code"]):
        return
    target = ((e[by].astype(np.uint64) * _ODD[15]) >> _32) % np.uint64(parts)
    order = np.argsort(target, kind="stable")
    e, target = take(e, order), target[order]
    cuts = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True])
    rows, held = [], 0
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        rows.append({"part": int(target[a]), "kind": kind, "entries": _packed(take(e, slice(a, z)))})
        held += z - a
        if held > SENT_AT_ONCE:
            yield pa.RecordBatch.from_pylist(rows, schema=SENT)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=SENT)


def _per_gram(e: dict[str, np.ndarray]) -> np.ndarray:
    """For each entry, how many have its gram."""
    back, counts = np.unique(e["gram"], return_inverse=True, return_counts=True)[1:]
    return counts[back]


def _united(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Entries of lost spans, those of a document that touch or overlap made one."""
    if not len(e["doc"]):
        return e
    e = take(e, np.lexsort((e["low"], e["sub"], e["doc"])))
    low, high = e["low"].astype(np.int64), e["low"].astype(np.int64) + e["size"]
    fresh = np.r_[True, (e["doc"][1:] != e["doc"][:-1]) | (e["sub"][1:] != e["sub"][:-1]) | (low[1:] > high[:-1])]
    heads = np.flatnonzero(fresh)
    out = take(e, heads)
    out["size"] = (np.maximum.reduceat(high, heads) - low[heads]).astype("<u4")
    return out


def _spans(told: DataFrame, kind: int) -> DataFrame:
    """(t_doc, t_sub, spans): one row per document with its (first byte, size) pairs."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = concat([_unpacked(x.as_py()) for b in batches for x in b.column("entries")])
        e = take(e, np.lexsort((e["low"], e["sub"], e["doc"])))
        doc, sub = e["doc"], e["sub"]
        spans = np.stack([e["low"], e["size"]], axis=1)
        cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]), True]) if len(doc) else np.zeros(1, int)
        for at in range(0, len(cuts) - 1, 4096):
            own = cuts[at : at + 4097]
            packed = [spans[a:z].tobytes() for a, z in zip(own[:-1].tolist(), own[1:].tolist())]
            yield pa.record_batch([pa.array(doc[own[:-1]]), pa.array(sub[own[:-1]]), pa.array(packed, pa.binary())], ["t_doc", "t_sub", "spans"])

    rows = told.where(F.col("kind") == kind).select("part", "entries")
    return map_rows(rows.repartitionById(_parts(told), "part"), gather, "t_doc long, t_sub int, spans binary")


def _parts(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _rounds(rows: DataFrame, batches_of: Callable[[pa.RecordBatch], Iterator[dict]], by: str, leave_open: bool) -> DataFrame:
    """Puts the entries that a kernel draws from ``rows`` through a family per task and
    then one per part: (part, kind, entries) of what is lost and, if ``leave_open``, of
    first places whose gram has several, dealt by document."""
    parts = _parts(rows)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(family: Family, lost: list) -> Iterator[pa.RecordBatch]:
            firsts = family.all()
            if leave_open:
                hot = _per_gram(firsts) >= HOT
                opened = take(firsts, hot)
                yield from _dealt(parts, OPEN, opened, "doc")
                yield from _dealt(parts, MARK, take(opened, np.unique(opened["gram"], return_index=True)[1]), "gram")
                firsts = take(firsts, ~hot)
            yield from _dealt(parts, FIRST, firsts, by)
            yield from _dealt(parts, LOST, _united(concat(lost)), "doc")

        family, lost, n_lost = Family(), [], 0
        for b in batches:
            for e in batches_of(b):
                lost.append(family.add(e))
                n_lost += len(lost[-1]["code"])
                if len(family) + n_lost > FAMILY:
                    yield from send(family, lost)
                    family, lost, n_lost = Family(), [], 0
        yield from send(family, lost)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, lost, marks = Family(), [], []
        for b in batches:
            for kind, data in zip(b.column("kind").to_pylist(), b.column("entries")):
                e = _unpacked(data.as_py())
                if kind == FIRST:
                    lost.append(family.add(e))
                elif kind == LOST:
                    lost.append(e)
                elif kind == MARK:
                    marks.append(np.unique(e["gram"]))
                else:
                    yield from _dealt(parts, OPEN, e, "doc")
        yield from _dealt(parts, LOST, _united(concat(lost)), "doc")
        if leave_open:
            firsts = family.all()
            hot = np.isin(firsts["gram"], np.concatenate(marks)) if marks else False
            yield from _dealt(parts, OPEN, take(firsts, (_per_gram(firsts) > 1) | hot), "doc")

    sent = map_rows(rows, own, "part int, kind int, entries binary").repartitionById(parts, "part")
    return map_rows(sent, meet, "part int, kind int, entries binary")


def _segment_batches(b: pa.RecordBatch) -> Iterator[dict]:
    docs, subs = b.column("doc").to_numpy(), b.column("sub").to_numpy()
    data, held, owners = [], 0, []

    def flush() -> Iterator[dict]:
        if not held:
            return
        sizes = np.array([len(x) for x in data])
        ends = np.cumsum(sizes)
        gram, code, more, low, size = segments(np.frombuffer(b"".join(data), np.uint8), ends)
        which = np.searchsorted(ends, low, "right")
        row, offset = (np.array(x)[which] for x in zip(*owners))
        yield entries(code=code, more=more, doc=docs[row], sub=subs[row], low=low - (ends - sizes)[which] + offset, size=size, gram=gram)

    for row, value in enumerate(b.column("data")):
        text = value.as_py() or b""
        if len(text) < LENGTH:
            continue
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            piece = text[at : at + PIECE + LENGTH - 1]
            if held + len(piece) > 2 * PIECE:
                yield from flush()
                data, held, owners = [], 0, []
            data.append(piece)
            owners.append((row, at))
            held += len(piece)
    yield from flush()


def _window_batches(b: pa.RecordBatch) -> Iterator[dict]:
    """The single windows of a document's open segments."""
    for doc, sub, value, spans in zip(b.column("doc").to_pylist(), b.column("sub").to_pylist(), b.column("data"), b.column("spans").to_pylist()):
        text = value.as_py()
        pairs = np.unique(np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64), axis=0)
        for at in range(0, len(pairs), 8192):
            low, size = pairs[at : at + 8192].T
            x64 = codes(np.frombuffer(b"".join(text[a : a + n] for a, n in zip(low.tolist(), size.tolist())), np.uint8))[1]
            base = np.cumsum(size) - size
            count = size - LENGTH + 1
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(base, count) + step
            code, more = range_codes(x64, start, np.full(len(start), LENGTH), np.zeros(len(start), np.int64))
            yield entries(code=code, more=more, doc=doc, sub=sub, low=np.repeat(low, count) + step, size=LENGTH, gram=0)


def _with_spans(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    same = (F.col("doc") == F.col("t_doc")) & (F.col("sub") == F.col("t_sub"))
    # A merge join at every size: the lists grow with the input and are not broadcast.
    return rows.join(lists.hint("merge"), same, how).drop("t_doc", "t_sub")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept BINARY) of every row: how many bytes
    it has and loses, in how many runs, which runs, and the bytes that stay. (The kept
    bytes need not be valid UTF-8: a run may end inside a character.)"""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"),
        F.hash(F.xxhash64(F.col(text_col))).alias("sub"),
        data.alias("data"),
    )
    long = rows.select("doc", "sub", "data")
    told = written(_rounds(long, _segment_batches, "gram", True), "suffix-segments")
    open_rows = _with_spans(long, _spans(told, OPEN), "inner")
    edges = written(_rounds(open_rows, _window_batches, "code", False), "suffix-windows")
    gone = written(_spans(told.unionAll(edges), LOST), "suffix-spans")
    release(told, edges)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = [_cut(value.as_py(), spans) for value, spans in zip(b.column("data"), b.column("spans").to_pylist())]
                n_bytes, n_removed, runs, kept = zip(*out)
                yield pa.record_batch(
                    [b.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(map(len, runs), pa.int64()), pa.array(runs, RUNS), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    joined = _with_spans(rows, gone, "left").select("id", "data", "spans")
    return map_rows(joined, cut, "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary").withColumnRenamed("id", id_col)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _cut(data: bytes, spans: bytes | None) -> tuple[int, int, list[dict], bytes]:
    if not spans:
        return len(data), 0, [], data
    pairs = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64)
    depth = np.zeros(len(data) + 1, np.int64)
    np.add.at(depth, pairs[:, 0], 1)
    np.add.at(depth, pairs[:, 0] + pairs[:, 1], -1)
    gone = np.cumsum(depth[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    runs = [{"start": a, "stop": z} for a, z in edge.reshape(-1, 2).tolist()]
    return len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()
