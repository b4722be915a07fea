"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

Every id is replaced by its rank in the corpus (most frequent first, ties by id) and
the rank is written in 1 to 4 bytes. The byte counts stand apart, two bits each, in a
control stream, so that a reader finds all value positions with one table lookup per
control byte and one cumulative sum, without branching per value.

A file is one row of a Parquet table in the shared folder, so any store that Spark
writes can hold it and a lost task leaves no half-written file: ``file`` (number, in
ascending document order), ``doc_ids``, ``counts`` (ids of each document), ``control``
and ``data``. The rank table is a second, small table of at most one row per id of
the vocabulary.

Edge cases: a null or empty text holds the end id alone; an empty table gives no
file; repeated texts are repeated; two rows with one document id stand one after the
other in an order that their ids decide; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.bpe import SPACES
from quirelake.llm.common import map_rows, slices, texts_of, written

#: Documents of a file, at most; a file is also closed at FILE_IDS ids.
FILE_DOCS = 2048
FILE_IDS = 1 << 20

#: For each control byte, the lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


# -- the code ------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    n = len(values)
    extra = (values >> 8 > 0).astype(np.uint8) + (values >> 16 > 0) + (values >> 24 > 0)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] <= extra[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(n, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8)
    padded = np.concatenate([raw, np.zeros(4, np.uint8)])
    out = padded[starts].astype(np.uint32)
    for byte in (1, 2, 3):
        has = np.flatnonzero(lengths > byte)
        if len(has):
            out[has] |= padded[starts[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


# -- encoding ------------------------------------------------------------------

#: Words whose ids a worker remembers; beyond it the memory is emptied.
WORD_CACHE = 900_000

#: Fixed value: what the tokenizer's pattern cuts a lower-cased text into.
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"

#: The same, letters first: only the last two kinds and the short ones share a beginning.
LETTERS_FIRST = "[{L}]+|'(?:[stmd]|re|ve|ll)|[{N}]|[^{S}{L}{N}]+"


#: Fixed value: the letter that stands for each byte in a byte-level vocabulary.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = dict(zip((b for b in range(256) if b not in _SHOWN), range(256, 512)))


def byte_letters(word: str) -> str:
    """The letters of a word's UTF-8 bytes; those of visible ASCII stand for themselves."""
    if word.isascii() and word.isalnum():
        return word
    return word.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)


class Encoder:
    """The library's ids of whole texts. A text of plain Latin letters is cut into the
    tokenizer's own pieces, and the library's model encodes each distinct piece once; any other
    text (marks to compose, letters whose case depends on their place, added tokens) is
    given to the library as it is."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: The library's model alone: pieces are normalised and cut already.
        self.model = self.library.model
        # A letter counts as plain only if its small form is one of them too.
        latin = [c for c in range(0x250) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250]
        kinds = {k: "".join(f"\\u{c:04x}" for c in latin if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        self.pieces = re.compile(LETTERS_FIRST.format(**kinds, S=SPACES))
        self.other = re.compile("[^" + "".join(f"\\u{c:04x}" for c in latin) + "\\u2010-\\u2027]|<\\|")
        self.known: dict[str, bytes] = {}
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.plain = self._cuts_into_pieces(path)

    @staticmethod
    def _cuts_into_pieces(path: str) -> bool:
        """Whether the file's rules are those that PIECES stands for."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        lower = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        return lower and cut[:1] == [PIECES.format(L="\\p{L}", N="\\p{N}", S="\\s")]

    def is_plain(self, text: str) -> bool:
        return self.plain and "<|" not in text and (text.isascii() or not self.other.search(text))

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids: list[int] = []
            ends = []
            for word in part:
                ids += [t.id for t in self.model.tokenize(byte_letters(word))]
                ends.append(len(ids))
            data, width, start = np.array(ids, self.kind).tobytes(), np.dtype(self.kind).itemsize, 0
            for word, end in zip(part, ends):
                self.known[word] = data[start * width : end * width]
                start = end

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces.findall(t.lower()) if self.is_plain(t) else None for t in texts]
        used = set().union(*filter(None, cut))
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        fresh = used.difference(self.known)
        if fresh:
            self.learn(list(fresh))
        return [self.whole(t) if words is None else b"".join(map(self.known.__getitem__, words)) for t, words in zip(texts, cut)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder of a file; made once and kept."""
    return Encoder(path)


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, width, ids BINARY): ids of each text with the end id, ``width`` bytes each,
    little-endian: 2 if the vocabulary allows it, else 4."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        end, width = np.array([end_id], e.kind).tobytes(), np.dtype(e.kind).itemsize
        for b in slices(batches):
            ids = [x + end for x in e.encode_batch(texts_of(b))]
            yield pa.record_batch([b.column("id"), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["id", "width", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, kernel, "id long, width int, ids binary").withColumnRenamed("id", id_col)


def numbers(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4")


def rank_table(encoded: DataFrame) -> DataFrame:
    """(token, freq, rank): every id that occurs, by falling frequency, then by id.

    Each task counts its own ids first, so what is shuffled is bounded by the
    vocabulary times the tasks, and the table by the vocabulary."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in slices(batches, "ids"):
            if b.num_rows:
                ids = numbers(b"".join(b.column("ids").to_pylist()), b.column("width")[0].as_py())
                seen = np.bincount(ids, minlength=len(total))
                seen[: len(total)] += total
                total = seen
        token = np.flatnonzero(total)
        yield pa.record_batch([pa.array(token, pa.int64()), pa.array(total[token], pa.int64())], ["token", "freq"])

    counts = map_rows(encoded.select("ids", "width"), kernel, "token long, freq long").groupBy("token").agg(F.sum("freq").alias("freq"))
    by = Window.orderBy(F.desc("freq"), "token")  # one row per id of the vocabulary
    return counts.withColumn("rank", F.row_number().over(by) - 1)


# -- files ---------------------------------------------------------------------


def write_files(encoded: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Writes the files and gives them as a table.

    Documents are dealt by ranges of their id and sorted in each range; every task
    closes a file at FILE_DOCS documents or FILE_IDS ids, so no file and no task
    grows with the input. A file's place is (range, number in it)."""
    spark = encoded.sparkSession
    table = ranks.select("token", "rank").collect()  # at most the vocabulary
    lookup = np.zeros(1 + max((r.token for r in table), default=0), "<u4")
    for r in table:
        lookup[r.token] = r.rank
    shared = spark.sparkContext.broadcast(lookup)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            control, data = pack(shared.value[np.concatenate(parts)])
            row = {"first_id": ids[0], "last_id": ids[-1], "n": int(counts.sum()), "doc_ids": list(ids), "counts": counts.tolist(), "control": control, "data": data}
            ids.clear(), parts.clear()
            return pa.RecordBatch.from_pylist([row], schema=FILE_SCHEMA)

        size = 0
        for b in slices(batches, "ids"):
            for i, width, x in zip(*(b.column(c).to_pylist() for c in ("id", "width", "ids"))):
                ids.append(i)
                parts.append(numbers(x, width))
                size += len(parts[-1])
                if len(ids) >= FILE_DOCS or size >= FILE_IDS:
                    yield close()
                    size = 0
        if ids:
            yield close()

    rows = encoded.select(F.col(id_col).alias("id"), "width", "ids")
    dealt = rows.repartitionByRange(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id").sortWithinPartitions("id", "ids")
    files = map_rows(dealt, kernel, FILE_COLUMNS)
    return written(files.withColumn("place", F.monotonically_increasing_id()), "token-files")


FILE_COLUMNS = "first_id long, last_id long, n long, doc_ids array<long>, counts array<long>, control binary, data binary"
FILE_SCHEMA = pa.schema(
    [("first_id", pa.int64()), ("last_id", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]
)


#: ``place`` is Spark's growing number of a row: the number of its part above these bits.
PART_BITS = 33


def with_starts(files: DataFrame) -> DataFrame:
    """The files with ``start``: how many ids the files before them hold.

    Ids are summed per range of documents first; one row per range goes through one window,
    and then the files of each range through its own."""
    heads = files.select("place", "n", F.shiftright("place", PART_BITS).alias("part"))
    ranges = heads.groupBy("part").agg(F.sum("n").alias("n"))
    before = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ranges.select("part", before(Window.orderBy("part")).alias("base"))
    inside = heads.select("place", "part", before(Window.partitionBy("part").orderBy("place")).alias("inside"))
    starts = inside.join(bases, "part").select("place", (F.col("base") + F.col("inside")).alias("start"))
    return files.join(starts, "place")


def read_files(files: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids BINARY) of every document, out of the files."""
    spark = files.sparkSession
    back = np.array([r.token for r in ranks.select("rank", "token").orderBy("rank").collect()], "<u4")
    shared = spark.sparkContext.broadcast(back)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                f = b.slice(row, 1).to_pylist()[0]
                ids = shared.value[unpack(f["control"], f["data"], f["n"])].astype("<u4").tobytes()
                counts = np.array(f["counts"], np.int64)
                ends = np.cumsum(counts)
                starts = ends - counts
                cut = [ids[4 * a : 4 * z] for a, z in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [pa.array(f["doc_ids"], pa.int64()), pa.array(starts + f["start"], pa.int64()), pa.array(counts, pa.int64()), pa.array(cut, pa.binary()), pa.array([zlib.crc32(x) for x in cut], pa.int64())],
                    ["id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    rows = with_starts(files).select("start", "n", "doc_ids", "counts", "control", "data")
    return map_rows(rows, kernel, "id long, start long, n_tokens long, ids binary, ids_crc32 long").withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, DataFrame]:
    """Encodes, ranks and writes ``docs``: (files, ranks)."""
    encoded = written(encode(docs, tokenizer, end_id), "token-ids")
    ranks = written(rank_table(encoded), "token-ranks")
    return write_files(encoded, ranks), ranks
