"""Byte-level BPE by speculation: encoding and decoding of whole texts.

A word is first cut greedily into the longest tokens (one automaton pass over all
new words of a slice). A cut is the BPE result if and only if every adjacent pair
of tokens is compatible: undoing merges from the boundary outwards, newest first,
never shows a cross-boundary merge that would have come earlier. That test runs in
numpy over the distinct pairs of the slice. Only words with an incompatible pair
(or without a full cover) are merged exactly.

Edge cases: a null or empty text has no ids and decodes to the empty text; texts of
any length are encoded whole; repeated rows give repeated results; an empty table
gives an empty table; columns besides the id and the text are ignored, whatever
their names.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import map_rows, slices, texts_of

#: Fixed value: White_Space of Unicode, as the tokenizer's pattern means ``\s``.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Fixed value: the byte-level pattern, with classes for letters, numbers, white space.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"

#: Words whose ids a worker remembers; beyond it the memory is emptied.
WORD_CACHE = 400_000

_SEPARATOR = "Ā"
_NEVER = np.int64(1) << 40


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it is printable
    in Latin-1, otherwise the next letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(plain))
    return letters


def _class_of(kind: str) -> str:
    """A character class of the basic plane's characters of a category."""
    out, start = [], None
    for cp in range(0x10001):
        inside = cp < 0x10000 and unicodedata.category(chr(cp))[0] == kind
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{cp - 1:04x}")
            start = None
    return "".join(out)


class Codec:
    """One tokenizer file; tokens are numbered inside by order of creation: the 256
    bytes, then the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        letter_byte = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        order: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        as_bytes = lambda s: bytes(letter_byte[c] for c in s)
        size = 256 + len(merges)
        self.left, self.right = np.arange(size), np.arange(size)
        codes = np.empty(len(merges), np.int64)
        #: Whether each token has one way to come about; else pairs prove nothing.
        self.proper = True
        for k, (a, b) in enumerate(merges):
            x, y = order[as_bytes(a)], order[as_bytes(b)]
            new = as_bytes(a) + as_bytes(b)
            self.proper &= new not in order
            order.setdefault(new, 256 + k)
            self.left[256 + k], self.right[256 + k] = x, y
            codes[k] = x * size + y
        self.size = size
        by = np.argsort(codes)
        self.pair_codes, self.pair_tokens = codes[by], by + 256
        self.merged = {int(c): 256 + k for k, c in enumerate(codes)}
        self.ids = np.zeros(size, "<u4")
        for token, k in order.items():
            self.ids[k] = vocab["".join(map(letters.__getitem__, token))]
        self.bytes_of: dict[int, bytes] = {i: as_bytes(s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.lengths = np.zeros(size, np.int64)
        greedy = ahocorasick.Automaton()
        for token, k in order.items():
            self.lengths[k] = len(token)
            greedy.add_word(token.decode("latin-1"), k)
        greedy.make_automaton()
        self.greedy = greedy
        basic = {"L": _class_of("L"), "N": _class_of("N"), "S": SPACES}
        self.basic = re.compile(PATTERN.format(**basic))
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.full = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", S=SPACES))
        self.known: dict[str, bytes] = {}
        self.checked = self.failed = 0

    # -- speculation -----------------------------------------------------------

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether BPE leaves the boundary between them."""
        good = np.ones(len(x), bool)
        at, limit = np.arange(len(x)), np.full(len(x), _NEVER)
        while len(at):
            code = x * self.size + y
            place = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            joined = np.where(self.pair_codes[place] == code, self.pair_tokens[place], _NEVER)
            broken = joined < limit
            good[at[broken]] = False
            # Undo the newer of the two; of equal ones the right, which came second.
            undo_x = ((x > y) & (x >= 256)) | (y < 256)
            done = broken | (undo_x & (x < 256))
            limit = np.where(undo_x, x, y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            keep = ~done
            x, y, at, limit = x[keep], y[keep], at[keep], limit[keep]
        return good

    def speculate(self, words: list[str]) -> None:
        """Puts the ids of ``words``, none of them known, into ``self.known``."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        text = _SEPARATOR.join(b.decode("latin-1") for b in raw)
        found = list(self.greedy.iter_long(text))
        ends, tokens = np.array(found, np.int64).reshape(-1, 2).T
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        after = np.cumsum(sizes + 1)
        owner = np.searchsorted(after, ends, "right")
        covered = np.bincount(owner, self.lengths[tokens], len(raw)) == sizes
        inside = owner[1:] == owner[:-1]
        pairs = (tokens[:-1] * self.size + tokens[1:])[inside]
        distinct, back = np.unique(pairs, return_inverse=True)
        good = self.compatible(distinct // self.size, distinct % self.size)
        whole = covered & self.proper
        whole[owner[1:][inside][~good[back]]] = False
        ids = self.ids[tokens]
        cut = np.searchsorted(owner, np.arange(len(raw) + 1))
        data, cut = ids.tobytes(), (cut * 4).tolist()
        for k, ok in enumerate(whole.tolist()):
            self.known[words[k]] = data[cut[k] : cut[k + 1]] if ok else self.ids[self.merge(raw[k])].tobytes()
        self.checked += len(raw)
        self.failed += len(raw) - int(whole.sum())

    # -- exact merging ---------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """The tokens of ``word`` by the merge rules alone."""
        return self._merge_short(word) if len(word) <= 48 else self._merge_long(word)

    def _merge_short(self, word: bytes) -> list[int]:
        parts, merged, size = list(word), self.merged, self.size
        joins = [merged.get(a * size + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while joins:
            best = min(joins)
            if best == _NEVER:
                break
            k = joins.index(best)
            parts[k : k + 2] = [best]
            del joins[k]
            if k:
                joins[k - 1] = merged.get(parts[k - 1] * size + best, _NEVER)
            if k < len(joins):
                joins[k] = merged.get(best * size + parts[k + 1], _NEVER)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        n, merged, size = len(word), self.merged, self.size
        token, prev, following = list(word), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, k) for k in range(n - 1) if (m := merged.get(token[k] * size + token[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            new, k = heapq.heappop(heap)
            r = following[k] if token[k] >= 0 else n
            if r >= n or merged.get(token[k] * size + token[r]) != new:
                continue
            token[k], token[r] = new, -1
            following[k] = after = following[r]
            if after < n:
                prev[after] = k
                if (m := merged.get(new * size + token[after])) is not None:
                    heapq.heappush(heap, (m, k))
            if (before := prev[k]) >= 0 and (m := merged.get(token[before] * size + new)) is not None:
                heapq.heappush(heap, (m, before))
        return [t for t in token if t >= 0]

    # -- texts -----------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        return (self.full if self.beyond.search(text) else self.basic).findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces: list[list[str | bytes]] = []
        fresh: set[str] = set()
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        known = self.known
        for text in texts:
            if self.added and self.split_added.search(text):
                own: list[str | bytes] = []
                at = 0
                for m in self.split_added.finditer(text):
                    own += self.words(text[at : m.start()])
                    own.append(self.added[m[0]].to_bytes(4, "little"))
                    at = m.end()
                own += self.words(text[at:])
                fresh.update(w for w in own if isinstance(w, str))
            else:
                own = self.words(text)
                fresh.update(own)
            pieces.append(own)
        new = [w for w in fresh if w not in known]
        if new:
            self.speculate(new)
        out = []
        for own in pieces:
            try:
                out.append(b"".join(map(known.__getitem__, own)))
            except KeyError:  # an added token stands as its id already
                out.append(b"".join(known[w] if isinstance(w, str) else w for w in own))
        return out

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """A worker's codec of a file; made once and kept."""
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids BINARY): the token ids of each text, little-endian, 4 bytes each."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in slices(batches):
            yield pa.record_batch([b.column("id"), pa.array(c.encode_batch(texts_of(b)), pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, kernel, "id long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids; null ids give the empty text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in slices(batches, "ids"):
            texts = [c.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return map_rows(rows, kernel, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids BINARY, decoded STRING): encoding, then decoding from the ids, in one
    pass over the rows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in slices(batches):
            ids = c.encode_batch(texts_of(b))
            yield pa.record_batch(
                [b.column("id"), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())],
                ["id", "ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, kernel, "id long, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(trip: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The contract's columns of a ``round_trip``, and those of it to ``keep``."""
    return trip.select(
        id_col,
        *(keep or []),
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


assert sys.byteorder == "little"
