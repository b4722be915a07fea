"""op1 and op3 against the library itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quirelake.llm import bpe, token_files
from tests.llm import data

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "the", " ", "  ", "\n", "'s", "é", "1", "٣", "!", "\U0001f600", "中", "_", "\xa0", "\t", "\x1f", "ß", "-", " ing", "tion", "<|endoftext|>", "\x85", "İ", "Σ", "é", "½", "''", "aaaaaaaa"]


def mixed(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_library():
    library, codec = Tokenizer.from_file(BYTE), bpe.codec(BYTE)
    texts = mixed(2000, 5) + ["", "x" * 5000, "abc" * 3000]
    for text, ids, e in zip(texts, codec.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert codec.decode(ids) == library.decode(e.ids, skip_special_tokens=False)
    assert codec.checked and 0 < codec.failed < codec.checked


def test_exact_merging_agrees_by_length():
    codec = bpe.codec(BYTE)
    for word in (b"international", b"aaaaaaaaaaaaa", "gégég".encode()):
        assert codec._merge_short(word) == codec._merge_long(word)


def test_round_trip_of_awkward_rows(spark):
    found = bpe.digests(bpe.round_trip(data.documents(spark), BYTE)).collect()
    texts = sorted((r[0], r[1] or "") for r in data.rows())
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, t in texts:
        ids = np.array(library.encode(t, add_special_tokens=False).ids, "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, found)) == sorted(want)


def test_encode_and_decode_apart(spark):
    encoded = bpe.encode(data.documents(spark), BYTE)
    texts = {r.doc_id: r.text for r in bpe.decode(encoded, BYTE).collect()}
    assert texts == {r[0]: r[1] or "" for r in data.rows()}
    assert bpe.round_trip(data.empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    control, packed = token_files.pack(values)
    assert len(control) == -(-n // 4)
    assert (token_files.unpack(control, packed, n) == values).all()


def test_words_of_the_library():
    library, encoder = Tokenizer.from_file(WORD), token_files.encoder(WORD)
    assert encoder.plain
    texts = mixed(2000, 9)
    for ids, e in zip(encoder.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, encoder.kind).tolist() == e.ids


def test_every_letter_of_the_library():
    """Code points in a word, before a capital and alone, as the library reads them."""
    library, encoder = Tokenizer.from_file(WORD), token_files.encoder(WORD)
    texts = [f"a{chr(c)}b {chr(c)}A{chr(c)} {chr(c)}" for c in range(1, 0x3000)]
    for text, ids, e in zip(texts, encoder.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, encoder.kind).tolist() == e.ids, hex(ord(text[1]))


def test_pieces_go_to_the_model_once():
    """Every distinct piece of plain texts is given to the library's model alone, by its bytes."""
    library, encoder, seen = Tokenizer.from_file(WORD), token_files.Encoder(WORD), []

    class Model:
        def tokenize(self, word, model=encoder.model):
            seen.append(word)
            return model.tokenize(word)

    encoder.model, encoder.library = Model(), None
    signs = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028)) if encoder.is_plain(chr(c))]
    texts = [f"x{c}y {c}{c} 7{c} don't {c}" for c in signs] * 2
    for text, ids, e in zip(texts, encoder.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, encoder.kind).tolist() == e.ids, text
    encoder.encode_batch(texts)
    assert len(signs) > 500 and len(seen) == len(set(seen)) == len(encoder.known)


def test_starts_add_up_over_ranges(spark):
    rows = [(part << 33 | k, part + k + 1) for part in (0, 1, 5) for k in range(4)]
    files = spark.createDataFrame(rows, "place long, n long").repartition(3)
    start, want = 0, {}
    for place, n in rows:
        want[place], start = start, start + n
    assert {r.place: r.start for r in token_files.with_starts(files).collect()} == want


def test_files_read_back(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_DOCS", 7)
    docs = data.documents(spark)
    files, ranks = token_files.token_files(docs, WORD, 2)
    found = token_files.read_files(files, ranks).orderBy("start").collect()
    library = Tokenizer.from_file(WORD)
    start, want = 0, []
    for i, t in sorted((r[0], r[1] or "") for r in data.rows()):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == want
    table = {r.token: (r.freq, r["rank"]) for r in ranks.collect()}
    order = sorted(table, key=lambda t: (-table[t][0], t))
    assert [table[t][1] for t in order] == list(range(len(order)))


def test_no_documents_no_files(spark):
    files, ranks = token_files.token_files(data.empty(spark), WORD, 2)
    assert files.count() == 0 and token_files.read_files(files, ranks).count() == 0
