"""Filters: round trips, and what damaged data keeps and tells."""

import base64
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.functions import filters as X
from quirelake.functions.syntax import Name, Ref
from quirelake.plans import encoders

DATA = bytes(range(256)) * 40 + b"the quick brown fox " * 200


def run(data, *names, most=X.MAX_DECODED, **step):
    out, faults, left = X.decode(data, X.Chain(tuple(X.Step(n, **step) for n in names), "none", ""), most)
    return out, [(f.code, f.severity) for f in faults], left


def test_flate_endings():
    whole = zlib.compress(DATA)
    assert run(whole, "FlateDecode") == (DATA, [], False)
    assert run(whole[:-4], "FlateDecode") == (DATA, [("filter.failed", "Repair")], False)
    assert run(whole[:-4] + b"abcd", "FlateDecode") == (DATA, [("filter.checksum-mismatch", "Warning")], False)
    out, faults, _ = run(whole[: len(whole) // 2], "FlateDecode")
    assert DATA.startswith(out) and out and faults == [("filter.failed", "Warning")]
    assert run(encoders.raw_deflate(DATA), "FlateDecode") == (DATA, [("filter.failed", "Repair")], False)
    assert run(b" \n" + whole, "FlateDecode") == (DATA, [("filter.failed", "Repair")], False)
    assert run(b"no zlib at all", "FlateDecode") == (b"no zlib at all", [("filter.failed", "Warning")], True)


def test_corrupt_flate_keeps_all_before_the_fault():
    noise = bytes((i * 7919 >> 3) & 255 for i in range(60_000))
    data = bytearray(zlib.compress(noise, 9))
    data[len(data) // 2] ^= 0xFF
    data[len(data) // 2 + 1] ^= 0xFF
    out, faults, _ = run(bytes(data), "FlateDecode")
    one, whole = zlib.decompressobj(), b""
    try:
        for k in range(len(data)):
            whole += one.decompress(bytes(data[k : k + 1]))
    except zlib.error:
        pass
    assert out == whole and faults and faults[0][1] == "Warning"


def test_predictor_parameters_out_of_range_are_read_as_the_nearest():
    rows = b"".join(b"\x01" + bytes(range(k, k + 8)) for k in range(5))
    want = X.predict(rows, X.Step("FlateDecode", predictor=12, colors=1, bits=8, columns=8))
    for step in ({"colors": 0, "columns": 8}, {"colors": -3, "bits": 7, "columns": 8}):
        assert X.predict(rows, X.Step("FlateDecode", predictor=12, **step)) == want
    assert X.predict(b"\x00a\x00b", X.Step("FlateDecode", predictor=12, columns=-1)) == (b"ab", [])


def test_lzw():
    for early in (0, 1):
        assert run(encoders.lzw(DATA, early), "LZWDecode", early_change=early) == (DATA, [], False)
    cut = encoders.lzw(DATA)[:-2]
    out, faults, _ = run(cut, "LZWDecode")
    assert DATA.startswith(out) and faults[0][0] == "filter.failed"
    assert run(b"\x80\x7f\xff\xff", "LZWDecode")[1] == [("filter.failed", "Warning")]


def test_ascii85():
    coded = base64.a85encode(DATA) + b"~>"
    assert run(coded, "ASCII85Decode") == (DATA, [], False)
    assert run(b"<~" + coded, "ASCII85Decode") == (DATA, [("filter.failed", "Repair")], False)
    assert run(b"z!!~>", "ASCII85Decode")[0] == bytes(5)
    assert run(base64.a85encode(b"abcd"), "ASCII85Decode") == (b"abcd", [("filter.failed", "Repair")], False)
    assert run(b"87cUR\x80D~>", "ASCII85Decode")[1] == [("filter.failed", "Warning")] * 2
    assert run(b"uuuuu~>", "ASCII85Decode") == ((85**5 - 1 & 0xFFFFFFFF).to_bytes(4, "big"), [("filter.failed", "Warning")], False)


def test_ascii_hex_and_run_length():
    assert run(DATA.hex().encode() + b">", "ASCIIHexDecode") == (DATA, [], False)
    assert run(b"4 1\n4>", "ASCIIHexDecode") == (b"A@", [], False)
    assert run(b"41", "ASCIIHexDecode") == (b"A", [("filter.failed", "Repair")], False)
    assert run(b"4g1>", "ASCIIHexDecode") == (b"A", [("filter.failed", "Warning")], False)
    assert run(encoders.run_length(DATA), "RunLengthDecode") == (DATA, [], False)
    assert run(encoders.run_length(DATA)[:-1], "RunLengthDecode") == (DATA, [("filter.failed", "Repair")], False)
    assert run(b"\x05ab", "RunLengthDecode") == (b"ab", [("filter.failed", "Warning")], False)


@pytest.mark.parametrize("columns", [1, 3, 64])
def test_predictors(columns):
    png = zlib.compress(encoders.png_rows(DATA, columns))
    assert run(png, "FlateDecode", predictor=12, columns=columns)[0] == DATA
    tiff = zlib.compress(encoders.tiff_rows(DATA, columns))
    assert run(tiff, "FlateDecode", predictor=2, columns=columns)[0] == DATA
    long = run(zlib.compress(b"ab"), "FlateDecode", predictor=12, columns=50)
    assert long == (b"ab", [("filter.failed", "Warning")], False)


def test_bound():
    out, faults, _ = run(zlib.compress(bytes(10_000)), "FlateDecode", most=100)
    assert len(out) == 100 and faults == [("limit.decoded-stream", "Warning")]


def test_chains():
    objects = {9: Name("FlateDecode")}
    get = lambda v: objects.get(v.number) if isinstance(v, Ref) else v
    chain = lambda **e: X.resolve_chain(e, get)
    assert chain() == X.Chain((), "none", "")
    assert [s.name for s in chain(Filter=Ref(9, 0)).steps] == ["FlateDecode"]
    two = chain(Filter=[Name("A85"), Name("Fl")], DecodeParms=[None, {"Predictor": 12, "Columns": 7}])
    assert [s.name for s in two.steps] == ["ASCII85Decode", "FlateDecode"] and two.steps[1].columns == 7
    assert chain(Filter=[Name("Crypt"), Name("Fl")]).steps[0].name == "FlateDecode"
    assert chain(Filter=[Name("Fl"), Name("DCTDecode")]).end == "image"
    assert chain(Filter=Name("Nope")).end == "unsupported"
    assert chain(Filter=[5]).end == "not-a-name" and chain(Filter=5).end == "not-a-filter-entry"
    assert chain(Filter=[Name("Fl")] * 65).end == "limit"
    assert X.decode(b"x", chain(Filter=Name("Nope")))[1][0].code == "filter.unsupported"


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(sorted(X.DECODERS)), st.integers(0, 15))
def test_any_bytes_are_decoded(data, name, predictor):
    run(data, name, predictor=predictor, columns=3, most=10_000)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_coders_invert(data):
    assert run(encoders.lzw(data), "LZWDecode")[0] == data
    assert run(encoders.run_length(data), "RunLengthDecode")[0] == data
