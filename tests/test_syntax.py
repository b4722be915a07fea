"""Lexing, numbers, strings, names, values and their tolerance."""

import re
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.functions import syntax as S


def read(data: bytes):
    told = []
    p = S.Parser(data, report=lambda *x: told.append(x[1]))
    return p.value(), told


@pytest.mark.parametrize(
    ("run", "value"),
    [
        (b"12", 12),
        (b"+5", 5),
        (b"--5", -5),
        (b"+-5", 5),
        (b"-+5", -5),
        (b".5", 0.5),
        (b"4.", 4.0),
        (b"-.25", -0.25),
        (b"007", 7),
        (b"9223372036854775807", 2**63 - 1),
        (b"9223372036854775808", float(2**63)),
        (b"1.2.3", None),
        (b"12abc", None),
        (b"-", None),
        (b".", None),
        (b"", None),
    ],
)
def test_numbers(run, value):
    found = S.parse_number(run)
    assert found == value and type(found) is type(value)


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        (b"a\\(b\\)", b"a(b)"),
        (b"\\n\\r\\t\\b\\f\\\\", b"\n\r\t\b\f\\"),
        (b"\\101\\60\\7x", b"A0\x07x"),
        (b"\\777", b"\xff"),
        (b"a\\\r\nb", b"ab"),
        (b"a\rb\r\nc", b"a\nb\nc"),
        (b"\\q", b"q"),
        (b"end\\", b"end"),
    ],
)
def test_literal_strings(raw, value):
    assert S.decode_literal(raw) == value


def test_hex_strings_and_names():
    assert S.decode_hex(b"48 65 6C6c 6F") == (b"Hello", 0)
    assert S.decode_hex(b"901FA") == (b"\x90\x1f\xa0", 0)
    assert S.decode_hex(b"4x8") == (b"H", 1)
    assert S.decode_name(b"A#20B#zz#4") == ("A B#zz#4", 2)


def test_values():
    value, told = read(b"<< /A [1 2.5 (x(y)z) <4142> /N#41 true false null 3 0 R] /B << /C 4 0 R >> % note\n /D -7 >>")
    assert value == {"A": [1, 2.5, b"x(y)z", b"AB", "NA", True, False, None, S.Ref(3, 0)], "B": {"C": S.Ref(4, 0)}, "D": -7}
    assert not told


@pytest.mark.parametrize(
    ("data", "value", "code"),
    [
        (b"<< /A 1 /A 2 >>", {"A": 2}, "syntax.key-repeated"),
        (b"<< /A 1 /A null >>", {}, "syntax.key-repeated"),
        (b"<< /A 1", {"A": 1}, "syntax.truncated-object"),
        (b"[1 2 endobj", [1, 2], "syntax.truncated-object"),
        (b"[1 5 0 obj", [1], "syntax.truncated-object"),
        (b"(open", b"open", "syntax.truncated-object"),
        (b"<41", b"A", "syntax.truncated-object"),
        (b"<4g1>", b"A", "syntax.hex-string-invalid"),
        (b"/A#1", "A#1", "syntax.name-escape-invalid"),
        (b"[1 foo 2]", [1, 2], "syntax.unexpected-token"),
        (b"<< 5 6 /A 1 >>", {"A": 1}, "syntax.unexpected-token"),
        (b"9" * 400 + b".0", None, "syntax.number-out-of-range"),
        (b"[" * 200 + b"]" * 200, None, "syntax.depth-exceeded"),
    ],
)
def test_tolerance(data, value, code):
    found, told = read(data)
    assert code in told
    if value is not None or code == "syntax.number-out-of-range":
        assert found == value


def test_text_of_strings():
    assert S.Text(b"\xfe\xff\x00A\x20\xac").text() == "A€"
    assert S.Text(b"\xff\xfeA\x00").text() == "A"
    assert S.Text(b"\xe9").text() == "é"


def test_typed_access():
    assert S.as_integer(4.0) == 4 and S.as_integer(4.5) is None and S.as_integer(True) is None
    assert S.as_number(3) == 3.0 and S.as_number(S.Name("x")) is None
    assert S.as_integer(1e300) is None and not math.isfinite(float("inf"))
    assert [S.kind_of(x) for x in (None, True, 1, 1.0, S.Name("a"), S.Text(b""), S.Ref(1, 0), [], {})] == [
        "null", "boolean", "integer", "real", "name", "string", "reference", "array", "dictionary",
    ]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_any_bytes_are_read(data):
    p = S.Parser(data)
    for _ in range(400):
        if p.value() is S.END:
            break
    assert p.pos <= len(data)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_written_strings_read_back(data):
    from quirelake.sources.builder import literal

    assert read(literal(data))[0] == data


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_written_texts_and_names_read_back(text):
    from quirelake.sources.builder import name, text_string

    text = text.encode("utf-8", "ignore").decode()
    assert read(text_string(text))[0].text() == text
    assert str(read(name(text))[0]).encode("latin-1").decode("utf-8") == text


PIECES = [b"/A", b"/A5", b"/A#42", b"/", b"/B", b"1", b"007", b"12345678901234567890", b"0", b"70000", b"R", b"R2", b"obj", b"endobj", b"true", b"null", b"foo", b"-4", b"+.5", b"(s)", b"<41>", b"[", b"]", b"<<", b">>", b"%c\n", b" ", b" ", b" ", b"\n", b"\x00", b"#"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=24), st.sampled_from([b"<<", b"["]), st.integers(0, 60))
def test_plain_entries_are_read_as_token_by_token(pieces, opening, cut):
    """Values, warnings and where reading ends are those without the short cut."""
    data = opening + b"".join(pieces)
    never = re.compile(rb"(?!)")

    def read(stop):
        told = []
        p = S.Parser(data, 0, stop, lambda *x: told.append(x))
        return repr(p.value()), p.pos, p.truncated, told

    for stop in (None, min(cut, len(data))):
        short = read(stop)
        entry, element = S._ENTRY, S._ELEMENT
        S._ENTRY = S._ELEMENT = never
        try:
            assert short == read(stop)
        finally:
            S._ENTRY, S._ELEMENT = entry, element
