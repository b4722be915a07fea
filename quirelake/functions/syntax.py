"""Object syntax: characters, tokens, numbers, strings, names and values.

Values are plain Python: None, bool, int, float, ``Name``, ``Text`` (bytes of a string),
``Ref``, list, dict and ``Stream``. Reading never raises: what is out of place is told
to a diagnostics callback and read on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import NamedTuple

WHITE = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"

#: Containers nested deeper are passed over and read as null.
MAX_DEPTH = 128

#: Links of references that lead to references, at most.
MAX_LINKS = 32

_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_NUMBER = re.compile(rb"([+-]*)(\d*)(?:(\.)(\d*))?\Z")
_REST_OF_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_HEADER_AHEAD = re.compile(rb"\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
#: The plainest entries of a dictionary, and elements of an array, at one go: a name without
#: escapes, a reference, a whole number. Whatever else there is goes token by token.
_BLANK, _PLAIN = rb"[\x00\t\n\x0c\r ]", rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%#]"
_END_OF_RUN = rb"(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])"
_SIMPLE = rb"(?:(\d{1,9})" + _BLANK + rb"+(\d{1,4})" + _BLANK + rb"+R|(\d{1,18}))" + _END_OF_RUN
_ENTRY = re.compile(_BLANK + rb"*/(" + _PLAIN + rb"*)" + _END_OF_RUN + _BLANK + rb"*(?:" + _SIMPLE + rb"|/(" + _PLAIN + rb"*)" + _END_OF_RUN + rb")")
_ELEMENT = re.compile(_BLANK + rb"*" + _SIMPLE + rb"(?!" + _BLANK + rb"+\d+" + _BLANK + rb"+obj)")

_STRING_STOP = re.compile(rb"[()\\\r]")
_HEX_PAIR = re.compile(rb"#([0-9A-Fa-f]{2})")

Report = Callable[[str, str, str, int], None]


def ignore(severity: str, code: str, message: str, position: int) -> None:
    """The callback of those who don't want to know."""


class Name(str):
    """A name, its escapes read, as Latin-1 text."""

    __slots__ = ()


class Text(bytes):
    """A string's bytes; ``is_hex`` if it was written in angle brackets."""

    is_hex = False

    def text(self) -> str:
        """UTF-16 if a byte-order mark says so, otherwise Latin-1."""
        if self[:2] == b"\xfe\xff":
            return bytes(self[2:]).decode("utf-16-be", "replace")
        if self[:2] == b"\xff\xfe":
            return bytes(self[2:]).decode("utf-16-le", "replace")
        return self.decode("latin-1")


class Ref(NamedTuple):
    number: int
    generation: int


class Stream:
    """A stream's dictionary, and where its encoded bytes lie."""

    __slots__ = ("cut", "entries", "length", "start")

    def __init__(self, entries: dict, start: int, length: int, cut: bool = False):
        self.entries, self.start, self.length, self.cut = entries, start, length, cut


class Keyword(bytes):
    """A run of regular characters that is no value."""


END = Keyword(b"")


# -- scalars ----------------------------------------------------------------------


def parse_number(run: bytes) -> int | float | None:
    """The number that a whole run of characters is, or None. Several signs may stand in
    front, of which the first counts; an integer past 64 bits is a real."""
    m = _NUMBER.match(run)
    if not m or not (m[2] or m[4]):
        return None
    negative = m[1][:1] == b"-"
    if m[3] is None:
        value = int(m[2])
        value = -value if negative else value
        return value if -(1 << 63) <= value < 1 << 63 else float(value) if len(run) < 400 else math.inf
    try:
        real = float(m[2] + b"." + (m[4] or b"0")) if m[2] else float(b"0." + m[4])
    except OverflowError:
        real = math.inf
    return -real if negative else real


def decode_name(raw: bytes) -> tuple[str, int]:
    """Text of a name's characters, and how many ``#`` begin no escape."""
    if b"#" not in raw:
        return raw.decode("latin-1"), 0
    bad = raw.count(b"#") - len(_HEX_PAIR.findall(raw))
    return _HEX_PAIR.sub(lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"), bad


def decode_hex(raw: bytes) -> tuple[bytes, int]:
    """Bytes of a hexadecimal string, and how many strays it holds; an odd digit at the
    end is padded with 0."""
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
    strays = len(re.sub(rb"[0-9A-Fa-f\x00\t\n\x0c\r ]", b"", raw))
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), strays


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.)|\Z)|(\r\n?)", re.S)


def decode_literal(raw: bytes) -> bytes:
    """Bytes of a literal string: escapes read, ends of line as LF."""
    if b"\\" not in raw and b"\r" not in raw:
        return raw

    def one(m: re.Match) -> bytes:
        if m[1]:
            return bytes([int(m[1], 8) & 255])
        if m[2]:
            return b""
        if m[3]:
            return _ESCAPES.get(m[3], m[3])
        return b"\n" if m[4] else b""

    return _ESCAPE.sub(one, raw)


# -- tokens and values --------------------------------------------------------------


class Parser:
    """Reads tokens and values of ``data`` from ``pos`` up to ``stop``."""

    def __init__(self, data: bytes, pos: int = 0, stop: int | None = None, report: Report = ignore, base: int = 0):
        self.data, self.pos, self.report, self.base = data, pos, report, base
        self.stop = len(data) if stop is None else stop
        self.at = pos  # where the last token began
        #: Containers or strings that ended before they were whole.
        self.truncated = 0

    def warn(self, code: str, message: str, position: int | None = None) -> None:
        self.report("Warning", code, message, (self.at if position is None else position) - self.base)

    def skip(self) -> int:
        pos = self.pos
        if pos < self.stop:
            c = self.data[pos]
            if c > 37 or 32 < c < 37:
                return pos
            if c == 32 and pos + 1 < self.stop and self.data[pos + 1] > 37:
                self.pos = pos + 1
                return pos + 1
        self.pos = min(_SKIP.match(self.data, self.pos, self.stop).end(), self.stop)
        return self.pos

    def token(self) -> object:
        """The next token: a scalar value, or a Keyword such as ``<<`` or ``obj``."""
        data, at = self.data, self.skip()
        self.at = at
        if at >= self.stop:
            return END
        c = data[at : at + 1]
        if c not in b"()<>[]{}/%":
            end = _REGULAR.match(data, at, self.stop).end()
            run = data[at:end]
            self.pos = end
            if c in b"0123456789+-.":
                if len(run) < 19 and run.isdigit():
                    return int(run)
                number = parse_number(run)
                if number is not None:
                    return number
            return Keyword(run)
        if c == b"/":
            end = _REGULAR.match(data, at + 1, self.stop).end()
            self.pos = end
            text, bad = decode_name(data[at + 1 : end])
            if bad:
                self.warn("syntax.name-escape-invalid", "a # in a name is not followed by two hexadecimal digits")
            return Name(text)
        if c == b"(":
            return self._literal(at + 1)
        if c == b"<":
            if data[at + 1 : at + 2] == b"<" and at + 1 < self.stop:
                self.pos = at + 2
                return Keyword(b"<<")
            return self._hex(at + 1)
        if c == b">" and data[at + 1 : at + 2] == b">" and at + 1 < self.stop:
            self.pos = at + 2
            return Keyword(b">>")
        self.pos = at + 1
        return Keyword(c)

    def _literal(self, at: int) -> Text:
        depth, pos, data = 1, at, self.data
        while True:
            m = _STRING_STOP.search(data, pos, self.stop)
            if not m:
                self.pos = self.stop
                self.truncated += 1
                self.warn("syntax.truncated-object", "a string is not closed")
                return Text(decode_literal(data[at : self.stop]))
            pos = m.end()
            if m[0] == b"(":
                depth += 1
            elif m[0] == b"\\":
                pos += 1
            elif m[0] == b")":
                depth -= 1
                if not depth:
                    self.pos = pos
                    return Text(decode_literal(data[at : pos - 1]))

    def _hex(self, at: int) -> Text:
        end = self.data.find(b">", at, self.stop)
        if end < 0:
            self.truncated += 1
            self.warn("syntax.truncated-object", "a hexadecimal string is not closed")
            end = self.stop
        raw, strays = decode_hex(self.data[at:end])
        if strays:
            self.warn("syntax.hex-string-invalid", f"{strays} bytes of a hexadecimal string are no digits")
        self.pos = min(end + 1, self.stop)
        value = Text(raw)
        value.is_hex = True
        return value

    def value(self, depth: int = 0) -> object:
        """The next value; a Keyword if there is none."""
        return self._value(self.token(), depth)

    def _value(self, token: object, depth: int) -> object:
        if isinstance(token, Keyword):
            if token == b"<<":
                return self._dictionary(depth)
            if token == b"[":
                return self._array(depth)
            if token == b"true":
                return True
            if token == b"false":
                return False
            if token == b"null":
                return None
            return token
        if type(token) is int and token >= 0:
            m = _REST_OF_REF.match(self.data, self.pos, self.stop)
            if m and token < 1 << 31 and int(m[1]) <= 65535:
                self.pos = m.end()
                return Ref(token, int(m[1]))
        if type(token) is float and not math.isfinite(token):
            self.warn("syntax.number-out-of-range", "a real number is past what a double holds")
            return None
        return token

    def _ends_container(self, token: Keyword) -> bool:
        """Whether a container can't go on here: end of input, or the object's end."""
        return token is END or token in (b"endobj", b"endstream", b"stream", b"obj") or token == b""

    def _next_object(self) -> bool:
        at = self.skip()
        return self.data[at : at + 1].isdigit() and bool(_HEADER_AHEAD.match(self.data, at, self.stop))

    def _cut_short(self, what: str) -> None:
        self.truncated += 1
        self.warn("syntax.truncated-object", f"{what} ended before it was whole")

    def _array(self, depth: int) -> object:
        if depth >= MAX_DEPTH:
            return self._pass_over()
        out: list = []
        while True:
            while m := _ELEMENT.match(self.data, self.pos, self.stop):
                number, generation, whole = m.groups()
                out.append(int(whole) if whole is not None else Ref(int(number), int(generation)))
                self.pos = m.end()
            if self._next_object():
                self._cut_short("an array")
                return out
            token = self.token()
            if isinstance(token, Keyword):
                if token == b"]":
                    return out
                if self._ends_container(token) or token == b">>":
                    self.pos = self.at
                    self._cut_short("an array")
                    return out
            item = self._value(token, depth + 1)
            if isinstance(item, Keyword):
                self.warn("syntax.unexpected-token", f"{bytes(item[:20])!r} in an array")
                continue
            out.append(item)

    def _dictionary(self, depth: int) -> object:
        if depth >= MAX_DEPTH:
            return self._pass_over()
        out: dict = {}
        given: set[str] = set()
        while True:
            while m := _ENTRY.match(self.data, self.pos, self.stop):
                raw, number, generation, whole, name = m.groups()
                key = Name(raw.decode("latin-1"))
                if key in given:
                    break
                given.add(key)
                out[key] = int(whole) if whole is not None else Ref(int(number), int(generation)) if number is not None else Name(name.decode("latin-1"))
                self.pos = m.end()
            if self._next_object():
                self._cut_short("a dictionary")
                return out
            key = self.token()
            if isinstance(key, Keyword):
                if key == b">>":
                    return out
                if self._ends_container(key):
                    self.pos = self.at
                    self._cut_short("a dictionary")
                    return out
            if not isinstance(key, Name):
                self._value(key, depth + 1)
                self.warn("syntax.unexpected-token", "a dictionary's key is no name")
                continue
            before = self.skip()
            value = self.value(depth + 1)
            if isinstance(value, Keyword):
                if value in (b">>", b"]") or self._ends_container(value):
                    self.pos = before
                    if value == b"]":
                        self.pos = self.skip() + 1
                else:
                    self.warn("syntax.unexpected-token", f"{bytes(value[:20])!r} as a value")
                value = None
            if key in given:
                self.warn("syntax.key-repeated", f"/{key} is given again", before)
            given.add(key)
            if value is None:
                out.pop(key, None)
            else:
                out.pop(key, None)
                out[key] = value

    def _pass_over(self) -> None:
        """Skips a container that is nested too deep; its opening token is read."""
        self.warn("syntax.depth-exceeded", f"containers are nested deeper than {MAX_DEPTH}")
        open_ = 1
        while open_:
            token = self.token()
            if isinstance(token, Keyword):
                if token in (b"<<", b"["):
                    open_ += 1
                elif token in (b">>", b"]"):
                    open_ -= 1
                elif self._ends_container(token):
                    self.pos = self.at
                    return


# -- typed access ---------------------------------------------------------------------


def as_integer(value: object) -> int | None:
    """An integer, or a real that is integral and fits 64 bits."""
    if type(value) is int:
        return value
    if type(value) is float and value.is_integer() and abs(value) < 1 << 63:
        return int(value)
    return None


def as_number(value: object) -> float | None:
    return float(value) if type(value) in (int, float) else None


def as_dictionary(value: object) -> dict | None:
    """A dictionary, or a stream's."""
    return value.entries if isinstance(value, Stream) else value if isinstance(value, dict) else None


def kind_of(value: object) -> str:
    if value is None:
        return "null"
    for kind, name in ((bool, "boolean"), (int, "integer"), (float, "real"), (Name, "name"), (Text, "string"), (Ref, "reference"), (list, "array"), (dict, "dictionary"), (Stream, "stream")):
        if isinstance(value, kind):
            return name
    return "keyword"
