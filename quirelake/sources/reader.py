"""One file's bytes as facts: header, index sections and rows, objects, diagnostics.

``PdfFile(data).open()`` reads eagerly and never raises on damaged input: an index that
can't be read is rebuilt by scanning for object headers, objects a few bytes off are
found near their offset, and each repair becomes a diagnostic with a stable code.
Offsets count from the ``%PDF-`` header.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

from quirelake.functions import filters
from quirelake.functions.syntax import MAX_LINKS, Keyword, Name, Parser, Ref, Stream, as_dictionary, as_integer

_W = rb"[\x00\t\n\x0c\r ]"
_R = rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]"
HEADER = re.compile(rb"(?<!" + _R + rb")(\d{1,10})" + _W + rb"+(\d{1,5})" + _W + rb"+obj(?!" + _R + rb")")
_STARTXREF = re.compile(rb"startxref" + _W + rb"*([+-]?\d+)")
_XREF = re.compile(_W + rb"*xref(?!" + _R + rb")")
_ENDSTREAM_NEXT = re.compile(rb"(?:" + _W + rb"+(?:%[^\r\n]*[\r\n]" + _W + rb"*)*)?endstream")
_ENDOBJ_NEXT = re.compile(rb"(?:" + _W + rb"|%[^\r\n]*[\r\n])*endobj(?!" + _R + rb")")
_ROW = re.compile(_W + rb"*(\d{1,18})" + _W + rb"+(\d{1,10})" + _W + rb"+([nf])(?!" + _R + rb")")
_SPACE = re.compile(_W + rb"*")
_VERSION = re.compile(rb"(\d\.\d)(?=[\x00\t\n\x0c\r %]|\Z)")

#: How far from a named offset an object or section is still looked for.
NEAR = 512

#: Searches for the end of streams read the file so often at most; past that
#: a search goes no further than this many bytes.
SEARCH_PASSES = 4
SEARCH_HELD = 64 << 10

#: Bytes of head and tail in which header and startxref are looked for.
ENDS = 4096


@dataclass(frozen=True)
class Limits:
    """Bounds of a reading; what passes one is left out and reported."""

    decoded_stream: int = 256 << 20
    raw_stream: int = 256 << 20
    object_length: int = 16 << 20
    section_length: int = 64 << 20
    sections: int = 1024
    trailer_length: int = 64 << 10
    index_entries: int = 8_388_607
    filter_chain: int = 64
    rebuild_passes: int = 4
    object_stream_decodes: int = 4
    diagnostics: int = 1000
    #: Whether a bound that is passed, or an encrypted file, ends the reading: the file is
    #: then a row whose open_error names the bound.
    strict: bool = False
    refuse_encrypted: bool = False


class Refused(Exception):
    """A strict reading met a bound or an encrypted file."""


@dataclass
class Entry:
    obj: int
    kind: str  # free, regular or compressed
    offset: int = 0
    gen: int = 0
    objstm: int = 0
    idx: int = 0
    section: int = -1
    row: int = 0
    found: bool = False
    refused: bool = False


@dataclass
class Section:
    ordinal: int
    named_by: str
    named_offset: int
    offset: int = -1
    kind: str = ""  # table or stream
    state: str = "NotFound"  # Read, Malformed or NotFound
    fault: str = ""
    trailer_fault: str = ""
    incomplete: bool = False
    no_subsection: bool = False
    unconfirmed: bool = False
    relocated: bool = False
    reserved_rows: int = 0
    highest: int = -1
    size: int | None = None
    prev: int | None = None
    xrefstm: int | None = None
    revision: int = 0
    wrong_values: list[str] = field(default_factory=list)
    trailer: dict = field(default_factory=dict)
    entries: list[Entry] = field(default_factory=list)


class PdfFile:
    def __init__(self, data: bytes, limits: Limits = Limits()):
        self.data, self.limits = data, limits
        self.diagnostics: list[tuple[str, str, str, int]] = []
        self.suppressed = 0
        self.codes: Counter[tuple[str, str]] = Counter()  # of all that is reported, kept or not
        self.header_pos: int | None = None
        self.header_version: str | None = None
        self.base = 0
        self.startxref_pos: int | None = None
        self.startxref: int | None = None
        self.sections: list[Section] = []
        self.chain_read = False
        self.loop_offset: int | None = None
        self.chain_cut = False
        self.chain_entries: list[Entry] = []
        self.index: dict[int, Entry] = {}
        self.trailer: dict = {}
        self.root_named: object = None
        self.root_usable = False
        self.catalog_found_as: int | None = None
        self.was_repaired = False
        self.is_encrypted = False
        self.open_error: str | None = None
        self.objects: dict[int, object] = {}
        self.facts: dict[int, dict] = {}
        self.members: dict[int, dict] = {}
        self._loading: set[int] = set()
        self._offsets: list[int] | None = None
        self._headers: list[tuple[int, int, int]] | None = None
        self._cut: set[int] = set()  # where objects begin that a bound cut short
        self._decodes: dict[int, int] = {}
        self._searched = 0
        self._places: dict[tuple[int, int], tuple[str, int, int]] = {}
        self._last_header: dict[int, int] | None = None

    # -- diagnostics ---------------------------------------------------------------

    def report(self, severity: str, code: str, message: str, position: int = -1) -> None:
        self.codes[severity, code] += 1
        if self.limits.strict and code.startswith("limit."):
            raise Refused(code)
        if len(self.diagnostics) < self.limits.diagnostics:
            self.diagnostics.append((severity, code, message, position))
        else:
            self.suppressed += 1

    # -- opening -------------------------------------------------------------------

    def open(self) -> PdfFile:
        if not self.data:
            self.open_error = "empty"
            return self
        self._detect_header()
        self._find_startxref()
        if self.startxref is not None:
            self._read_chain(self.startxref)
        self.chain_entries = [e for s in self.sections for e in s.entries]
        self.root_named = self.trailer.get("Root")
        if not self.chain_read or not self.index or not self._lossless():
            self._rebuild("the file's index can't be read whole")
        elif not self._usable_catalog():
            if not self._search_catalog():
                self._rebuild("the index leads to no catalog")
        elif self._any_lost():
            self._rebuild("an entry places no object")
        self.root_usable = self._usable_catalog()
        self._decide_encryption()
        if self.is_encrypted and self.limits.refuse_encrypted:
            raise Refused("encrypted")
        if not self.index:
            self.open_error = "no-object"
        return self

    def _detect_header(self) -> None:
        at = self.data.find(b"%PDF-", 0, ENDS)
        if at < 0:
            self.report("Repair", "header.missing", "no header in the first 4,096 bytes", 0)
            return
        self.header_pos = self.base = at
        m = _VERSION.match(self.data, at + 5, ENDS + 5)
        self.header_version = m[1].decode() if m else None
        if at:
            self.report("Repair", "xref.offset-adjusted", f"the header stands at byte {at}, from which offsets are counted", at)

    def _find_startxref(self) -> None:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - ENDS))
        m = _STARTXREF.match(self.data, at) if at >= 0 else None
        if m:
            self.startxref_pos = at
            value = int(m[1])
            self.startxref = value if 0 <= value < 1 << 62 else -1

    def _lossless(self) -> bool:
        """Whether the first section was read, which names the rest."""
        return bool(self.sections) and self.sections[0].state == "Read"

    def _usable_catalog(self) -> bool:
        root = as_dictionary(self.resolve(self.trailer.get("Root")))
        return root is not None and (root.get("Type") == "Catalog" or "Pages" in root)

    def _any_lost(self) -> bool:
        return any(e.kind == "regular" and n and self._place(n, e)[0] == "NotFound" for n, e in self.index.items())

    def _decide_encryption(self) -> None:
        if "Encrypt" not in self.trailer:
            return
        self.is_encrypted = as_dictionary(self.resolve(self.trailer["Encrypt"])) is not None
        if not self.is_encrypted:
            self.report("Warning", "trailer.encrypt-invalid", "/Encrypt gives no dictionary")
        elif self.was_repaired:
            self.report("Warning", "trailer.encrypt-late", "the rebuilt trailer holds an /Encrypt")

    # -- the chain of sections -------------------------------------------------------

    def _read_chain(self, start: int) -> None:
        """Sections from ``start`` on: a table's rows, its stream's, then the older."""
        seen: set[int] = set()
        named: set[int] = set()
        offset, by, revision = start, "startxref", 0
        while True:
            if len(self.sections) >= self.limits.sections:
                self.chain_cut = True
                self.report("Warning", "limit.xref-section-count", f"more than {self.limits.sections} sections")
                break
            section = self._section(offset, by, revision)
            if section.offset in seen and section.state == "Read" or offset in named:
                self.loop_offset = offset
                self.report("Warning", "xref.chain-cycle", f"the chain comes back to {offset}", offset)
                break
            named.add(offset)
            seen.add(section.offset)
            self.sections.append(section)
            if section.state != "Read":
                break
            self._take(section)
            if section.kind == "table" and section.xrefstm is not None:
                hybrid = self._section(section.xrefstm, "XRefStm", revision)
                if hybrid.kind != "stream" or hybrid.state == "NotFound" or hybrid.offset in seen:
                    hybrid.state = "NotFound" if hybrid.kind != "stream" else hybrid.state
                    hybrid.fault = "hybrid"
                    self.report("Warning", "xref.hybrid-stream-lost", "/XRefStm leads to no stream of its revision", section.xrefstm)
                    hybrid.entries = []
                else:
                    seen.add(hybrid.offset)
                hybrid.ordinal = len(self.sections)
                self.sections.append(hybrid)
                self._take(hybrid)
            if section.prev is None:
                break
            offset, by, revision = section.prev, "Prev", revision + 1
        first = self.sections[0] if self.sections else None
        self.chain_read = first is not None and first.state == "Read"

    def _take(self, section: Section) -> None:
        """The section's rows and trailer, where no newer section gave them."""
        for e in section.entries:
            if e.obj not in self.index:
                if len(self.index) >= self.limits.index_entries:
                    self.report("Warning", "limit.index-entries", "the index is full")
                    break
                self.index[e.obj] = e if not e.refused else Entry(e.obj, "free", section=e.section, row=e.row)
        for key, value in section.trailer.items():
            self.trailer.setdefault(key, value)

    def _section(self, offset: int, by: str, revision: int) -> Section:
        s = Section(len(self.sections), by, offset, revision=revision)
        found = self._section_at(s, self.base + offset) if 0 <= offset else False
        if not found and by != "startxref" and 0 <= offset:
            for place, clean in self._near_sections(self.base + offset):
                known = next((x for x in self.sections if x.offset == place - self.base), None)
                if known is not None:
                    if known.named_by == "XRefStm":
                        self.report("Warning", "xref.stream-passed-over", f"the stream near {offset} is a newer table's own", known.offset)
                    continue
                found = self._section_at(s, place)
                if found:
                    s.unconfirmed, s.relocated = not clean, True
                    self.report("Repair", "xref.offset-adjusted", f"the section named at {offset} lies at {s.offset}", s.offset)
                    break
        if not found:
            self.report("Warning", "xref.section-missing", f"no section at {offset}, where {by} names one", offset)
        elif s.state == "Malformed" or s.incomplete:
            self.report("Warning", "xref.section-unreadable", f"the section at {s.offset} can't be read whole", s.offset)
        if s.no_subsection:
            self.report("Repair", "xref.section-empty", "a table has no subsection", s.offset)
        if s.reserved_rows:
            self.report("Warning", "xref.entry-reserved", f"{s.reserved_rows} rows are of a reserved type", s.offset)
        return s

    def _near_sections(self, at: int) -> list[tuple[int, bool]]:
        low, high = max(0, at - NEAR), min(len(self.data), at + NEAR)
        places = [m.start() for m in re.finditer(rb"(?<!start)(?<!" + _R + rb")xref(?!" + _R + rb")", self.data[low:high])]
        spots = [low + p for p in places]
        for m in HEADER.finditer(self.data, low, high):
            head = self.data[m.end() : m.end() + 400]
            if re.search(rb"/Type" + _W + rb"*/XRef(?!" + _R + rb")", head):
                spots.append(m.start())
        clean = lambda p: not self._in_comment(p)
        return sorted(((p, clean(p)) for p in spots), key=lambda x: (not x[1], abs(x[0] - at), x[0]))[:32]

    def _in_comment(self, at: int) -> bool:
        line = max(self.data.rfind(b"\n", 0, at), self.data.rfind(b"\r", 0, at)) + 1
        return b"%" in self.data[line:at]

    def _section_at(self, s: Section, at: int) -> bool:
        if at >= len(self.data):
            return False
        m = _XREF.match(self.data, at)
        if m:
            s.kind, s.offset = "table", m.end() - 4 - self.base
            self._table(s, m.end())
            return True
        start = _SPACE.match(self.data, at).end()
        m = HEADER.match(self.data, start)
        if not m:
            return False
        value = self._parse_object(m, None)[0]
        if not isinstance(value, Stream) or not (value.entries.get("Type") == "XRef" or "W" in value.entries):
            return False
        if value.entries.get("Type") != "XRef" and not self._stream_rows(Section(0, "", 0), value):
            return False
        s.kind, s.offset = "stream", start - self.base
        self._stream_section(s, value)
        return True

    def _trailer_number(self, s: Section, key: str) -> int | None:
        """An integer of a trailer; how it is written, if not directly as one, is noted."""
        value = s.trailer.get(key)
        if value is None:
            return None
        if isinstance(value, Ref):
            s.wrong_values.append(key)
            value = self.resolve(value) if self.index else None
        number = as_integer(value)
        if type(value) is float:
            s.wrong_values.append(key)
        return number

    def _read_trailer_values(self, s: Section) -> None:
        s.size = self._trailer_number(s, "Size")
        s.prev = self._trailer_number(s, "Prev")
        if s.kind == "table" and "XRefStm" in s.trailer:
            s.xrefstm = as_integer(self.resolve(s.trailer["XRefStm"]))

    def _table(self, s: Section, at: int) -> None:
        """A classic table: rows as tokens, then the trailer."""
        p = Parser(self.data, at, min(len(self.data), at + self.limits.section_length), self.report, self.base)
        s.state = "Read"
        subsections = 0
        while True:
            back = p.skip()
            first = p.token()
            if isinstance(first, Keyword):
                if first == b"trailer":
                    self._table_trailer(s, p, "")
                else:
                    p.pos = back
                    self._table_trailer(s, p, "missing")
                break
            count = p.token()
            if type(first) is not int or type(count) is not int or first < 0 or count < 0 or first + count > 1 << 31:
                s.state, s.fault = "Malformed", "subsection header"
                return
            subsections += 1
            if not self._subsection(s, p, first, count):
                back = p.data.find(b"trailer", p.pos)
                if back < 0:
                    s.trailer_fault = "missing"
                else:
                    p.pos = back + 7
                    self._table_trailer(s, p, "")
                break
        s.no_subsection = not subsections and s.state == "Read"
        if p.stop < len(self.data) and (s.incomplete or s.trailer_fault) and p.pos >= p.stop - 20:
            self.report("Warning", "limit.xref-section-length", "a section is longer than the bound", s.offset)

    def _subsection(self, s: Section, p: Parser, first: int, count: int) -> bool:
        for k in range(count):
            back = p.pos
            m = _ROW.match(p.data, back, p.stop)
            if m:
                p.pos = m.end()
                offset, gen, mark = int(m[1]), int(m[2]), Keyword(m[3])
            else:
                offset, gen, mark = p.token(), p.token(), p.token()
            if type(offset) is not int or type(gen) is not int or mark not in (b"n", b"f") or not isinstance(mark, Keyword):
                p.pos = back
                s.incomplete = True
                return False
            e = Entry(first + k, "regular" if mark == b"n" else "free", offset, gen, section=s.ordinal, row=len(s.entries))
            e.refused = gen > 65535 or gen < 0 or offset < 0
            s.entries.append(e)
            s.highest = max(s.highest, first + k)
        return True

    def _table_trailer(self, s: Section, p: Parser, fault: str) -> None:
        before = len(self.diagnostics)
        at = p.skip()
        if p.data[at : at + 2] != b"<<":
            s.trailer_fault = fault or "malformed"
            return
        whole, p.stop = p.stop, min(p.stop, at + self.limits.trailer_length)
        value = p.value()
        if p.truncated and p.stop < whole:
            self.report("Warning", "limit.trailer", "a trailer is longer than the bound", at - self.base)
        p.stop = whole
        s.trailer = value if isinstance(value, dict) else {}
        told = {code for _, code, _, _ in self.diagnostics[before:]}
        s.trailer_fault = fault or ("malformed" if any(c.startswith("syntax.") for c in told) or p.truncated else "")
        self._read_trailer_values(s)

    def _stream_section(self, s: Section, stream: Stream) -> None:
        s.trailer = {k: v for k, v in stream.entries.items() if k not in ("Length", "Filter", "DecodeParms", "W", "Index", "Type")}
        for key in ("Type", "Index", "W", "Filter", "DecodeParms"):
            if isinstance(stream.entries.get(key), Ref):
                s.wrong_values.append(key)
        s.state = "Read" if self._stream_rows(s, stream) else "Malformed"
        self._read_trailer_values(s)

    def _stream_rows(self, s: Section, stream: Stream) -> bool:
        d = {k: self.resolve(v) for k, v in stream.entries.items()}
        widths = [as_integer(w) for w in d.get("W") or []] if isinstance(d.get("W"), list) else []
        if len(widths) < 3 or any(w is None or w < 0 or w > 64 for w in widths[:3]) or not sum(widths[:3]):
            s.fault = "widths"
            return False
        size = as_integer(d.get("Size"))
        pairs = d.get("Index") if isinstance(d.get("Index"), list) else [0, size if size is not None else 0]
        numbers = [as_integer(self.resolve(x)) for x in pairs]
        if len(numbers) % 2 or any(n is None or n < 0 for n in numbers):
            s.fault = "numbering"
            return False
        data = self.decode(stream)[0]
        a, b, c = widths[:3]
        at = 0
        for first, count in zip(numbers[::2], numbers[1::2]):
            for k in range(count):
                row = data[at : at + a + b + c]
                if len(row) < a + b + c:
                    s.incomplete = True
                    return True
                at += a + b + c
                kind = int.from_bytes(row[:a], "big") if a else 1
                two, three = int.from_bytes(row[a : a + b], "big"), int.from_bytes(row[a + b :], "big")
                e = Entry(first + k, "free", section=s.ordinal, row=len(s.entries))
                if kind == 1:
                    e.kind, e.offset, e.gen = "regular", min(two, (1 << 63) - 1), min(three, 1 << 31)
                    e.refused = three > 65535
                elif kind == 2:
                    e.kind, e.objstm, e.idx = "compressed", min(two, 1 << 31), min(three, 1 << 31)
                    e.refused = not 0 < two < 1 << 31
                elif kind == 0:
                    e.offset, e.gen = min(two, (1 << 63) - 1), min(three, 1 << 31)
                else:
                    s.reserved_rows += 1
                s.entries.append(e)
                s.highest = max(s.highest, first + k)
        return True

    # -- objects ---------------------------------------------------------------------

    def headers(self) -> list[tuple[int, int, int]]:
        """(position from the header, number, generation) of every object header that
        stands between objects."""
        if self._headers is None:
            self._headers = [(m.start() - self.base, int(m[1]), int(m[2])) for m, _ in self._scan()]
        return self._headers

    def _place(self, number: int, e: Entry) -> tuple[str, int, int]:
        """Where the object of a regular entry begins: (AtOffset, Nearby or NotFound,
        position, generation written there)."""
        known = self._places.get((number, e.offset))
        if known is None:
            known = self._places[number, e.offset] = self._look(number, e)
        return known

    def _look(self, number: int, e: Entry) -> tuple[str, int, int]:
        at = self.base + e.offset
        if 0 <= at < len(self.data):
            m = HEADER.match(self.data, _SPACE.match(self.data, at).end())
            if m and int(m[1]) == number:
                return "AtOffset", m.start(), int(m[2])
        best = None
        for m in HEADER.finditer(self.data, max(0, at - NEAR), min(len(self.data), at + NEAR)):
            if int(m[1]) == number:
                rank = (self._in_comment(m.start()), abs(m.start() - at), m.start())
                if best is None or rank < best[0]:
                    best = (rank, m)
        if best is None:
            return "NotFound", -1, -1
        return "Nearby", best[1].start(), int(best[1][2])

    def get(self, number: int) -> object:
        """The object of a number; None where there is none, or it can't be produced."""
        if number in self.objects:
            return self.objects[number]
        e = self.index.get(number)
        if e is None or e.kind == "free" or not number:
            return None
        if number in self._loading:
            self.report("Warning", "stream.self-reference", f"object {number} needs itself to be read")
            return None
        self._loading.add(number)
        try:
            value, fact = self._load_regular(number, e) if e.kind == "regular" else self._load_member(number, e)
        finally:
            self._loading.discard(number)
        self.objects[number], self.facts[number] = value, fact
        return value

    def _load_regular(self, number: int, e: Entry) -> tuple[object, dict]:
        place, at, gen = self._place(number, e)
        fact = {"source": "direct", "offset": at - self.base, "gen": gen, "endobj_missing": False, "presence": "defined"}
        if not 0 <= self.base + e.offset < len(self.data):
            self.report("Warning", "xref.entry-out-of-range", f"object {number} is placed outside the file", e.offset)
        if place == "NotFound":
            return None, fact | {"offset": -1, "gen": e.gen, "presence": "unproduced"}
        if place == "Nearby":
            self.report("Repair", "xref.offset-adjusted", f"object {number} lies at {at - self.base}, not at {e.offset}", at - self.base)
        value, ended = self._parse_object(HEADER.match(self.data, at), number)
        cut = at in self._cut
        return value, fact | {"endobj_missing": not ended and not cut, "cut": cut}

    def _parse_object(self, m: re.Match, number: int | None) -> tuple[object, bool]:
        """The value after a header, and whether ``endobj`` follows it. Sets _end."""
        stop = min(len(self.data), m.end() + self.limits.object_length)
        p = Parser(self.data, m.end(), stop, self.report if number is not None else _silent, self.base)
        back = p.skip()
        value = p.value()
        if p.truncated and stop < len(self.data):
            self._cut.add(m.start())
            if number is not None:
                self.report("Warning", "limit.object", f"object {number} is longer than the bound", m.start() - self.base)
        if isinstance(value, Keyword):
            if value == b"endobj":
                self._end = p.pos
                return None, True
            p.pos, value = back, None
        if isinstance(value, dict):
            at = p.skip()
            if self.data[at : at + 6] == b"stream" and at + 6 <= stop:
                start = at + 6
                if self.data[start : start + 2] == b"\r\n":
                    start += 2
                elif self.data[start : start + 1] in (b"\n", b"\r"):
                    start += 1
                value, p.pos = self._stream(value, start, number)
        m = _ENDOBJ_NEXT.match(self.data, p.pos)
        self._end = m.end() if m else p.pos
        # Data that runs to the end of the file hides whether an endobj was there.
        return value, bool(m) or (isinstance(value, Stream) and p.pos >= len(self.data))

    def _declared(self, entries: dict) -> int | None:
        length = entries.get("Length")
        if isinstance(length, Ref):
            if self.index:
                length = self.resolve(length)
            else:  # no index yet: the last header of that number in the file
                if self._last_header is None:
                    self._last_header = {int(m[1]): m.end() for m in HEADER.finditer(self.data)}
                at = self._last_header.get(length.number)
                length = Parser(self.data, at).value() if at is not None else None
        return as_integer(length)

    def _stop(self, start: int) -> int:
        """Where data from ``start`` ends at the latest: the next placed offset, the next
        header, the end."""
        if self._offsets is None:
            self._offsets = sorted({self.base + e.offset for e in self.index.values() if e.kind == "regular"})
        k = bisect_right(self._offsets, start)
        placed = self._offsets[k] if k < len(self._offsets) else len(self.data)
        m = HEADER.search(self.data, start, placed)
        return m.start() if m else placed

    def _find_end(self, start: int, stop: int) -> int:
        """The next ``endstream``, or -1. What all searches of the file may read is bounded:
        else a file of many streams without an end takes the square of its length."""
        if self._searched >= SEARCH_PASSES * len(self.data):
            stop = min(stop, start + SEARCH_HELD)
        at = self.data.find(b"endstream", start, stop)
        self._searched += (at if at >= 0 else stop) - start
        return at

    def _stream(self, entries: dict, start: int, number: int | None) -> tuple[Stream, int]:
        tell = self.report if number is not None else _silent
        declared = self._declared(entries)
        usable = declared is not None and declared >= 0 and start + declared <= len(self.data)
        if usable and self.data[start + declared : start + declared + 1] != b"%":
            m = _ENDSTREAM_NEXT.match(self.data, start + declared)
            if m:
                return Stream(entries, start, declared), m.end()
        stop = self._stop(start)
        end = self._find_end(start, stop)
        if end < 0 and stop < len(self.data):
            # A header inside the data is no stop if no object ends before it.
            later = self._find_end(start, len(self.data))
            if later >= 0 and b"endobj" not in self.data[start:later] and stop not in (self._offsets or ()):
                end = later
        if end >= 0:
            tell("Warning", "stream.length-invalid", "/Length is not where the data ends", start - self.base)
            cut = end
            if self.data[cut - 2 : cut] == b"\r\n" and cut - 2 >= start:
                cut -= 2
            elif cut > start and self.data[cut - 1 : cut] in (b"\n", b"\r"):
                cut -= 1
            return Stream(entries, start, cut - start), end + 9
        if usable and start + declared <= stop and _ENDOBJ_NEXT.match(self.data, start + declared):
            tell("Warning", "stream.truncated", "no endstream follows the data", start - self.base)
            return Stream(entries, start, declared), start + declared
        last = self.data.rfind(b"endobj", start, stop)
        if last >= 0 and not self.data[last + 6 : stop].strip(b"\x00\t\n\x0c\r "):
            tell("Warning", "stream.truncated", "no endstream follows the data", start - self.base)
            cut = last - 1 if last > start and self.data[last - 1 : last] in (b"\n", b"\r") else last
            return Stream(entries, start, cut - start), last
        if usable and start + declared <= stop:
            tell("Warning", "stream.length-invalid", "no endstream follows the data", start - self.base)
            return Stream(entries, start, declared), start + declared
        code = "stream.truncated" if stop == len(self.data) else "stream.length-invalid"
        tell("Warning", code, "the data runs to where the next object begins, or the file ends", start - self.base)
        return Stream(entries, start, stop - start), stop

    # -- object streams ----------------------------------------------------------------

    def container(self, number: int) -> dict:
        """An object stream's header: members, decoded data, and a fault if any."""
        if number in self.members:
            return self.members[number]
        self._decodes[number] = self._decodes.get(number, 0) + 1
        if self._decodes[number] > self.limits.object_stream_decodes:
            self.report("Warning", "limit.object-stream-decodes", f"object stream {number} was decoded often enough")
            return {"numbers": [], "offsets": [], "data": b"", "first": 0, "fault": "limit"}
        out = {"numbers": [], "offsets": [], "data": b"", "first": 0, "fault": ""}
        e = self.index.get(number)
        value = self.get(number) if e is not None and e.kind == "regular" else None
        if value is None:
            out["fault"] = "missing"
        elif not isinstance(value, Stream) or self.resolve(value.entries.get("Type")) != "ObjStm":
            out["fault"] = "type"
        else:
            n, first = (as_integer(self.resolve(value.entries.get(k))) for k in ("N", "First"))
            if n is None or first is None or n < 0 or first < 0:
                out["fault"] = "header"
            elif n:
                out["data"], out["first"] = self.decode(value)[0], first
                p, last = Parser(out["data"], 0, min(first, len(out["data"]))), -1
                for _ in range(n):
                    obj, offset = p.token(), p.token()
                    if type(obj) is not int or type(offset) is not int or obj < 0 or offset <= last or first + offset >= len(out["data"]):
                        out["fault"] = "header"
                        break
                    out["numbers"].append(obj)
                    out["offsets"].append(offset)
                    last = offset
        if out["fault"]:
            self.report("Warning", "object-stream.unreadable", f"object stream {number}: {out['fault']}")
        self.members[number] = out
        return out

    def _load_member(self, number: int, e: Entry) -> tuple[object, dict]:
        fact = {"source": "objstm", "offset": -1, "gen": 0, "endobj_missing": False, "presence": "defined", "objstm": e.objstm}
        c = self.container(e.objstm)
        k = e.idx if e.idx < len(c["numbers"]) and c["numbers"][e.idx] == number else -1
        if k < 0:
            if number not in c["numbers"]:
                return None, fact | {"presence": "unproduced"}
            k = c["numbers"].index(number)
            self.report("Repair", "object-stream.member-moved", f"object {number} is at {k} of its object stream, not at {e.idx}")
        start = c["first"] + c["offsets"][k]
        stop = c["first"] + c["offsets"][k + 1] if k + 1 < len(c["offsets"]) else len(c["data"])
        p = Parser(c["data"], start, stop, self.report)
        value = p.value()
        if isinstance(value, Keyword):
            value = None
        if isinstance(value, dict) and c["data"][p.skip() : p.pos + 6] == b"stream":
            self.report("Warning", "object-stream.member-stream", f"object {number} is written as a stream in an object stream")
            return None, fact | {"presence": "unproduced"}
        return value, fact

    def resolve(self, value: object) -> object:
        for _ in range(MAX_LINKS):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.number)
        return None

    def decode(self, stream: Stream, report: bool = True) -> tuple[bytes, filters.Chain, list[filters.Fault], bool]:
        raw = self.data[stream.start : stream.start + min(stream.length, self.limits.raw_stream)]
        chain = filters.resolve_chain(stream.entries, self.resolve, self.limits.filter_chain)
        data, faults, left = filters.decode(raw, chain, self.limits.decoded_stream)
        if stream.length > self.limits.raw_stream:
            faults.append(filters.Fault("limit.stream-length", "Warning", "a stream is longer than the bound"))
        if report:
            for f in faults:
                self.report(f.severity, f.code, f.message, stream.start - self.base)
        return data, chain, faults, left

    # -- rebuilding ----------------------------------------------------------------------

    def _scan(self) -> list[tuple[re.Match, object]]:
        """Headers between objects with the values after them, by position."""
        out, at = [], 0
        index, self.index, self._offsets = self.index, {}, None
        try:
            while m := HEADER.search(self.data, at):
                if self._in_gap_comment(at, m.start()) or int(m[1]) == 0 or int(m[1]) > 0x7FFFFFFF or int(m[2]) > 65535:
                    at = m.end()
                    continue
                value, _ = self._parse_object(m, None)
                out.append((m, value))
                at = max(self._end, m.end())
        finally:
            self.index, self._offsets = index, None
        return out

    def _in_gap_comment(self, gap: int, at: int) -> bool:
        line = max(self.data.rfind(b"\n", gap, at), self.data.rfind(b"\r", gap, at)) + 1
        return b"%" in self.data[max(line, gap) : at]

    def _rebuild(self, why: str) -> None:
        if self.was_repaired:
            return
        if self.limits.rebuild_passes < 1:
            self.report("Warning", "limit.rebuild-reads", "the file may not be read again")
            return
        self.was_repaired = True
        self.report("Repair", "xref.rebuilt", f"the index is rebuilt by scanning: {why}")
        scanned = self._scan()
        self._headers = [(m.start() - self.base, int(m[1]), int(m[2])) for m, _ in scanned]
        self.objects, self.facts, self.members = {}, {}, {}
        chain, index = self.index, {}
        again = 0
        containers: list[tuple[int, int]] = []
        trailers: list[tuple[int, dict]] = []
        for m, value in scanned:
            number = int(m[1])
            again += number in index
            index[number] = Entry(number, "regular", m.start() - self.base, int(m[2]), found=True)
            d = as_dictionary(value)
            if isinstance(value, Stream) and d.get("Type") == "ObjStm":
                containers.append((m.start(), number))
            if isinstance(value, Stream) and d.get("Type") == "XRef":
                trailers.append((m.start(), {k: v for k, v in d.items() if k in ("Root", "Info", "Encrypt", "ID", "Size")}))
        self.index = index
        for at, number in containers:
            if index[number].offset + self.base != at:
                continue
            for k, member in enumerate(self.container(number)["numbers"]):
                old = index.get(member)
                if old is not None and (old.kind == "regular" and old.offset + self.base > at):
                    continue
                again += old is not None
                index[member] = Entry(member, "compressed", objstm=number, idx=k, found=True)
        if self.chain_read and self.chain_cut:
            # A bound cut the chain, not the file: its entries hold where the scan found none.
            for number, e in chain.items():
                if e.kind != "free" and number not in index:
                    if len(index) >= self.limits.index_entries:
                        self.report("Warning", "limit.index-entries", "the index is full")
                        break
                    index[number] = e
        if again:
            self.report("Information", "object.redefined", f"{again} objects are defined again later in the file")
        for m in re.finditer(rb"(?<!" + _R + rb")trailer(?!" + _R + rb")", self.data):
            if self._in_comment(m.start()):
                continue
            p = Parser(self.data, m.end(), None, _silent, self.base)
            if self.data[p.skip() : p.pos + 2] == b"<<":
                value = p.value()
                if isinstance(value, dict):
                    trailers.append((m.start(), value))
            else:
                self.report("Warning", "syntax.unexpected-token", "a trailer is no dictionary", m.start() - self.base)
        self.trailer, old = {}, self.trailer
        for _, trailer in sorted(trailers, key=lambda t: -t[0]):
            for key, value in trailer.items():
                if key not in ("Prev", "XRefStm"):
                    self.trailer.setdefault(key, value)
        for key, value in old.items():
            if key not in ("Prev", "XRefStm"):
                self.trailer.setdefault(key, value)
        if not self._usable_catalog():
            self._search_catalog()

    def _search_catalog(self) -> bool:
        best = None
        for number in sorted(self.index):
            d = self.get(number)
            if isinstance(d, dict) and d.get("Type") == "Catalog":
                best = number
        if best is None:
            return False
        self.catalog_found_as = best
        self.trailer["Root"] = Ref(best, 0)
        self.report("Repair", "trailer.root-recovered", f"object {best} is taken as the catalog")
        return True

    # -- derived facts --------------------------------------------------------------------

    def catalog(self) -> dict | None:
        return as_dictionary(self.resolve(self.trailer.get("Root")))

    def declared_version(self) -> str | None:
        """The later of the header's version and the catalog's; None without a header's."""
        if self.header_version is None:
            return None
        own = self.resolve((self.catalog() or {}).get("Version"))
        return max(self.header_version, str(own)) if isinstance(own, Name) and re.fullmatch(r"\d\.\d", own) else self.header_version

    def load_all(self) -> PdfFile:
        for number in sorted(self.index):
            self.get(number)
        return self

    def nodes(self, holders: tuple[int, ...] | None = None):
        """(holder, order, path, parent path, key, element, depth, value) of every value:
        the trailer's under holder 0, then each object's, depth first; or of ``holders``."""
        if holders is None or 0 in holders:
            yield from _walk(0, {k: v for k, v in self.trailer.items() if k not in ("Prev", "XRefStm")})
        for number in sorted(self.index if holders is None else self.index.keys() & set(holders)):
            if self.index[number].kind != "free" and number:
                yield from _walk(number, self.get(number))


def _walk(holder: int, value: object):
    order = 0
    stack = [("", None, None, None, 0, value)]
    while stack:
        path, parent, key, elem, depth, value = stack.pop()
        yield holder, order, path, parent, key, elem, depth, value
        order += 1
        inner = value.entries if isinstance(value, Stream) else value
        if isinstance(inner, dict):
            stack.extend((f"{path}/{k}", path, str(k), None, depth + 1, v) for k, v in reversed(inner.items()))
        elif isinstance(inner, list):
            stack.extend((f"{path}[{k}]", path, None, k, depth + 1, v) for k, v in reversed(list(enumerate(inner))))


def _silent(severity: str, code: str, message: str, position: int = -1) -> None:
    pass
