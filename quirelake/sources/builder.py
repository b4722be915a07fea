"""Writes PDF bytes from numbered object bodies: the fixtures of tests and queries.

``build(bodies, ...)`` lays the objects out and indexes them by a classic table, a
cross-reference stream or none; ``update`` appends a revision; ``damaged`` applies a
named damage. The output depends on the arguments alone.
"""

from __future__ import annotations

import re
import zlib

Bodies = dict[int, bytes]

DAMAGES = ("no-xref", "shifted-offsets", "truncated-tail", "junk-prefix", "lying-length", "no-header", "no-eof", "no-startxref", "wrong-startxref", "bad-version", "junk-version")


def literal(data: bytes) -> bytes:
    """A literal string of any bytes."""
    return b"(" + re.sub(rb"[()\\]", lambda m: b"\\" + m[0], data).replace(b"\r", b"\\r") + b")"


def text_string(text: str) -> bytes:
    """Latin-1 where that suffices and reads back alike, else UTF-16BE, as hex."""
    try:
        raw = text.encode("latin-1")
        if raw[:2] not in (b"\xfe\xff", b"\xff\xfe"):
            return literal(raw)
    except UnicodeEncodeError:
        pass
    return b"<FEFF" + text.encode("utf-16-be", "surrogatepass").hex().upper().encode() + b">"


def name(text: str) -> bytes:
    """A name; what is not printable or delimits is escaped."""
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in text.encode("utf-8"))


def stream(data: bytes, entries: bytes = b"", length: int | None = None) -> bytes:
    return b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data) if length is None else length, entries, data)


def flate_stream(data: bytes, entries: bytes = b"") -> bytes:
    return stream(zlib.compress(data), b"/Filter /FlateDecode " + entries)


def _object(number: int, body: bytes, gen: int = 0) -> bytes:
    return b"%d %d obj\n%s\nendobj\n" % (number, gen, body)


def _table(places: dict[int, tuple[int, int]], free_head: bool = True) -> bytes:
    """Rows of a classic table, in runs of following numbers."""
    rows = {0: (0, 65535, b"f")} if free_head else {}
    rows |= {n: (at, gen, b"n") for n, (at, gen) in places.items()}
    out, numbers = [b"xref\n"], sorted(rows)
    start = 0
    for k in range(1, len(numbers) + 1):
        if k == len(numbers) or numbers[k] != numbers[k - 1] + 1:
            run = numbers[start:k]
            out.append(b"%d %d\n" % (run[0], len(run)))
            out += [b"%010d %05d %s \n" % rows[n] for n in run]
            start = k
    return b"".join(out)


def build(
    bodies: Bodies,
    root: int = 1,
    version: str = "1.7",
    index: str = "table",
    packed: Bodies | None = None,
    trailer: bytes = b"",
    offset_error: int | dict[int, int] = 0,
    gens: dict[int, int] | None = None,
    size: int | None = None,
    root_entry: bytes | None = None,
) -> bytes:
    """A whole file. ``packed`` objects go into one object stream, which needs ``index``
    "stream"; ``offset_error`` is added to written offsets, of all objects or of some."""
    out = bytearray(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % version.encode())
    bodies, gens = dict(bodies), gens or {}
    top = max([*bodies, *(packed or {}), 0])
    members: list[int] = []
    container = 0
    if packed:
        container, members = top + 1, sorted(packed)
        top = container
        head, at = [], 0
        for n in members:
            head.append(b"%d %d" % (n, at))
            at += len(packed[n]) + 1
        first = b" ".join(head) + b"\n"
        bodies[container] = flate_stream(first + b"\n".join(packed[n] for n in members) + b"\n", b"/Type /ObjStm /N %d /First %d " % (len(members), len(first)))
    places: dict[int, tuple[int, int]] = {}
    for n in sorted(bodies):
        places[n] = (len(out), gens.get(n, 0))
        out += _object(n, bodies[n])
    wrong = offset_error if isinstance(offset_error, dict) else dict.fromkeys(places, offset_error)
    places = {n: (at + wrong.get(n, 0), gen) for n, (at, gen) in places.items()}
    entry = b"/Root %d 0 R " % root if root_entry is None else root_entry
    at = len(out)
    if index == "table":
        out += _table(places) + b"trailer\n<< /Size %d %s%s>>\n" % (top + 1 if size is None else size, entry, trailer)
    elif index == "stream":
        number = top + 1
        places[number] = (at, 0)
        rows = bytearray(b"\x00" + bytes(4) + b"\xff\xff")
        listed = sorted({*places, *members})
        for n in listed:
            if n in members:
                rows += b"\x02" + container.to_bytes(4, "big") + members.index(n).to_bytes(2, "big")
            else:
                rows += b"\x01" + places[n][0].to_bytes(4, "big") + places[n][1].to_bytes(2, "big")
        numbers = [0, *listed]
        runs, start = [], 0
        for k in range(1, len(numbers) + 1):
            if k == len(numbers) or numbers[k] != numbers[k - 1] + 1:
                runs.append(b"%d %d" % (numbers[start], k - start))
                start = k
        out += _object(number, flate_stream(bytes(rows), b"/Type /XRef /W [1 4 2] /Index [%s] /Size %d %s%s" % (b" ".join(runs), number + 1 if size is None else size, entry, trailer)))
    if index != "none":
        out += b"startxref\n%d\n%%%%EOF\n" % at
    else:
        out += b"%%EOF\n"
    return bytes(out)


def update(data: bytes, bodies: Bodies, root: int = 1, size: int | None = None, loop: bool = False, trailer: bytes = b"") -> bytes:
    """``data`` with a revision appended that gives ``bodies`` anew; with ``loop`` its
    /Prev names itself."""
    previous = int(re.findall(rb"startxref\s+(\d+)", data)[-1])
    out = bytearray(data)
    places: dict[int, tuple[int, int]] = {}
    for n in sorted(bodies):
        places[n] = (len(out), 0)
        out += _object(n, bodies[n])
    at = len(out)
    sizes = [int(x) for x in re.findall(rb"/Size (\d+)", data)]
    top = max([*sizes, max(bodies, default=0) + 1]) if size is None else size
    out += _table(places, False) + b"trailer\n<< /Size %d /Root %d 0 R /Prev %d %s>>\nstartxref\n%d\n%%%%EOF\n" % (top, root, at if loop else previous, trailer, at)
    return bytes(out)


def damaged(data: bytes, damage: str) -> bytes:
    """A named damage done to a whole file."""
    if damage == "no-xref":
        at = data.rfind(b"\nxref")
        return data[: at if at >= 0 else data.rfind(b"startxref")] + b"\n%%EOF\n"
    if damage == "shifted-offsets":
        at = data.index(b"\n") + 1
        return data[:at] + b"% a line that nobody counted with\n" + data[at:]
    if damage == "truncated-tail":
        return data[: len(data) * 82 // 100]
    if damage == "junk-prefix":
        return b"HTTP/1.1 200 OK\r\nContent-Type: application/pdf\r\n\r\n" + data
    if damage == "lying-length":
        m = re.search(rb"/Length (\d+)", data)
        return data if not m else data[: m.start(1)] + str(max(1, int(m[1]) // 3)).encode().rjust(len(m[1]), b"0") + data[m.end(1) :]
    if damage == "no-header":
        return b"#" * 9 + data[9:]
    if damage == "no-eof":
        return data.replace(b"%%EOF", b"%%end")
    if damage == "no-startxref":
        return data.replace(b"startxref", b"startnone")
    if damage == "wrong-startxref":
        return re.sub(rb"startxref\n\d+", b"startxref\n5", data)
    if damage == "bad-version":
        return data.replace(b"%PDF-1.7", b"%PDF-1.8", 1)
    if damage == "junk-version":
        return data.replace(b"%PDF-1.7\n", b"%PDF-x.y\n", 1)
    return data


# -- documents made of pages --------------------------------------------------------


def page_bodies(pages: int, contents: list[bytes] | None = None, info: bytes | None = None, catalog: bytes = b"") -> Bodies:
    """Catalog 1, page tree 2, page 3+2i and its content 4+2i; the tree gives the box
    and the resources. With ``info``, an information dictionary follows."""
    kids = b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(pages))
    bodies = {
        1: b"<< /Type /Catalog /Pages 2 0 R %s>>" % catalog,
        2: b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] /Resources << >> >>" % (kids, pages),
    }
    for i in range(pages):
        bodies[3 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i)
        bodies[4 + 2 * i] = stream(contents[i] if contents else b"q Q")
    if info is not None:
        bodies[3 + 2 * pages] = info
    return bodies
