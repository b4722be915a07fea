"""Encoders for the filters, used to build test files."""

from __future__ import annotations

import zlib


def raw_deflate(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, a clear at the start and where the table is full."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table: dict[bytes, int] = {bytes([k]): k for k in range(256)}
    following, width, word = 258, 9, b""
    put(256, 9)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = following
        following += 1
        width = _width(following + early - 1)
        if following >= 4094:
            put(256, width)
            table = {bytes([k]): k for k in range(256)}
            following, width = 258, 9
        word = data[k : k + 1]
    if word:
        put(table[word], width)
        following += 1
        width = _width(following + early - 1)
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def _width(reach: int) -> int:
    return 12 if reach >= 2048 else 11 if reach >= 1024 else 10 if reach >= 512 else 9


def run_length(data: bytes) -> bytes:
    """Runs of three or more equal bytes, other bytes as they are."""
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and not (end + 2 < n and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    out.append(128)
    return bytes(out)


def png_rows(data: bytes, columns: int) -> bytes:
    """Rows with the five PNG tags in turn; the last row may be short."""
    out, above = bytearray(), bytes(columns)
    for k, at in enumerate(range(0, len(data), columns)):
        line, tag = data[at : at + columns], k % 5
        out.append(tag)
        for i, c in enumerate(line):
            left = line[i - 1] if i else 0
            up = above[i]
            corner = above[i - 1] if i else 0
            near = left + up - corner
            a, b, d = abs(near - left), abs(near - up), abs(near - corner)
            paeth = left if a <= b and a <= d else up if b <= d else corner
            out.append(c - (0, left, up, (left + up) // 2, paeth)[tag] & 255)
        above = line
    return bytes(out)


def tiff_rows(data: bytes, columns: int) -> bytes:
    return b"".join(bytes(c - (line[i - 1] if i else 0) & 255 for i, c in enumerate(line)) for line in (data[at : at + columns] for at in range(0, len(data), columns)))
