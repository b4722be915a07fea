"""Stream filters: decoding with every fault reported and the good part kept.

``decode(raw, chain)`` applies a chain of steps and returns the data, the faults as
(code, severity, message) and whether an image or unknown filter left it encoded.
Output is bounded; what lies past the bound is left out and reported.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np

#: Bytes of a decoded stream, and steps of a chain, at most.
MAX_DECODED = 256 << 20
MAX_CHAIN = 64

#: Short names of filters, and the filters that hold images.
SHORT = {"A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode", "Fl": "FlateDecode", "LZW": "LZWDecode", "RL": "RunLengthDecode"}
IMAGE = frozenset({"DCTDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode"})


class Step(NamedTuple):
    name: str
    predictor: int = 1
    colors: int = 1
    bits: int = 8
    columns: int = 1
    early_change: int = 1


class Fault(NamedTuple):
    code: str
    severity: str
    message: str


def failed(message: str, severity: str = "Warning") -> Fault:
    return Fault("filter.failed", severity, message)


# -- Flate ----------------------------------------------------------------------


def _inflate(data: bytes, bits: int, most: int) -> tuple[bytes, str, int]:
    """Output, ending and bytes used. Data goes in by pieces with a copy of the state
    kept, so that a fault loses nothing: the faulting piece is replayed byte by byte."""
    state, out, size = zlib.decompressobj(bits), [], 0
    at, piece = 0, 4096
    while at < len(data) and not state.eof:
        before = state.copy()
        part = data[at : at + piece]
        try:
            got = state.decompress(part)
        except zlib.error as e:
            state = before
            for k in range(len(part)):
                try:
                    got = state.decompress(part[k : k + 1])
                except zlib.error:
                    break
                out.append(got)
            return b"".join(out)[:most], "checksum" if "incorrect data check" in str(e) else "corrupt", at + k
        out.append(got)
        size += len(got)
        at += len(part)
        if size > most:
            return b"".join(out)[:most], "bound", at
    if not state.eof:
        out.append(state.flush())
        return b"".join(out)[:most], "short", at
    return b"".join(out)[:most], "whole", at - len(state.unused_data)


def flate(data: bytes, most: int) -> tuple[bytes | None, list[Fault], bool]:
    """zlib data; else raw deflate; else either after leading white space. None if
    nothing decodes. The last value tells whether the bound was reached."""
    out, ending, at = _inflate(data, 15, most)
    if ending == "bound":
        return out, [], True
    if ending == "whole":
        return out, [], False
    if ending == "checksum":
        return out, [Fault("filter.checksum-mismatch", "Warning", "the checksum disagrees with the data")], False
    if ending == "short" and out:
        # Only the checksum missing, or data too? The raw form of the rest tells.
        tail = zlib.decompressobj(-15)
        try:
            tail.decompress(data[2:])
        except zlib.error:
            pass
        if tail.eof:
            return out, [failed("the checksum is missing", "Repair")], False
        return out, [failed("the data ends early")], False
    if ending == "corrupt" and out:
        return out, [failed(f"the data is corrupt at byte {at}")], False
    for start in (0, len(data) - len(data.lstrip(b"\x00\t\n\x0c\r "))):
        for bits in (-15, 15):
            if start == 0 and bits == 15:
                continue
            out, ending, _ = _inflate(data[start:], bits, most)
            # Raw deflate may hold nothing, as an empty content stream does.
            if (out or start == 0) and ending in ("whole", "bound", "checksum"):
                return out, [failed("the zlib header is missing or late", "Repair")], ending == "bound"
    if not data:
        return b"", [failed("there is no data")], False
    return None, [failed("the data is no zlib or deflate data")], False


# -- LZW -------------------------------------------------------------------------


def lzw(data: bytes, early: int, most: int) -> tuple[bytes, list[Fault], bool]:
    table: list[bytes] = [bytes([k]) for k in range(256)] + [b"", b""]
    out, size, width, previous = [], 0, 9, b""
    held = bits = 0
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, previous = 9, b""
            continue
        if code == 257:
            return b"".join(out)[:most], [], size > most
        if code < len(table):
            word = table[code]
        elif code == len(table) and previous:
            word = previous + previous[:1]
        else:
            return b"".join(out)[:most], [failed("a code is not defined")], size > most
        out.append(word)
        size += len(word)
        if size > most:
            return b"".join(out)[:most], [], True
        if previous and len(table) < 4096:
            table.append(previous + word[:1])
        previous = word
        reach = len(table) + early
        width = 12 if reach >= 2048 else 11 if reach >= 1024 else 10 if reach >= 512 else 9
    severity = "Repair" if bits < 8 and not held else "Warning"
    return b"".join(out)[:most], [failed("the end marker is missing", severity)], False


# -- ASCII and run-length ---------------------------------------------------------


def ascii85(data: bytes) -> tuple[bytes, list[Fault]]:
    faults: list[Fault] = []
    body = data.lstrip(b"\x00\t\n\x0c\r ")
    if body.startswith(b"<~"):
        faults.append(failed("an introducer stands before the data", "Repair"))
        body = body[2:]
    end = body.find(b"~")
    ended = end >= 0
    body = re.sub(rb"[\x00\t\n\x0c\r ]", b"", body[:end] if ended else body)
    strays = len(re.sub(rb"[!-uz]", b"", body))
    out, group, overflow = bytearray(), [], False
    for c in body:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 0x21 <= c <= 0x75:
            group.append(c - 33)
            if len(group) == 5:
                number = 0
                for g in group:
                    number = number * 85 + g
                overflow |= number >> 32 > 0
                out += (number & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
        elif c == 0x7A:
            strays += 1
    partial = bool(group)
    if len(group) == 1:
        faults.append(failed("a single digit ends the data"))
    elif group:
        keep, number = len(group) - 1, 0
        for g in group + [84] * (5 - len(group)):
            number = number * 85 + g
        overflow |= number >> 32 > 0
        out += (number & 0xFFFFFFFF).to_bytes(4, "big")[:keep]
    if strays:
        faults.append(failed(f"{strays} bytes encode nothing"))
    if overflow:
        faults.append(failed("a group is past 32 bits"))
    if not ended:
        faults.append(failed("the end marker is missing", "Warning" if partial else "Repair"))
    return bytes(out), faults


def ascii_hex(data: bytes) -> tuple[bytes, list[Fault]]:
    end = data.find(b">")
    body = data[:end] if end >= 0 else data
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", body)
    strays = len(re.sub(rb"[0-9A-Fa-f\x00\t\n\x0c\r ]", b"", body))
    faults = [failed(f"{strays} bytes encode nothing")] if strays else []
    odd = len(digits) % 2
    if end < 0:
        faults.append(failed("the end marker is missing", "Warning" if odd else "Repair"))
    return bytes.fromhex((digits + b"0" * odd).decode()), faults


def run_length(data: bytes, most: int) -> tuple[bytes, list[Fault], bool]:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n == 128:
            return bytes(out[:most]), [], len(out) > most
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            out += part
            at += 2 + n
            if len(part) <= n:
                return bytes(out[:most]), [failed("a run ends early")], len(out) > most
        else:
            if at + 1 >= len(data):
                return bytes(out[:most]), [failed("a run ends early")], len(out) > most
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        if len(out) > most:
            return bytes(out[:most]), [], True
    return bytes(out), [failed("the end marker is missing", "Repair")], False


# -- predictors --------------------------------------------------------------------


def predict(data: bytes, step: Step) -> tuple[bytes, list[Fault]]:
    """Undoes a predictor: 2 is TIFF's (8 bits only), any other above 1 PNG's."""
    if step.predictor <= 1:
        return data, []
    # What no parameter can be is read as the nearest that can, or as the default.
    step = step._replace(colors=min(max(step.colors, 1), 32), columns=max(step.columns, 1), bits=step.bits if step.bits in (1, 2, 4, 8, 16) else 8)
    unit = max(1, step.colors * step.bits // 8)
    row = (step.colors * step.bits * step.columns + 7) // 8
    if step.predictor == 2:
        if step.bits != 8:
            return data, []
        whole = len(data) // row * row
        lines = np.frombuffer(data[:whole], np.uint8).reshape(-1, step.columns, step.colors)
        head = np.cumsum(lines, axis=1, dtype=np.uint8).tobytes()
        rest = np.frombuffer(data[whole:], np.uint8)
        tail = bytearray(rest.tobytes())
        for k in range(step.colors, len(tail)):
            tail[k] = tail[k] + tail[k - step.colors] & 255
        return head + bytes(tail), []
    if len(data) < row + 1 and len(data) < 2:
        return data, [failed("a row of the predictor is longer than the data")] if data else []
    if row + 1 > len(data):
        return data, [failed("a row of the predictor is longer than the data")]
    out, above = [], np.zeros(row, np.uint8)
    for at in range(0, len(data), row + 1):
        tag = data[at]
        line = np.frombuffer(data[at + 1 : at + 1 + row], np.uint8)
        n = len(line)
        if tag == 2:
            line = line + above[:n]
        elif tag == 1:
            padded = np.zeros(-(-n // unit) * unit, np.uint8)
            padded[:n] = line
            line = np.cumsum(padded.reshape(-1, unit), axis=0, dtype=np.uint8).reshape(-1)[:n]
        elif tag in (3, 4):
            line = _by_neighbours(line.tobytes(), above.tobytes(), unit, tag)
        out.append(line.tobytes())
        if n == row:
            above = line
    return b"".join(out), []


def _by_neighbours(line: bytes, above: bytes, unit: int, tag: int) -> np.ndarray:
    out = bytearray(line)
    for k in range(len(out)):
        left = out[k - unit] if k >= unit else 0
        up = above[k]
        if tag == 3:
            guess = (left + up) // 2
        else:
            corner = above[k - unit] if k >= unit else 0
            near = left + up - corner
            a, b, c = abs(near - left), abs(near - up), abs(near - corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        out[k] = out[k] + guess & 255
    return np.frombuffer(bytes(out), np.uint8)


# -- chains ------------------------------------------------------------------------


class Chain(NamedTuple):
    """Steps to apply and how the chain ends: none, image, unsupported, not-a-name,
    not-a-filter-entry or limit."""

    steps: tuple[Step, ...]
    end: str
    end_name: str


def resolve_chain(entries: dict, get=lambda value: value, most: int = MAX_CHAIN) -> Chain:
    """The chain that a stream's dictionary asks for; ``get`` resolves references."""
    from quirelake.functions.syntax import Name, as_dictionary, as_integer

    named = get(entries.get("Filter", entries.get("F")))
    if named is None:
        return Chain((), "none", "")
    params = get(entries.get("DecodeParms", entries.get("DP")))
    names = named if isinstance(named, list) else [named]
    if not isinstance(named, (list, Name)):
        return Chain((), "not-a-filter-entry", "")
    lists = params if isinstance(params, list) else [params]
    steps: list[Step] = []
    for k, item in enumerate(names):
        name = get(item)
        if k >= most:
            return Chain(tuple(steps), "limit", "")
        if not isinstance(name, Name):
            return Chain(tuple(steps), "not-a-name", "")
        full = SHORT.get(name, str(name))
        if full == "Crypt":
            continue
        if full in IMAGE:
            return Chain(tuple(steps), "image", full)
        if full not in DECODERS:
            return Chain(tuple(steps), "unsupported", full)
        own = as_dictionary(get(lists[k])) if k < len(lists) else None
        number = lambda key, default, own=own: default if not own or (n := as_integer(get(own.get(key)))) is None else n
        steps.append(Step(full, number("Predictor", 1), number("Colors", 1), number("BitsPerComponent", 8), number("Columns", 1), number("EarlyChange", 1)))
    return Chain(tuple(steps), "none", "")


DECODERS = frozenset({"FlateDecode", "LZWDecode", "ASCII85Decode", "ASCIIHexDecode", "RunLengthDecode"})


def decode(data: bytes, chain: Chain, most: int = MAX_DECODED) -> tuple[bytes, list[Fault], bool]:
    """Decoded data, faults, and whether a filter was left alone."""
    faults: list[Fault] = []
    for step in chain.steps:
        over = False
        if step.name == "FlateDecode":
            got, found, over = flate(data, most)
            faults += found
            if got is None:
                return data, faults, True
        elif step.name == "LZWDecode":
            got, found, over = lzw(data, step.early_change, most)
            faults += found
        elif step.name == "RunLengthDecode":
            got, found, over = run_length(data, most)
            faults += found
        else:
            got, found = ascii85(data) if step.name == "ASCII85Decode" else ascii_hex(data)
            faults += found
            over, got = len(got) > most, got[:most]
        data = got
        if over:
            faults.append(Fault("limit.decoded-stream", "Warning", f"a stream decodes to more than {most} bytes"))
        if step.name in ("FlateDecode", "LZWDecode"):
            data, found = predict(data, step)
            faults += found
    if chain.end == "limit":
        faults.append(Fault("limit.filter-chain", "Warning", "a stream names too many filters"))
    elif chain.end in ("unsupported", "not-a-name", "not-a-filter-entry"):
        faults.append(Fault("filter.unsupported", "Warning", f"filter {chain.end_name or 'without a name'} is not known"))
    return data, faults, chain.end != "none"
