"""How values and counts are shown: printable ASCII, bounded."""

from __future__ import annotations

from quirelake.functions.syntax import Name, Ref, Stream, Text


def quote(data: bytes, most: int = 60) -> str:
    """Bytes as printable ASCII; others as ``\\xNN``; cut with an ellipsis."""
    shown = "".join(chr(c) if 32 <= c < 127 and c != 92 else f"\\x{c:02X}" for c in data[:most])
    return shown + ("..." if len(data) > most else "")


def count_of(n: int, noun: str, plural: str | None = None) -> str:
    """``1 object``, ``12,345 objects``."""
    return f"{n:,} {noun if n == 1 else plural or noun + 's'}"


def show(value: object, most: int = 120) -> str:
    """A value in one bounded line."""
    text = _show(value, 0)
    return text if len(text) <= most else text[: most - 3] + "..."


def _show(value: object, depth: int) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Name):
        return "/" + quote(value.encode("latin-1", "replace"))
    if isinstance(value, Text):
        return f"<{value.hex().upper()[:80]}>" if value.is_hex else f"({quote(value)})"
    if isinstance(value, Ref):
        return f"{value.number} {value.generation} R"
    if isinstance(value, Stream):
        return f"{_show(value.entries, depth)} stream of {count_of(value.length, 'byte')}"
    if isinstance(value, (dict, list)) and depth > 3:
        return "<<...>>" if isinstance(value, dict) else "[...]"
    if isinstance(value, dict):
        return "<< " + "".join(f"/{k} {_show(v, depth + 1)} " for k, v in list(value.items())[:12]) + ("... " if len(value) > 12 else "") + ">>"
    if isinstance(value, list):
        return "[" + " ".join(_show(v, depth + 1) for v in value[:12]) + (" ..." if len(value) > 12 else "") + "]"
    return repr(value)
