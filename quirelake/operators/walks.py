"""Per-file walks as table functions: tokens, and the entries of name and number trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.display import show
from quirelake.functions.syntax import END, Keyword, Parser, Ref, Text, as_dictionary, as_integer, kind_of
from quirelake.sources.reader import HEADER, PdfFile


def _per_file(files: DataFrame, rows_of, columns: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    names = [n for n, _ in fields]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, x in zip(b.column("doc_id").to_pylist(), b.column("content")):
                rows = list(zip(*rows_of(x.as_py() or b""))) or [[] for _ in names]
                arrays = [pa.array(c, t) for c, (_, t) in zip(rows, fields)]
                yield pa.record_batch([pa.array([doc] * len(arrays[0]), pa.int64()), *arrays], ["doc_id", *names])

    return files.select(F.col("doc_id").cast("long"), "content").mapInArrow(kernel, "doc_id long, " + columns)


def token_rows(data: bytes) -> list[tuple]:
    """(object, order, kind, start, end, shown) of the tokens of each object that the
    index places; a stream's data is passed over."""
    f = PdfFile(data).open()
    out = []
    for n, e in sorted(f.index.items()):
        if e.kind != "regular" or not n:
            continue
        _, at, _ = f._place(n, e)
        m = HEADER.match(f.data, at) if at >= 0 else None
        if not m:
            continue
        p, order = Parser(f.data, m.end()), 0
        while True:
            token = p.token()
            if token is END or token in (b"stream", b"endobj") and isinstance(token, Keyword):
                break
            kind = "keyword" if isinstance(token, Keyword) else kind_of(token)
            out.append((n, order, kind, p.at - f.base, p.pos - f.base, bytes(token).decode("latin-1") if isinstance(token, Keyword) else show(token)))
            order += 1
    return out


def tokens(files: DataFrame) -> DataFrame:
    fields = [("obj", pa.int64()), ("ord", pa.int32()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("shown", pa.string())]
    return _per_file(files, token_rows, "obj long, ord int, kind string, start long, stop long, shown string", fields)


def tree_rows(data: bytes) -> list[tuple]:
    """(tree, order, name, number, target, kind) of the entries of the catalog's name and
    number trees, in order; a node is expanded once, however many name it."""
    f = PdfFile(data).open()
    catalog = (f.catalog() or {}) if f.open_error is None else {}
    names = as_dictionary(f.resolve(catalog.get("Names"))) or {}
    trees = [(key, value, "Names") for key, value in names.items()]
    trees += [(key, catalog[key], "Nums") for key in ("PageLabels",) if key in catalog]
    out = []
    for tree, root, leaf in trees:
        seen: set[int] = set()
        stack, order = [root], 0
        while stack:
            value = stack.pop()
            if isinstance(value, Ref):
                if value.number in seen:
                    continue
                seen.add(value.number)
            node = as_dictionary(f.resolve(value)) or {}
            pairs = f.resolve(node.get(leaf))
            pairs = pairs if isinstance(pairs, list) else []
            for key, item in zip(pairs[::2], pairs[1::2]):
                key = f.resolve(key)
                out.append((tree, order, key.text() if isinstance(key, Text) else None, as_integer(key), item.number if isinstance(item, Ref) else None, kind_of(f.resolve(item))))
                order += 1
            kids = f.resolve(node.get("Kids"))
            stack.extend(reversed(kids) if isinstance(kids, list) else [])
    return out


def tree_entries(files: DataFrame) -> DataFrame:
    fields = [("tree", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("number", pa.int64()), ("target", pa.int64()), ("kind", pa.string())]
    return _per_file(files, tree_rows, "tree string, ord int, name string, number long, target long, kind string", fields)
