"""Files as relations: one parsing kernel per file, then ``explode``.

``parse(files)`` takes (doc_id, content) and gives one row of nested arrays per file;
``Tables`` names the relations in it. A file that can't be opened is a row with
``open_error``; no input fails a task. Parallelism is over files; with ``want`` only
the named parts are computed.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.functions.syntax import Name, Ref, Stream, Text, as_dictionary, kind_of
from quirelake.operators import joins, page_tree, shapes
from quirelake.sources.reader import HEADER, Limits, PdfFile, Refused, _walk

#: Column types of each relation.
SCHEMAS = {
    "structure": "length long, header_pos long, header_version string, header_named string, declared_version string, eof_marker boolean, startxref_pos long, startxref long,"
    " chain_read boolean, chain_empty boolean, loop_offset long, chain_cut boolean, root_usable boolean, root_named_usable boolean, has_root boolean, catalog_found_as int,"
    " was_repaired boolean, is_encrypted boolean, object_count int, page_count int, page_root int, tree_whole boolean, open_error string, suppressed long",
    "sections": "ordinal int, named_by string, named_offset long, offset long, kind string, state string, fault string, trailer_fault string, incomplete boolean, no_subsection boolean,"
    " unconfirmed boolean, relocated boolean, reserved_rows long, highest long, size long, prev long, xrefstm long, revision int, wrong_values array<string>",
    "xref_entries": "section int, row_ord long, obj long, kind string, offset long, lands long, gen long, objstm long, idx long, refused boolean",
    "headers": "pos long, obj long, gen int, clean boolean",
    "index": "obj long, kind string, offset long, gen long, objstm long, idx long, found_by_reader boolean",
    "members": "objstm long, idx int, obj long",
    "containers": "objstm long, fault string, listed int",
    "objects": "obj long, gen int, source string, offset long, kind string, type_name string, subtype string, data_offset long, raw_length long, endobj_missing boolean, cut boolean, presence string, reachable boolean, visit int",
    "nodes": "holder long, ord int, path string, parent_path string, key string, elem int, depth int, kind string, i long, d double, b boolean, name string, bytes binary, is_hex boolean, ref_obj long, ref_gen int",
    "trailers": "section int, ord int, path string, parent_path string, key string, kind string, i long, d double, name string, ref_obj long, ref_gen int",
    "streams": "obj long, filters array<string>, chain_end string, decoded binary, decoded_length long, left_encoded boolean, faults array<struct<code:string,severity:string,message:string>>",
    "pages": "page_index int, obj long, parent long, mediabox array<double>, has_resources boolean, path array<int>",
    "tree_faults": "seq int, rule_id string, severity string, obj long, page_index int, detail string",
    "diagnostics": "seq long, severity string, code string, message string, position long",
    "codes": "severity string, code string, n long",
    "kinds": "kind string, n int",
    "breaches": "seq int, rule_id string, type string, key string, obj long, page_index int, detail string",
}
PARTS = tuple(SCHEMAS)


def _arrow(ddl: str) -> pa.StructType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T._parse_datatype_string(ddl))


# -- one file ----------------------------------------------------------------------


def structure_of(f: PdfFile) -> dict:
    root = f.trailer.get("Root")
    named = as_dictionary(f.resolve(f.root_named)) if f.root_named is not None else None
    pages = (as_dictionary(f.resolve(root)) or {}).get("Pages")
    at = f.header_pos
    return {
        "length": len(f.data),
        "header_pos": at,
        "header_version": f.header_version,
        "header_named": None if at is None else re.match(rb"[^\x00\t\n\x0c\r %]*", f.data[at + 5 : at + 64])[0].decode("latin-1"),
        "declared_version": f.declared_version(),
        "eof_marker": b"%%EOF" in f.data[-1024:],
        "startxref_pos": f.startxref_pos,
        "startxref": f.startxref,
        "chain_read": f.chain_read,
        "chain_empty": f.chain_read and not f.chain_entries,
        "loop_offset": f.loop_offset,
        "chain_cut": f.chain_cut,
        "root_usable": f.root_usable,
        "root_named_usable": named is not None and (named.get("Type") == "Catalog" or "Pages" in named),
        "has_root": f.root_named is not None,
        "catalog_found_as": f.catalog_found_as,
        "was_repaired": f.was_repaired,
        "is_encrypted": f.is_encrypted,
        "object_count": sum(e.kind != "free" for n, e in f.index.items() if n),
        "page_root": page_tree.target(f, pages) if as_dictionary(f.resolve(pages)) is not None else None,
        "open_error": f.open_error,
        "suppressed": f.suppressed,
    }


def node_row(holder: int, order: int, path: str, parent: str | None, key: str | None, elem: int | None, depth: int, value: object) -> dict:
    kind = kind_of(value)
    return {
        "holder": holder,
        "ord": order,
        "path": path,
        "parent_path": parent,
        "key": key,
        "elem": elem,
        "depth": depth,
        "kind": kind,
        "i": value if kind == "integer" else None,
        "d": value if kind == "real" else None,
        "b": value if kind == "boolean" else None,
        "name": str(value) if kind == "name" else None,
        "bytes": bytes(value) if kind == "string" else None,
        "is_hex": value.is_hex if isinstance(value, Text) else None,
        "ref_obj": value.number if isinstance(value, Ref) else None,
        "ref_gen": value.generation if isinstance(value, Ref) else None,
    }


def reach(f: PdfFile) -> dict[int, int]:
    """Visit order of every object that references lead to from the trailer."""
    seen: dict[int, int] = {}
    stack: list[object] = [{k: v for k, v in f.trailer.items() if k not in ("Prev", "XRefStm")}]
    while stack:
        value = stack.pop()
        if isinstance(value, Ref):
            if value.number not in seen:
                e = f.index.get(value.number)
                if e is not None and e.kind != "free" and value.number:
                    seen[value.number] = len(seen)
                    stack.append(f.get(value.number))
        elif isinstance(value, (dict, Stream)):
            stack.extend(reversed(as_dictionary(value).values()))
        elif isinstance(value, list):
            stack.extend(reversed(value))
    return seen


#: Relations that every object must be read for.
OF_OBJECTS = {"objects", "nodes", "streams", "diagnostics", "codes", "containers", "members", "kinds", "breaches"}


def facts_of(data: bytes, want: frozenset[str], limits: Limits = Limits(), holders: tuple[int, ...] | None = None, model: dict | None = None) -> dict:
    """The wanted relations of one file; of ``nodes`` those in ``holders`` alone. A file that
    strict limits refuse has none, and an open_error that says why."""
    try:
        return _facts(PdfFile(data, limits).open(), want, holders, model)
    except Refused as refused:
        f = PdfFile(b"")
        f.open_error = str(refused)
        return _facts(f, want, holders, model) | ({"structure": structure_of(f) | {"length": len(data), "tree_whole": False, "page_count": 0}} if "structure" in want else {})


def _facts(f: PdfFile, want: frozenset[str], holders: tuple[int, ...] | None, model: dict | None) -> dict:
    out: dict = {}
    if f.open_error is None and want & (OF_OBJECTS if holders is None else OF_OBJECTS - {"nodes"}):
        f.load_all()
    walk = page_tree.Walk(f) if want & {"pages", "tree_faults", "structure"} and f.open_error is None else None
    if "pages" in want:
        out["pages"] = [] if walk is None else [{"page_index": i, "obj": n, "parent": p, "mediabox": box, "has_resources": r, "path": list(path)} for i, n, p, box, r, path in walk.pages]
    if "tree_faults" in want:
        out["tree_faults"] = [] if walk is None else [
            {"seq": k, "rule_id": rule, "severity": page_tree.FAULTS[rule], "obj": n, "page_index": page, "detail": detail} for k, (rule, n, page, detail) in enumerate(walk.faults)
        ]
    if "sections" in want:
        out["sections"] = [
            {n: getattr(s, n) for n in ("ordinal", "named_by", "named_offset", "offset", "kind", "state", "fault", "trailer_fault", "incomplete", "no_subsection", "unconfirmed", "relocated", "reserved_rows", "highest", "size", "prev", "xrefstm", "revision", "wrong_values")}
            for s in f.sections
        ]
    if "xref_entries" in want:
        out["xref_entries"] = [
            {"section": e.section, "row_ord": e.row, "obj": e.obj, "kind": e.kind, "offset": e.offset, "lands": _lands(f, e.offset) if e.kind == "regular" else None, "gen": e.gen, "objstm": e.objstm, "idx": e.idx, "refused": e.refused}
            for e in f.chain_entries
        ]
    if "headers" in want:
        clean = {p for p, _, _ in f.headers()}
        out["headers"] = [{"pos": m.start() - f.base, "obj": int(m[1]), "gen": int(m[2]), "clean": m.start() - f.base in clean} for m in HEADER.finditer(f.data)]
    if "index" in want:
        out["index"] = [{"obj": n, "kind": e.kind, "offset": e.offset, "gen": e.gen, "objstm": e.objstm, "idx": e.idx, "found_by_reader": e.found} for n, e in sorted(f.index.items())]
    if want & {"members", "containers"}:
        numbers = sorted({e.objstm for e in f.index.values() if e.kind == "compressed"} | {e.objstm for e in f.chain_entries if e.kind == "compressed"})
        held = [(n, f.container(n)) for n in numbers]
        out["members"] = [{"objstm": n, "idx": k, "obj": obj} for n, c in held for k, obj in enumerate(c["numbers"])]
        out["containers"] = [{"objstm": n, "fault": c["fault"], "listed": len(c["numbers"])} for n, c in held]
    if "objects" in want:
        order = reach(f)
        out["objects"] = [_object_row(f, n, order) for n in sorted(f.objects)]
    if "nodes" in want:
        out["nodes"] = [node_row(*x) for x in f.nodes(holders)] if f.open_error is None else []
    if "kinds" in want:
        kinds = Counter(kind_of(x) for x in f.objects.values())
        out["kinds"] = [{"kind": k, "n": n} for k, n in sorted(kinds.items())]
    if "breaches" in want:
        found = shapes.check(f, model or shapes.basic_model()) if f.open_error is None else []
        names = ("rule_id", "type", "key", "obj", "page_index", "detail")
        out["breaches"] = [{"seq": k} | dict(zip(names, x)) for k, x in enumerate(found)]
    if "trailers" in want:
        keep = ("ord", "path", "parent_path", "key", "kind", "i", "d", "name", "ref_obj", "ref_gen")
        out["trailers"] = [{"section": x.ordinal} | {k: row[k] for k in keep} for x in f.sections for row in (node_row(*n) for n in _walk(0, x.trailer))]
    if want & {"streams", "diagnostics", "codes"}:
        rows = []
        for n in sorted(f.objects):
            if isinstance(f.objects[n], Stream):
                data_, chain, faults, left = f.decode(f.objects[n])
                if "streams" in want:
                    rows.append({"obj": n, "filters": [s.name for s in chain.steps], "chain_end": chain.end, "decoded": data_, "decoded_length": len(data_), "left_encoded": left, "faults": [x._asdict() for x in faults]})
        out["streams"] = rows
    if "structure" in want:
        out["structure"] = structure_of(f) | {"tree_whole": walk is None or walk.whole, "page_count": 0 if walk is None else len(walk.pages)}
    if "diagnostics" in want:
        out["diagnostics"] = [{"seq": k, "severity": s, "code": c, "message": m, "position": p} for k, (s, c, m, p) in enumerate(f.diagnostics)]
    if "codes" in want:  # beyond the bound on diagnostics too
        out["codes"] = [{"severity": s, "code": c, "n": n} for (s, c), n in sorted(f.codes.items())]
    return {k: out[k] for k in out if k in want}


def _lands(f: PdfFile, offset: int) -> int:
    from quirelake.sources.reader import _SPACE

    at = f.base + offset
    return _SPACE.match(f.data, at).end() - f.base if 0 <= at < len(f.data) else offset


def _object_row(f: PdfFile, n: int, order: dict[int, int]) -> dict:
    value, fact = f.objects[n], f.facts[n]
    d = as_dictionary(value) or {}
    name = lambda key: str(v) if isinstance(v := f.resolve(d.get(key)), Name) else None
    stream = value if isinstance(value, Stream) else None
    return {
        "obj": n,
        "gen": fact["gen"],
        "source": fact["source"],
        "offset": fact["offset"],
        "kind": kind_of(value),
        "type_name": name("Type"),
        "subtype": name("Subtype"),
        "data_offset": stream.start - f.base if stream else None,
        "raw_length": stream.length if stream else None,
        "endobj_missing": fact["endobj_missing"],
        "cut": fact.get("cut", False),
        "presence": fact["presence"],
        "reachable": n in order,
        "visit": order.get(n),
    }


# -- over tables --------------------------------------------------------------------


#: Files, and bytes of them but for one larger file, that a kernel gives at a time.
SLICE_FILES = 64
SLICE_BYTES = 16 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of SLICE_FILES files and SLICE_BYTES bytes at most."""
    start, held = 0, 0
    for at, x in enumerate(batch.column("content")):
        size = len(x.as_buffer()) if x.is_valid else 0
        if at > start and (at - start >= SLICE_FILES or held + size > SLICE_BYTES):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def parse(files: DataFrame, *want: str, limits: Limits = Limits(), holders: tuple[int, ...] | None = None, model: dict | None = None) -> DataFrame:
    """(doc_id, the wanted relations as nested columns) of (doc_id, content). With
    ``holders``, ``nodes`` has the values of those objects alone (0: the trailer), and only
    those are read for it. ``model`` is what ``breaches`` are held against."""
    parts = tuple(want or PARTS)
    wanted = frozenset(parts)
    types = {p: _arrow(SCHEMAS[p]) if p == "structure" else pa.list_(_arrow(SCHEMAS[p])) for p in parts}
    # The model's size is the model's, not the data's.
    shared = files.sparkSession.sparkContext.broadcast(model) if model else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value if shared else None
        for batch in batches:
            for b in slices(batch):
                rows = [facts_of(x.as_py() or b"", wanted, limits, holders, own) for x in b.column("content")]
                yield pa.record_batch([b.column("doc_id"), *(pa.array([r[p] for r in rows], types[p]) for p in parts)], ["doc_id", *parts])

    schema = "doc_id long, " + ", ".join(f"{p} struct<{_inner(p)}>" if p == "structure" else f"{p} array<struct<{_inner(p)}>>" for p in parts)
    return files.select(F.col("doc_id").cast("long"), "content").mapInArrow(kernel, schema)


def _inner(part: str) -> str:
    return T._parse_datatype_string(SCHEMAS[part]).simpleString()[len("struct<") : -1]


class Tables:
    """The relations of parsed files, each a DataFrame with ``doc_id``.

    ``placed`` and ``packed`` are joins that several rules ask for: they are made once and
    kept as ``parsed`` is. ``release`` lets go of what the executors keep."""

    def __init__(self, parsed: DataFrame, files: DataFrame | None = None, model: dict | None = None):
        self.parsed, self.files, self.model = parsed, files, model
        self._kept: dict[str, DataFrame] = {}

    def __getattr__(self, part: str) -> DataFrame:
        if part == "structure":
            return self.parsed.select("doc_id", "structure.*")
        if part == "refs":
            return self.nodes.where("kind = 'reference'").selectExpr("doc_id", "holder as src", "ord", "path", "parent_path", "key", "elem", "ref_obj as dst", "ref_gen as dst_gen")
        if part in SCHEMAS:
            return self.parsed.select("doc_id", F.inline(part))
        if part in ("placed", "packed"):
            if part not in self._kept:
                found = joins.placed(self.xref_entries, self.headers) if part == "placed" else joins.members_of(self.xref_entries, self.members, self.containers)
                self._kept[part] = stored(found, part)
            return self._kept[part]
        raise AttributeError(part)

    def release(self) -> None:
        for df in (self.parsed, *self._kept.values()):
            df.unpersist()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the session's checkpoint folder where it names one, of which every
    reader takes its own columns alone; without such a folder kept by the executors."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def tables_of(files: DataFrame, *want: str, model: dict | None = None, limits: Limits = Limits()) -> Tables:
    """The relations of ``files``, parsed once and stored."""
    return Tables(stored(parse(files, *want, limits=limits, model=model), "parsed"), files, model)
