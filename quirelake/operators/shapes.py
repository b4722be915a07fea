"""Object shapes: objects typed along a model's links, and checked against its rows.

The model is a set of object types, each with rows for its keys: value types, since and
deprecated versions, whether required, links to the types of what the value names, and
the values a ``/Type`` or ``/Subtype`` may have. ``compile_model`` reads a folder of
tab-separated tables of twelve columns (one per object type); ``basic_model`` is the part
for documents, pages and fonts. Types go breadth-first from the catalog; an object is
typed by the first context that names it, and checked once.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.syntax import Name, Ref, Stream, as_dictionary, kind_of
from quirelake.operators.page_tree import Walk
from quirelake.sources.reader import PdfFile

RULES = (
    ("object.key-missing", "Warning"),
    ("object.value-type-wrong", "Warning"),
    ("object.type-value-wrong", "Warning"),
    ("object.key-deprecated", "Information"),
)

#: What each value type of the model accepts, by the value's class.
ACCEPTS = {
    "integer": {"integer"},
    "bitmask": {"integer"},
    "number": {"integer", "real"},
    "boolean": {"boolean"},
    "name": {"name"},
    "string": {"string"},
    "string-byte": {"string"},
    "string-ascii": {"string"},
    "string-text": {"string"},
    "date": {"string"},
    "array": {"array"},
    "rectangle": {"array"},
    "matrix": {"array"},
    "dictionary": {"dictionary"},
    "name-tree": {"dictionary"},
    "number-tree": {"dictionary"},
    "stream": {"stream"},
    "null": {"null"},
}

#: Weights of a candidate type's evidence.
DISCRIMINATES, MISMATCHES, FIRST, NOT_FIRST, VALUE, NO_VALUE, LACKS = 80, -40, 60, -20, 4, -3, -6

#: Keys that tell types apart.
DISCRIMINATORS = frozenset({"Type", "Subtype", "S", "FunctionType", "ShadingType", "PatternType", "HalftoneType", "FT", "TransformMethod", "CFM"})

#: Rows on which a rule of the page tree speaks instead: (type, key) -> silent rules.
SILENT = {
    ("PageObject", "MediaBox"): {"object.key-missing", "object.value-type-wrong"},
    ("PageTreeNode", "MediaBox"): {"object.value-type-wrong"},
    ("PageTreeNodeRoot", "MediaBox"): {"object.value-type-wrong"},
    ("PageObject", "Resources"): {"object.key-missing"},
    ("PageObject", "Parent"): {"object.value-type-wrong"},
    ("PageTreeNode", "Parent"): {"object.key-missing", "object.value-type-wrong"},
    ("PageTreeNode", "Kids"): {"object.key-missing", "object.value-type-wrong"},
    ("PageTreeNodeRoot", "Kids"): {"object.key-missing", "object.value-type-wrong"},
    ("PageTreeNode", "Count"): {"object.key-missing"},
    ("PageTreeNodeRoot", "Count"): {"object.key-missing"},
    ("ArrayOfPageTreeNodeKids", "*"): {"object.value-type-wrong"},
}

#: Keys whose values a filter of the same stream types.
PARAMETERS = frozenset({"DecodeParms", "FDecodeParms"})

#: Keys that point back up the graph: checked, not followed.
BACK = frozenset({"Parent"})


@dataclass
class Row:
    key: str
    types: list[str]
    since: int = 10
    deprecated: int | None = None
    required: bool = False
    required_from: int | None = None
    required_before: int | None = None
    inheritable: bool = False
    links: dict[str, list[str]] = field(default_factory=dict)
    values: list[str] = field(default_factory=list)

    def is_required(self, version: int | None) -> bool:
        at = 20 if version is None else version
        if self.required:
            return at >= self.since
        if version is None or (self.required_from is None and self.required_before is None):
            return False
        return (self.required_from is None or version >= self.required_from) and (self.required_before is None or version < self.required_before)


Model = dict[str, dict[str, Row]]


# -- the compiler ----------------------------------------------------------------------


def split_top(cell: str, mark: str = ";") -> list[str]:
    """Cuts a cell at ``mark`` outside brackets and parentheses."""
    out, depth, last = [], 0, 0
    for k, c in enumerate(cell):
        depth += (c in "[(") - (c in "])")
        if c == mark and not depth:
            out.append(cell[last:k])
            last = k + 1
    return [x.strip() for x in [*out, cell[last:]] if x.strip()]


def unwrap(cell: str) -> tuple[str, int | None, int | None, int | None]:
    """Strips version predicates: (rest, since, deprecated, before)."""
    since = deprecated = before = None
    while m := re.match(r"fn:(SinceVersion|Deprecated|BeforeVersion|IsPDFVersion)\((\d\.\d)(?:,(.*))?\)$", cell):
        version = int(m[2].replace(".", ""))
        if m[1] == "SinceVersion":
            since = version
        elif m[1] == "Deprecated":
            deprecated = version
        elif m[1] == "BeforeVersion":
            before = version
        else:
            since, before = version, version + 1
        cell = (m[3] or "").strip()
    return cell, since, deprecated, before


def _slots(cell: str) -> list[list[str]]:
    """A list cell's slots: ``[a,b];[c]`` are two, of two and one."""
    return [split_top(s[1:-1] if s.startswith("[") and s.endswith("]") else s, ",") for s in split_top(cell)]


def compile_row(cells: dict[str, str]) -> Row | None:
    types = [t for x in split_top(cells["Type"]) if (t := unwrap(x)[0]) in ACCEPTS]
    if "Extension" in cells.get("SinceVersion", ""):
        return None
    since = re.search(r"\d\.\d", cells.get("SinceVersion", "") or "1.0")
    gone = re.fullmatch(r"\d\.\d", cells.get("DeprecatedIn", "") or "")
    row = Row(cells["Key"], types, int(since[0].replace(".", "")) if since else 10, int(gone[0].replace(".", "")) if gone else None)
    required = cells.get("Required", "FALSE")
    if required == "TRUE":
        row.required = True
    elif m := re.fullmatch(r"fn:IsRequired\((.*)\)", required):
        rest, from_, _, before = unwrap(m[1])
        if not rest:
            row.required_from, row.required_before = from_, before
    row.inheritable = cells.get("Inheritable", "FALSE") == "TRUE"
    kinds = [unwrap(x)[0] for x in split_top(cells["Type"])]
    for kind, slot in zip(kinds, _slots(cells.get("Link", ""))):
        names = [unwrap(x)[0] for x in slot]
        row.links[kind] = [n for n in names if re.fullmatch(r"\w+", n)]
    for kind, slot in zip(kinds, _slots(cells.get("PossibleValues", ""))):
        if kind == "name" and slot and all(not unwrap(x)[0].startswith("fn:") for x in slot):
            row.values += [unwrap(x)[0] for x in slot]
    return row


def compile_table(lines: list[str]) -> dict[str, Row]:
    """The rows of one type from its tab-separated lines, the first of which is a head."""
    head = lines[0].rstrip("\n").split("\t")
    out = {}
    for line in lines[1:]:
        cells = dict(zip(head, line.rstrip("\n").split("\t")))
        if cells.get("Key") and (row := compile_row(cells)):
            out[row.key] = row
    return out


def compile_model(folder: str) -> Model:
    """The model of a folder of ``<type>.tsv`` files, over the basic one."""
    model = dict(basic_model())
    for file in sorted(os.listdir(folder)):
        if file.endswith(".tsv"):
            with open(os.path.join(folder, file), encoding="utf-8") as f:
                model[file[:-4]] = compile_table(f.readlines())
    return model


@lru_cache(maxsize=1)
def basic_model() -> Model:
    """Catalog, page tree, pages, information and the simplest fonts."""
    r = Row
    node = {
        "Type": r("Type", ["name"], required=True, values=["Pages"]),
        "Kids": r("Kids", ["array"], required=True, links={"array": ["ArrayOfPageTreeNodeKids"]}),
        "Count": r("Count", ["integer"], required=True),
        "MediaBox": r("MediaBox", ["rectangle"], inheritable=True),
        "Resources": r("Resources", ["dictionary"], inheritable=True, links={"dictionary": ["Resource"]}),
        "Rotate": r("Rotate", ["integer"], inheritable=True),
    }
    font = {
        "Type": r("Type", ["name"], required=True, values=["Font"]),
        "BaseFont": r("BaseFont", ["name"], required=True),
        "Name": r("Name", ["name"], required_before=11, deprecated=20),
        "FirstChar": r("FirstChar", ["integer"]),
        "LastChar": r("LastChar", ["integer"]),
    }
    return {
        "Catalog": {
            "Type": r("Type", ["name"], required=True, values=["Catalog"]),
            "Version": r("Version", ["name"], since=14),
            "Pages": r("Pages", ["dictionary"], required=True, links={"dictionary": ["PageTreeNodeRoot"]}),
            "PageLayout": r("PageLayout", ["name"]),
            "PageMode": r("PageMode", ["name"]),
            "Lang": r("Lang", ["string-text"], since=14),
            "NeedsRendering": r("NeedsRendering", ["boolean"], since=17, deprecated=20),
        },
        "PageTreeNodeRoot": node,
        "PageTreeNode": node | {"Parent": r("Parent", ["dictionary"], required=True)},
        "ArrayOfPageTreeNodeKids": {"*": r("*", ["dictionary"], links={"dictionary": ["PageTreeNode", "PageObject"]})},
        "PageObject": {
            "Type": r("Type", ["name"], required=True, values=["Page", "Template"]),
            "Parent": r("Parent", ["dictionary"]),
            "Resources": r("Resources", ["dictionary"], required=True, inheritable=True, links={"dictionary": ["Resource"]}),
            "MediaBox": r("MediaBox", ["rectangle"], required=True, inheritable=True),
            "Rotate": r("Rotate", ["integer"], inheritable=True),
            "Contents": r("Contents", ["array", "stream"]),
            "LastModified": r("LastModified", ["date"], since=13),
            "Dur": r("Dur", ["number"], since=11),
            "UserUnit": r("UserUnit", ["number"], since=16),
        },
        "Resource": {
            "Font": r("Font", ["dictionary"], links={"dictionary": ["FontMap"]}),
            "ProcSet": r("ProcSet", ["array"], deprecated=20),
        },
        "FontMap": {"*": r("*", ["dictionary"], links={"dictionary": ["FontType1", "FontTrueType"]})},
        "FontType1": font | {"Subtype": r("Subtype", ["name"], required=True, values=["Type1"])},
        "FontTrueType": font | {"Subtype": r("Subtype", ["name"], required=True, values=["TrueType"])},
        "DocInfo": {
            "Title": r("Title", ["string-text"]),
            "Author": r("Author", ["string-text"]),
            "Producer": r("Producer", ["string-text"]),
            "CreationDate": r("CreationDate", ["date"]),
            "Trapped": r("Trapped", ["name"], since=13, values=["True", "False", "Unknown"]),
        },
    }


def model_rows(model: Model) -> list[tuple]:
    """(object, ord, key, types, since, deprecated, required, inheritable, links) rows."""
    return [
        (name, k, row.key, row.types, row.since, row.deprecated, row.required, row.inheritable, sorted({x for v in row.links.values() for x in v}))
        for name, rows in sorted(model.items())
        for k, row in enumerate(rows.values())
    ]


def discriminators(model: Model, candidates: list[str]) -> dict[str, dict[str, list[str]]]:
    """What tells candidate types apart: for each key whose values differ between them, the
    types that each value speaks for. Keys that tell types apart by rule come first."""
    out: dict[str, dict[str, list[str]]] = {}
    keys = {k: None for c in candidates for k, row in model.get(c, {}).items() if row.values}
    for key in sorted(keys, key=lambda k: (k not in DISCRIMINATORS, k)):
        told: dict[str, list[str]] = {}
        for c in candidates:
            for value in (model.get(c, {}).get(key) or Row(key, [])).values:
                told.setdefault(value, []).append(c)
        if any(len(x) < len(candidates) for x in told.values()):
            out[key] = told
    return out


# -- the walk ----------------------------------------------------------------------------


def version_code(version: str | None) -> int | None:
    return int(version.replace(".", "")) if version in ("1.0", "1.1", "1.2", "1.3", "1.4", "1.5", "1.6", "1.7", "2.0") else None


def type_of(file: PdfFile, value: object, candidates: list[str], model: Model, version: int | None) -> str | None:
    """The candidate that the value fits best; None on a tie."""
    arrays = isinstance(value, list)
    fits = [c for c in candidates if c in model and arrays == (c.startswith("ArrayOf") or c.endswith("Array"))]
    if len(fits) <= 1:
        return fits[0] if fits else None
    d = as_dictionary(value) or {}
    scored = []
    first = file.resolve(value[0]) if arrays and value else None
    for name in fits:
        score = 0
        own = model[name].get("0")
        if own is not None and own.values and isinstance(first, Name):
            score += FIRST if first in own.values else NOT_FIRST
        for row in model[name].values():
            own = file.resolve(d.get(row.key))
            if row.values and isinstance(own, Name):
                hit, sure = own in row.values, row.key in DISCRIMINATORS
                score += (DISCRIMINATES if sure else VALUE) if hit else (MISMATCHES if sure else NO_VALUE)
            if own is None and row.key != "*" and row.is_required(version) and not row.inheritable:
                score += LACKS
        scored.append((score, name))
    best = max(score for score, _ in scored)
    top = [name for score, name in scored if score == best]
    return top[0] if len(top) == 1 else None


def by_filter(file: PdfFile, holder: dict, key: str, at: int | None, candidates: list[str]) -> list[str] | None:
    """Of the candidates for ``/DecodeParms`` (or the one at a place of its array), what the
    filter at that place names; None if no filter stands there or it names none."""
    filters = file.resolve(holder.get("FFilter" if key == "FDecodeParms" else "Filter"))
    if isinstance(filters, list):
        place = at if at is not None else 0 if len(filters) == 1 else len(filters)
        own = file.resolve(filters[place]) if place < len(filters) else None
    else:
        own = filters if not at else None
    named = [c for c in candidates if isinstance(own, Name) and c == "Filter" + own]
    return named or None


def elements(rows: dict[str, Row], values: list, file: PdfFile) -> list[tuple[str, Row | None, object]]:
    """(place, row, value) of an array: rows for a place, then a group of rows that repeats
    (``n*``), of which one that is optional and does not accept a value is passed over, else
    ``*``."""
    fixed = sum(k.isdigit() for k in rows)
    group = [r for k, r in rows.items() if k[:-1].isdigit() and k.endswith("*")]
    out, member = [], 0
    for place, raw in enumerate(values):
        row = rows.get(str(place), rows.get("*"))
        if group and place >= fixed:
            got = file.resolve(raw)
            unknown = got is None and isinstance(raw, Ref)
            fits = [unknown or any(kind_of(got) in ACCEPTS[t] for t in r.types) for r in group]
            for _ in group:
                if fits[member] or group[member].required:
                    break
                member = (member + 1) % len(group)
            row, member = group[member], (member + 1) % len(group)
        out.append((str(place), row, raw))
    return out


def check(file: PdfFile, model: Model) -> list[tuple[str, str, str, int, int | None, str]]:
    """(rule, type, key, object, page index, detail) of every breach, in walk order."""
    version = version_code(file.declared_version())
    tree = Walk(file)
    page_index = {n: i for i, n, *_ in tree.pages if n is not None}
    entered = set(page_index) | tree.listed
    typed: dict[int, str] = {}
    out: list = []
    queue: deque = deque()

    def follow(value: object, names: list[str], holder: int) -> None:
        number = value.number if isinstance(value, Ref) else None
        for _ in range(32):
            if not isinstance(value, Ref):
                break
            number, value = value.number, file.get(value.number)
        if not names or not isinstance(value, (dict, list, Stream)) or (number is not None and number in typed):
            return
        name = type_of(file, value, names, model, version)
        if name is None:
            return
        if number is not None:
            typed[number] = name
        queue.append((holder if number is None else number, name, value))

    follow(file.trailer.get("Root"), ["Catalog"], 0)
    follow(file.trailer.get("Info"), ["DocInfo"], 0)
    while queue:
        holder, name, value = queue.popleft()
        rows = model[name]

        def breach(rule: str, key: str, detail: str, holder=holder, name=name) -> None:
            if rule not in SILENT.get((name, key), ()) or holder not in entered:
                out.append((rule, name, key, holder, page_index.get(holder), detail))

        if isinstance(value, list):
            items = elements(rows, value, file)
            missing = [r for r in rows.values() if r.key.isdigit() and int(r.key) >= len(value)]
        else:
            d = as_dictionary(value)
            items = [(k, rows.get(k, rows.get("*")), d[k]) for k in sorted(d)]
            missing = [r for r in rows.values() if r.key != "*" and r.key not in d]
        for row in missing:
            if row.is_required(version) and not (row.inheritable and _inherits(file, value, row.key)):
                breach("object.key-missing", row.key, "missing")
        for key, row, raw in items:
            if row is None:
                continue
            if version is not None and row.deprecated is not None and row.deprecated <= version:
                breach("object.key-deprecated", row.key, key)
            got = file.resolve(raw)
            if got is None and isinstance(raw, Ref):
                continue
            kind = kind_of(got)
            allowed = {k for t in row.types for k in ACCEPTS[t]}
            if allowed and kind not in allowed:
                breach("object.value-type-wrong", row.key, f"{kind} at {key}")
                continue
            if row.key in ("Type", "Subtype") and row.values and isinstance(got, Name) and got not in row.values:
                breach("object.type-value-wrong", row.key, str(got))
            if row.key not in BACK:
                links = [n for t, names in row.links.items() if kind in ACCEPTS.get(t, ()) for n in names]
                if row.key in PARAMETERS and isinstance(got, dict):
                    links = by_filter(file, as_dictionary(value), row.key, None, links) or []
                elif row.key in PARAMETERS and isinstance(got, list):
                    for at, x in enumerate(got):
                        own = [n for c in links for r in model.get(c, {}).values() for names in r.links.values() for n in names]
                        follow(x, by_filter(file, as_dictionary(value), row.key, at, own) or [], holder)
                    continue
                follow(raw, links, holder)
    return out


def _inherits(file: PdfFile, value: object, key: str) -> bool:
    d, seen = as_dictionary(value), set()
    while d is not None:
        if d.get(key) is not None:
            return True
        parent = d.get("Parent")
        if not isinstance(parent, Ref) or parent.number in seen:
            return False
        seen.add(parent.number)
        d = as_dictionary(file.resolve(parent))
    return False


# -- over tables ----------------------------------------------------------------------------


def one_per_row(found: DataFrame) -> DataFrame:
    """One finding per row of the model: the first object in walk order, and how many."""
    first = lambda c: F.min_by(c, "seq").alias(c)
    return found.groupBy("doc_id", "rule_id", "type", "key").agg(first("obj"), first("page_index"), F.count_distinct("obj").alias("n")).withColumn(
        "detail", F.concat_ws(" ", F.concat("type", F.lit("/"), "key"), F.lit("in"), "n", F.lit("objects"))
    )
