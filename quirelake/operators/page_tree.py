"""The page tree: pages in order with what they inherit, and the tree's faults.

``Walk`` goes through one file's tree as it is written; a tree is as deep as its file
says and may loop, so this is sequential per file and parallel over files. A page is a
row each time it is listed; a node listed again is counted again, but its pages are not
rows again, as such trees may name more pages than anything could hold.
``pages_by_recursion`` is the same for sound trees as one recursive statement.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from quirelake.functions.syntax import MAX_LINKS, Name, Ref, Stream, as_dictionary, as_integer, as_number
from quirelake.sources.reader import PdfFile

#: (rule, severity) of the faults, in the order that a profile names them.
FAULTS = {
    "page-tree.cycle": "Error",
    "page-tree.node-repeated": "Warning",
    "page-tree.kids-missing": "Warning",
    "page-tree.kid-invalid": "Warning",
    "page-tree.count-mismatch": "Warning",
    "page-tree.parent-wrong": "Warning",
    "page-tree.mediabox-invalid": "Warning",
    "page-tree.resources-missing": "Warning",
}


def target(file: PdfFile, value: object) -> int | None:
    """Number of the object where a chain of references ends; None for a value that
    is written in place, or a chain too long."""
    number = None
    for _ in range(MAX_LINKS):
        if not isinstance(value, Ref):
            return number
        number = value.number
        value = file.get(number)
    return None


def box_of(file: PdfFile, value: object) -> list[float] | None:
    """Four finite numbers that enclose an area, or None."""
    value = file.resolve(value)
    if not isinstance(value, list) or len(value) != 4:
        return None
    corners = [as_number(file.resolve(x)) for x in value]
    if any(c is None or not math.isfinite(c) for c in corners):
        return None
    return corners if corners[0] != corners[2] and corners[1] != corners[3] else None


class Walk:
    """pages: (index, object, parent, box, has resources, path of kid positions);
    faults: (rule, object, page index, detail)."""

    def __init__(self, file: PdfFile):
        self.file = file
        self.pages: list[tuple] = []
        self.faults: list[tuple] = []
        self.listed: set[int] = set()
        self.counts: dict[int, int] = {}  # pages below each node that was walked
        self.whole = True
        root = (file.catalog() or {}).get("Pages")
        node = as_dictionary(file.resolve(root))
        if node is not None:
            self._node(target(file, root), node)

    def fault(self, rule: str, number: int | None, page: int | None = None, detail: str = "") -> None:
        self.faults.append((rule, number, page, detail))

    def _is_node(self, d: dict) -> bool:
        return isinstance(self.file.resolve(d.get("Kids")), list) or self.file.resolve(d.get("Type")) == "Pages"

    def _present(self, d: dict, key: str) -> bool:
        """Whether a key gives something: a reference to what the file lacks does."""
        value = d.get(key)
        if isinstance(value, Ref):
            e = self.file.index.get(value.number)
            return e is None or e.kind == "free" or self.file.resolve(value) is not None or self.file.facts.get(value.number, {}).get("presence") == "unproduced"
        return value is not None

    def _node(self, number: int | None, node: dict) -> None:
        """An explicit stack: each frame is a node with where its kids have got to."""
        file = self.file
        if "Parent" in node:
            self.fault("page-tree.parent-wrong", number, None, "the root has a parent")
        frames = [self._enter(number, node, (None, False), ())]
        while frames:
            frame = frames[-1]
            if frame["at"] >= len(frame["kids"]):
                frames.pop()
                self._leave(frame)
                if frames:
                    frames[-1]["count"] += frame["count"]
                    frames[-1]["doubt"] |= frame["doubt"]
                continue
            k = frame["at"]
            frame["at"] += 1
            kid = frame["kids"][k]
            own = target(file, kid)
            value = file.resolve(kid)
            path = (*frame["path"], k)
            if own is not None and any(own == f["number"] for f in frames):
                self.fault("page-tree.cycle", frame["number"], None, f"kid {own}")
                frame["doubt"] = True
                continue
            d = as_dictionary(value)
            if d is None:
                e = file.index.get(own) if own is not None else None
                lost = e is not None and e.kind != "free" and file.facts.get(own, {}).get("presence") == "unproduced"
                if lost:
                    frame["doubt"], self.whole = True, False
                else:
                    self.fault("page-tree.kid-invalid", frame["number"], len(self.pages), "null, missing or no dictionary")
                self.pages.append((len(self.pages), own, frame["number"], None, False, path))
                frame["count"] += 1
                continue
            if isinstance(value, Stream) or not isinstance(kid, Ref):
                self.fault("page-tree.kid-invalid", frame["number"], None, "a stream" if isinstance(value, Stream) else "written in the array")
            if own is not None and own in self.listed:
                self.fault("page-tree.node-repeated", frame["number"], None, f"kid {own}")
                known = self.counts.get(own)
                if known is not None:
                    frame["count"] += known
                    if not self._is_node(d):  # a page is a row each time it is listed
                        box = d.get("MediaBox", frame["box"])
                        self.pages.append((len(self.pages), own, frame["number"], box_of(file, box), frame["resources"] or self._present(d, "Resources"), path))
                    continue
            if own is not None:
                self.listed.add(own)
            parent = d.get("Parent")
            if isinstance(kid, Ref) and (not isinstance(parent, Ref) or parent.number != frame["number"]) and frame["number"] is not None:
                self.fault("page-tree.parent-wrong", own, None if self._is_node(d) else len(self.pages), f"listed by {frame['number']}")
            if self._is_node(d):
                frames.append(self._enter(own, d, (frame["box"], frame["resources"]), path))
            else:
                self._page(own, d, frame, path)
                frame["count"] += 1

    def _enter(self, number: int | None, node: dict, inherited: tuple, path: tuple) -> dict:
        if not path and number is not None:
            self.listed.add(number)
        kids = self.file.resolve(node.get("Kids"))
        missing = not isinstance(kids, list)
        if missing and not self._dangling(node.get("Kids")):
            self.fault("page-tree.kids-missing", number)
        box, resources = inherited
        if self._present(node, "MediaBox"):
            box = node["MediaBox"]
            if box_of(self.file, box) is None and not self._dangling(box):
                self.fault("page-tree.mediabox-invalid", number, None, "no area")
        resources = resources or self._present(node, "Resources")
        return {"number": number, "node": node, "kids": [] if missing else kids, "at": 0, "count": 0, "doubt": missing, "box": box, "resources": resources, "path": path}

    def _dangling(self, value: object) -> bool:
        if not isinstance(value, Ref):
            return False
        e = self.file.index.get(value.number)
        return e is None or e.kind == "free"

    def _leave(self, frame: dict) -> None:
        if frame["number"] is not None:
            self.counts[frame["number"]] = frame["count"]
        raw = self.file.resolve(frame["node"].get("Count"))
        if raw is None:
            self.fault("page-tree.count-mismatch", frame["number"], None, "missing")
        elif not frame["doubt"] and as_integer(raw) is not None and as_integer(raw) != frame["count"]:
            self.fault("page-tree.count-mismatch", frame["number"], None, f"{as_integer(raw)} given, {frame['count']} listed")

    def _page(self, number: int | None, page: dict, frame: dict, path: tuple) -> None:
        index, box = len(self.pages), frame["box"]
        if self._present(page, "MediaBox"):
            box = page["MediaBox"]
            if box_of(self.file, box) is None and not self._dangling(box):
                self.fault("page-tree.mediabox-invalid", number, index, "no area")
        elif box is None:
            self.fault("page-tree.mediabox-invalid", number, index, "missing")
        resources = frame["resources"] or self._present(page, "Resources")
        if not resources:
            self.fault("page-tree.resources-missing", number, index)
        if number is not None:
            self.counts[number] = 1
        self.pages.append((index, number, frame["number"], box_of(self.file, box), resources, path))


def pages_by_recursion(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, page_index, obj, parent, box_holder) of sound trees, by one recursive
    statement over ``nodes`` and ``roots`` (doc_id, obj). A loop ends; deeper trees than
    spark.sql.cteRecursionLevelLimit fail rather than lose pages. Rows grow with the files,
    so Spark's bound on a recursion's rows is lifted, for the session, as the rows come
    when the result is read."""
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    kids = nodes.where("parent_path = '/Kids' and kind = 'reference'").selectExpr("doc_id", "holder as parent", "elem as pos", "ref_obj as kid")
    inner = nodes.where("path in ('/Kids', '/MediaBox')").groupBy("doc_id", "holder").agg({"path": "collect_set"}).withColumnRenamed("collect_set(path)", "has")
    names = {"q_kids": kids, "q_has": inner, "q_roots": roots}
    for name, df in names.items():
        df.createOrReplaceTempView(name)
    out = spark.sql("""
        WITH RECURSIVE tree (doc_id, obj, parent, ords, seen, box_holder) AS (
          SELECT r.doc_id, r.obj, CAST(NULL AS INT), CAST(array() AS ARRAY<INT>), array(r.obj),
                 CASE WHEN array_contains(h.has, '/MediaBox') THEN r.obj END
          FROM q_roots r LEFT JOIN q_has h ON r.doc_id = h.doc_id AND r.obj = h.holder
          UNION ALL
          SELECT t.doc_id, k.kid, t.obj, concat(t.ords, array(k.pos)), concat(t.seen, array(k.kid)),
                 CASE WHEN array_contains(h.has, '/MediaBox') THEN k.kid ELSE t.box_holder END
          FROM tree t JOIN q_kids k ON t.doc_id = k.doc_id AND t.obj = k.parent
          LEFT JOIN q_has h ON k.doc_id = h.doc_id AND k.kid = h.holder
          WHERE NOT array_contains(t.seen, k.kid)
        )
        SELECT t.doc_id, CAST(row_number() OVER (PARTITION BY t.doc_id ORDER BY t.ords) - 1 AS INT) AS page_index,
               t.obj, t.parent, t.box_holder
        FROM tree t LEFT JOIN q_has h ON t.doc_id = h.doc_id AND t.obj = h.holder
        WHERE NOT coalesce(array_contains(h.has, '/Kids'), false)
    """)
    return out


def is_page(d: dict) -> bool:
    return isinstance(d.get("Type"), Name) and d["Type"] == "Page" and ("Parent" in d or "Contents" in d)
