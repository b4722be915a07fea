"""The structural profile: 46 rules, each a DataFrame of findings over ``Tables``.

A rule is a function from ``Tables`` to (doc_id, obj, gen, position, page_index,
detail); ``PROFILE`` names them in order with their severity. ``findings`` unites them,
``report`` keeps the first findings of each file and counts the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators import joins, shapes
from quirelake.operators.tables import Tables

#: Versions that exist.
VERSIONS = ("1.0", "1.1", "1.2", "1.3", "1.4", "1.5", "1.6", "1.7", "2.0")

Rule = Callable[[Tables], DataFrame]


def _found(df: DataFrame, obj="NULL", position="NULL", page="NULL", gen="NULL", detail="''") -> DataFrame:
    return df.selectExpr(
        "doc_id",
        f"CAST({obj} AS BIGINT) AS obj",
        f"CAST({gen} AS INT) AS gen",
        f"CAST({position} AS BIGINT) AS position",
        f"CAST({page} AS INT) AS page_index",
        f"CAST({detail} AS STRING) AS detail",
    )


def _structure(where: str, position: str = "NULL", detail: str = "''") -> Rule:
    return lambda t: _found(t.structure.where("open_error IS NULL").where(where), position=position, detail=detail)


def _sections(where: str, position: str = "named_offset", detail: str = "fault") -> Rule:
    return lambda t: _found(t.sections.where(where), position=position, detail=detail)


def _tree(rule_id: str) -> Rule:
    return lambda t: _found(t.tree_faults.where(F.col("rule_id") == rule_id), obj="obj", page="page_index", detail="detail")


def _whole_chain(t: Tables) -> DataFrame:
    """Files whose chain lost nothing."""
    lost = t.sections.where("state <> 'Read' or incomplete or trailer_fault <> ''").select("doc_id").distinct()
    return t.structure.where("chain_read and loop_offset is null and not chain_cut").select("doc_id").join(joins.apart(lost), "doc_id", "left_anti")


def root_invalid(t: Tables) -> DataFrame:
    read = t.sections.where("trailer_fault = '' and state = 'Read'").select("doc_id").distinct()
    judged = t.structure.where("(chain_read and not root_named_usable) or (was_repaired and not root_usable)").join(joins.apart(read), "doc_id", "left_semi")
    return _found(judged.where("not (was_repaired and root_usable)"), detail="CASE WHEN has_root THEN 'leads to no catalog' ELSE 'missing' END")


def size_wrong(t: Tables) -> DataFrame:
    """/Size against one more than the highest number of a section and the older ones."""
    oldest_first = Window.partitionBy("doc_id").orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, 0)
    top = t.sections.join(joins.apart(_whole_chain(t)), "doc_id", "left_semi").withColumn("top", F.max("highest").over(oldest_first))
    past = object_past_size(t).select("doc_id").distinct()
    wrong = top.where("named_by <> 'XRefStm' and top >= 0 and (size is null or size <> top + 1)")
    newest = wrong.where("ordinal = 0 and size is not null and size <= top").join(joins.apart(past), "doc_id", "left_semi").select("doc_id", "ordinal")
    return _found(wrong.join(joins.apart(newest), ["doc_id", "ordinal"], "left_anti"), position="offset", detail="concat(coalesce(size, 'none'), ' given, ', top + 1, ' used')")


def object_past_size(t: Tables) -> DataFrame:
    size = t.sections.where("ordinal = 0 and state = 'Read' and size is not null").selectExpr("doc_id", "size")
    used = joins.newest_rows(t.xref_entries).where("kind <> 'free' and not refused and obj > 0")
    past = used.join(joins.apart(size), "doc_id").where("obj >= size").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("obj").alias("obj"))
    return _found(past, obj="obj", detail="concat(n, ' objects')")


def trailer_value_wrong(t: Tables) -> DataFrame:
    return _found(t.sections.where("size(wrong_values) > 0"), position="offset", detail="concat_ws(' ', wrong_values)")


def _entries(where: str) -> Rule:
    def rule(t: Tables) -> DataFrame:
        return _found(t.placed.where(where), obj="obj", gen="gen", position="offset")

    return rule


def entry_broken(t: Tables) -> DataFrame:
    direct = _entries("place = 'not-found'")(t)
    state = t.packed
    bad = t.objects.where("source = 'objstm' and presence = 'unproduced'").select("doc_id", "obj")
    packed = state.where("state = 'unlisted'").unionByName(state.where("state in ('listed', 'moved')").join(joins.apart(bad), ["doc_id", "obj"], "left_semi"))
    return direct.unionByName(_found(packed, obj="obj", detail="concat('object stream ', objstm)"))


def entry_shifted(t: Tables) -> DataFrame:
    moved = t.packed.where("state = 'moved'")
    return _entries("place = 'nearby' and vouched")(t).unionByName(_found(moved, obj="obj", detail="concat('object stream ', objstm)"))


def needs(t: Tables) -> DataFrame:
    """(doc_id, a, b): object stream a needs, to be decoded, an object that b holds."""
    used = t.index.where("kind = 'compressed'").select("doc_id", F.col("objstm").alias("a")).distinct()
    asked = t.refs.where("path rlike '^/(Length|Type|N|First|Filter|DecodeParms)([/\\\\[]|$)'").selectExpr("doc_id", "src as a", "dst")
    held = t.index.where("kind = 'compressed'").selectExpr("doc_id", "obj as dst", "objstm as b")
    return asked.join(joins.apart(used), ["doc_id", "a"], "left_semi").join(joins.apart(held), ["doc_id", "dst"]).select("doc_id", "a", "b").distinct()


def object_stream_circular(t: Tables) -> DataFrame:
    return _found(joins.strongly_connected(needs(t)), obj="node", detail="concat('with ', component)")


def object_stream_broken(t: Tables) -> DataFrame:
    state = t.packed.where("state = 'broken'")
    lost = state.groupBy("doc_id", "objstm").agg(F.count("*").alias("n"), F.first("fault").alias("fault"))
    circular = object_stream_circular(t).selectExpr("doc_id", "obj as objstm")
    return _found(lost.join(joins.apart(circular), ["doc_id", "objstm"], "left_anti"), obj="objstm", detail="concat(coalesce(fault, 'missing'), ', ', n, ' objects lost')")


def object_stream_value_wrong(t: Tables) -> DataFrame:
    used = t.index.where("kind = 'compressed'").select("doc_id", F.col("objstm").alias("holder")).distinct()
    reals = t.nodes.where("path in ('/N', '/First', '/Length') and kind = 'real' and d = floor(d)")
    return _found(reals.join(joins.apart(used), ["doc_id", "holder"], "left_semi"), obj="holder", detail="key")


def offset_imprecise(t: Tables) -> DataFrame:
    placed = t.placed.where("place = 'at-offset' and lands <> offset").selectExpr("doc_id", "obj", "offset")
    sections = t.sections.where("state <> 'NotFound' and not relocated and offset <> named_offset").selectExpr(
        "doc_id", "CAST(NULL AS BIGINT) AS obj", "named_offset AS offset"
    )
    both = placed.unionByName(sections).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("offset").alias("offset"), F.min_by("obj", "offset").alias("obj"))
    return _found(both, obj="obj", position="offset", detail="concat(n, ' offsets')")


def reference_missing(t: Tables) -> DataFrame:
    """By holder, but for kids of the page tree and the trailer's /Root."""
    live = t.objects.where("reachable").selectExpr("doc_id", "obj as src").unionByName(t.structure.selectExpr("doc_id", "CAST(0 AS BIGINT) AS src"))
    nodes = t.nodes.where("path = '/Kids' or (path = '/Type' and name = 'Pages')").selectExpr("doc_id", "holder as src").distinct()
    refs = t.refs.where("not (src = 0 and path = '/Root')").join(joins.apart(live), ["doc_id", "src"], "left_semi")
    kids = refs.where("parent_path = '/Kids'").join(joins.apart(nodes), ["doc_id", "src"], "left_semi").select("doc_id", "src", "path")
    missing = joins.dangling(refs, t.index).join(joins.apart(kids), ["doc_id", "src", "path"], "left_anti")
    first = missing.groupBy("doc_id", "src").agg(F.count("*").alias("n"), F.min_by("path", "ord").alias("path"), F.min_by("dst", "ord").alias("dst"))
    return _found(first, obj="nullif(src, 0)", detail="concat(n, ' references, first ', path, ' to ', dst)")


def endobj_missing(t: Tables) -> DataFrame:
    return _found(t.objects.where("reachable and endobj_missing and presence = 'defined'"), obj="obj", gen="gen", position="offset")


def name_null_character(t: Tables) -> DataFrame:
    live = t.objects.where("reachable").selectExpr("doc_id", "obj as holder")
    bad = t.nodes.where("instr(coalesce(name, ''), char(0)) > 0 or instr(coalesce(key, ''), char(0)) > 0").join(joins.apart(live), ["doc_id", "holder"], "left_semi")
    first = bad.groupBy("doc_id", "holder").agg(F.count("*").alias("n"), F.min_by("path", "ord").alias("path"))
    return _found(first, obj="holder", detail="concat(n, ' names')")


def page_orphaned(t: Tables) -> DataFrame:
    """Only where the file's own index is sound and its tree was read whole."""
    unsound = t.sections.where("state <> 'Read' or incomplete or unconfirmed").select("doc_id").distinct()
    sound = t.structure.where("not was_repaired and tree_whole and loop_offset is null and page_root is not null").select("doc_id").join(joins.apart(unsound), "doc_id", "left_anti")
    real = t.nodes.where("path in ('/Parent', '/Contents')").selectExpr("doc_id", "holder as obj").distinct()
    pages = t.objects.where("type_name = 'Page'").join(joins.apart(sound), "doc_id", "left_semi").join(joins.apart(real), ["doc_id", "obj"], "left_semi")
    return _found(pages.join(joins.apart(t.pages.select("doc_id", "obj")), ["doc_id", "obj"], "left_anti"), obj="obj", gen="gen", position="offset")


_VERSION_LIST = ", ".join(f"'{v}'" for v in VERSIONS)

#: The rules in the order in which their findings come: (id, severity, rule).
PROFILE: tuple[tuple[str, str, Rule], ...] = (
    ("file.header-missing", "Warning", _structure("header_pos is null or header_pos >= 1024", "coalesce(header_pos, 0)")),
    ("file.header-offset", "Warning", _structure("header_pos between 1 and 1023", "header_pos")),
    ("file.header-version-invalid", "Warning", _structure(f"header_pos < 1024 and header_named not in ({_VERSION_LIST})", "header_pos", "header_named")),
    ("file.eof-missing", "Warning", _structure("not eof_marker", "length")),
    ("file.startxref-missing", "Error", _structure("startxref is null", "length")),
    ("file.startxref-wrong", "Error", _sections("ordinal = 0 and state = 'NotFound'", "named_offset", "'no section'")),
    ("file.trailer-missing", "Error", _sections("trailer_fault = 'missing'", "offset", "trailer_fault")),
    ("file.trailer-malformed", "Error", _sections("trailer_fault = 'malformed'", "offset", "trailer_fault")),
    ("file.root-invalid", "Error", root_invalid),
    ("file.size-wrong", "Warning", size_wrong),
    ("file.trailer-value-wrong", "Warning", trailer_value_wrong),
    ("xref.section-malformed", "Error", _sections("state = 'Malformed' or (state = 'Read' and incomplete)", "offset")),
    ("xref.entry-type-reserved", "Warning", _sections("reserved_rows > 0", "offset", "reserved_rows")),
    ("xref.section-not-found", "Error", _sections("ordinal > 0 and state = 'NotFound' and fault <> 'hybrid'")),
    ("xref.section-shifted", "Warning", _sections("relocated and not unconfirmed")),
    ("xref.section-unconfirmed", "Error", _sections("unconfirmed")),
    ("xref.subsection-missing", "Warning", _sections("no_subsection", "offset")),
    ("xref.chain-loop", "Error", _structure("loop_offset is not null", "loop_offset")),
    ("xref.chain-empty", "Error", lambda t: _found(t.structure.where("chain_empty").join(joins.apart(_whole_chain(t)), "doc_id", "left_semi"))),
    ("xref.hybrid-stream-wrong", "Error", _sections("named_by = 'XRefStm' and fault = 'hybrid'")),
    ("xref.entry-broken", "Error", entry_broken),
    ("xref.entry-shifted", "Warning", entry_shifted),
    ("xref.entry-unconfirmed", "Error", _entries("place = 'nearby' and not vouched")),
    ("xref.generation-mismatch", "Warning", _entries("place <> 'not-found' and written_gen <> gen")),
    ("xref.object-stream-circular", "Error", object_stream_circular),
    ("xref.object-stream-broken", "Error", object_stream_broken),
    ("xref.object-stream-value-wrong", "Warning", object_stream_value_wrong),
    ("xref.offset-imprecise", "Warning", offset_imprecise),
    ("xref.object-past-size", "Warning", object_past_size),
    ("xref.checked-in-part", "Information", lambda t: _found(t.diagnostics.where("code like 'limit.%'"), position="nullif(position, -1)", detail="code")),
    ("object.reference-missing", "Warning", reference_missing),
    ("object.endobj-missing", "Warning", endobj_missing),
    ("object.name-null-character", "Warning", name_null_character),
    *((rule, severity, lambda t, rule=rule: _found(shapes.one_per_row(t.breaches.where(F.col("rule_id") == rule)), obj="obj", page="page_index", detail="detail")) for rule, severity in shapes.RULES),
    ("page-tree.cycle", "Error", _tree("page-tree.cycle")),
    ("page-tree.node-repeated", "Warning", _tree("page-tree.node-repeated")),
    ("page-tree.kids-missing", "Warning", _tree("page-tree.kids-missing")),
    ("page-tree.kid-invalid", "Warning", _tree("page-tree.kid-invalid")),
    ("page-tree.count-mismatch", "Warning", _tree("page-tree.count-mismatch")),
    ("page-tree.parent-wrong", "Warning", _tree("page-tree.parent-wrong")),
    ("page-tree.mediabox-invalid", "Warning", _tree("page-tree.mediabox-invalid")),
    ("page-tree.resources-missing", "Warning", _tree("page-tree.resources-missing")),
    ("page-tree.page-orphaned", "Information", page_orphaned),
)

RULES: dict[str, tuple[int, str, Rule]] = {rule_id: (k, severity, rule) for k, (rule_id, severity, rule) in enumerate(PROFILE)}

#: What to do about a finding of each rule.
REMEDIES = {
    "file.header-missing": "write a header line with the version at the first byte",
    "file.header-offset": "cut what stands before the header, and correct the offsets",
    "file.header-version-invalid": "name a version that exists in the header",
    "file.eof-missing": "end the file with its end marker",
    "file.startxref-missing": "write the offset of the newest section before the end marker",
    "file.startxref-wrong": "give the offset at which the newest section begins",
    "file.trailer-missing": "write a trailer dictionary after the table",
    "file.trailer-malformed": "write the trailer as one dictionary",
    "file.root-invalid": "let the trailer's /Root lead to the catalog",
    "file.size-wrong": "set /Size to one more than the highest object number",
    "file.trailer-value-wrong": "write the trailer's numbers directly, as integers",
    "xref.section-malformed": "write the section's rows anew, whole and in their form",
    "xref.entry-type-reserved": "use row types that are defined",
    "xref.section-not-found": "let /Prev give the offset of the section before, or leave it out",
    "xref.section-shifted": "give the offset at which the section begins",
    "xref.section-unconfirmed": "give the offset of the section, which only a comment shows now",
    "xref.subsection-missing": "begin the table with a subsection's first number and count",
    "xref.chain-loop": "let the oldest section name none before it",
    "xref.chain-empty": "list the objects in the sections",
    "xref.hybrid-stream-wrong": "let /XRefStm lead to the stream of the same revision",
    "xref.entry-broken": "give the object's offset or place, or mark the row as free",
    "xref.entry-shifted": "give the offset or place at which the object stands",
    "xref.entry-unconfirmed": "check which object the row means, and give its offset",
    "xref.generation-mismatch": "give one generation in the row and at the object",
    "xref.object-stream-circular": "take out of the object stream what it needs to be decoded",
    "xref.object-stream-broken": "write the object stream anew, or its objects directly",
    "xref.object-stream-value-wrong": "write the object stream's numbers as integers",
    "xref.offset-imprecise": "let offsets point at the first byte of what they name",
    "xref.object-past-size": "raise /Size above all object numbers in use",
    "xref.checked-in-part": "raise the bound that was reached, and check again",
    "object.reference-missing": "add the object, or remove the reference",
    "object.endobj-missing": "end the object with its keyword",
    "object.name-null-character": "take the null character out of the name",
    "object.key-missing": "add the key that this type of object must have",
    "object.value-type-wrong": "write the value as one of the types that the key takes",
    "object.type-value-wrong": "name the type that this object is used as",
    "object.key-deprecated": "leave the key out, or declare an older version",
    "page-tree.cycle": "list every node below one parent alone",
    "page-tree.node-repeated": "list the node once",
    "page-tree.kids-missing": "give the node an array of /Kids",
    "page-tree.kid-invalid": "list pages and nodes alone",
    "page-tree.count-mismatch": "set /Count to the number of pages below",
    "page-tree.parent-wrong": "let /Parent lead to the node that lists this one",
    "page-tree.mediabox-invalid": "give the page, or a node above it, a box of four numbers",
    "page-tree.resources-missing": "give the page, or a node above it, a /Resources dictionary",
    "page-tree.page-orphaned": "list the page in the tree, or remove it",
}

#: The relations that the rules of each family read.
READS = {
    "file": ("structure", "sections", "xref_entries"),
    "xref": ("structure", "sections", "xref_entries", "headers", "index", "members", "containers", "objects", "nodes", "diagnostics"),
    "object": ("structure", "index", "objects", "nodes", "breaches"),
    "page-tree": ("structure", "sections", "objects", "nodes", "pages", "tree_faults"),
}


def reads(only: list[str] | None = None) -> tuple[str, ...]:
    """The relations that ``findings`` need: what to ask ``tables_of`` for."""
    families = {rule_id.split(".")[0] for rule_id in only or RULES}
    return tuple(sorted({part for family in families for part in READS[family]}))


def findings(tables: Tables, only: list[str] | None = None) -> DataFrame:
    """All findings of the profile, or of the rules named, with rule, severity, order."""
    parts = []
    for rule_id in only or RULES:
        ordinal, severity, rule = RULES[rule_id]
        parts.append(
            rule(tables).select(
                "doc_id",
                F.lit(ordinal).alias("rule_ord"),
                F.lit(rule_id).alias("rule_id"),
                F.lit(severity).alias("severity"),
                "obj",
                "gen",
                "position",
                "page_index",
                F.concat_ws(": ", F.lit(rule_id), F.nullif(F.col("detail"), F.lit(""))).alias("message"),
                F.lit(REMEDIES[rule_id]).alias("remedy"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def ranked(found: DataFrame) -> DataFrame:
    """``seq``: a finding's place in its file's report, the same on every run."""
    by = Window.partitionBy("doc_id").orderBy("rule_ord", F.col("page_index").asc_nulls_last(), F.col("obj").asc_nulls_last(), F.col("position").asc_nulls_last(), "message")
    return found.withColumn("seq", F.row_number().over(by).cast("long") - 1)


def capped(found: DataFrame, most: int = 1000) -> DataFrame:
    """The first ``most`` findings of each file."""
    return ranked(found).where(F.col("seq") < most)


def report(found: DataFrame, most: int = 1000) -> DataFrame:
    """One row per file with findings: counts by severity, and how many were left out."""
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("severity") == "Error").alias("errors"),
        F.count_if(F.col("severity") == "Warning").alias("warnings"),
        F.count_if(F.col("severity") == "Information").alias("informations"),
        F.greatest(F.count("*") - most, F.lit(0)).alias("suppressed"),
    )
