"""Access, walks, limits, rarer rules and codes."""

import re

from quirelake.functions.display import count_of, quote, show
from quirelake.functions.syntax import Name, Ref, Text
from quirelake.operators import access, joins, rules, walks
from quirelake.operators.tables import parse, tables_of
from quirelake.sources import builder as B
from quirelake.sources.reader import Limits, PdfFile

BODIES = B.page_bodies(2, info=b"<< /Title <FEFF20AC> /N 4.0 /X 2.5 /B true /M /Nm /R 1 0 R >>")
BASE = B.build(BODIES, trailer=b"/Info 7 0 R ")


def files(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "doc_id long, content binary")


def codes(data, **limits):
    return [c for _, c, _, _ in PdfFile(data, Limits(**limits)).open().load_all().diagnostics]


def test_typed_access(spark):
    t = tables_of(files(spark, BASE))
    row = access.pick(
        t.nodes.where("holder = 7"),
        title=("/Title", "text"), n=("/N", "integer"), x=("/X", "integer"), y=("/X", "number"), b=("/B", "boolean"), m=("/M", "name"), r=("/R", "reference"),
    ).first()
    assert (row.title, row.n, row.x, row.y, row.b, row.m, row.r) == ("€", 4, None, 2.5, True, "Nm", 1)
    assert access.of_type(t.objects, "Page").count() == 2
    assert {r.presence for r in access.presence(t.refs, t.index, t.objects).collect()} == {"defined"}
    assert access.has_image_filter(t.streams).count() == 0 and "DCTDecode" in access.image_filters()


def test_merged_trailer_and_extents(spark):
    t = tables_of(files(spark, B.update(BASE, {7: b"<< >>"}, trailer=b"/Mine 5 ")))
    merged = {r.key: (r.section, r.ref_obj or r.i) for r in joins.merged_trailer(t.trailers).collect()}
    assert merged == {"Size": (0, 8), "Root": (0, 1), "Info": (1, 7), "Mine": (0, 5)}
    rows = {r.obj: r for r in joins.extents(t.index).collect()}
    assert rows[2].before == rows[1].offset and rows[2].after == rows[3].offset and rows[7].after is None


def test_rows_of_a_stream_by_expressions(spark):
    t = tables_of(files(spark, B.build(BODIES, index="stream")))
    decoded = t.streams.join(t.objects.where("type_name = 'XRef'").select("doc_id", "obj"), ["doc_id", "obj"])
    by_sql = [(r.kind, r.two, r.three) for r in joins.stream_rows(decoded, (1, 4, 2)).orderBy("row").collect()]
    by_kernel = [({"free": 0, "regular": 1}[r.kind], r.offset, r.gen) for r in t.xref_entries.orderBy("row_ord").collect()]
    assert by_sql == by_kernel and len(by_sql) == 9


def test_tokens_and_trees(spark):
    b = {
        **BODIES,
        1: b"<< /Type /Catalog /Pages 2 0 R /Names << /Dests 20 0 R >> /PageLabels << /Nums [0 << >> 5 null] >> >>",
        20: b"<< /Kids [21 0 R 22 0 R 21 0 R 20 0 R] >>",
        21: b"<< /Names [(a) 3 0 R (b) [1]] >>",
        22: b"<< /Names [(c) 5 0 R (odd)] >>",
    }
    df = files(spark, B.build(b), b"")
    rows = sorted((r.tree, r.ord, r.name, r.number, r.target, r.kind) for r in walks.tree_entries(df).collect() if r.tree == "Dests")
    assert rows == [("Dests", 0, "a", None, 3, "dictionary"), ("Dests", 1, "b", None, None, "array"), ("Dests", 2, "c", None, 5, "dictionary")]
    assert walks.tree_entries(df).where("tree = 'PageLabels'").count() == 2
    found = walks.tokens(df).where("obj = 3").orderBy("ord").collect()
    assert [r.shown for r in found][:5] == ["<<", "/Type", "/Page", "/Parent", "2"] and found[0].kind == "keyword"


def test_display():
    assert show({"A": [1, Name("b"), Text(b"x\n"), Ref(2, 0), None, True]}) == "<< /A [1 /b (x\\x0A) 2 0 R null true] >>"
    assert quote(b"a" * 80).endswith("...") and count_of(1, "object") == "1 object" and count_of(12345, "object") == "12,345 objects"
    assert len(show(list(range(1000)))) <= 120


def decoding(body, **limits):
    f = PdfFile(B.build({**BODIES, 9: body}), Limits(**limits)).open()
    f.decode(f.get(9))
    return [c for _, c, _, _ in f.diagnostics]


def test_limits():
    assert "limit.object" in codes(B.build({**BODIES, 9: b"[" + b"1 " * 500 + b"]"}), object_length=300)
    assert "limit.trailer" in codes(B.build(BODIES, trailer=b"/Pad (" + b"x" * 500 + b") "), trailer_length=100)
    assert "limit.xref-section-length" in codes(BASE, section_length=60)
    assert "limit.index-entries" in codes(BASE, index_entries=3)
    assert "limit.filter-chain" in decoding(B.stream(b"", b"/Filter [" + b"/AHx " * 9 + b"] "), filter_chain=5)
    assert "limit.decoded-stream" in decoding(B.flate_stream(bytes(9999)), decoded_stream=100)
    assert "limit.stream-length" in decoding(B.stream(b"x" * 200), raw_stream=100)
    assert "limit.rebuild-reads" in codes(B.damaged(BASE, "no-startxref"), rebuild_passes=0)
    packed = B.build({4: BODIES[4], 6: BODIES[6]}, index="stream", packed={n: BODIES[n] for n in (1, 2, 3, 5)})
    assert "limit.object-stream-decodes" in codes(packed, object_stream_decodes=0)
    f = PdfFile(BASE.replace(b"[3 0 R 5 0 R]", b"[" * 40 + b"]" * 2), Limits(diagnostics=1)).open().load_all()
    assert len(f.diagnostics) == 1


def rule_ids(spark, data):
    return {r.rule_id for r in rules.findings(tables_of(files(spark, data)), [x for x in rules.RULES if x.startswith(("xref.", "file."))]).collect()}


def test_rarer_rules(spark):
    # Two definitions of an object near its offset, neither there: unconfirmed.
    twice = B.build({**BODIES, 9: b"null"}, offset_error={9: 9}).replace(b"endobj\n9 0 obj\nnull\nendobj\n", b"endobj\n9 0 obj\nnull\nendobj\n9 0 obj\nnull\nendobj\n")
    at = twice.rindex(b"xref\n0")
    twice = re.sub(rb"startxref\n\d+", b"startxref\n%d" % at, twice)
    assert "xref.entry-unconfirmed" in rule_ids(spark, twice)
    # A chain that indexes nothing.
    data = B.build(BODIES, index="none")
    data += b"xref\n0 0\ntrailer\n<< /Size 0 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % len(data)
    assert "xref.chain-empty" in rule_ids(spark, data)
    # /XRefStm that names the table of the older revision.
    old = int(re.findall(rb"startxref\s+(\d+)", BASE)[-1])
    assert "xref.hybrid-stream-wrong" in rule_ids(spark, B.update(BASE, {7: b"<< >>"}, trailer=b"/XRefStm %d " % old))
    # A section found only in a comment.
    pad = b"%" + b"." * 700 + b"\n"
    at = len(BASE + pad)
    lost = BASE + pad + b"% xref\n0 0\ntrailer << /Size 8 >>\n" + pad
    new = len(lost)
    lost += b"xref\n0 0\ntrailer\n<< /Size 8 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at + 4, new)
    assert "xref.section-unconfirmed" in rule_ids(spark, lost)


def test_checked_in_part(spark):
    df = files(spark, B.build({**BODIES, 9: B.flate_stream(bytes(9999))}))
    t = tables_of(df)
    t.parsed = parse(df, limits=Limits(decoded_stream=100))
    assert rules.findings(t, ["xref.checked-in-part"]).count() == 1


def test_stream_passed_over():
    data = B.build({**BODIES}, index="stream")
    at = int(re.findall(rb"startxref\s+(\d+)", data)[-1])
    table = len(data)
    data += b"xref\n0 0\ntrailer\n<< /Size 9 /Root 1 0 R /XRefStm %d /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at, at + 3, table)
    assert "xref.stream-passed-over" in codes(data)
