"""Rules, joins, trees and shapes over small files; queries against their SQL."""

import pytest

from quirelake.operators import joins, page_tree, rules, shapes
from quirelake.operators.tables import PARTS, Tables, parse, tables_of
from quirelake.plans import queries
from quirelake.sources import builder as B
from quirelake.sources.reader import Limits, PdfFile
from quirelake.sources import files

BODIES = B.page_bodies(3, info=b"<< /Title (x) >>")
TREE = BODIES[2]


def bodies(**changed):
    return BODIES | {int(k[1:]): v for k, v in changed.items()}


CASES = {
    "sound": (B.build(BODIES), {}),
    "cycle": (B.build(bodies(n2=TREE.replace(b"[3", b"[2 0 R 3"))), {"page-tree.cycle": 1}),
    "kid in array": (B.build(bodies(n2=TREE.replace(b"[3 0 R", b"[<< /Type /Page /Parent 2 0 R >>"))), {"page-tree.kid-invalid": 1, "page-tree.page-orphaned": 1}),
    "no count": (B.build(bodies(n2=TREE.replace(b"/Count 3", b""))), {"page-tree.count-mismatch": 1}),
    "flat box": (B.build(bodies(n2=TREE.replace(b"[0 0 612 792]", b"[0 0 0 792]"))), {"page-tree.mediabox-invalid": 1}),
    "upper corner": (B.build(bodies(n2=TREE.replace(b"[0 0 612 792]", b"[612 792 0 0]"))), {}),
    "root parent": (B.build(bodies(n2=TREE.replace(b"/Kids", b"/Parent 1 0 R /Kids"))), {"page-tree.parent-wrong": 1}),
    "missing resources": (B.build(bodies(n2=TREE.replace(b"/Resources << >>", b"/Resources 88 0 R"))), {"object.reference-missing": 1}),
    "no catalog type": (B.build(bodies(n1=b"<< /Pages 2 0 R >>")), {"object.key-missing": 1}),
    "stray pages": (B.build(bodies(n1=b"<< /Type /Catalog /Pages 77 0 R >>")), {"object.reference-missing": 1}),
    "empty": (b"", {}),
    "junk": (b"not a file", {}),
}


@pytest.fixture(scope="module")
def tables(spark):
    df = spark.createDataFrame([(k, data) for k, (data, _) in enumerate(CASES.values())], "doc_id long, content binary")
    return tables_of(df)


def test_findings(tables):
    found: dict = {}
    for r in rules.findings(tables).collect():
        found.setdefault(r.doc_id, {}).setdefault(r.rule_id, 0)
        found[r.doc_id][r.rule_id] += 1
    for k, (name, (_, want)) in enumerate(CASES.items()):
        if name == "junk":
            continue
        assert found.get(k, {}) == want, name


def test_profile_is_whole():
    assert len(rules.PROFILE) == 46 and len(rules.RULES) == 46
    severities = [s for _, s, _ in rules.PROFILE]
    assert (severities.count("Warning"), severities.count("Error"), severities.count("Information")) == (27, 16, 3)


def test_reports_are_ranked_and_capped(tables):
    found = rules.findings(tables)
    a, b = (sorted(map(tuple, rules.ranked(found).collect()), key=str) for _ in range(2))
    assert a == b and rules.capped(found, 0).count() == 0
    assert rules.report(found, 0).agg({"suppressed": "sum"}).first()[0] == found.count()


def test_every_part_can_be_asked_alone(spark, tables):
    for part in PARTS:
        assert parse(tables.files, part).count() == len(CASES)


def test_reachable_by_frontiers(tables):
    by_kernel = tables.objects.where("reachable").select("doc_id", "obj")
    by_frontiers = joins.reachable(tables.refs, tables.index)
    assert sorted(map(tuple, by_kernel.collect())) == sorted(map(tuple, by_frontiers.collect()))


def test_pages_by_recursion(spark, tables):
    nodes = tables.nodes.selectExpr("doc_id", "path", "parent_path", "elem", "kind", "CAST(holder AS INT) AS holder", "CAST(ref_obj AS INT) AS ref_obj")
    roots = tables.structure.where("doc_id in (0, 4, 5)").selectExpr("doc_id", "page_root AS obj")
    by_sql = page_tree.pages_by_recursion(nodes, roots).selectExpr("doc_id", "page_index", "obj").collect()
    by_walk = tables.pages.where("doc_id in (0, 4, 5)").selectExpr("doc_id", "page_index", "CAST(obj AS INT) AS obj").collect()
    assert sorted(map(tuple, by_sql)) == sorted(map(tuple, by_walk))


def test_a_page_listed_twice_counts_twice(spark):
    twice = B.build(bodies(n2=TREE.replace(b"[3 0 R", b"[5 0 R 3 0 R").replace(b"/Count 3", b"/Count 4")))
    node = B.build({**bodies(n2=TREE.replace(b"[3 0 R", b"[30 0 R 30 0 R 3 0 R").replace(b"/Count 3", b"/Count 5")), 30: b"<< /Type /Pages /Parent 2 0 R /Count 1 /Kids [31 0 R] >>", 31: b"<< /Type /Page /Parent 30 0 R >>"})
    t = tables_of(spark.createDataFrame([(1, twice), (2, node)], "doc_id long, content binary"))
    rows = t.pages.where("doc_id = 1").orderBy("page_index").collect()
    assert [r.obj for r in rows] == [5, 3, 5, 7] and [r.page_index for r in rows] == [0, 1, 2, 3]
    found = sorted((r.doc_id, r.rule_id) for r in rules.findings(t, queries.TREE_RULES).collect())
    assert found == [(1, "page-tree.node-repeated"), (2, "page-tree.node-repeated")]


def test_strongly_connected(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 4), (2, 5, 5), (2, 6, 7), (1, 8, 9), (1, 9, 8)], "doc_id long, a long, b long")
    found = sorted(map(tuple, joins.strongly_connected(edges).collect()))
    assert found == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 8, 8), (1, 9, 8), (2, 5, 5)]


def test_shape_compiler(tmp_path):
    head = "Key\tType\tSinceVersion\tDeprecatedIn\tRequired\tIndirectReference\tInheritable\tDefaultValue\tPossibleValues\tSpecialCase\tLink\tNote"
    lines = [
        "Type\tname\t1.0\t\tTRUE\tFALSE\tFALSE\t\t[Thing,Other]\t\t\t",
        "Old\tinteger;name\t1.0\t1.3\tFALSE\tFALSE\tFALSE\t\t\t\t\t",
        "Kid\tarray;dictionary\t1.0\t\tfn:IsRequired(fn:SinceVersion(1.5))\tFALSE\tTRUE\t\t\t\t[ArrayOfThings];[fn:SinceVersion(1.2,Thing),Other]\t",
        "If\tfn:SinceVersion(1.4,name)\t1.0\t\tfn:IsRequired(@Type==Thing)\tFALSE\tFALSE\t\t\t\t\t",
        "Ext\tname\tfn:Extension(X)\t\tTRUE\tFALSE\tFALSE\t\t\t\t\t",
    ]
    (tmp_path / "Thing.tsv").write_text("\n".join([head, *lines]) + "\n")
    rows = shapes.compile_model(str(tmp_path))["Thing"]
    assert list(rows) == ["Type", "Old", "Kid", "If"]
    assert rows["Type"].required and rows["Type"].values == ["Thing", "Other"] and rows["Old"].deprecated == 13
    assert rows["Kid"].links == {"array": ["ArrayOfThings"], "dictionary": ["Thing", "Other"]} and rows["Kid"].inheritable
    assert rows["Kid"].is_required(15) and not rows["Kid"].is_required(14) and not rows["Kid"].is_required(None)
    assert rows["If"].types == ["name"] and not rows["If"].is_required(17)
    assert len(shapes.model_rows({"Thing": rows})) == 4


def test_shapes_choose_by_subtype(spark):
    b = bodies(
        n2=TREE.replace(b"<< >>", b"<< /Font << /A 20 0 R /B 21 0 R /C 22 0 R >> >>"),
        n20=b"<< /Type /Font /Subtype /Type1 /BaseFont /X /FirstChar (a) >>",
        n21=b"<< /Type /Font /Subtype /TrueType >>",
        n22=b"<< /Type /Font /Subtype /Unknown >>",
    )
    df = spark.createDataFrame([(1, B.build(b))], "doc_id long, content binary")
    found = sorted((r.rule_id, r.type, r.key) for r in Tables(parse(df, "breaches")).breaches.collect())
    assert found == [("object.key-missing", "FontTrueType", "BaseFont"), ("object.value-type-wrong", "FontType1", "FirstChar")]


def test_strict_limits_refuse_files(spark):
    chained = B.build({**BODIES, 4: B.stream(b"q Q").replace(b"<< ", b"<< /Filter [%s] " % (b"/ASCIIHexDecode " * 70), 1)})
    locked = B.build({**BODIES, 30: b"<< /Filter /Standard >>"}, trailer=b"/Encrypt 30 0 R ")
    df = spark.createDataFrame([(1, chained), (2, locked), (3, CASES["sound"][0])], "doc_id long, content binary")
    strict = tables_of(df, "structure", "streams", "objects", limits=Limits(strict=True, refuse_encrypted=True))
    assert {r.doc_id: r.open_error for r in strict.structure.collect()} == {1: "limit.filter-chain", 2: "encrypted", 3: None}
    assert {r.doc_id for r in strict.objects.collect()} == {3}
    loose = tables_of(df, "structure", "streams")
    assert all(r.open_error is None for r in loose.structure.collect())


def test_raw_bytes_presence_and_runs(spark):
    from quirelake.operators import access

    data = B.damaged(B.build(BODIES), "junk-prefix")
    t = tables_of(spark.createDataFrame([(1, data)], "doc_id long, content binary"), "objects", "structure", "nodes", "index")
    rows = access.raw_bytes(t.files, t.objects, t.structure).collect()
    assert rows and all(bytes(r.raw) == b"q Q" for r in rows)
    update = B.update(B.build(bodies(n3=BODIES[3].replace(b">>", b"/X 60 0 R >>"))), {1: BODIES[1]})
    df = spark.createDataFrame([(1, update)], "doc_id long, content binary")
    for limits, want in ((Limits(), "missing"), (Limits(sections=1, rebuild_passes=0), "unindexed")):
        t = Tables(parse(df, "nodes", "index", "objects", "structure", limits=limits))
        found = {r.dst: r.presence for r in access.presence(t.refs, t.index, t.objects, t.structure).collect()}
        assert want in found.values(), (found, want)
    run = spark.sql("SELECT array(1, 4, 9) AS a, array(2, 4) AS b").select(access.merged_runs("a", "b").alias("m")).first().m
    assert run == [1, 2, 4, 9]


def test_discriminators():
    model = shapes.basic_model()
    found = shapes.discriminators(model, ["FontType1", "FontTrueType"])
    assert found == {"Subtype": {"Type1": ["FontType1"], "TrueType": ["FontTrueType"]}}
    assert list(shapes.discriminators(model, ["PageTreeNode", "PageObject"])) == ["Type"]


def test_codes_past_the_bound_are_counted(spark):
    df = spark.createDataFrame([(1, B.damaged(CASES["sound"][0], "junk-prefix"))], "doc_id long, content binary")
    t = Tables(parse(df, "codes", "diagnostics", limits=Limits(diagnostics=0)))
    assert t.diagnostics.count() == 0
    assert {(r.severity, r.code) for r in t.codes.collect()} >= {("Repair", "xref.offset-adjusted")}


def test_bounded_chain_is_merged_into_the_rebuilt_index():
    """A chain that a bound cut keeps its entries where the scan finds no object."""
    data = B.build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [] /Count 0 >>", 3: b"3"}, index="table")
    for _ in range(3):
        data = B.update(data, {3: b"4"})
    whole, cut = PdfFile(data).open(), PdfFile(data, Limits(sections=1)).open()
    assert set(whole.index) >= {1, 2, 3} and cut.chain_cut
    cut._rebuild("asked for")
    found = set(cut.index)
    kept = PdfFile(data, Limits(sections=1)).open()
    kept.was_repaired = False
    kept.index[9] = type(kept.index[3])(9, "regular", offset=7)
    kept._rebuild("asked for")
    assert set(kept.index) == found | {9}


def test_searches_for_ends_are_bounded():
    """Streams without an end: what all searches read is a few times the file."""
    n = 400
    body = b"<< /Length 9999999 >>\nstream\n" + b"x" * 400
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (k + 1) + body + b"\n" for k in range(n)) + b"trailer << /Root 1 0 R >>\n"
    f = PdfFile(data).open().load_all()
    assert f._searched <= 5 * len(data) + 3 * n * (64 << 10)  # the scan and the loading search apart


def test_every_rule_has_its_own_remedy():
    assert list(rules.REMEDIES) == list(rules.RULES) and len(set(rules.REMEDIES.values())) == 46


def test_shapes_of_parameters_and_repeating_rows():
    """Parameters typed by their filter, repeating groups with a member left out, the first
    element that tells arrays apart."""
    r = shapes.Row
    model = {
        "Catalog": {"S": r("S", ["stream"], links={"stream": ["Data"]}), "G": r("G", ["array"], links={"array": ["GroupArray"]}), "C": r("C", ["array"], links={"array": ["ArrayOfA", "ArrayOfB"]})},
        "Data": {"DecodeParms": r("DecodeParms", ["dictionary", "array"], links={"dictionary": ["FilterFlateDecode", "FilterLZWDecode"], "array": ["ArrayOfDecodeParams"]})},
        "ArrayOfDecodeParams": {"*": r("*", ["dictionary"], links={"dictionary": ["FilterFlateDecode", "FilterLZWDecode"]})},
        "FilterFlateDecode": {"Columns": r("Columns", ["integer"])},
        "FilterLZWDecode": {"Columns": r("Columns", ["name"])},
        "GroupArray": {"0": r("0", ["name"]), "1*": r("1*", ["integer"]), "2*": r("2*", ["name"])},
        "ArrayOfA": {"0": r("0", ["name"], values=["A"]), "1": r("1", ["integer"])},
        "ArrayOfB": {"0": r("0", ["name"], values=["B"]), "1": r("1", ["name"])},
        "DocInfo": {},
    }

    def found(catalog: bytes, parms: bytes = b"", filters: bytes = b"") -> list:
        data = B.build({1: b"<< /Type /Catalog /Pages 2 0 R /S 3 0 R " + catalog + b" >>", 2: b"<< /Type /Pages /Kids [] /Count 0 >>", 3: b"<< /Length 1 " + filters + parms + b" >>\nstream\nx\nendstream"})
        return [(rule, name, key) for rule, name, key, *_ in shapes.check(PdfFile(data).open(), model)]

    wrong = [("object.value-type-wrong", "FilterLZWDecode", "Columns")]
    assert found(b"", b"/DecodeParms << /Columns 4 >>", b"/Filter /FlateDecode ") == []
    assert found(b"", b"/DecodeParms << /Columns 4 >>", b"/Filter /LZWDecode ") == wrong
    assert found(b"", b"/DecodeParms << /Columns 4 >>", b"/Filter [/LZWDecode] ") == wrong
    assert found(b"", b"/DecodeParms << /Columns 4 >>", b"/Filter [/FlateDecode /LZWDecode] ") == []
    assert found(b"", b"/DecodeParms [null << /Columns 4 >>]", b"/Filter [/FlateDecode /LZWDecode] ") == wrong
    assert found(b"/G [/X 1 /a 2 /b 3 4 /c]") == []
    assert found(b"/G [/X 1 /a (s) /b]") == [("object.value-type-wrong", "GroupArray", "1*")]
    assert found(b"/C [/B 5]") == [("object.value-type-wrong", "ArrayOfB", "1")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(CASES["sound"][0])
    (tmp_path / "b.pdf").write_bytes(B.damaged(CASES["sound"][0], "junk-prefix"))
    (tmp_path / "c.txt").write_text("x")
    found = files.read_folder(spark, str(tmp_path))
    assert found.count() == 2
    headers = sorted((r.header_pos, r.header_version) for r in files.header_by_sql(found).collect())
    assert headers[0] == (0, "1.7") and headers[1][0] > 0
    spark.dataSource.register(files.PdfEnds)
    ends = spark.read.format("pdf_ends").option("path", str(tmp_path)).option("bytes", "64").load()
    assert sorted(r.length for r in ends.collect()) == sorted(r.length for r in found.collect())
    column = files.from_column(found.selectExpr("1 AS k", "content AS c"), "k", "c")
    assert column.columns == ["doc_id", "path", "length", "content"]


def test_arrivals_are_read_as_they_come(spark, tmp_path):
    from quirelake.streaming.inbox import watch

    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    for k in range(2):
        (inbox / f"{k}.pdf").write_bytes(CASES["cycle"][0])
        watch(spark, str(inbox), str(out), str(tmp_path / "state"), rules_only=["page-tree.cycle"]).awaitTermination(120)
    assert spark.read.parquet(f"{out}/findings").count() == 2
    assert spark.read.parquet(f"{out}/structure").count() == 2


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "nation customer part orders lineitem events documents embeddings benchmark conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    found = queries.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(columns)
    tidy = lambda row: tuple(round(x, 4) + 0.0 if isinstance(x, float) else x for x in row)
    assert sorted(map(tidy, map(tuple, found.select(columns).collect())), key=str) == sorted(map(tidy, want.fetchall()), key=str)
