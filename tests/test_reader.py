"""Opening, chains, streams' ends, rebuilding, object streams, fuzzing."""

import random
import re

import pytest

from quirelake.functions.syntax import Ref, Stream
from quirelake.operators import page_tree
from quirelake.sources import builder as B
from quirelake.sources.reader import Limits, PdfFile

BODIES = B.page_bodies(3, [b"BT (hello) Tj ET " * 9] * 3, b"<< /Title (x) >>")
BASE = B.build(BODIES, trailer=b"/Info 9 0 R ")


def opened(data: bytes, **limits) -> PdfFile:
    return PdfFile(data, Limits(**limits)).open().load_all()


def codes(f: PdfFile) -> list[str]:
    return [c for _, c, _, _ in f.diagnostics]


def split(bodies):
    streams = {n: b for n, b in bodies.items() if b"stream" in b}
    return streams, {n: b for n, b in bodies.items() if n not in streams}


def packed(**more) -> bytes:
    streams, rest = split(BODIES)
    return B.build(streams, index="stream", packed=rest, **more)


@pytest.mark.parametrize("data", [BASE, B.build(BODIES, index="stream"), packed(), B.update(BASE, {9: b"<< /Title (y) >>"})])
def test_sound_files(data):
    f = opened(data)
    assert not f.was_repaired and not f.diagnostics and f.root_usable and f.declared_version() == "1.7"
    assert len(page_tree.Walk(f).pages) == 3


def test_newest_revision_wins():
    f = opened(B.update(B.update(BASE, {9: b"<< /Title (y) >>"}, trailer=b"/Info 9 0 R "), {9: b"<< /Title (z) >>"}, trailer=b"/Info 9 0 R "))
    assert f.get(9) == {"Title": b"z"} and [s.named_by for s in f.sections] == ["startxref", "Prev", "Prev"]


@pytest.mark.parametrize(
    ("damage", "told", "rebuilt"),
    [
        ("no-xref", ["xref.rebuilt"], True),
        ("shifted-offsets", ["xref.rebuilt"], True),
        ("truncated-tail", ["xref.rebuilt"], True),
        ("junk-prefix", ["xref.offset-adjusted"], False),
        ("lying-length", ["stream.length-invalid"], False),
        ("no-header", ["header.missing"], False),
        ("no-startxref", ["xref.rebuilt"], True),
        ("wrong-startxref", ["xref.section-missing", "xref.rebuilt"], True),
    ],
)
def test_damages(damage, told, rebuilt):
    f = opened(B.damaged(BASE, damage))
    assert set(told) <= set(codes(f)) and f.was_repaired == rebuilt and f.root_usable
    if damage != "truncated-tail":
        assert len(page_tree.Walk(f).pages) == 3
        assert {n: f.objects[n] for n in (1, 2)} == {n: opened(BASE).objects[n] for n in (1, 2)}


def test_errors_are_rows():
    assert PdfFile(b"").open().open_error == "empty"
    assert PdfFile(b"hello").open().open_error == "no-object"


def test_stream_ends():
    def body(length, data=b"abc", tail=b"\nendstream"):
        text = b"<< /Length %s >>\nstream\n%s%s" % (length, data, tail)
        f = opened(B.build({**BODIES, 10: text, 11: b"3"}))
        s = f.get(10)
        return f.data[s.start : s.start + s.length], codes(f)

    assert body(b"3") == (b"abc", [])
    assert body(b"11 0 R") == (b"abc", [])
    assert body(b"3.0") == (b"abc", [])
    assert body(b"1") == (b"abc", ["stream.length-invalid"])
    assert body(b"3", tail=b" % x\nendstream") == (b"abc", [])
    assert body(b"(x)", tail=b"\r\nendstream") == (b"abc", ["stream.length-invalid"])
    assert body(b"3", tail=b"\n") == (b"abc", ["stream.truncated"])
    assert body(b"99", tail=b"") == (b"abc", ["stream.truncated"])


def test_cut_inside_a_stream():
    f = opened(BASE[: BASE.index(b"8 0 obj") + 60])
    assert {"xref.rebuilt", "stream.truncated"} <= set(codes(f)) and isinstance(f.get(8), Stream)
    assert not f.facts[8]["endobj_missing"]


def test_headers_in_streams_and_comments_are_no_objects():
    trap = b"7 0 obj << /Type /Catalog >> endobj\ntrailer << /Root 7 0 R >>"
    bodies = {**B.page_bodies(1, [trap])}
    data = B.build(bodies).replace(b"2 0 obj", b"% 8 0 obj null endobj\n2 0 obj", 1)
    f = opened(B.damaged(data, "no-startxref"))
    assert set(f.index) == {1, 2, 3, 4} and f.trailer["Root"] == Ref(1, 0)


def test_rebuild_takes_the_last_definition():
    data = B.damaged(B.update(BASE, {9: b"<< /Title (new) >>"}), "no-startxref")
    f = opened(data)
    assert f.get(9) == {"Title": b"new"} and "object.redefined" in codes(f)
    f = opened(B.damaged(packed(), "no-startxref"))
    assert f.get(3)["Type"] == "Page" and f.index[3].kind == "compressed"


def test_catalog_is_searched():
    f = opened(B.build(BODIES, root_entry=b"/Root 3 0 R "))
    assert f.catalog_found_as == 1 and "trailer.root-recovered" in codes(f) and not f.was_repaired


def test_relocated_objects_and_sections():
    f = opened(B.build(BODIES, offset_error={5: 3}))
    assert not f.was_repaired and codes(f) == ["xref.offset-adjusted"]
    assert opened(B.build(BODIES, offset_error={5: 900})).was_repaired
    data = B.update(BASE, {9: b"<< /Title (y) >>"})
    m = re.search(rb"/Prev (\d+)", data)
    f = opened(data[: m.start(1)] + b"%d" % (int(m[1]) + 2) + data[m.end(1) :])
    assert [s.relocated for s in f.sections] == [False, True] and f.get(5)["Type"] == "Page"


def test_chain_faults():
    f = opened(B.update(BASE, {9: b"<< >>"}, loop=True))
    assert f.loop_offset is not None and "xref.chain-cycle" in codes(f)
    f = opened(BASE, sections=0)
    assert "limit.xref-section-count" in codes(f)
    f = opened(BASE.replace(b"trailer\n<<", b"trailer\n( "))
    assert f.sections[0].trailer_fault == "malformed" and f.catalog_found_as == 1


def test_hybrid_files():
    streams, rest = split(BODIES)
    data = B.build({**streams, 1: rest[1], 2: rest[2]}, index="table")
    inner = B.build({}, index="stream", packed={n: rest[n] for n in (3, 5, 7)})
    at = len(data)
    container = inner[inner.index(b"8 0 obj") : inner.index(b"9 0 obj")].replace(b"8 0 obj", b"20 0 obj", 1)
    rows = b"".join(b"\x02" + (20).to_bytes(4, "big") + k.to_bytes(2, "big") for k in range(3))
    rows = rows[:7] + rows[7:14] + rows[14:] + b"\x01" + at.to_bytes(4, "big") + b"\x00\x00"
    stm = len(data) + len(container)
    xref = B._object(21, B.stream(rows, b"/Type /XRef /W [1 4 2] /Index [3 1 5 1 7 1 20 1] /Size 22 "))
    old = int(re.findall(rb"startxref\s+(\d+)", data)[-1])
    table = len(data) + len(container) + len(xref)
    out = data + container + xref + b"xref\n0 0\ntrailer\n<< /Size 22 /Root 1 0 R /XRefStm %d /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (stm, old, table)
    f = opened(out)
    assert [s.named_by for s in f.sections] == ["startxref", "XRefStm", "Prev"]
    assert not f.was_repaired and f.get(7)["Type"] == "Page" and len(page_tree.Walk(f).pages) == 3
    lost = opened(out.replace(b"/XRefStm %d" % stm, b"/XRefStm %d" % old))
    assert "xref.hybrid-stream-lost" in codes(lost)


def test_object_streams():
    data = packed()
    f = opened(data.replace(b"/Type /ObjStm", b"/Type /ObjStx", 1))
    assert "object-stream.unreadable" in codes(f)
    f = opened(B.build({4: BODIES[4]}, index="stream", packed={1: b"<< /Type /Catalog >>", 2: b"<< /Length 1 >> stream"}))
    assert "object-stream.member-stream" in codes(f)
    moved = opened(data)
    e = moved.index[5]
    e.idx += 1
    moved.objects.clear()
    assert moved.get(5)["Type"] == "Page" and "object-stream.member-moved" in codes(moved)


def test_self_reference():
    f = opened(B.build({**BODIES, 10: b"<< /Length 10 0 R >>\nstream\nabc\nendstream"}))
    assert isinstance(f.get(10), Stream) and "stream.self-reference" in codes(f)


def test_encryption():
    f = opened(B.build({**BODIES, 10: b"<< /Filter /Standard >>"}, trailer=b"/Encrypt 10 0 R "))
    assert f.is_encrypted
    assert "trailer.encrypt-invalid" in codes(opened(B.build(BODIES, trailer=b"/Encrypt 77 0 R ")))
    late = opened(B.damaged(B.build({**BODIES, 10: b"<< >>"}, trailer=b"/Encrypt 10 0 R "), "no-startxref"))
    assert "trailer.encrypt-late" in codes(late)


def test_out_of_range_and_reserved_rows():
    f = opened(BASE.replace(b"0000000015 00000 n", b"0099999999 00000 n"))
    assert {"xref.entry-out-of-range", "xref.rebuilt"} & set(codes(f)) and f.root_usable


def test_references_are_followed_so_far():
    chain = {10 + k: b"%d 0 R" % (11 + k) for k in range(40)} | {50: b"7"}
    f = opened(B.build({**BODIES, **chain}))
    assert f.resolve(Ref(30, 0)) == 7 and f.resolve(Ref(10, 0)) is None


def test_versions():
    version = lambda v, c: opened(B.build(B.page_bodies(1, catalog=c), version=v)).declared_version()
    assert version("1.4", b"/Version /1.6 ") == "1.6" and version("1.4", b"/Version /1.2 ") == "1.4"
    assert version("1.8", b"") == "1.8" and version("x.y", b"/Version /1.6 ") is None


@pytest.mark.parametrize("seed", range(150))
def test_mutations_never_raise(seed):
    rng = random.Random(seed)
    data = bytearray(rng.choice([BASE, packed(), B.update(BASE, {9: b"<< /Title (y) >>"})]))
    kind = seed % 6
    if kind == 0:
        for _ in range(rng.randint(1, 8)):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
    elif kind == 1:
        places = [k for k, c in enumerate(data) if 48 <= c <= 57]
        for _ in range(16):
            data[rng.choice(places)] = rng.randint(48, 57)
    elif kind == 2:
        del data[rng.randrange(len(data)) :]
    elif kind == 3:
        at = rng.randrange(len(data))
        data[at : at + 64] = rng.randbytes(rng.randint(1, 64))
    else:
        word = b"endstream" if kind == 4 else b" obj"
        data = bytearray(bytes(data).replace(word, word[:-1] + b"#", rng.randint(1, 3)))
    f = opened(bytes(data))
    page_tree.Walk(f)
    assert list(f.nodes()) is not None
    assert codes(opened(bytes(data))) == codes(f)
