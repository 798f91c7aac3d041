"""Words, reading, building, transforms: vectors as data, limits, and seeded random frames."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe import schemas
from loomframe.kernel import columnar, packing, rows, transform, wire
from loomframe.kernel.builder import Builder
from loomframe.kernel.reader import Frame, walk
from loomframe.kernel.wire import FrameError, Limits, Pointer
from loomframe.layout import INT32, TEXT, UINT8, UINT32, Field, Struct, list_of, struct_of

FRAMED = bytes.fromhex(
    "0000000023000000000000000000010001000000570000000800000001000400"
    "7b00000002000000210000003200000021000000920000002900000017000000"
    "3900000022000000c80100000000000035000000220000003500000082000000"
    "39000000270000000000000000000000416c696365000000616c696365406578"
    "616d706c652e636f6d0000000000000004000000010001000000000000000000"
    "010000004a0000003535352d3132313200000000000000004d49540000000000"
    "426f620000000000626f62406578616d706c652e636f6d000800000001000100"
    "0100000000000000090000004a0000000200000000000000090000004a000000"
    "3535352d3435363700000000000000003535352d373635340000000000000000"
)
PACKED = bytes.fromhex(
    "1023400111015751080104117b0211213211219211291711392203c801113522"
    "11358211392700001f416c696365ff616c69636540657801616d706c652e636f"
    "016d51040101000011014aff3535352d31323132000000074d495407426f62ff"
    "626f62406578616d01706c652e636f6d0051080101010111094a010211094aff"
    "3535352d34353637000000ff3535352d37363534000000"
)


def words(*ws: int) -> bytes:
    return b"".join(w.to_bytes(8, "little") for w in ws)


def frame(*ws: int) -> Frame:
    return Frame.raw(words(*ws))


def S(off, d, p):
    return wire.struct_word(off, d, p)


def L(off, e, n):
    return wire.list_word(off, e, n)


def code(f, *args) -> str:
    with pytest.raises(FrameError) as e:
        f(*args)
    return e.value.code


def test_pointer_words():
    for off, d, p in ((0, 0, 0), (-1, 0, 0), (5, 2, 3), (-(1 << 29), 65535, 65535)):
        x = Pointer.of(S(off, d, p))
        assert (x.kind, x.offset, x.dwords, x.pwords) == (wire.STRUCT, off, d, p)
    x = Pointer.of(L(-7, 4, 1 << 28))
    assert (x.kind, x.offset, x.esize, x.count) == (wire.LIST, -7, 4, 1 << 28)
    x = Pointer.of(wire.far_word(True, 99, 3))
    assert (x.kind, x.two, x.offset, x.segment) == (wire.FAR, True, 99, 3)
    assert Pointer.of(wire.cap_word(42)).cap == 42
    assert S(-1, 0, 0) == wire.EMPTY_STRUCT


def test_address_book_vectors():
    value, errors = columnar.decode(pa.array([FRAMED]), schemas.ADDRESS_BOOK)
    people = value[0].as_py()["people"]
    assert [p["name"] for p in people] == ["Alice", "Bob"] and people[0]["employment"] == {"which": "school", "employer": None, "school": "MIT"}
    assert people[1]["phones"] == [{"number": "555-4567", "type": "home"}, {"number": "555-7654", "type": "work"}]
    assert transform.pack(FRAMED) == PACKED and transform.unpack(PACKED) == FRAMED
    assert columnar.encode(pa.array([value[0].as_py()], schemas.ADDRESS_BOOK.arrow()), schemas.ADDRESS_BOOK)[0].as_py() == FRAMED
    canonical = transform.canonicalize(Frame.parse(FRAMED))
    assert len(canonical) == 272 and transform.canonicalize(Frame.raw(canonical)) == canonical
    for first in (1, 2, 4, 16):
        other = transform.resegment(Frame.parse(FRAMED), first)
        assert len(Frame.parse(other).segments) > 1 and transform.canonicalize(Frame.parse(other)) == canonical
        assert columnar.decode(pa.array([other]), schemas.ADDRESS_BOOK)[0][0].as_py() == value[0].as_py()


def test_packing():
    spec = bytes.fromhex("080000000300020019000000aa010000")
    assert transform.pack(spec).hex() == "510803023119aa01"
    assert transform.pack(b"bob@example.com\0").hex() == "ff" + b"bob@exam".hex() + "01" + b"ple.com\0".hex()
    assert code(transform.pack, b"123") == "ARG"
    assert code(transform.unpack, bytes([0, 255] * 32), 16) == "PACKED"
    for cut in (b"\0", b"\x01", b"\xff12345678", b"\xff12345678\x01abc"):
        assert code(transform.unpack, cut) == "PACKED"
    assert transform.pack(b"") == b"" == transform.unpack(b"")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"\0" * 8, b"\1" * 8, b"\1" * 7 + b"\0", b"\1" * 6 + b"\0\0", b"\0\0\5\0\0\0\0\1"]), max_size=600))
def test_pack_inverse(parts):
    raw = b"".join(parts)
    assert transform.unpack(transform.pack(raw)) == raw


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"\0" * 8, b"\1" * 8, b"\1" * 7 + b"\0", b"\1" * 6 + b"\0\0", b"\0\0\5\0\0\0\0\1", b"\2" * 2400, b"\0" * 2400, b"\2" * 2047 + b"\0"]), max_size=40), max_size=12))
def test_columns_pack_as_frames_do(frames):
    raw = [b"".join(x) if len(x) != 3 else None for x in frames]
    column = pa.array([b"junk", *raw], pa.binary())[1:]  # a slice
    packed = packing.pack(column)
    assert packed.to_pylist() == [None if x is None else transform.pack(x) for x in raw]
    for long in (0, 64, 1 << 20):
        packing.LONG = long
        assert packing.unpack(packed).to_pylist() == raw
    cut = pa.array([x[:-1] if x else x for x in packed.to_pylist()], pa.binary())

    def plain(x):
        try:
            return None if x is None else transform.unpack(x, 100)
        except FrameError:
            return None

    assert packing.unpack(cut, 100, "PERMISSIVE").to_pylist() == [plain(x) for x in cut.to_pylist()]


def test_list_evolution():
    r = frame(S(0, 0, 1), L(0, 4, 2), 100 | 200 << 32).root().pointer(0)
    assert r.element_struct(1).number(0, "uint32") == 200 and r.element_struct(1).number(0, "uint64", 5) == 5 and r.element_struct(0).number(0, "uint16") == 100
    r = frame(S(0, 0, 1), L(0, 2, 5), int.from_bytes(bytes([1, 2, 3, 4, 5, 0, 0, 0]), "little")).root().pointer(0)
    assert r.element_struct(3).number(0, "uint8") == 4 and r.element_struct(3).number(0, "uint16", 0xABCD) == 0xABCD
    r = frame(S(0, 0, 1), L(0, 6, 1), L(0, 2, 5), int.from_bytes(b"elem\0\0\0\0", "little")).root().pointer(0)
    assert r.element_struct(0).text(0) == "elem" and r.element_text(0) == "elem"
    r = frame(S(0, 0, 1), L(0, 1, 3), 0b101).root().pointer(0)
    assert [r.element_flag(i) for i in range(3)] == [True, False, True] and code(r.element_struct, 0) == "KIND"
    r = frame(S(0, 0, 1), L(0, 0, 42)).root().pointer(0)
    assert len(r) == 42 and r.element_struct(41).number(0, "uint32", 7) == 7
    r = frame(S(0, 0, 1), L(0, 7, 4), S(2, 1, 1), 1000, L(2, 2, 6), 1001, 0, int.from_bytes(b"hello\0\0\0", "little")).root().pointer(0)
    assert [r.element_number(i, "uint32") for i in (0, 1, 2)] == [1000, 1001, 0] and r.element_text(0) == "hello" and r.element_text(1) == ""
    assert r.element_number(0, "uint8") == 1000 & 255 and code(r.element_number, -1, "uint8") == "BOUNDS"


def test_text():
    plain = frame(S(0, 0, 1), L(0, 2, 4), int.from_bytes(b"abcd\0\0\0\0", "little")).root()
    assert plain.text(0) == "abcd" and plain.pointer(0).as_data() == b"abcd"
    bad = frame(S(0, 0, 1), L(0, 2, 4), int.from_bytes(b"a\xff\xfeb\0\0\0\0", "little")).root()
    assert bad.text(0) == "a��b"
    s = Struct("t", 0, 1, (Field("t", TEXT, 0, ""),))
    for text in ("", "a\0b", "é" * 7, "é" * 8, "é" * 4095, "﻿x"):
        data = columnar.encode(pa.array([{"t": text}], s.arrow()), s)[0].as_py()
        assert columnar.decode(pa.array([data]), s)[0][0].as_py()["t"] == rows.decode_row(data, s, Limits())[0]["t"] == text.removeprefix("﻿")


def test_defaults_and_missing():
    r = frame(S(0, 1, 0), 0).root()
    assert r.number(0, "int32", -7) == -7 and r.number(8, "float64", 2.5) == 2.5 and r.flag(3, True) is True and r.pointer(4).null and r.text(0, "unnamed") == "unnamed"
    assert code(frame(0).root().pointer, 0) == "KIND"


def test_limits():
    deep = frame(S(0, 0, 1), S(0, 0, 1), S(0, 1, 0), 5)
    assert deep.root().pointer(0).pointer(0).number(0, "uint8") == 5
    f = Frame.raw(words(S(0, 0, 1), S(0, 0, 1), S(0, 1, 0), 5), Limits(depth=0))
    root = f.root()
    assert code(root.pointer, 0) == "DEPTH"
    many = words(S(0, 0, 1), L(0, 7, 0), S(100, 0, 0))
    assert len(Frame.raw(many).root().pointer(0)) == 100
    eight = words(S(0, 0, 1), L(0, 7, 8), S(100, 0, 0), *[0] * 8)
    assert code(lambda: Frame.raw(eight, Limits(words=5)).root().pointer(0)) == "TRAVERSAL"
    assert code(lambda: frame(S(0, 0, 1), L(0, 6, 1 << 26)).root().pointer(0)) == "TRAVERSAL"
    assert code(lambda: frame(S(0, 0, 1), L(0, 7, 1), L(0, 2, 1), 0).root().pointer(0)) == "KIND"
    assert code(lambda: frame(S(0, 0, 1), L(0, 7, 1), S(2, 1, 0), 0).root().pointer(0)) == "BOUNDS"
    assert code(lambda: frame(S(5, 1, 0)).root()) == "BOUNDS"
    assert frame(wire.cap_word(42)).root().count == 42 and code(lambda: frame(wire.cap_word(1) | 4).root()) == "KIND"
    assert code(lambda: frame(wire.far_word(False, 0, 3)).root()) == "SEGMENT" and code(lambda: frame(wire.far_word(True, 9, 0)).root()) == "BOUNDS"
    assert code(lambda: frame(wire.far_word(False, 0, 0)).root()) == "DEPTH"
    for data in (b"", b"\0" * 7, wire.frame_of([bytes(8)] * 2)[:-1], (599).to_bytes(4, "little") + bytes(4000)):
        assert code(Frame.parse, data) == "FRAMING"


def test_double_far():
    pad = words(wire.far_word(False, 0, 2), S(0, 1, 0))
    f = Frame([words(wire.far_word(True, 0, 1)), pad, words(77)])
    assert f.root().number(0, "uint32") == 77
    assert code(lambda: Frame([words(wire.far_word(True, 0, 1)), words(S(0, 0, 0), S(0, 1, 0))]).root()) == "KIND"
    assert code(lambda: Frame([words(wire.far_word(True, 0, 1)), words(wire.far_word(False, 0, 0), wire.cap_word(1))]).root()) == "KIND"


def test_frames():
    two = wire.frame_of([b"\xaa" * 8, b"\xbb" * 8])
    assert len(two) == 32 and two[16] == 0xAA and two[24] == 0xBB
    assert wire.frame_length(two) == 32 and wire.frame_length(two[:20]) == 0 and wire.frame_length(b"\1") == 0
    assert code(wire.frame_length, (99).to_bytes(4, "little") + bytes(800)) == "FRAMING" and code(wire.frame_of, []) == "FRAMING"


def test_builder_and_orphans():
    b = Builder(first_words=4)
    root = b.init_root(1, 3)
    root.set(0, "int32", -3, -7)
    root.slot(0).set_text("hello, a text of more than a segment's size")
    items = root.slot(1).init_structs(2, 1, 1)
    for i in range(2):
        items.struct(i).set(0, "uint32", 100 * (i + 1))
        items.struct(i).slot(0).set_text(f"item {i}")
    f = Frame.parse(b.frame())
    assert len(f.segments) >= 3 and f.root().number(0, "int32", -7) == -3 and f.root().pointer(1).element_struct(1).text(0) == "item 1"
    orphan = root.slot(0).disown()
    root.slot(2).adopt(orphan)
    assert code(root.slot(0).adopt, orphan) == "ARG"
    r = Frame.parse(b.frame()).root()
    assert r.pointer(0).null and r.text(2).startswith("hello")
    other = Builder()
    assert code(other.init_root(0, 1).slot(0).adopt, items.struct(0).slot(0).disown()) == "ARG"
    assert code(other.root_slot) == "ARG" and code(Builder().frame) == "ARG"
    assert code(root.set, 8, "uint8", 1) == "BOUNDS" and code(lambda: Builder(1, 1, single=True).init_root(5, 0)) == "ALLOC"
    assert code(lambda: Builder(1, max_segments=2).init_root(0, 2).slot(0).builder.alloc(1 << 30)) == "ALLOC"


def test_move_graft_extract():
    s = Struct("t", 1, 2, (Field("k", UINT32, 0), Field("a", TEXT, 0, ""), Field("b", list_of(TEXT), 1, ())))
    data = columnar.encode(pa.array([{"k": 1, "a": "x", "b": ["p", "q"]}], s.arrow()), s)[0].as_py()
    f = Frame.parse(data)
    assert Frame.parse(transform.extract(f, ".1[1]")).root().as_text() == "q"
    r = Frame.parse(transform.graft(f, ".1[0]", Frame.parse(transform.extract(f, ".0")))).root()
    assert r.pointer(1).element_text(0) == "x" and r.text(0) == "x"
    r = Frame.parse(transform.move(f, ".0", ".1")).root()
    assert r.pointer(0).null and r.text(1) == "x"
    assert code(transform.extract, f, "1") == "ARG" and code(transform.graft, f, ".0.0", f) == "BOUNDS"
    assert [p for p, _ in walk(f.root())] == ["root", "root.0", "root.1", "root.1[0]", "root.1[1]"]


def test_canonical():
    assert transform.canonicalize(frame(wire.EMPTY_STRUCT)) == words(wire.EMPTY_STRUCT)
    assert transform.canonicalize(frame(0)) == words(0)
    wide = frame(S(0, 3, 2), 5, 0, 0, 0, 0)
    assert transform.canonicalize(wide) == words(S(0, 1, 0), 5)
    assert code(lambda: transform.canonicalize(frame(S(0, 0, 1), wire.cap_word(0)))) == "CANONICAL"
    bits = frame(S(0, 0, 1), L(0, 1, 3), 0xFF)
    assert transform.canonicalize(bits)[-8] == 0xFF and transform.canonicalize(bits, mask_padding=True)[-8] == 0b111


def test_random_frames_only_give_typed_errors():
    rng = random.Random(0xC0FFEE)
    samples = [bytes(rng.randbytes(rng.randint(0, 512) * 16 // 16)) for _ in range(100)]
    for _ in range(400):  # hostile variants of a good frame
        data = bytearray(FRAMED)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.choice((0, 1, 2, 3, 255, rng.randrange(256)))
        samples.append(bytes(data))
    value, errors = columnar.decode(pa.array(samples, pa.binary()), schemas.ADDRESS_BOOK, mode="PERMISSIVE")
    for x, got, error in zip(samples, value.to_pylist(), errors):
        want, why = rows.decode_row(x, schemas.ADDRESS_BOOK, Limits())
        assert got == want and (error is None) == (why is None) and (error is None or error.code == why.code)
        try:
            transform.canonicalize(Frame.parse(x))
            transform.unpack(x)
        except FrameError as e:
            assert e.code in wire.ERROR_CODES


def test_compiled_defaults():
    from loomframe.plans import schema

    probe = Struct("Probe", 1, 1, (Field("n", INT32, 4, -7), Field("label", TEXT, 0, "unnamed")))
    made = schema.compile_request(schema.request_of("probe.schema", [probe])).layout("Probe")
    assert made == probe
    assert columnar.decode(pa.array([wire.frame_of([words(S(0, 0, 0) or wire.EMPTY_STRUCT)])]), made)[0][0].as_py() in (None, {"n": -7, "label": "unnamed"})
    with pytest.raises(FrameError):
        schema.compile_request(b"\0" * 4)


def test_compile_command(tmp_path, capsys, monkeypatch):
    from loomframe.plans import schema

    path = tmp_path / "request.bin"
    path.write_bytes(schema.request_of("dir/book.schema", [schemas.ADDRESS_BOOK]))
    assert schema.main([str(path), "--stdout"]) == 0 and "struct dir/book.schema:Person" in capsys.readouterr().out
    monkeypatch.chdir(tmp_path)
    assert schema.main([str(path)]) == 0 and (tmp_path / "book.json").exists()
    path.write_bytes(b"junk")
    assert schema.main([str(path)]) == 1
    assert schema.short_name("a/b.x:Person.PhoneNumber") == "Person_PhoneNumber" and schema.constant_name("PhoneNumber_type") == "PHONE_NUMBER_TYPE"


def test_lists_are_bounded_by_words_alone():
    n = (1 << 20) + 5
    s = Struct("Long", 0, 1, (Field("x", list_of(UINT8), 0),))
    frames = columnar.encode(pa.array([{"x": [i % 251 for i in range(n)]}], s.arrow()), s)
    value, errors = columnar.decode(frames, s, mode="PERMISSIVE")
    assert errors == [None] and len(value[0]["x"]) == n and value[0]["x"][n - 1].as_py() == (n - 1) % 251
    # Only elements without any width are bounded by number.
    holder = Struct("Holder", 0, 1, (Field("x", list_of(struct_of(Struct("Nothing", 0, 0, ()))), 0),))
    b = Builder(64)
    b.init_root(0, 1).slot(0).init_structs(n, 0, 0)
    assert columnar.decode(pa.array([b.frame()], pa.binary()), holder, mode="PERMISSIVE")[1][0].code == "TRAVERSAL"


def test_list_elements_as_functions():
    from loomframe.kernel import lists

    s = Struct("Rows", 0, 2, (Field("n", list_of(UINT32), 0), Field("t", list_of(TEXT), 1)))
    frame = columnar.encode(pa.array([{"n": [7, 1 << 31], "t": ["a", "é"]}], s.arrow()), s)[0].as_py()
    root = Frame.parse(frame).root()
    n, t = root.pointer(0), root.pointer(1)
    assert [lists.list_uint32(n, i) for i in range(2)] == [7, 1 << 31] and lists.list_int32(n, 1) == -(1 << 31)
    assert lists.list_struct(n, 0).number(0, "uint32") == 7 and lists.list_text(t, 1) == "é"
    assert lists.list_bool(n, 0, True) is True and lists.list_uint16(n, 0, 5) == 5 and lists.list_uint32(n, 9, 3) == 3
    with pytest.raises(FrameError):
        lists.list_text(t, 2)
