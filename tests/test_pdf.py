"""PDF files made here: known text, tables, pages and faults."""

from __future__ import annotations

import zlib

import pytest

from siltstone.sources import files, pdf, pdf_layout

BODY = "The committee reviewed every proposal and kept the minutes"


def obj(n: int, body: bytes) -> bytes:
    return b"%d 0 obj\n%s\nendobj\n" % (n, body)


def stream(data: bytes, extra: bytes = b"", packed: bool = True) -> bytes:
    raw = zlib.compress(data) if packed else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(raw), b"/Filter /FlateDecode" if packed else b"", extra, raw)


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /fi 200 /uni20AC] >> /FirstChar 32 /Widths [%s] >>" % b" ".join([b"500"] * 95)


def made(pages: list[bytes], modern: bool = False, trailer: bytes = b"", fonts: bytes = FONT, extra: dict[int, bytes] | None = None) -> bytes:
    """A file with a page for each content stream; ``modern`` ones have object streams and cross-reference streams."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> /XObject << /X1 4 0 R >> >> >>" % (kids, len(pages)), 3: fonts}
    bodies |= extra or {}
    for i, content in enumerate(pages):
        bodies[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        bodies[11 + 2 * i] = stream(content)
    out = b"%PDF-1.7\n"
    places, packed = {}, {}
    if modern:
        inside = [n for n in bodies if not bodies[n].endswith(b"endstream")]
        heads, rest = b"", b""
        for k, n in enumerate(inside):
            heads += b"%d %d " % (n, len(rest))
            rest += bodies[n] + b" "
            packed[n] = (90, k)
        bodies = {n: b for n, b in bodies.items() if n not in packed} | {90: stream(heads + rest, b"/Type /ObjStm /N %d /First %d" % (len(inside), len(heads)))}
    for n, body in bodies.items():
        places[n] = len(out)
        out += obj(n, body)
    at = len(out)
    if modern:
        rows = [b"\0\0\0\0\0\0"] * 92
        for n, place in places.items():
            rows[n] = b"\1" + place.to_bytes(4, "big") + b"\0"
        for n, (holder, k) in packed.items():
            rows[n] = b"\2" + holder.to_bytes(4, "big") + bytes([k])
        rows[91] = b"\1" + at.to_bytes(4, "big") + b"\0"
        up = [bytes([2]) + bytes((x - y) & 255 for x, y in zip(r, before, strict=True)) for r, before in zip(rows, [bytes(6), *rows[:-1]], strict=True)]  # rows as differences to the row above
        out += obj(91, stream(b"".join(up), b"/Type /XRef /W [1 4 1] /Size 92 /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 6 >> " + trailer))
        return out + b"startxref\n%d\n%%%%EOF" % at
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in places.items())
    return out + b"trailer\n<< /Root 1 0 R /Size 99 %s >>\nstartxref\n%d\n%%%%EOF" % (trailer, at)


def text(*rows: str, x: int = 72, y: int = 700, step: int = 14) -> bytes:
    return b"BT /F1 12 Tf %d TL %d %d Td " % (step, x, y) + b" ".join(b"(%s) Tj T*" % r.encode("cp1252").replace(b"(", b"\\(") for r in rows) + b" ET\n"


def cell_row(y: int, cells: list[tuple[int, str]]) -> bytes:
    return b"".join(b"BT /F1 10 Tf 1 0 0 1 %d %d Tm (%s) Tj ET\n" % (x, y, t.encode()) for x, t in cells)


def pages_of(data: bytes) -> list[tuple[str, list]]:
    f = pdf.File(data)
    found = [pdf.Page(f, p) for p in f.pages()]
    return [(pdf_layout.page_text(p.spans), pdf_layout.page_tables(p.spans, p.rulings)) for p in found]


@pytest.mark.parametrize("modern", [False, True])
def test_text_of_pages(modern):
    data = made([text("First line", "second (line"), text("Page two", y=500) + text("far below", y=300)], modern)
    assert [t for t, _ in pages_of(data)] == ["First line\nsecond (line", "Page two\n\nfar below"]


def test_strings_spacing_and_glyphs():
    content = rb"BT /F1 12 Tf 72 700 Td [(Kern) -20 (ed) -700 (words)] TJ 0 -14 Td (caf\001 o\002ce \310 \(x\)) Tj 0 -14 Td <48 65 78> Tj (\
 line) ' ET"
    got = pages_of(made([content]))[0][0].split("\n")
    assert got[:2] == ["Kerned words", "café oﬁce € (x)"] and got[2:] == ["Hex", "line"]


def test_wide_font_with_unicode_map():
    cmap = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0010> <D83DDE00> endbfchar 2 beginbfrange <0024> <0026> <0041> <0030> <0031> [<00DF> <03A9>] endbfrange endcmap"
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 5 0 R /DescendantFonts [6 0 R] >>"
    data = made([b"BT /F1 10 Tf 50 700 Td <0024002500260003003000310010> Tj ET"], fonts=font, extra={5: stream(cmap), 6: b"<< /Type /Font /Subtype /CIDFontType2 /DW 600 /W [36 [500 510] 38 40 700] >>"})
    assert pages_of(data)[0][0] == "ABC ßΩ😀"


def test_forms_and_transformations():
    form = stream(b"BT /F1 12 Tf 10 10 Td (inside the form) Tj ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0]")
    data = made([b"q 2 0 0 2 0 100 cm /X1 Do Q " + text("outside", y=700)], extra={4: form})
    f = pdf.File(data)
    spans = pdf.Page(f, next(f.pages())).spans
    assert (spans[0].x, spans[0].y, spans[0].size, spans[0].text) == (220, 120, 24, "inside the form") and spans[1].text == "outside"


def test_ruled_table():
    rows = [("Item", "Count", "Price"), ("Bolt", "12", "0.50"), ("Nut and", "7", "")]
    lines = b"".join(b"72 %d m 372 %d l S " % (y, y) for y in (600, 620, 640, 660)) + b"".join(b"%d 600 m %d 660 l S " % (x, x) for x in (72, 172, 272, 372))
    cells = b"".join(cell_row(646 - 20 * i, [(76 + 100 * k, c) for k, c in enumerate(r) if c]) for i, r in enumerate(rows))
    found, tables = pages_of(made([text("Before the table", y=720) + lines + cells]))[0]
    assert tables == [[list(r) for r in rows]] and found.startswith("Before the table")


def test_boxed_cells_and_two_tables():
    box = lambda x, y: b"%d %d 80 18 re S " % (x, y)
    one = b"".join(box(x, y) for x in (72, 152) for y in (700, 682)) + cell_row(704, [(75, "a"), (155, "b")]) + cell_row(686, [(75, "c"), (155, "d")])
    two = b"".join(box(x, y) for x in (72, 152) for y in (400, 382)) + cell_row(404, [(75, "e"), (155, "f")]) + cell_row(386, [(75, "g"), (155, "h")])
    assert pages_of(made([two + one]))[0][1] == [[["a", "b"], ["c", "d"]], [["e", "f"], ["g", "h"]]]


def test_table_by_gaps_alone():
    rows = [("Year", "Sales", "Share"), ("2020", "1,200", "12 %"), ("2021", "1,350", "14 %"), ("2022", "990", "9 %")]
    cells = b"".join(cell_row(600 - 14 * i, [(72, r[0]), (200, r[1]), (330, r[2])]) for i, r in enumerate(rows))
    assert pages_of(made([text(BODY, y=700) + cells + text(BODY, y=400)]))[0][1] == [[list(r) for r in rows]]


def test_columns_of_prose_are_no_table():
    left = text(*[BODY[:50]] * 5, x=50, y=700)
    right = text(*[BODY[:50]] * 5, x=350, y=700)
    found, tables = pages_of(made([left + right]))[0]
    assert tables == [] and found == "\n".join([BODY[:50]] * 5) + "\n\n" + "\n".join([BODY[:50]] * 5)


def test_broken_cross_references_are_rebuilt():
    for modern in (False, True):
        data = made([text("Still readable")], modern)
        at = data.rindex(b"startxref")
        for broken in (data[:at] + b"startxref\n7\n%%EOF", data[: at - 30], data.replace(b"%PDF-1.7\n", b"%PDF-1.7\n% moved by a line\n")):
            assert pages_of(broken)[0][0] == "Still readable"


def test_pages_of_a_cycle_end():
    data = made([text("once")]).replace(b"/Kids [10 0 R]", b"/Kids [10 0 R 2 0 R]")
    assert [t for t, _ in pages_of(data)] == ["once"]


def test_folder_of_files(spark, tmp_path):
    long = [BODY, "and the offi-", "cers signed them all on the same day"]
    table = b"".join(cell_row(600 - 14 * i, [(72, f"k{i}"), (200, f"v{i}")]) for i in range(3))
    (tmp_path / "good.pdf").write_bytes(made([text(*long), b"", text(BODY + " again", y=700) + table]))
    (tmp_path / "scanned.pdf").write_bytes(made([b"q 100 0 0 100 0 0 cm BI /W 1 /H 1 ID x EI Q", text("short")]))
    (tmp_path / "locked.pdf").write_bytes(made([text(*long)], trailer=b"/Encrypt << /Filter /Standard /V 1 >>"))
    (tmp_path / "locked2.pdf").write_bytes(made([text(*long)], True, trailer=b"/Encrypt << /Filter /Standard /V 4 >>"))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 and nothing else")
    (tmp_path / "other.pdf").write_bytes(b"plain text")
    (tmp_path / "note.txt").write_text("a note")
    got = {r.source.rsplit("/", 1)[1]: r for r in files.LoaderRegistry().load(spark, str(tmp_path)).collect()}
    assert got["good.pdf"].status == "ok" and got["good.pdf"].tables == [[["k0", "v0"], ["k1", "v1"], ["k2", "v2"]]]
    assert got["good.pdf"].text.startswith(f"{BODY}\nand the officers signed them all on the same day\n\n{BODY} again")
    assert {n: got[n].status for n in got if n != "good.pdf"} == {"scanned.pdf": "failed", "locked.pdf": "failed", "locked2.pdf": "failed", "broken.pdf": "failed", "other.pdf": "failed", "note.txt": "ok"}
    assert "scanned" in got["scanned.pdf"].error and "encrypted" in got["locked.pdf"].error and "encrypted" in got["locked2.pdf"].error and "not a PDF" in got["other.pdf"].error
    docs = {r.source: r for r in files.pdf_documents(pdf_layout.read_pages(spark.read.format("binaryFile").load(str(tmp_path / "*.pdf")))).collect()}
    good = next(r for s, r in docs.items() if s.endswith("good.pdf"))
    assert (good.page_count, good.n_scanned) == (3, 1)


def test_many_pages(spark, tmp_path):
    (tmp_path / "long.pdf").write_bytes(made([text(f"Page number {i} " + BODY) for i in range(150)]))
    rows = pdf_layout.read_pages(spark.read.format("binaryFile").load(str(tmp_path / "long.pdf"))).orderBy("page_no").collect()
    assert [r.page_no for r in rows] == list(range(1, 151)) and rows[99].text == f"Page number 99 {BODY}"


def test_random_bytes_never_raise(spark):
    import random

    rng, data = random.Random(3), made([text("Some text"), text(*[BODY] * 3)])
    rows = []
    for i in range(150):
        b = bytearray(data)
        for _ in range(rng.randint(1, 30)):
            b[rng.randrange(9, len(b))] = rng.randrange(256)
        rows.append((str(i), bytes(b)))
    found = pdf_layout.read_pages(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {r.source for r in found} == {r[0] for r in rows}
