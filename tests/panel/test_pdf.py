import zlib

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import reports, words
from fieldloom.plans import reportpages
from fieldloom.sources import pages, pdf

FONT = b"<< /Type /Font /Subtype /Type1 /FirstChar 32 /LastChar 126 /Widths [" + b"500 " * 95 + b"] /Encoding << /Differences [64 /aacute /ccedilla 67 /uni20AC /nothing] >> /FontDescriptor << /Descent -200 >> >>"
WIDE = b"<< /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [<< /DW 1000 /W [1 [250 750] 5 9 400] >>] /ToUnicode 9 0 R >>"
CMAP = b"2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 2 beginbfrange <0005> <0007> <0061> <0008> <0009> [<0078> <D83DDE00>] endbfrange"


def stream(data, more=b"", packed=True):
    body = zlib.compress(data) if packed else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if packed else b"", more, body)


def parts(content, packed=True, form=None):
    return {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] /Resources << /Font << /A 5 0 R /W 6 0 R >> /XObject << /F 8 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R 7 0 R] >>",
        4: stream(content, packed=packed),
        5: FONT,
        6: WIDE,
        7: stream(b" ", packed=False),
        8: stream(form or b"", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 10 5]"),
        9: stream(CMAP),
    }


def with_table(objects, junk=b"", trailer=b""):
    data, places = bytearray(b"%PDF-1.4\n" + junk), {}
    for n, body in objects.items():
        places[n] = len(data)
        data += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    rows = b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(places))
    return bytes(data) + b"xref\n0 1\n0000000000 65535 f \n1 %d\n%strailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (len(places), rows, len(places) + 1, trailer, len(data))


def with_streams(objects, predicted):
    """Objects without streams in one compressed stream, and a cross-reference stream."""
    data, places = bytearray(b"%PDF-1.5\n"), {}
    inner = {n: b for n, b in objects.items() if b"stream" not in b}
    for n, body in objects.items():
        if n not in inner:
            places[n] = (1, len(data), 0)
            data += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    head, at = b"", 0
    for n, body in inner.items():
        head += b"%d %d " % (n, at)
        at += len(body) + 1
    places[20] = (1, len(data), 0)
    data += b"20 0 obj\n%s\nendobj\n" % stream(head + b" ".join(inner.values()), b"/Type /ObjStm /N %d /First %d" % (len(inner), len(head)))
    places |= {n: (2, 20, k) for k, n in enumerate(inner)}
    start = len(data)
    places[21] = (1, start, 0)
    rows = [bytes([k]) + a.to_bytes(3, "big") + bytes([b]) for k, a, b in (places.get(n, (0, 0, 0)) for n in range(22))]
    more = b"/Type /XRef /Size 22 /W [1 3 1] /Root 1 0 R"
    if predicted:
        above, out = bytes(5), b""
        for row in rows:
            out += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
            above = row
        body = stream(out, more + b" /DecodeParms << /Predictor 12 /Columns 5 >>")
    else:
        body = stream(b"".join(rows), more)
    return bytes(data) + b"21 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (body, start)


def read(data):
    doc = pdf.Document(data)
    return [[(t, *(round(v, 6) for v in at)) for t, *at in pdf.characters(doc, page)] for page in doc.pages()]


SHOWN = b"BT /A 10 Tf 1 0 0 1 20 50 Tm (ab) Tj ET"
#: Ten points high, its descent two under the base line: top at 100 - 50 - 8.
PLACED = [[("a", 20, 25, 42), ("b", 25, 30, 42)]]


@pytest.mark.parametrize("make", [with_table, lambda o: with_streams(o, False), lambda o: with_streams(o, True), lambda o: with_table(o, b"%junk\n").replace(b"startxref", b"startxxxx"), lambda o: with_table(o)[:-60], lambda o: with_streams(o, True).replace(b"startxref", b"startxxxx")], ids=["table", "streams", "predictor", "no start", "cut off", "streams without start"])
def test_cross_references(make):
    assert read(make(parts(SHOWN))) == PLACED


@pytest.mark.parametrize(
    "content,want",
    [
        (b"BT /A 10 Tf 20 50 Td (a) Tj 0 -12 TD (b) Tj T* (c) Tj (d) ' ET", [("a", 20, 25, 42), ("b", 20, 25, 54), ("c", 20, 25, 66), ("d", 20, 25, 78)]),
        (b"BT /A 10 Tf 2 Tc 5 Tw 20 50 Td (a b) Tj ET", [("a", 20, 25, 42), (" ", 27, 32, 42), ("b", 39, 44, 42)]),
        (b"BT /A 10 Tf 50 Tz 20 50 Td [(a) -1000 (b)] TJ ET", [("a", 20, 22.5, 42), ("b", 27.5, 30, 42)]),
        (b"q 2 0 0 2 0 0 cm BT /A 5 Tf 10 25 Td 1 Ts (a) Tj ET Q BT /A 10 Tf 1 2 (b) \" ET", [("a", 20, 25, 40), ("b", 0, 5, 92)]),
        (b"BT /A 10 Tf 20 50 Td (\\141\\(\\)\\\\\\n(n)) Tj ET", [(c, 20 + 5 * k, 25 + 5 * k, 42) for k, c in enumerate("a()\\")] + [(c, 40 + 5 * k, 45 + 5 * k, 42) for k, c in enumerate("(n)")]),
        (b"BT /A 10 Tf 20 50 Td <40 41 42 4344> Tj ET", [("á", 20, 25, 42), ("ç", 25, 30, 42), ("B", 30, 35, 42), ("€", 35, 40, 42)]),
        (b"BT /W 10 Tf 20 50 Td <00010002000500070009> Tj ET", [("A", 20, 22.5, 40), ("fi", 22.5, 30, 40), ("a", 30, 34, 40), ("c", 34, 38, 40), ("😀", 38, 42, 40)]),
        (b"1 0 0 1 5 0 cm /F Do BT /A 10 Tf 0 50 Td (z) Tj ET", [("f", 35, 40, 37), ("z", 5, 10, 42)]),
        (b"BI /W 1 /H 1 ID \x00(EI)\xff EI BT /A 10 Tf 20 50 Td (a) Tj ET % done", [("a", 20, 25, 42)]),
    ],
    ids=["lines", "spacing", "kerning", "matrices", "strings", "differences", "two bytes", "form", "inline image"],
)
def test_content(content, want):
    made = read(with_table(parts(content, form=b"BT /A 10 Tf 20 50 Td (f) Tj ET")))[0]
    assert [m for m in made if m[0] != "\n"] == want


def test_filters_and_errors():
    hexed = parts(SHOWN) | {4: b"<< /Filter [/ASCIIHexDecode /FlateDecode] /Length 0 >>\nstream\n" + zlib.compress(SHOWN).hex().encode() + b">\nendstream"}
    assert read(with_table(hexed)) == PLACED
    with pytest.raises(ValueError, match="encrypted"):
        pdf.Document(with_table(parts(SHOWN), trailer=b"/Encrypt << >>"))
    for data in (b"", b"%PDF-1.4\nnothing", b"%PDF\n1 0 obj\n<< /Type /Catalog /Pages 1 0 R"):
        with pytest.raises(ValueError):
            list(pdf.Document(data).pages())
    loop = parts(SHOWN) | {2: b"<< /Type /Pages /Kids [3 0 R 2 0 R] /MediaBox [0 0 200 100] /Resources << /Font << /A 5 0 R >> >> >>"}
    assert read(with_table(loop)) == PLACED


def frame(spark, docs):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "doc string, content binary")


def test_words_and_texts(spark, tmp_path):
    lines = b"BT /A 10 Tf 20 50 Td (One  two) Tj 1 0 0 1 61 50 Tm (3) Tj 1 0 0 1 71 50.5 Tm (4) Tj 1 0 0 1 20 30 Tm (low) Tj ET"
    (tmp_path / "a.pdf").write_bytes(with_table(parts(lines)))
    (tmp_path / "b.pdf").write_bytes(with_table(parts(b" ")))
    (tmp_path / "c.txt").write_bytes(b"plain")
    docs = pages.documents(spark, str(tmp_path)).withColumn("doc", F.element_at(F.split("doc", "/"), -1))
    found = pages.page_words(docs).orderBy("word_idx").collect()
    # 3 touches "two" within the tolerance, 4 lies apart; half a point is the same line.
    assert [(r.text, r.x0, r.x1, r.top, r.word_idx) for r in found] == [("One", 20, 35, 42, 0), ("two3", 45, 66, 42, 1), ("4", 71, 76, 41.5, 2), ("low", 20, 35, 62, 3)]
    assert [tuple(r) for r in pages.page_texts(docs).orderBy("doc").collect()] == [("a.pdf", 0, "One two3 4\nlow"), ("b.pdf", 0, "")]


def test_unreadable_documents(spark):
    docs = frame(spark, {"good": with_table(parts(SHOWN)), "bad": b"%PDF-1.4 nothing"})
    with pytest.raises(Exception, match="bad, after page -1"):
        pages.page_words(docs).collect()
    assert [r.text for r in pages.page_words(docs, strict=False).collect()] == ["ab"]
    assert [(r.doc, r.page) for r in pages.characters(docs, strict=False).where("error is not null").collect()] == [("bad", 0)]
    assert pages.page_texts(docs, strict=False).count() == 1 and pages.page_words(docs.limit(0)).count() == 0


def report(changes=None, title=reportpages.TITLE, season="2024/2025"):
    rows = {"16/04": (100, 120), "30/04": (250, 300), "31/03": (900, 900)} | (changes or {})
    piece = lambda text, x, top: {"text": text, "x": x, "top": top}
    page = [piece(w, 30 + 60 * k, 20) for k, w in enumerate(title.split(" "))] + [piece(*h) for h in reportpages.HEADS]
    page += [piece(s, c[k], 78) for c in reportpages.CELLS for k, s in enumerate((season, "2025/2026"))]
    for n, (period, values) in enumerate(rows.items()):
        page.append(piece(period, 36, 100 + 14 * n))
        for c in reportpages.CELLS if values else ():
            page += [piece(t, x, 100 + 14 * n) for t, x in zip((str(values[0]), str(values[1]), "1,5%"), c, strict=True)]
    return reportpages._pdf([[piece("Relatório", 30, 30)], page])


def history(spark, docs):
    found = pages.words_of(pages.characters(frame(spark, docs)))
    return reports.normalized_reports(words.titled_tables(found, reportpages.TITLE))


def test_report_to_history(spark):
    made = history(spark, {"a": report(), "b": report({"31/03": None}), "other": report(title="Outra tabela")}).where("region = 'other_states'").orderBy("doc", "season", "period_end_date").collect()
    want = [("a", "24-25", "2024-04-16", 100), ("a", "24-25", "2024-04-30", 150), ("a", "24-25", "2025-03-31", 650), ("a", "25-26", "2025-04-16", 120), ("a", "25-26", "2025-04-30", 180), ("a", "25-26", "2026-03-31", 600)]
    want += [("b", *w[1:]) for w in want if "03-31" not in w[2]]
    assert [(r.doc, r.season, str(r.period_end_date), r.crush_tonnes) for r in made] == want and {r.variation_percent for r in made} == {1.5}


@pytest.mark.parametrize(
    "changes,season,message",
    [({"30/04": (90, 300)}, "2024/2025", "Running totals fall in a, 24-25, .*2024-04-30"), ({"16/04": None}, "2024/2025", "does not begin on 16 April in a"), (dict.fromkeys(("16/04", "30/04", "31/03")), "2025/2026", "Two harvest seasons expected"), ({"30/04": ("x", 3)}, "2024/2025", "Invalid Brazilian integer: x")],
)
def test_broken_reports_name_the_row(spark, changes, season, message):
    with pytest.raises(Exception, match=message):
        history(spark, {"a": report(changes, season=season)}).collect()


def test_bench_documents_grow_with_the_orders(spark):
    docs = reportpages.report_documents(spark, "/root/testdata/sf0.001")
    assert docs.where(F.substring("content", 1, 4) != F.lit(b"%PDF")).count() == 0 and docs.count() > 100
