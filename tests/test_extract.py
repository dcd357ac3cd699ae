import io
import struct
import zipfile
import zlib

import pytest

from gleanwork.sources.extract import Router, extract
from gleanwork.sources.extract import plain

R = Router()


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def test_docx():
    body = f"<w:document {W}><w:body>{para('第一段')}<w:tbl><w:tr><w:tc>{para('甲')}</w:tc><w:tc>{para(' ')}</w:tc><w:tc>{para('乙')}</w:tc></w:tr></w:tbl>{para('')}{para('end')}</w:body></w:document>"
    assert R.extract("docx", zipped({"word/document.xml": body})) == (True, "第一段\nend\n甲 | 乙", None)
    assert R.extract("docx", b"not a zip")[0] is False


S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def xlsx(rows, shared=""):
    return zipped(
        {
            "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="a" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {S}>{shared}</sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>",
        }
    )


def test_xlsx():
    rows = '<row><c r="A1"><v>10</v></c><c r="B1"><v>20</v></c><c r="C1"><f>A1+B1</f></c></row><row><c r="A2" t="s"><v>0</v></c><c r="B2"/><c r="C2"><f>SUM(A1:B1)*2</f></c><c r="D2"><f>UNKNOWN(A1)</f><v>7.5</v></c><c r="E2"><f>NOPE()</f></c></row>'
    ok, text, _ = R.extract("xlsx", xlsx(rows, "<si><t>部门</t></si>"))
    assert ok and text == "10 | 20 | 30\n部门 | 60 | 7.5 | NOPE()"
    assert not R.extract("xlsx", b"corrupt")[0]


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (rb"{\rtf1\ansi Hello \b bold\b0  text\par next\tab x}", "Hello bold text\nnext\tx"),
        (rb"{\rtf1\ansi\ansicpg936 \'d6\'d0\'ce\'c4\'b2\'e2\'ca\'d4}", "中文测试"),
        (rb"{\rtf1 \u20013?\u25991?end}", "中文end"),
        (rb"{\rtf1{\fonttbl{\f0 Arial;}}{\colortbl;\red0;}{\*\gen x}body \{a\\b\}}", "body {a\\b}"),
        (b"", ""),
    ],
)
def test_rtf(data, want):
    assert R.extract("rtf", data) == (True, want, None)


def test_plain():
    assert plain.read_text("这是GBK编码的中文测试内容".encode("gbk")) == "这是GBK编码的中文测试内容"
    assert plain.read_text("﻿Hello 世界，…".encode()) == "Hello 世界，…"
    assert plain.read_text("héé".encode("utf-16")) == "héé"
    assert R.extract("txt", b"") == (True, "", None)


def epub(container=True):
    files = {"b.xhtml": "<p>second &amp; last</p>", "OPS/a.xhtml": "<h1>first</h1>"}
    if container:
        files |= {
            "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
            "OPS/p.opf": '<package><manifest><item id="x" href="../b.xhtml"/><item id="y" href="a.xhtml"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine></package>',
        }
    return zipped(files)


def test_epub():
    assert [x.strip() for x in R.extract("epub", epub())[1].split("\n")] == ["first", "second & last"]
    assert [x.strip() for x in R.extract("epub", epub(False))[1].split("\n")] == ["second & last", "first"]
    assert not R.extract("epub", b"PK no")[0]


def pdf(content, extra=b"", flate=True):
    body = zlib.compress(content) if flate else content
    return (
        b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj "
        b"3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>endobj 4 0 obj<</Length %d%s>>stream\n" % (len(body), b"/Filter/FlateDecode" if flate else b"")
        + body + b"\nendstream endobj 5 0 obj<</Type/Font/Subtype/Type1>>endobj\ntrailer<</Root 1 0 R" + extra + b">>\n%%EOF"
    )


def test_pdf():
    page = rb"BT /F1 12 Tf 10 10 Td (Hello \(PDF\)) Tj 0 -14 Td [(Te) -10 (st) -300 (Content)] TJ ET"
    assert R.extract("pdf", pdf(page)) == (True, "Hello (PDF)\nTest Content", None)
    assert R.extract("pdf", pdf(page, flate=False))[1].startswith("Hello")
    ok, _, why = R.extract("pdf", pdf(page, b"/Encrypt 9 0 R"))
    assert not ok and "加密" in why
    assert not R.extract("pdf", b"nonsense")[0]


def test_ciphers():
    from gleanwork.sources.extract import cipher

    assert cipher.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, secret in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):  # the standard's examples
        assert cipher.aes_cbc(bytes(range(size)), bytes(16) + bytes.fromhex(secret)) == plain


def test_pdf_with_an_empty_password():
    import hashlib

    from gleanwork.sources.extract import cipher

    first, owner, permissions = b"0123456789abcdef", b"o" * 32, -44
    key = hashlib.md5(cipher.PAD + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + first).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    user = cipher.rc4(key, hashlib.md5(cipher.PAD + first).digest())
    for i in range(1, 20):
        user = cipher.rc4(bytes(b ^ i for b in key), user)
    plain = pdf(b"BT /F1 12 Tf (Secret words) Tj ET")
    start, end = plain.index(b"stream\n") + 7, plain.index(b"\nendstream")
    secret = cipher.rc4(cipher.object_key(key, 4, 0, False), plain[start:end])
    made = plain[:start] + secret + plain[end:]
    lock = lambda u: b"/ID[<%s><%s>]/Encrypt<</Filter/Standard/V 2/R 3/Length 128/P %d/O<%s>/U<%s>>>" % (first.hex().encode(), first.hex().encode(), permissions, owner.hex().encode(), u.hex().encode())
    assert R.extract("pdf", made.replace(b"/Root 1 0 R", b"/Root 1 0 R" + lock(user + bytes(16)))) == (True, "Secret words", None)
    ok, _, why = R.extract("pdf", made.replace(b"/Root 1 0 R", b"/Root 1 0 R" + lock(bytes(32))))  # another password
    assert not ok and "加密" in why


def compound(streams):
    """A compound file of 512-byte sectors; every stream is stored whole in sectors."""
    sectors, fat, entries = [], [], []
    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        first, n = len(sectors), -(-len(data) // 512)
        sectors += [data[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(n)]
        fat += [*range(first + 1, first + n), 0xFFFFFFFE]
        entries.append((name, 2, first, len(data)))
    blob = b""
    for name, kind, first, size in [("Root Entry", 5, 0xFFFFFFFE, 0), *entries]:
        raw = name.encode("utf-16-le")
        blob += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", first, size)
    directory = len(sectors)
    blob = blob.ljust(-(-len(blob) // 512) * 512, b"\0")
    n = len(blob) // 512
    sectors += [blob[i * 512 : (i + 1) * 512] for i in range(n)]
    fat += [*range(directory + 1, directory + n), 0xFFFFFFFE]
    at = len(sectors)
    sectors.append(struct.pack("<128I", *(fat + [0xFFFFFFFD]).__add__([0xFFFFFFFF] * 200)[:128]))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIII", 0, 1, directory, 0, 4096) + struct.pack("<IIII", 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head.ljust(76, b"\0") + struct.pack("<109I", at, *[0xFFFFFFFF] * 108) + b"".join(sectors)


def test_doc():
    text = "Word 97 文本\r第二段"
    raw = text.encode("utf-16-le")
    word = bytearray(2048)
    struct.pack_into("<H", word, 10, 0x200)
    struct.pack_into("<I", word, 0x4C, len(text))
    clx = b"\x02" + struct.pack("<I", 4 * 2 + 8) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 2048, 0)
    struct.pack_into("<II", word, 0x1A2, 0, len(clx))
    assert R.extract("doc", compound({"WordDocument": bytes(word) + raw, "1Table": clx})) == (True, "Word 97 文本\n第二段", None)
    assert not R.extract("doc", b"junk")[0]


def test_xls():
    rec = lambda kind, b: struct.pack("<HH", kind, len(b)) + b
    s = "部门".encode("utf-16-le")
    sst = rec(0xFC, struct.pack("<II", 1, 1) + struct.pack("<HB", 2, 1) + s)
    bound = lambda at: rec(0x85, struct.pack("<IH", at, 0) + b"\x01\x00a")
    head = rec(0x809, b"\0" * 16)
    size = len(head + bound(0) + sst + rec(0x0A, b""))
    sheet = head + rec(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(0x203, struct.pack("<HHHd", 0, 1, 0, 12.5)) + rec(0x27E, struct.pack("<HHHI", 1, 0, 0, (42 << 2) | 2)) + rec(0x0A, b"")
    book = head + bound(size) + sst + rec(0x0A, b"") + sheet
    assert R.extract("xls", compound({"Workbook": book})) == (True, "部门 | 12.5\n42", None)


def test_router():
    assert R.is_supported(".DOCX") and not R.is_supported("exe") and R.extract("exe", b"")[2] == "不支持的文件类型"
    assert R.extract("pptx", b"anything") == (True, "", None)
    with pytest.raises(ValueError):
        Router([(["txt"], plain.read_text), (["TXT"], plain.read_text)])
    with pytest.raises(ValueError):
        Router([(["txt"], plain.read_text)])
    assert R.with_reader(["log2"], lambda b: "own").extract("log2", b"") == (True, "own", None)


def test_table(spark):
    files = spark.createDataFrame([("/a.txt", "txt", bytearray(b"hi")), ("/b.docx", "docx", bytearray(b"bad")), ("/c.txt", "txt", bytearray(b""))], "path string, extension string, content binary")
    got = {r.path: (r.success, r.content) for r in extract(files, R).collect()}
    assert got["/a.txt"] == (True, "hi") and got["/b.docx"][0] is False and got["/c.txt"] == (True, "")
