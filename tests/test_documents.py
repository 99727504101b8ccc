import io
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.operators import documents as D


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def unzip(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist()}


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
DOCX = {
    "[Content_Types].xml": "<x/>", "word/media/image1.png": b"\x89PNG\x00\x01", "word/header2.xml": P.format("head b@c.de"),
    "word/document.xml": '<?xml version="1.0"?><w:document><w:body><w:p><w:r><w:t>mail a@</w:t></w:r><w:r><w:t>b.de &amp; é</w:t></w:r></w:p><wp:docPr id="1" descr="on 2020-01-02 &quot;x&quot;"/><w:p/></w:body></w:document>',
    "word/charts/chart1.xml": "<c><a:v>a@b.de</a:v></c>", "docProps/core.xml": "<p><dc:creator>Ann</dc:creator><k>a@b.de</k></p>", "docProps/app.xml": "<p><Company a='1'>Firm</Company></p>",
}


def test_text_of_parts_in_order():
    text = D.document_text("x.DOCX", zipped(DOCX))
    assert text == 'mail a@b.de & é\non 2020-01-02 "x"\n\n\nhead b@c.de\n\n\na@b.de\n'
    slides = {f"ppt/slides/slide{i}.xml": f"<a:p><a:t>s{i}</a:t></a:p>" for i in (10, 2)} | {"ppt/notesSlides/notesSlide1.xml": "<a:p><a:t>n</a:t></a:p>"}
    assert D.document_text("x.pptx", zipped(slides)) == "s2\n\n\ns10\n\n\nn\n"
    assert D.document_text("x.xlsx", zipped({"xl/sharedStrings.xml": "<sst><si><t>a</t></si><si><t>b</t></si></sst>", "xl/other.xml": "<t>no</t>"})) == "a\nb\n"


def test_anonymized_documents(spark):
    pdf = D.make_pdf("write to a@b.de (now)\n\nor 2020-01-02 é")
    docs = spark.createDataFrame([("a.docx", zipped(DOCX)), ("b.pdf", pdf), ("c.docx", b"no zip"), ("d.txt", b"x"), ("e.xlsx", zipped({"xl/sharedStrings.xml": "<sst/>"}))], "path string, content binary")
    out, vault = D.anonymize_documents(docs)
    got = {r.path: r for r in out.collect()}
    fake = {r.real: r.fake for r in vault.collect()}
    assert sorted(got) == ["a.docx", "b.pdf", "e.xlsx"] and got["a.docx"].n_placements == 4
    files = unzip(got["a.docx"].content)
    assert f"<w:t>mail {fake['a@b.de']}</w:t></w:r><w:r><w:t> &amp; é</w:t>" in files["word/document.xml"].decode()
    assert f'descr="on {fake["2020-01-02"]} &quot;x&quot;"/>' in files["word/document.xml"].decode()
    assert files["word/charts/chart1.xml"].decode() == f"<c><a:v>{fake['a@b.de']}</a:v></c>"
    assert files["docProps/core.xml"] == b"<p><dc:creator></dc:creator><k>a@b.de</k></p>" and files["docProps/app.xml"] == b"<p><Company a='1'></Company></p>"
    assert files["word/media/image1.png"] == DOCX["word/media/image1.png"] and list(files) == list(DOCX)
    assert D.pdf_text(got["b.pdf"].content) == f"write to {fake['a@b.de']} (now)\n\nor {fake['2020-01-02']} é"
    errors = {r.path: r.error for r in D.extract(docs).collect()}
    assert errors["a.docx"] is None and "BadZipFile" in errors["c.docx"] and "known kind" in errors["d.txt"]


@pytest.mark.parametrize(
    "text, start, placements, want",
    [
        ("héllo", 0, [(0, 3, "X")], "Xllo"), ("héllo", 10, [(0, 20, "X")], ""), ("hello", 10, [(10, 12, "X")], "Xllo"), ("hello", 10, [(8, 12, "X")], "llo"),
        ("héllo", 10, [(14, 30, "X")], "hélX"), ("héllo", 10, [(10, 11, "A"), (13, 14, "B")], "AéBlo"), ("héll", 10, [(15, 16, "X")], "héll"),
    ],
)
def test_placements_of_a_node(text, start, placements, want):
    assert D.replaced(text, start, placements) == want


def test_wrap_and_pdf():
    assert D.wrap("a  b\n\n" + "x" * 100 + " y\r", 95) == ["a b", "", "x" * 95, "xxxxx y"]
    assert D.wrap("aaa bbb cc", 7) == ["aaa bbb", "cc"]
    assert D.pdf_escape("a\t(é)\\€") == b"a \\(\xe9\\)\\\\?"
    text = "\n".join(f"line {i}" for i in range(120))
    data = D.make_pdf(text)
    assert D.pdf_text(data) == text and data.count(b"/Type /Page ") == 3
    import zlib

    packed = zlib.compress(b"BT [(Hel) -20 (lo)] TJ 0 -14 Td <776f> Tj (rl\\144\\)) ' ET")
    assert D.pdf_text(b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode /Length 9 >>\nstream\n" + packed + b"\nendstream") == "Hello\nwo\nrld)"


def test_metadata_in_any_encoding():
    assert D.scrubbed(b"<p><dc:creator>J\xf6rg</dc:creator>\xff</p>") == b"<p><dc:creator></dc:creator>\xff</p>"
    wide = "<p><dc:creator>me</dc:creator></p>".encode("utf-16")
    assert D.scrubbed(wide).decode("utf-16") == "<p><dc:creator></dc:creator></p>"


def test_one_bad_document_fails_alone(spark):
    docs = spark.createDataFrame([("a.docx", b"no zip"), ("b.pdf", D.make_pdf("x"))], "path string, content binary")
    placed = docs.select("path", F.array().cast("array<struct<start:int,end:int,surrogate:string>>").alias("placements"))
    got = {r.path: r for r in D.rewrite(docs, placed).collect()}
    assert got["a.docx"].content is None and "BadZipFile" in got["a.docx"].error
    assert got["b.pdf"].error is None and D.pdf_text(got["b.pdf"].content) == "x"
