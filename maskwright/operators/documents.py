"""Office documents and PDFs: their text for detection, and the same documents with placements put in.

``extract`` and ``rewrite`` are Arrow-batched passes over (path, content); between them runs the same text pipeline as
for any other text. A document's parts are laid end to end into one text with a blank line between them, and a
placement goes to the node in which it begins.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names in the Office formats.
MIME = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pdf": "application/pdf",
}
TEXT_TAGS = {"docx": ("w:t", "w:p"), "pptx": ("a:t", "a:p"), "xlsx": ("t", "si")}
METADATA = ("docProps/core.xml", "docProps/app.xml")
BLANKED = ("dc:creator", "cp:lastModifiedBy", "Manager", "Company")
ALT_TEXT = ("descr", "title")

TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<[^>]*>|[^<]+", re.S)
TAG = re.compile(r"<(/?)([^\s/>]+)[^>]*?(/?)>", re.S)
ATTRIBUTE = re.compile(r"(\s)(" + "|".join(ALT_TEXT) + r")(\s*=\s*)(\"[^\"]*\"|'[^']*')", re.S)


@dataclass
class Node:
    """A stretch of the document's text, where it begins in the whole text (in bytes), and how to write it back."""

    text: str
    start: int = 0
    attribute: bool = False

    def xml(self, text: str) -> str:
        return escape(text, {'"': "&quot;"} if self.attribute else {})


def number(name: str) -> int:
    """The number in a part's name."""
    return int(m[1]) if (m := re.search(r"(\d+)\.xml$", name)) else 0


def parts(kind: str, names: list[str]) -> list[tuple[str, tuple[str, str] | None]]:
    """The parts that hold text, in order, and the tags of text and paragraph; without tags all text counts."""
    tags = TEXT_TAGS[kind]
    inside = lambda prefix: [n for n in names if n.startswith(prefix) and n.endswith(".xml")]
    if kind == "docx":
        chosen = ["word/document.xml", *sorted({*inside("word/header"), *inside("word/footer")}), "word/comments.xml", "word/footnotes.xml", "word/endnotes.xml"]
    elif kind == "pptx":
        chosen = [*sorted(inside("ppt/slides/slide"), key=number), *sorted(inside("ppt/notesSlides/notesSlide"), key=number)]
    else:
        chosen = ["xl/sharedStrings.xml"]
    extra = sorted(n for n in names if n.endswith(".xml") and ("/charts/chart" in n or "/diagrams/data" in n or n == "docProps/custom.xml"))
    return [(n, tags) for n in chosen if n in names] + [(n, None) for n in extra]


def layout(xml: str, tags: tuple[str, str] | None, start: int) -> tuple[list[str | Node], str]:
    """The part as literal pieces and nodes, and its text: nodes, with a line's end after each paragraph or alternative
    text, and after each node where all text counts."""
    out: list[str | Node] = []
    text: list[str] = []
    at, depth = start, 0 if tags else 1

    def add(node: Node, after: str) -> None:
        nonlocal at
        node.start = at
        out.append(node)
        text.append(node.text + after)
        at += len(node.text.encode()) + len(after)

    for token in TOKEN.findall(xml):
        tag = TAG.match(token) if token.startswith("<") and token[1] not in "!?" else None
        if tag is None:
            if depth > 0 and not token.startswith("<"):
                add(Node(unescape(token)), "" if tags else "\n")
            else:
                out.append(token)
            continue
        closing, name, empty = tag.groups()
        last = 0
        for m in ATTRIBUTE.finditer(token) if not closing else ():
            out.append(token[last : m.start(4)] + '"')
            add(Node(unescape(m[4][1:-1]), attribute=True), "\n")
            out.append('"')
            last = m.end()
        out.append(token[last:])
        if tags and name == tags[0] and not empty:
            depth = max(0, depth - 1) if closing else depth + 1
        elif tags and name == tags[1] and closing:
            text.append("\n")
            at += 1
    return out, "".join(text)


def replaced(text: str, start: int, placements: list[tuple[int, int, str]]) -> str:
    """The text of a node that begins at byte ``start``, with what is placed there; ``placements`` are in order and apart.

    The node is cut at every border of a placement. A piece that one covers goes, and where one begins its surrogate
    comes; so one that spans several nodes shows in the node in which it begins.
    """
    data = text.encode()
    stop = start + len(data)
    here = placements[bisect_right(placements, start, key=lambda p: p[1]) : bisect_left(placements, stop, key=lambda p: p[0])]
    begins: dict[int, str] = {}
    for a, _, surrogate in here:
        begins[a] = begins.get(a, "") + surrogate
    covered = {x for a, b, _ in here if a < b for x in (max(a, start),)}
    borders = sorted({start, stop, *(x for a, b, _ in here for x in (a, b) if start < x < stop)})
    out = []
    for a, b in zip(borders, borders[1:], strict=False):
        out.append(begins.get(a, "") + ("" if a in covered else data[a - start : b - start].decode("utf-8", "ignore")))
    return "".join(out)


def scrub(xml: str) -> str:
    """The metadata without its authors and company."""
    return re.sub(rf"(<({'|'.join(map(re.escape, BLANKED))})(?:\s[^>]*)?>)[^<]*(</\2>)", r"\1\3", xml)


def scrubbed(data: bytes) -> bytes:
    """The same for a part as it is stored: UTF-16 by its mark, else byte by byte, so that no encoding is an error."""
    code = "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "latin-1"
    return scrub(data.decode(code, "replace")).encode(code)


def kind_of(path: str) -> str:
    kind = path.rpartition(".")[2].lower()
    if kind not in MIME:
        raise ValueError(f"{path}: not a document of a known kind")
    return kind


def _plan(kind: str, content: bytes) -> tuple[str, dict[str, list[str | Node]]]:
    text, laid = "", {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name, tags in parts(kind, z.namelist()):
            try:
                xml = z.read(name).decode()
            except (KeyError, UnicodeDecodeError, zipfile.BadZipFile, zlib.error):
                continue
            if laid:
                text += "\n\n"
            laid[name], more = layout(xml, tags, len(text.encode()))
            text += more
    return text, laid


def document_text(path: str, content: bytes) -> str:
    kind = kind_of(path)
    return pdf_text(content) if kind == "pdf" else _plan(kind, content)[0]


def rewrite_document(path: str, content: bytes, placements: list[tuple[int, int, str]]) -> bytes:
    """The document with placements put in and authors taken out; entries that hold no text are the same bytes."""
    kind = kind_of(path)
    if kind == "pdf":
        return make_pdf(replaced(pdf_text(content), 0, placements))
    _, laid = _plan(kind, content)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w") as w:
        for item in z.infolist():
            data = z.read(item)
            if item.filename in laid:
                data = "".join(p if isinstance(p, str) else p.xml(replaced(p.text, p.start, placements)) for p in laid[item.filename]).encode()
            elif item.filename in METADATA:
                data = scrubbed(data)
            info = zipfile.ZipInfo(item.filename, item.date_time)
            info.compress_type = zipfile.ZIP_DEFLATED if item.filename in laid or item.filename in METADATA else item.compress_type
            info.external_attr = item.external_attr
            w.writestr(info, data)
    return out.getvalue()


# PDF: text is read from plain or deflated content streams with their simple text operators; what is written is a new
# document of plain lines.
LINE, PER_PAGE, SIZE, LEADING, MARGIN, WIDTH, HEIGHT = 95, 48, 11, 14, 54, 612, 792
OPERATOR = re.compile(rb"(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]()<])*\]|[-+.\d]+|/[^\s/\[\]()<>]+|T\*|'|\"|[A-Za-z]+\*?)", re.S)


def _pdf_string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
    value = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else plain.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", value, raw[1:-1], flags=re.S).decode("cp1252", "replace")


def pdf_text(content: bytes) -> str:
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    lines: list[str] = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = m[2]
        if b"FlateDecode" in m[1]:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
            line: list[str] = []
            held: list[bytes] = []
            for token in OPERATOR.findall(block):
                if token in (b"Tj", b"'", b'"') and held:
                    if token != b"Tj":
                        lines.append("".join(line))
                        line = []
                    line.append(_pdf_string(held[-1]))
                elif token == b"TJ" and held:
                    line += [_pdf_string(s) for s in re.findall(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", held[-1], re.S)]
                elif token == b"T*" or token in (b"Td", b"TD") and line:
                    lines.append("".join(line))
                    line = []
                held = [token] if token[:1] in b"(<[" else held if token[:1] in b"-+.0123456789/" else []
            if line:
                lines.append("".join(line))
    return "\n".join(lines)


def wrap(text: str, width: int = LINE) -> list[str]:
    """Lines of at most ``width`` characters: runs of spaces shrink to one, long words are cut, blank lines stay."""
    lines: list[str] = []
    for paragraph in text.split("\n"):
        rows: list[list[str]] = [[]]
        room = width
        for word in paragraph.rstrip("\r").split(" "):
            for piece in (word[i : i + width] for i in range(0, len(word), width)):
                if rows[-1] and len(piece) >= room:
                    rows.append([])
                room = (room - 1 if rows[-1] else width) - len(piece)
                rows[-1].append(piece)
        lines += map(" ".join, rows)
    return lines


def pdf_escape(text: str) -> bytes:
    """Latin-1 text in a PDF string; a tab is a space and what doesn't fit a question mark."""
    out = bytearray()
    for c in text:
        n = 32 if c == "\t" else ord(c) if 32 <= ord(c) <= 126 or 160 <= ord(c) <= 255 else 63
        out += b"\\" * (n in (40, 41, 92)) + bytes([n])
    return bytes(out)


def make_pdf(text: str) -> bytes:
    lines = wrap(text)
    pages = [lines[i : i + PER_PAGE] for i in range(0, len(lines), PER_PAGE)]
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, page in enumerate(pages):
        stream = f"BT\n/F1 {SIZE} Tf\n{LEADING} TL\n{MARGIN} {HEIGHT - MARGIN} Td\n".encode() + b"".join(b"(" + pdf_escape(x) + b") Tj\nT*\n" for x in page) + b"ET\n"
        objects.append(f"<< /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << /F1 3 0 R >> >> /Contents {4 + 2 * i} 0 R >>".encode())
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010} 00000 n \n" for p in places)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()
    return bytes(out)


def extract(docs: DataFrame) -> DataFrame:
    """path, text and error of each (path, content); a document that can't be read has an error and no text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, errors = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts.append(document_text(path, content))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return docs.select("path", "content").mapInArrow(run, "path string, text string, error string")


def rewrite(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """path, content, mime, n_placements and error of the rewritten documents; ``placed`` has path and placements. One that
    can't be rewritten has an error and no content."""
    out = "path string, content binary, mime string, n_placements int, error string"

    def one(r: dict) -> tuple:
        try:
            placements = sorted((p["start"], p["end"], p["surrogate"]) for p in r["placements"])
            return r["path"], rewrite_document(r["path"], r["content"], placements), MIME[kind_of(r["path"])], len(placements), None
        except Exception as e:
            return r["path"], None, None, 0, f"{type(e).__name__}: {e}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = (pa.string(), pa.binary(), pa.string(), pa.int32(), pa.string())
        for batch in batches:
            done = [one(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 5, types, strict=True)], names=[c.split()[0] for c in out.split(", ")])

    return docs.select("path", "content").join(placed.select("path", "placements"), "path").mapInArrow(run, out)


def anonymize_documents(docs: DataFrame, detector=None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rewritten documents and the vault that they share; ``detector`` takes (doc_id, text), by default the patterns."""
    from maskwright.operators.detect import regex_detector
    from maskwright.operators.shared import materialize
    from maskwright.operators.vault import anonymize_corpus

    texts = materialize(extract(docs).where("text IS NOT NULL"), "document-texts")
    found = (detector or regex_detector())(texts.where(F.trim("text") != "").select(F.col("path").alias("doc_id"), "text"))
    spans = texts.join(found.withColumnRenamed("doc_id", "path"), "path")
    out, vault = anonymize_corpus(spans, ["path"], seed=seed)
    none = F.array().cast("array<struct<start:int,end:int,surrogate:string>>")
    placed = texts.select("path").join(out.select("path", "placements"), "path", "left").select("path", F.coalesce("placements", none).alias("placements"))
    return rewrite(docs, placed), vault
