"""Attachment files: what they are by their first bytes, and the text of office formats and digital PDF files."""

from __future__ import annotations

import io
import re
import signal
import threading
import zipfile
import zlib
from contextlib import contextmanager
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File types that are read here.
READABLE = ("pdf", "docx", "xlsx")
MOST_CELLS = 2_000_000
MOST_BYTES = 300 * 1024 * 1024
MOST_PAGES = 600
#: Longest time one file may take.
SECONDS = 90.0
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
FILE_ROWS = "path string, detected string, status string, text string, error string"


def detected_format(content: Column) -> Column:
    """pdf, ole (old office), zip (new office and archives), html, png, jpeg, gif, or unknown, by the first bytes."""
    start = F.hex(F.substring(content, 1, 16))
    begins = lambda *marks: F.rlike(start, F.lit("^(?:" + "|".join(marks) + ")"))
    page = F.rlike(F.lower(F.decode(F.substring(content, 1, 16), "ISO-8859-1")), F.lit(r"^\s*(?:<!doctype h|<html|<head|<body|<script)"))
    return (
        F.when(begins("25504446"), "pdf").when(begins("D0CF11E0A1B11AE1"), "ole").when(begins("504B0304", "504B0506"), "zip")
        .when(begins("89504E47"), "png").when(begins("FFD8FF"), "jpeg").when(begins("47494638"), "gif").when(page, "html").otherwise("unknown")
    )


def _member(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def docx_text(data: bytes) -> tuple[str, bool]:
    """Paragraphs and table rows in document order, cells parted by tabs; and whether drawings were left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        _bounded(archive)
        body = _member(archive, "word/document.xml")[0]
    words = lambda node: "".join(t.text or "" if t.tag == f"{WORD}t" else "\t" for t in node.iter() if t.tag in (f"{WORD}t", f"{WORD}tab"))
    lines = []
    for block in body:
        if block.tag == f"{WORD}p":
            lines.append(words(block))
        elif block.tag == f"{WORD}tbl":
            lines += ["\t".join(words(cell) for cell in row.iter(f"{WORD}tc")) for row in block.iter(f"{WORD}tr")]
    return "\n".join(line for line in lines if line.strip()), any(n.tag == f"{WORD}drawing" for n in body.iter())


def xlsx_text(data: bytes) -> tuple[str, bool]:
    """Every sheet under its name, rows with cells parted by tabs, formulas as text; and whether cells were left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        _bounded(archive)
        strings = _member(archive, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in strings] if strings is not None else []
        links = {r.get("Id"): r.get("Target") for r in _member(archive, "xl/_rels/workbook.xml.rels")}
        lines, cells = [], 0
        for sheet in _member(archive, "xl/workbook.xml").iter(f"{SHEET}sheet"):
            lines.append(f"[工作表：{sheet.get('name')}]")
            target = links[sheet.get(RELATION)].lstrip("/")
            tree = _member(archive, target if target.startswith("xl/") else f"xl/{target}")
            for row in tree.iter(f"{SHEET}row"):
                values = [_cell(c, shared) for c in row.iter(f"{SHEET}c")]
                cells += len(values)
                if cells > MOST_CELLS:
                    return "\n".join(lines), True
                if any(values):
                    lines.append("\t".join(values).rstrip("\t"))
    return "\n".join(lines), False


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    formula, value = cell.find(f"{SHEET}f"), cell.find(f"{SHEET}v")
    if formula is not None and formula.text:
        return f"={formula.text}"
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    if value is None or value.text is None:
        return ""
    return shared[int(value.text)] if cell.get("t") == "s" else value.text


def _bounded(archive: zipfile.ZipFile) -> None:
    if sum(i.file_size for i in archive.infolist()) > MOST_BYTES:
        raise ValueError("the archive expands to more than 300 MiB")


# What a file that gives no text is put down as.
REVIEW, IS_HTML, OLD_OFFICE, NO_READER, NO_TEXT = "needs_manual_review", "attachment_link_returns_html", "legacy_or_encrypted_ole_container", "unsupported_format_no_ocr", "no_extractable_text"


def file_text(data: bytes, detected: str) -> tuple[str, str, str | None]:
    """(status, text, error) of one file; a file that was read and holds no text is left to a person."""
    known = {"html": IS_HTML, "ole": OLD_OFFICE}
    if detected in known:
        return REVIEW, "", known[detected]
    if detected == "pdf":
        return _read(pdf_text, data)
    if detected != "zip":
        return REVIEW, "", NO_READER
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = set(archive.namelist())
    except Exception as problem:  # noqa: BLE001
        return "failed", "", f"{type(problem).__name__}: {problem}"[:300]
    reader = docx_text if "word/document.xml" in names else xlsx_text if "xl/workbook.xml" in names else None
    return _read(reader, data) if reader else (REVIEW, "", NO_READER)


def _read(reader, data: bytes) -> tuple[str, str, str | None]:
    try:
        with limited(SECONDS):
            text, cut = reader(data)
    except Exception as problem:  # noqa: BLE001
        return "failed", "", f"{type(problem).__name__}: {problem}"[:300]
    if not text.strip():
        return REVIEW, "", NO_TEXT
    return ("partial" if cut else "parsed"), text, None


@contextmanager
def limited(seconds: float):
    """Ends what takes longer with an error.  A worker's main thread alone can be interrupted; elsewhere there is no limit."""
    def late(*_):
        raise TimeoutError(f"parsing took more than {seconds} s")

    if threading.current_thread() is not threading.main_thread():
        yield
        return
    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


class _Pdf:
    """The objects of a PDF file that are written plainly or in compressed object streams, by number."""

    def __init__(self, data: bytes):
        self.objects: dict[int, bytes] = {int(m.group(1)): m.group(2) for m in re.finditer(rb"(?s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data)}
        if b"/Encrypt" in data:
            raise ValueError("the file is encrypted")
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                inner, first = self.stream(body), int(re.search(rb"/First\s+(\d+)", body).group(1))
                heads = [int(x) for x in inner[:first].split()]
                ends = [*heads[3::2], len(inner) - first]
                for number, at, end in zip(heads[::2], heads[1::2], ends):
                    self.objects.setdefault(number, inner[first + at : first + end])

    @staticmethod
    def stream(body: bytes) -> bytes:
        """The decoded stream of an object; b'' where it has none or another filter than Flate."""
        found = re.search(rb"(?s)stream\r?\n(.*?)\r?\n?endstream", body)
        if not found:
            return b""
        filters = re.search(rb"/Filter\s*\[?\s*((?:/\w+\s*)+)", body)
        named = filters.group(1).split() if filters else []
        if not named:
            return found.group(1)
        return zlib.decompressobj().decompress(found.group(1)) if named == [b"/FlateDecode"] else b""

    def inherited(self, number: int, key: bytes) -> bytes:
        """The value of a page's key, its own or that of a node above."""
        for _ in range(32):
            body = self.objects.get(number, b"")
            if found := re.search(key + rb"\s*(\d+\s+\d+\s+R|<<(?s:.*?)>>(?:\s*>>)*)", body):
                return self.resolved(found.group(1))
            above = re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", body)
            if not above:
                return b""
            number = int(above.group(1))
        return b""

    def resolved(self, value: bytes) -> bytes:
        reference = re.fullmatch(rb"(\d+)\s+\d+\s+R", value.strip())
        return self.objects.get(int(reference.group(1)), b"") if reference else value

    def pages(self, number: int | None = None, depth: int = 0) -> list[int]:
        """Numbers of the pages in reading order."""
        if number is None:
            roots = [int(m.group(1)) for body in self.objects.values() if b"/Catalog" in body and (m := re.search(rb"/Pages\s+(\d+)", body))]
            return self.pages(roots[-1]) if roots else []
        body = self.objects.get(number, b"")
        kids = re.search(rb"(?s)/Kids\s*\[(.*?)\]", body)
        if not kids or depth > 32:
            return [number]
        return [p for k in re.findall(rb"(\d+)\s+\d+\s+R", kids.group(1)) for p in self.pages(int(k), depth + 1)]


def _hex_text(digits: bytes) -> str:
    return bytes.fromhex(digits.decode()).decode("utf-16-be", "replace")


def _unicode_map(cmap: bytes) -> dict[int, str]:
    """Character codes to text, from a font's ToUnicode map."""
    table: dict[int, str] = {}
    for block in re.findall(rb"(?s)beginbfchar(.*?)endbfchar", cmap):
        table |= {int(a, 16): _hex_text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"(?s)beginbfrange(.*?)endbfrange", cmap):
        for low, high, start in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = _hex_text(start)
            table |= {int(low, 16) + i: first[:-1] + chr(ord(first[-1]) + i) for i in range(min(int(high, 16) - int(low, 16), 0xFFFF) + 1)}
    return table


def _shown(token: bytes, table: dict[int, str] | None) -> str:
    """The text of a string operand under a font's map; without a map, one byte a character."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        one = lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() else escapes.get(m.group(1), m.group(1).strip(b"\r\n"))
        raw = re.sub(rb"(?s)\\([0-7]{1,3}|.)", one, token[1:-1])
    if table is None:
        return raw.decode("latin-1")
    width = 2 if max(table, default=0) > 255 or token.startswith(b"<") else 1
    return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


_PDF_TOKEN = re.compile(rb"(?s)\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+|\[|\]")


def pdf_text(data: bytes) -> tuple[str, bool]:
    """Each page under its number, a line for each text position; and whether pages without text that show images were left out.

    Digital files with plain or Flate streams; fonts by their ToUnicode maps.  Encrypted files are an error.
    """
    pdf = _Pdf(data)
    numbers = pdf.pages()
    parts, cut = [], len(numbers) > MOST_PAGES
    for n, page in enumerate(numbers[:MOST_PAGES], 1):
        resources = pdf.inherited(page, rb"/Resources")
        fonts = re.search(rb"(?s)/Font\s*(<<.*?>>|\d+\s+\d+\s+R)", resources)
        named = dict(re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", pdf.resolved(fonts.group(1)))) if fonts else {}
        tables = {}
        for name, number in named.items():
            to = re.search(rb"/ToUnicode\s+(\d+)", pdf.objects.get(int(number), b""))
            tables[name] = _unicode_map(pdf.stream(pdf.objects.get(int(to.group(1)), b""))) if to else None
        contents = re.search(rb"(?s)/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", pdf.objects.get(page, b""))
        streams = [pdf.stream(pdf.objects.get(int(c), b"")) for c in re.findall(rb"(\d+)\s+\d+\s+R", contents.group(1))] if contents else []
        table, pieces, operands = None, [], []
        for token in _PDF_TOKEN.findall(b"\n".join(streams)):
            if token[:1].isalpha() or token in (b"'", b'"', b"T*"):
                if token == b"Tf" and len(operands) >= 2:
                    table = tables.get(operands[-2])
                elif token in (b"Td", b"TD", b"Tm", b"T*", b"'", b'"'):
                    pieces.append("\n")
                if token in (b"Tj", b"TJ", b"'", b'"'):
                    pieces += [_shown(o, table) for o in operands if o[:1] in b"(<"]
                operands = []
            else:
                operands.append(token)
        text = "\n".join(line for line in (" ".join(x.split()) for x in "".join(pieces).split("\n")) if line)
        # a page of hardly any text that shows an image is a scan
        cut |= len(text) < 20 and b"/XObject" in resources
        if text:
            parts.append(f"[第 {n} 页]\n{text}")
    return "\n".join(parts), cut


def read_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of the ``binaryFile`` source to (path, detected, status, text, error); a bad file is a row, never a failure. The source itself gives no row for a file of no bytes."""
    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, kind, *file_text(bytes(data), kind)) for p, data, kind in zip(frame["path"], frame["content"], frame["detected"])]
            yield pd.DataFrame(rows, columns=["path", "detected", "status", "text", "error"])

    read = files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("content"), detected_format(F.col(content)).alias("detected"))
    return read.mapInPandas(run, FILE_ROWS)
