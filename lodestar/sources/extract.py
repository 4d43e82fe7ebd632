"""Extractors: file content to ordered blocks. An extractor never raises; a file that it can't read is a failed document."""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Block = dict
# Extensions of source files and their languages.
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".sql": "sql", ".sh": "shell", ".html": "html", ".css": "css", ".json": "json"}
_COMMENT = {"python": "#", "ruby": "#", "shell": "#", "sql": "--"}


def decode(raw: bytes) -> tuple[str, str]:
    """Text and the encoding that fitted first."""
    for name in ("utf-8-sig", "utf-8", "cp1252", "latin-1"):
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "replaced"


def block(kind: str, text: str, label: str = "", tabular: bool = False, heading: bool = False, rows: int = 0) -> Block:
    return {"kind": kind, "label": label, "text": text, "is_tabular": tabular, "is_heading": heading, "row_count": rows}


def prose(raw: bytes, ext: str, stem: str) -> list[Block]:
    """Paragraphs between blank lines; in Markdown also headings and pipe tables."""
    text, _ = decode(raw)
    marked, out = ext in (".md", ".markdown"), []
    for part in (p.strip() for p in re.split(r"\n\s*\n", text.replace("\r\n", "\n"))):
        if part:
            table = marked and sum(line.count("|") >= 2 for line in part.split("\n")) >= 2
            heading = marked and part.startswith("#")
            out.append(block("table" if table else "heading" if heading else "paragraph", part, part.split("\n")[0][:60], table, heading, part.count("\n") + 1 if table else 0))
    return out


def source(raw: bytes, ext: str, stem: str) -> list[Block]:
    text, _ = decode(raw)
    language = LANGUAGES.get(ext, "text")
    mark = _COMMENT.get(language, "//")
    lines = text.split("\n")
    comments = sum(line.strip().startswith(mark) for line in lines)
    return [block("code", text, f"{language}, {len(lines)} lines, {comments} comments", rows=len(lines))] if text.strip() else []


def table(raw: bytes, ext: str, stem: str) -> list[Block]:
    text, _ = decode(raw)
    try:
        rows = list(csv.reader(io.StringIO(text), delimiter="\t" if ext == ".tsv" else ","))
    except csv.Error:
        rows = [[line] for line in text.split("\n")]
    rows = [r for r in rows if any(c.strip() for c in r)]
    said = "\n".join(" | ".join(c.strip() for c in r) for r in rows)
    return [block("table", said, f"{stem}, {len(rows)} rows", True, rows=len(rows))] if rows else []


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node, end: str = "p", run: str = "t") -> list[str]:
    return ["".join(t.text or "" for t in p.iter() if _local(t.tag) == run) for p in node.iter() if _local(p.tag) == end]


def _cells(node, row: str, cell: str) -> list[str]:
    return [" | ".join(" ".join(x for x in _texts(c) if x) for c in r.iter() if _local(c.tag) == cell) for r in node.iter() if _local(r.tag) == row]


def word(raw: bytes, ext: str, stem: str) -> list[Block]:
    """Paragraphs in order, then tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out, tables = [], []
    for node in next(n for n in body.iter() if _local(n.tag) == "body"):
        if _local(node.tag) == "p":
            text = "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")
            style = next((v for n in node.iter() if _local(n.tag) == "pStyle" for k, v in n.attrib.items() if _local(k) == "val"), "")
            heading = style.startswith("Heading") or style == "Title"
            if text.strip():
                out.append(block("heading" if heading else "paragraph", text.strip(), text.strip()[:60], heading=heading))
        elif _local(node.tag) == "tbl":
            rows = [r for r in _cells(node, "tr", "tc") if r.strip(" |")]
            if rows:
                tables.append(block("table", "\n".join(rows), f"table {len(tables) + 1}", True, rows=len(rows)))
    return out + tables


def slides(raw: bytes, ext: str, stem: str) -> list[Block]:
    """For each slide its tables, its text and its notes."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = {n for n in z.namelist()}
        numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for k in numbers:
            root = ElementTree.fromstring(z.read(f"ppt/slides/slide{k}.xml"))
            inside = set()
            for t in (n for n in root.iter() if _local(n.tag) == "tbl"):
                rows = _cells(t, "tr", "tc")
                inside.update(id(p) for p in t.iter())
                out.append(block("table", "\n".join(rows), f"slide {k} table", True, rows=len(rows)))
            said = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in root.iter() if _local(p.tag) == "p" and id(p) not in inside]
            said = [s.strip() for s in said if s.strip()]
            if said:
                out.append(block("slide", "\n".join(said), f"slide {k}: {said[0][:40]}"))
            if f"ppt/notesSlides/notesSlide{k}.xml" in names:
                notes = [s for s in _texts(ElementTree.fromstring(z.read(f"ppt/notesSlides/notesSlide{k}.xml"))) if s.strip()]
                if notes:
                    out.append(block("notes", "\n".join(notes), f"slide {k} notes"))
    return out


def sheets(raw: bytes, ext: str, stem: str) -> list[Block]:
    """A table for each sheet that isn't empty: its name, then its rows."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = [_joined(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(n.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        titles = [n.attrib.get("name", "") for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(n.tag) == "sheet"]
        numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for at, k in enumerate(numbers):
            rows = []
            for row in (n for n in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter() if _local(n.tag) == "row"):
                cells = []
                for c in (n for n in row if _local(n.tag) == "c"):
                    value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value.isdigit() and int(value) < len(shared) else _joined(c) if c.attrib.get("t") == "inlineStr" else value)
                if any(x.strip() for x in cells):
                    rows.append(re.sub(r"( \|)+\s*$", "", " | ".join(x.strip() for x in cells)))
            title = titles[at] if at < len(titles) else f"sheet {k}"
            if rows:
                out.append(block("sheet", "\n".join([title, *rows]), title, True, rows=len(rows)))
    return out


def _joined(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


_PDF_STREAM = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_PDF_SHOWN = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\[\]()]|\((?:[^()\\]|\\.)*\))*)\]\s*TJ|\b(T\*|Td|TD|Tm|ET)\b", re.S)
_PDF_PART = re.compile(rb"\(((?:[^()\\]|\\.)*)\)|(-?\d+(?:\.\d+)?)", re.S)
_PDF_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)


def _pdf_string(raw: bytes) -> str:
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
    plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else named.get(m[1], m[1])
    return _PDF_ESCAPE.sub(plain, raw).decode("cp1252", "replace")


def _pdf_pages(raw: bytes) -> list[str]:
    """Text of the pages of a plain PDF: literal strings of their content streams, raw or deflated, in the order of the file's page objects."""
    objects = {int(m[1]): m[2] for m in _PDF_STREAM.finditer(raw)}
    pages = [body for body in objects.values() if re.search(rb"/Type\s*/Page\b", body)]
    out = []
    for page in pages:
        said: list[str] = []
        ref = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        for number in re.findall(rb"(\d+)\s+\d+\s+R", ref[1] if ref else b""):
            body = objects.get(int(number), b"")
            head, _, tail = body.partition(b"stream")
            data = tail.lstrip(b"\r").removeprefix(b"\n").rpartition(b"endstream")[0]
            if b"FlateDecode" in head:
                data = zlib.decompressobj().decompress(data)
            for one, several, move in _PDF_SHOWN.findall(data):
                if move:
                    said.append("\n")
                elif several:  # a wide gap between parts is a blank
                    said += [_pdf_string(x) if not gap else " " if float(gap) < -200 else "" for x, gap in _PDF_PART.findall(several)]
                else:
                    said.append(_pdf_string(one))
        out.append("\n".join(x for x in (" ".join(line.split()) for line in "".join(said).split("\n")) if x))
    return out


def pdf(raw: bytes, ext: str, stem: str) -> list[Block]:
    """Pages with text: by a PDF reader if one is installed, else those of a plain, unencrypted file. Empty pages are left out."""
    try:
        from pypdf import PdfReader
    except ImportError:
        if b"/Encrypt" in raw:
            raise ValueError("the file is encrypted") from None
        texts = _pdf_pages(raw)
    else:
        reader = PdfReader(io.BytesIO(raw))
        if reader.is_encrypted and not reader.decrypt(""):
            raise ValueError("the file is encrypted")
        texts = [(p.extract_text() or "").strip() for p in reader.pages]
    if not any(texts):
        raise ValueError("the file has no text")
    return [block("page", t, f"page {k}") for k, t in enumerate(texts, 1) if t]


def picture(raw: bytes) -> dict[str, str]:
    """Format, width and height of an image's head, and the day that its EXIF data say, where they can be read."""
    out: dict[str, str] = {}
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        out = dict(zip(("format", "width", "height"), ("png", *map(str, struct.unpack(">II", raw[16:24])))))
    elif raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        out = dict(zip(("format", "width", "height"), ("gif", *map(str, struct.unpack("<HH", raw[6:10])))))
    elif raw[:2] == b"BM" and len(raw) >= 26:
        out = dict(zip(("format", "width", "height"), ("bmp", *(str(abs(x)) for x in struct.unpack("<ii", raw[18:26])))))
    elif raw[:2] == b"\xff\xd8":
        out, at = {"format": "jpeg"}, 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                out["height"], out["width"] = (str(x) for x in struct.unpack(">HH", raw[at + 5 : at + 9]))
                break
            at += 2 + size
    if day := re.search(rb"Exif\x00\x00.{8,4096}?((?:19|20)\d\d):([01]\d):([0-3]\d) [0-2]\d:[0-5]\d:[0-5]\d\x00", raw[:70_000], re.S):
        out["taken"] = b"-".join(day.groups()).decode()
    return out


def image(raw: bytes, ext: str, stem: str) -> list[Block]:
    """The name as words; what the head says of the image is the label."""
    known = picture(raw)
    said = " ".join(x for x in (known.get("format", ""), f"{known['width']}x{known['height']}" if "width" in known else "", known.get("taken", "")) if x)
    return [block("image", stem.replace("_", " ").replace("-", " "), f"name only; {said}" if said else "name only")]


Extractor = Callable[[bytes, str, str], list[Block]]
REGISTRY: dict[str, tuple[str, Extractor]] = {
    **{e: ("text", prose) for e in (".txt", ".md", ".markdown", ".rst", ".log")},
    **{e: ("code", source) for e in LANGUAGES},
    **{e: ("csv", table) for e in (".csv", ".tsv")},
    ".pdf": ("pdf", pdf), ".docx": ("docx", word), ".pptx": ("pptx", slides), ".xlsx": ("xlsx", sheets),
    **{e: ("image", image) for e in (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tiff")},
}


def supported() -> list[str]:
    return sorted(REGISTRY)


def read(raw: bytes | None, name: str, limit: int = 400_000) -> dict:
    """A document of a file's content: ok, extractor, error, truncated and its blocks, whose characters sum to `limit` at most."""
    stem, dot, tail = name.rpartition(".")
    ext = "." + tail.lower() if dot and stem else ""
    stem = stem if ext else name
    kind, extractor = REGISTRY.get(ext, ("unsupported", None))
    if extractor is None:
        return {"ok": False, "extractor": kind, "error": f"no extractor for {ext or 'files without an extension'}", "truncated": False, "blocks": []}
    try:
        blocks = extractor(raw or b"", ext, stem)
    except Exception as e:  # noqa: BLE001  a file that can't be read is reported, whatever it does to its reader
        return {"ok": False, "extractor": kind, "error": f"{type(e).__name__}: {e}"[:300], "truncated": False, "blocks": []}
    kept, room = [], limit
    for b in blocks:
        if len(b["text"]) <= room:
            kept.append(b)
            room -= len(b["text"])
            continue
        if room > 200:
            kept.append({**b, "text": b["text"][:room], "label": b["label"] + " (truncated)"})
        return {"ok": True, "extractor": kind, "error": None, "truncated": True, "blocks": kept}
    return {"ok": True, "extractor": kind, "error": None, "truncated": False, "blocks": kept}


DOCUMENT = "path string, ok boolean, extractor string, error string, truncated boolean, blocks array<struct<kind:string,label:string,text:string,is_tabular:boolean,is_heading:boolean,row_count:int>>"


def extract(files: DataFrame, limit: int = 400_000) -> DataFrame:
    """Documents of files (path, content), one per row."""

    def run(batches):
        for pdf_ in batches:
            rows = [{"path": p, **read(c, p.rsplit("/", 1)[-1], limit)} for p, c in zip(pdf_.path, pdf_.content)]
            yield pd.DataFrame(rows, columns=["path", "ok", "extractor", "error", "truncated", "blocks"])

    return files.select("path", "content").mapInPandas(run, DOCUMENT)


def explode_blocks(documents: DataFrame, key: str = "path") -> DataFrame:
    return documents.select(key, F.posexplode("blocks").alias("block_index", "b")).select(key, "block_index", "b.*")


def report(documents: DataFrame) -> DataFrame:
    """Success by extractor: total, ok, failed, empty, truncated, with tables."""
    empty = F.col("ok") & (F.size("blocks") == 0)
    tabular = F.exists("blocks", lambda b: b["is_tabular"])
    return documents.groupBy("extractor").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(empty).alias("empty"), F.count_if("truncated").alias("truncated"), F.count_if(tabular).alias("tabular"))
