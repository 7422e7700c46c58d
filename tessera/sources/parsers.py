"""Documents to text blocks (text, page or None).

Office files are zip archives of XML and are read with the standard library. PDF text, old spreadsheets and OCR need
libraries or models that may be absent: they are adapters, passed to Registry or found if installed.
"""

from __future__ import annotations

import io
import re
import warnings
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.etree import ElementTree

Block = tuple[str, int | None]

# Suffixes of the formats.
TEXT = {".txt", ".md", ".markdown"}
IMAGES = {".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp"}
SHEETS = {".xlsx", ".xlsm", ".xls"}
SUPPORTED = TEXT | IMAGES | SHEETS | {".pdf", ".docx", ".pptx"}
LEGACY = {".doc", ".ppt"}
#: A PDF page with fewer letters is read again by OCR.
PAGE_LETTERS = 50

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def suffix_of(path: str) -> str:
    name = re.split(r"[/\\]", path)[-1]
    dot = name.rfind(".")
    return name[dot:].lower() if 0 < dot < len(name) - 1 else ""


def parse_text(content: bytes) -> Iterator[Block]:
    text = re.sub("\r\n?", "\n", content.decode("utf-8", "replace")).strip()
    if text:
        yield text, None


def parse_pdf(content: bytes, pages: Callable[[bytes], list[str]]) -> Iterator[Block]:
    """The text layer of every page, empty ones too: whether a page is to be recognised is decided later, page by page."""
    for k, layer in enumerate(pages(content)):
        yield layer.strip(), k + 1


def _cells(values) -> str:
    return " | ".join(v for x in values if (v := str(x).strip()))


def parse_docx(content: bytes) -> Iterator[Block]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda p: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    parts = [s for p in body.findall(f"{_W}p") if (s := said(p).strip())]
    for table in body.findall(f"{_W}tbl"):
        for row in table.findall(f"{_W}tr"):
            line = _cells("\n".join(said(p) for p in c.findall(f"{_W}p")) for c in row.findall(f"{_W}tc"))
            if line:
                parts.append(line)
    if parts:
        yield "\n\n".join(parts), None


def _related(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Target and kind of each relationship of a part, by id."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    out = {}
    for r in ElementTree.fromstring(z.read(rels)):
        steps: list[str] = [] if r.get("Target", "").startswith("/") else folder.split("/")
        for s in r.get("Target", "").strip("/").split("/"):
            steps = steps[:-1] if s == ".." else [*steps, s]
        out[r.get("Id")] = ("/".join(steps), r.get("Type", "").rpartition("/")[2])
    return out


def _drawn(shape) -> str:
    """A slide shape's paragraphs, or its table's rows, by line."""
    found = [s for body in shape.findall(f"{_P}txBody") for p in body.findall(f"{_A}p") if (s := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip())]
    for row in shape.iter(f"{_A}tr"):
        line = _cells("\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in c.iter(f"{_A}p")) for c in row.findall(f"{_A}tc"))
        if line:
            found.append(line)
    return "\n".join(found)


def _notes(z: zipfile.ZipFile, part: str) -> str:
    """A slide's speaker notes; those that can't be read are none."""
    try:
        for target, kind in _related(z, part).values():
            if kind == "notesSlide":
                root = ElementTree.fromstring(z.read(target))
                bodies = [s for s in root.iter(f"{_P}sp") if (ph := s.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")) is not None and ph.get("type") == "body"]
                return "\n".join(x for s in bodies if (x := _drawn(s)))
    except (KeyError, ElementTree.ParseError):
        pass
    return ""


def parse_pptx(content: bytes) -> Iterator[Block]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        deck = "ppt/presentation.xml"
        rels = _related(z, deck)
        order = [rels[s.get(f"{_R}id")][0] for s in ElementTree.fromstring(z.read(deck)).iter(f"{_P}sldId")]
        for number, part in enumerate(order, 1):
            tree = ElementTree.fromstring(z.read(part)).find(f"{_P}cSld/{_P}spTree")
            parts = [x for shape in (tree if tree is not None else ()) if shape.tag in (f"{_P}sp", f"{_P}graphicFrame") and (x := _drawn(shape))]
            if notes := _notes(z, part):
                parts.append(f"[Speaker notes]\n{notes}")
            if parts:
                yield "\n\n".join(parts), number


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n


# Fixed values of the file format: numbers of its own formats that show dates or times, and of elapsed time.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ELAPSED = {46}


def _date_styles(z: zipfile.ZipFile) -> tuple[set[int], set[int]]:
    """Cell styles that show dates or times, and those that show elapsed time."""
    if "xl/styles.xml" not in z.namelist():
        return set(), set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    dates, elapsed = set(_DATES), set(_ELAPSED)
    for f in root.iter(f"{_S}numFmt"):
        number, shown = int(f.get("numFmtId", "-1")), re.sub(r'"[^"]*"|\\.|_.', "", f.get("formatCode", "").split(";")[0].lower())
        dates.discard(number)
        if re.search(r"\[(h+|m+|s+)\]", shown):
            elapsed.add(number)
        elif re.search("[dmyhs]", re.sub(r"\[[^\]]*\]", "", shown)) and "general" not in shown:
            dates.add(number)
    styles = [int(x.get("numFmtId", "0")) for x in root.findall(f"{_S}cellXfs/{_S}xf")]
    return {k for k, n in enumerate(styles) if n in dates}, {k for k, n in enumerate(styles) if n in elapsed}


def _number(v: str) -> str:
    """As Python shows it: whole numbers without a point if they are written so."""
    try:
        return str(int(v))
    except ValueError:
        return str(float(v))


def _moment(v: float, elapsed: bool, epoch: datetime) -> str:
    """A serial number of days as a date and time, a time of day under one, or a length of time."""
    past = timedelta(milliseconds=round(v * 86_400_000))
    if elapsed:
        return str(past)
    if 0 <= v < 1 and past.days == 0:
        return str((epoch + past).time())
    # the format counts a 29 February 1900 that never was
    return str(epoch + past + timedelta(days=1 if 0 < v < 60 and epoch.year == 1899 else 0))


def _value(c, shared: list[str], styles: tuple[set[int], set[int]], epoch: datetime) -> str:
    v, kind = c.findtext(f"{_S}v"), c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t"))
    if v is None:
        return ""
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return str(v == "1")
    if kind == "d":
        return str(datetime.fromisoformat(v))
    if kind != "n":
        return v
    style = int(c.get("s", "0"))
    try:
        return _moment(float(v), style in styles[1], epoch) if style in styles[0] | styles[1] else _number(v)
    except (ValueError, OverflowError):
        return v


def parse_xlsx(content: bytes) -> Iterator[Block]:
    """Values, as they were last computed; dates and times by their cells' formats."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        book = "xl/workbook.xml"
        rels, styles, root = _related(z, book), _date_styles(z), ElementTree.fromstring(z.read(book))
        options = root.find(f"{_S}workbookPr")
        epoch = datetime(1904, 1, 1) if options is not None and options.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        for sheet in root.iter(f"{_S}sheet"):
            lines = []
            for row in ElementTree.fromstring(z.read(rels[sheet.get(f"{_R}id")][0])).iter(f"{_S}row"):
                cells = []
                for c in sorted(row.findall(f"{_S}c"), key=lambda c: _column(c.get("r", ""))):
                    cells.append(_value(c, shared, styles, epoch))
                if line := _cells(cells):
                    lines.append(line)
            if lines:
                yield f"[Sheet: {sheet.get('name')}]\n" + "\n".join(lines), None


def parse_xls(content: bytes, sheets: Callable[[bytes], list[tuple[str, list[list]]]]) -> Iterator[Block]:
    for name, rows in sheets(content):
        lines = [line for row in rows if (line := _cells(row))]
        if lines:
            yield f"[Sheet: {name}]\n" + "\n".join(lines), None


def keep_lines(result, least: float = 0.5) -> str:
    """OCR result (box, text, confidence) -> text: malformed entries go, a confidence that can't be read is 0."""
    kept = []
    for entry in result or ():
        try:
            _, text, conf = entry
        except (TypeError, ValueError):
            continue
        try:
            sure = float(conf)
        except (TypeError, ValueError):
            sure = 0.0
        if text and sure >= least:
            kept.append(str(text))
    return "\n".join(kept)


def raster_scale(width: float, height: float, dpi: int = 200, largest: int = 4000) -> float:
    """Scale of a page in points for a resolution, held so that no side has more pixels than largest."""
    return min(dpi / 72, largest / max(width, height, 1))


def installed_pdf() -> Callable[[bytes], list[str]] | None:
    try:
        import pypdf
    except ImportError:
        return None
    return lambda content: [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]


def installed_xls() -> Callable | None:
    try:
        import xlrd
    except ImportError:
        return None
    return lambda content: [(s.name, [s.row_values(r) for r in range(s.nrows)]) for s in xlrd.open_workbook(file_contents=content).sheets()]


@dataclass
class Registry:
    """Parsers by suffix, and readers of images: ocr(image bytes) gives result lines; ocr_page(pdf bytes, page from 0) gives text.

    A file whose reader isn't there, .xls or an image, has no text, and a warning says so.
    """

    pdf_pages: Callable[[bytes], list[str]] | None = field(default_factory=installed_pdf)
    xls_sheets: Callable | None = field(default_factory=installed_xls)
    ocr: Callable[[bytes], list] | None = None
    ocr_page: Callable[[bytes, int], str] | None = None
    least_confidence: float = 0.5

    def parse(self, path: str, content: bytes) -> Iterator[Block]:
        kind = suffix_of(path)
        if kind in TEXT:
            return parse_text(content)
        if kind == ".docx":
            return parse_docx(content)
        if kind == ".pptx":
            return parse_pptx(content)
        if kind in (".xlsx", ".xlsm"):
            return parse_xlsx(content)
        if kind == ".xls":
            return parse_xls(content, self.xls_sheets) if self.xls_sheets else self._without(path, "an xls reader")
        if kind == ".pdf":
            if self.pdf_pages is None:
                raise RuntimeError("a PDF reader is not installed")
            return parse_pdf(content, self.pdf_pages)
        if kind in IMAGES:
            return iter([("", None)]) if self.ocr else self._without(path, "an engine for images")
        raise ValueError(f"unsupported file type: {kind or path}")

    def recognised(self, path: str, content: bytes, page: int | None) -> str:
        """What is read of an image, or of a page of a PDF."""
        return keep_lines(self.ocr(content), self.least_confidence) if page is None else self.ocr_page(content, page - 1)

    @staticmethod
    def _without(path: str, what: str) -> Iterator[Block]:
        warnings.warn(f"{path} is skipped: {what} is not installed", stacklevel=2)
        return iter([])
