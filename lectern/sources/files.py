"""Files to text: one row for each file, with its text or the reason why there is none."""

from __future__ import annotations

import email
import functools
import html.parser
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import policy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Encodings tried in turn.
ENCODINGS = ("utf-8", "latin-1")
#: Elements of a web page that hold no text.
SILENT_TAGS = ("script", "style", "meta", "link")
SCHEMA = "path string, kind string, content string, status string, error string"


def _decoded(data: bytes) -> str:
    for encoding in ENCODINGS[:-1]:
        try:
            return data.decode(encoding).removeprefix("\ufeff")
        except UnicodeDecodeError:
            pass
    return data.decode(ENCODINGS[-1])


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _named(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _name(x) == name)


def _xml(data: bytes, part: str) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ElementTree.fromstring(z.read(part))


#: Elements of office formats that stand for white space.
_BLANKS = {"tab": "\t", "br": "\n", "cr": "\n"}


def _runs(paragraph: ElementTree.Element) -> str:
    return "".join(x.text or "" if _name(x) == "t" else _BLANKS.get(_name(x), "") for x in paragraph.iter())


def docx(data: bytes) -> str:
    """Paragraphs with text, parted by blank lines, then each table row as ``a | b`` on a line."""
    body = next(_named(_xml(data, "word/document.xml"), "body"))
    paragraphs = [t for x in body if _name(x) == "p" and (t := _runs(x)).strip()]
    cells = lambda row: [" ".join(_runs(p) for p in _named(c, "p")) for c in row if _name(c) == "tc"]
    rows = [" | ".join(cells(r)) for t in body if _name(t) == "tbl" for r in t if _name(r) == "tr"]
    return "\n".join(["\n\n".join(paragraphs), *rows])


def pptx(data: bytes) -> str:
    """Slides in the order of the presentation, each under ``--- Slide n ---``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        order = [next(v for k, v in s.items() if k.endswith("}id")) for s in _named(ElementTree.fromstring(z.read("ppt/presentation.xml")), "sldId")]
        slides = [ElementTree.fromstring(z.read("ppt/" + targets[i])) for i in order]
    out = []
    for n, slide in enumerate(slides, 1):
        texts = ["\n".join(_runs(p) for p in _named(body, "p")) for body in _named(slide, "txBody")]
        out.append(f"--- Slide {n} ---\n" + "".join(t + "\n" for t in texts if t.strip()))
    return "\n\n".join(out)


def _inner(node: ElementTree.Element) -> str:
    return "".join(node.itertext())


def odt(data: bytes) -> str:
    """Paragraphs, then headings marked ``#``, parted by blank lines."""
    root = _xml(data, "content.xml")
    found = [_inner(x) for x in _named(root, "p")], [f"# {_inner(x)}" for x in _named(root, "h") if _inner(x).strip()]
    return "\n\n".join([*(t for t in found[0] if t.strip()), *found[1]])


def ods(data: bytes) -> str:
    """Each sheet's name as ``--- name ---``, then its rows that hold anything, as ``a | b``."""
    lines = []
    for sheet in _named(_xml(data, "content.xml"), "table"):
        lines.append(f"--- {next((v for k, v in sheet.items() if k.endswith('}name')), None) or 'Sheet'} ---")
        rows = ([_inner(c) for c in _named(r, "table-cell")] for r in _named(sheet, "table-row"))
        lines += [" | ".join(cells) for cells in rows if any(cells)]
    return "\n".join(lines)


def odp(data: bytes) -> str:
    """Each frame with text under ``--- Slide n ---``; without any, all paragraphs."""
    root, parts = _xml(data, "content.xml"), []
    for n, frame in enumerate(_named(root, "frame"), 1):
        if texts := [t for p in _named(frame, "p") if (t := _inner(p)).strip()]:
            parts.append("\n".join([f"--- Slide {n} ---", *texts]))
    return "\n\n".join(parts or [t for p in _named(root, "p") if (t := _inner(p)).strip()])


def eml(data: bytes) -> str:
    """Subject, sender and receiver, a blank line, then the plain text parts."""
    mail = email.message_from_bytes(data, policy=policy.default)
    parts = [p for p in mail.walk() if p.get_content_type() == "text/plain"] if mail.is_multipart() else [mail]
    return f"Subject: {mail['subject']}\nFrom: {mail['from']}\nTo: {mail['to']}\n\n" + "".join(p.get_content() for p in parts)


#: Groups of a rich text file that hold no text, and words that stand for characters.
_RTF_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"}
_RTF_WORDS = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}
_RTF_TOKEN = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z'])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def rtf(data: bytes) -> str:
    """The text of a rich text file, paragraphs on lines of their own."""
    out, stack, silent, skip = [], [], False, 0
    for word, number, code, sign, brace, plain in _RTF_TOKEN.findall(data.decode("utf-8", "ignore")):
        if brace == "{":
            stack.append(silent)
        elif brace == "}":
            silent = stack.pop() if stack else False
        elif word in _RTF_SILENT or sign == "*":
            silent = True
        elif silent:
            continue
        elif word == "u":
            out.append(chr(int(number) % 65536))
            skip = 1
        elif code or plain:
            text = bytes.fromhex(code).decode("cp1252", "replace") if code else plain
            out.append(text[skip:])
            skip = 0
        elif word or sign:
            out.append(_RTF_WORDS.get(word, "") if word else sign if sign in "\\{}" else {"~": "\u00a0"}.get(sign, ""))
    return "".join(out).strip()


class _Page(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.texts, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT_TAGS[:2]

    def handle_endtag(self, tag):
        self.silent -= tag in SILENT_TAGS[:2] and self.silent > 0

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.texts.append(data.strip())


def web_page(data: bytes) -> str:
    """The texts of a web page, each on a line of its own."""
    page = _Page()
    page.feed(_decoded(data))
    page.close()
    return "\n".join(page.texts)


def _front_matter(data: bytes) -> str:
    """A Markdown text without the front matter before it."""
    return re.sub(r"(?s)\A---\s*\n.*?\n---\s*\n?", "", _decoded(data))


def _cell_values(sheet: ElementTree.Element, shared: list[str]) -> Iterator[list[str]]:
    """Rows of a worksheet, with empty cells where the file leaves some out."""
    for row in _named(sheet, "row"):
        cells: list[str] = []
        for c in _named(row, "c"):
            letters = re.match("[A-Z]*", c.get("r", "")).group()
            column = functools.reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0) or len(cells) + 1
            cells += [""] * (column - 1 - len(cells))
            said = "".join(x.text or "" for x in c.iter() if _name(x) in ("v", "t"))
            cells.append(shared[int(said)] if c.get("t") == "s" and said else said)
        yield cells


def sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Name and rows of each worksheet of a workbook, in its order, without empty rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        there = set(z.namelist())
        texts = ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in there else None
        shared = ["".join(x.text or "" for x in _named(si, "t")) for si in _named(texts, "si")] if texts is not None else []
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in _named(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
            target = next(links[v] for k, v in sheet.attrib.items() if k.endswith("}id") or k == "id")
            rows = _cell_values(ElementTree.fromstring(z.read(f"xl/{target}".replace("xl//xl/", "xl/"))), shared)
            out.append((sheet.get("name", ""), [r for r in rows if any(x.strip() for x in r)]))
        return out


def xlsx(data: bytes) -> str:
    """Each sheet as a Markdown table under its name; the first row has the columns' names."""
    parts = []
    for name, rows in sheets(data):
        width = max(map(len, rows), default=0)
        lines = ["| " + " | ".join(x.replace("|", "\\|") for x in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
        parts.append("\n".join([f"## {name}", "", *lines[:1], *(["|" + "---|" * width] if lines else []), *lines[1:]]))
    return "\n\n---\n\n".join(parts)


def sheet_rows(files: DataFrame) -> DataFrame:
    """``path, sheet, row, cells`` of all workbooks among rows with ``path`` and ``content``; rows are numbered from 0 for the names of columns. Broken workbooks have none: :func:`parsed` tells why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = sheets(bytes(content or b""))
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, ValueError, IndexError):
                    continue
                out += [(path, name, k, cells) for name, rows in found for k, cells in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


PARSERS: dict[str, Callable[[bytes], str]] = {
    ".docx": docx, ".pptx": pptx, ".odt": odt, ".ods": ods, ".odp": odp, ".eml": eml, ".rtf": rtf, ".html": web_page, ".htm": web_page, ".xlsx": xlsx, ".md": _front_matter, ".markdown": _front_matter, ".txt": _decoded, ".csv": _decoded, ".log": _decoded, ".json": _decoded, ".rst": _decoded, ".ini": _decoded, ".cfg": _decoded, ".yaml": _decoded, ".yml": _decoded,
}


def _parse(path: str, data: bytes) -> tuple:
    kind = re.search(r"(\.[^./]+)?$", path.lower()).group()
    if kind not in PARSERS:
        return path, kind, None, "error", f"unsupported: {kind or 'no extension'}"
    try:
        content = PARSERS[kind](data)
    except Exception as why:  # a broken file must not end the job: its row tells
        return path, kind, None, "error", f"{type(why).__name__}: {why}"
    return path, kind, content, "ok" if content.strip() else "empty", None


def parsed(files: DataFrame) -> DataFrame:
    """``path, kind, content, status, error`` of rows with ``path`` and ``content`` (bytes). Status is ``ok``, ``empty`` or ``error``.

    Batches follow ``spark.sql.execution.arrow.maxRecordsPerBatch``: lower it for large files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_parse(p, bytes(c or b"")) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["path", "kind", "content", "status", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """All files below a folder, parsed."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder))


GOLDEN = "id string, projet string, question string, reponse_reference string, sources_reference array<string>"


def golden_set(spark: SparkSession, path: str, schema: str = GOLDEN) -> DataFrame:
    """Cases of an evaluation, one JSON object on each line that isn't blank; lines without a case are in :func:`golden_errors`."""
    return spark.read.schema(schema).json(path).where("id IS NOT NULL")


def golden_errors(spark: SparkSession, path: str) -> DataFrame:
    """``line, error`` of the lines that give no case: what is no JSON, and objects without an ``id``. Blank lines are none."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    found = F.try_parse_json(F.trim("value"))
    error = F.when(found.isNull(), "no JSON").when(F.try_variant_get(found, "$.id", "string").isNull(), "no id")
    return lines.select(F.col("value").alias("line"), error.alias("error")).where("error is not null")


def log_tail(spark: SparkSession, path: str, lines: int = 200) -> DataFrame:
    """``nth, line``: the last lines of a log that aren't blank, oldest first."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"\S")).withColumn("_at", F.monotonically_increasing_id())
    last = rows.orderBy(F.desc("_at")).limit(lines)
    return last.select((F.row_number().over(Window.orderBy("_at")) - 1).alias("nth"), F.col("value").alias("line"))  # ``lines`` rows
