"""Text of documents that are zipped XML: word-processor texts, sheets and slides, read in bounded steps."""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.lineage import stored
from basalt.sources.collections import Store

KINDS = ("docx", "xlsx", "pptx")
#: Bytes of a file, bytes that its parts may have when expanded, and how many times as large as the file they may be (small ones aside).
MOST_BYTES, MOST_EXPANDED, MOST_RATIO, SMALL = 64 << 20, 256 << 20, 200, 1 << 20
#: Letters, white space aside, below which a text is scant.
SCANT = 50
#: Letters of text that a task gathers before it hands them on.
PART = 1 << 20


class Refused(Exception):
    """Why a file has no text here; the message is the status."""


class _Parts:
    """The parts of a container, read in pieces; what was expanded is counted over all of them."""

    def __init__(self, content: bytes, most: int) -> None:
        self.zip, self.left = zipfile.ZipFile(io.BytesIO(content)), min(most, max(SMALL, MOST_RATIO * len(content)))
        self.names = {i.filename.lstrip("/"): i for i in self.zip.infolist()}

    def parse(self, name: str, start: Callable | None = None, text: Callable | None = None, end: Callable | None = None) -> None:
        """Hands the elements of a part to the handlers, by their names without a prefix; attributes have theirs."""
        if self.names[name].flag_bits & 1:
            raise Refused("encrypted")
        bare = lambda tag: tag.rsplit(":", 1)[-1]
        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler = (lambda tag, given: start(bare(tag), given)) if start else None
        parser.EndElementHandler = (lambda tag: end(bare(tag))) if end else None
        parser.CharacterDataHandler = text

        def no_doctype(*_: object) -> None:
            raise Refused("damaged")  # such files declare no entities

        parser.StartDoctypeDeclHandler = no_doctype
        with self.zip.open(self.names[name]) as part:
            while piece := part.read(1 << 16):
                self.left -= len(piece)
                if self.left < 0:
                    raise Refused("too large")
                parser.Parse(piece)
        parser.Parse(b"", True)

    def targets(self, of: str) -> dict[str, str]:
        """The relations of a part: by their ids, the names of other parts."""
        folder, base = posixpath.split(of)
        name, found = f"{folder}/_rels/{base}.rels", {}

        def start(tag: str, given: dict) -> None:
            if tag == "Relationship" and given.get("TargetMode") != "External":
                target = given.get("Target", "")
                found[given.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))

        if name in self.names:
            self.parse(name, start)
        return found

    def named(self, pattern: str) -> list[str]:
        """Parts by a pattern with one number, in the order of that."""
        found = [(int(m[1]), n) for n in self.names if (m := re.fullmatch(pattern, n))]
        return [n for _, n in sorted(found)]


def _paragraphs(parts: _Parts, name: str) -> str:
    """The text of one part: a line for each paragraph, in it tabs and breaks as they are."""
    out: list[str] = []
    inside = [False]

    def start(tag: str, _: dict) -> None:
        if tag == "t":
            inside[0] = True
        elif tag == "tab":
            out.append("\t")
        elif tag in ("br", "cr"):
            out.append("\n")

    def end(tag: str) -> None:
        if tag == "t":
            inside[0] = False
        elif tag == "p":
            out.append("\n")
        elif tag in ("tabs", "pPr"):  # tab stops are settings, not text
            while out and out[-1] == "\t":
                out.pop()

    parts.parse(name, start, lambda t: out.append(t) if inside[0] else None, end)
    return "".join(out).removesuffix("\n")


def _relation(given: dict) -> str:
    """The id of the relation that an element names, beside ids of its own."""
    return next((v for k, v in given.items() if k.endswith(":id")), "")


def _docx(parts: _Parts) -> str:
    return _paragraphs(parts, "word/document.xml")


def _pptx(parts: _Parts) -> str:
    """Slides in the order of the presentation, an empty line between them."""
    targets, order = parts.targets("ppt/presentation.xml"), []
    parts.parse("ppt/presentation.xml", lambda tag, given: order.append(targets.get(_relation(given))) if tag == "sldId" else None)
    slides = [n for n in order if n in parts.names] or parts.named(r"ppt/slides/slide(\d+)\.xml")
    return "\n\n".join(_paragraphs(parts, n) for n in slides)


def _xlsx(parts: _Parts) -> str:
    """Sheets in the order of the book, each under its name; rows as lines, cells parted by tabs where they stand."""
    shared: list[str] = []
    state: dict = {"on": False}

    def s_start(tag: str, _: dict) -> None:
        if tag == "si":
            shared.append("")
        state["on"] = tag == "t" or state["on"] and tag != "rPh"

    def s_end(tag: str) -> None:
        state["on"] = state["on"] and tag != "t"

    if "xl/sharedStrings.xml" in parts.names:
        pieces: list[str] = []

        def s_close(tag: str) -> None:
            s_end(tag)
            if tag == "si":
                shared[-1] = "".join(pieces)
                pieces.clear()

        parts.parse("xl/sharedStrings.xml", s_start, lambda t: pieces.append(t) if state["on"] else None, s_close)

    targets, sheets = parts.targets("xl/workbook.xml"), []
    parts.parse("xl/workbook.xml", lambda tag, given: sheets.append((given.get("name", ""), targets.get(_relation(given)))) if tag == "sheet" else None)
    return "\n\n".join(f"## {name}\n{_rows(parts, part, shared)}" for name, part in sheets if part in parts.names)


def _rows(parts: _Parts, name: str, shared: list[str]) -> str:
    lines: list[str] = []
    row: dict[int, str] = {}
    cell: dict = {"at": 0, "kind": "", "on": False, "text": []}

    def start(tag: str, given: dict) -> None:
        if tag == "row":
            row.clear()
        elif tag == "c":
            letters = re.match("[A-Z]*", given.get("r", ""))[0]
            at = 0
            for c in letters:
                at = at * 26 + ord(c) - 64
            cell.update(at=min(at, 16384) or max(row, default=0) + 1, kind=given.get("t", ""), text=[])
        elif tag in ("v", "t"):
            cell["on"] = True

    def end(tag: str) -> None:
        if tag in ("v", "t"):
            cell["on"] = False
        elif tag == "c":
            text = "".join(cell["text"])
            if cell["kind"] == "s":
                text = shared[int(text)] if text.isdigit() and int(text) < len(shared) else ""
            row[cell["at"]] = text
        elif tag == "row":
            lines.append("\t".join(row.get(i, "") for i in range(1, max(row, default=0) + 1)))

    parts.parse(name, start, lambda t: cell["text"].append(t) if cell["on"] else None, end)
    return "\n".join(lines)


READERS = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}


def text_of(kind: str, content: bytes, most: int = MOST_EXPANDED) -> tuple[str | None, str]:
    """Text and status of one file: ok, scant, too large, encrypted, damaged, or unknown kind."""
    if kind not in READERS:
        return None, "unknown kind"
    try:
        text = READERS[kind](_Parts(content, most))
    except Refused as why:
        return None, str(why)
    except (zipfile.BadZipFile, zlib.error, expat.ExpatError, KeyError, EOFError, ValueError, NotImplementedError, RuntimeError, OSError):
        return None, "damaged"
    return text, "ok" if len("".join(text.split())) >= SCANT else "scant"


def extracted(files: DataFrame, most_bytes: int = MOST_BYTES, most_expanded: int = MOST_EXPANDED) -> DataFrame:
    """path, kind, text and status of files (path, length, content), one row for each; without a column content (as of ``listed``) each file is opened by its path.

    A file of more than ``most_bytes``, or whose parts expand to more than ``most_expanded`` or to many
    times its size, is ``too large``; its content is not read, or not to its end. Other statuses: ``ok``, ``scant`` (fewer
    than 50 letters), ``encrypted``, ``damaged`` (null contents too) and ``unknown kind``; only the first two have a text.
    """
    kind = F.coalesce(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.lit(""))
    given = "content" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = None
        for batch in batches:
            own: list[tuple] = []
            size = 0
            for at in range(batch.num_rows):  # one file at a time is expanded
                path, name = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if given:
                    content = batch.column(2)[at].as_py()
                else:
                    fs = fs or Store(path).fs
                    with fs.open_input_file(_below(path)) as source:
                        content = source.read()
                text, status = (None, "damaged") if content is None else text_of(name, content, most_expanded)
                own.append((path, name, text, status))
                size += len(text or "")
                if size > PART or at + 1 == batch.num_rows:
                    yield pa.record_batch([pa.array(column, pa.string()) for column in zip(*own)], names=["path", "kind", "text", "status"])
                    own, size = [], 0

    known, small = F.col("kind").isin(*KINDS), F.coalesce("length", F.lit(0)) <= most_bytes
    rows = files.withColumn("kind", kind)
    wanted = rows.filter(known & small).select("path", "kind", *(["content"] if given else []))
    read = wanted.mapInArrow(run, "path string, kind string, text string, status string")
    status = F.when(~known, "unknown kind").otherwise("too large")
    return read.unionByName(rows.filter(~known | ~small).select("path", "kind", F.lit(None).cast("string").alias("text"), status.alias("status")))


def read(spark: SparkSession, root: str) -> DataFrame:
    """path, length and content of the files below a folder; the content is read only of the rows that are asked for it. For few files: Spark lists them in the driver, and plans tasks as if each had 4 MB."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")


def _below(path: str) -> str:
    """A path as its own file system has it."""
    return path if path.startswith("/") else Store(path).root


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path and length of the files below a folder, for any number of them: tasks list the folders, level by level, and the driver sees none.

    One folder is listed by one task. Names that begin with a dot or an underscore are hidden, as from Spark's readers. The
    rows are stored, and dealt to as many parts as the session's shuffles have, of about as many files each. A folder that is not there holds none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store = Store(folder)
                start = folder.removesuffix(store.root)
                found = [x for x in store.fs.get_file_info(pfs.FileSelector(store.root, allow_not_found=True)) if x.base_name[:1] not in (".", "_")]
                for at in range(0, len(found), 4096):
                    part = found[at : at + 4096]
                    yield pa.record_batch([pa.array([start + x.path for x in part], pa.string()), pa.array([x.size for x in part], pa.int64()), pa.array([x.type == pfs.FileType.Directory for x in part])], names=["path", "length", "folder"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    levels, folders = [], spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    while True:
        level = stored(folders.repartition(parts, "path").mapInArrow(run, "path string, length long, folder boolean"))
        levels.append(level.filter("not folder").select("path", "length"))
        folders = level.filter("folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels).repartition(parts, "path")


# Writing, for exports and tests: the least that a container of each kind has to hold.

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Signs that XML 1.0 has no way to write.
UNWRITABLE = "[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _written(text: str) -> str:
    return escape(re.sub(UNWRITABLE, "", text), {"\r": "&#13;", "\n": "&#10;", "\t": "&#9;"})


def _relations(*targets: str) -> str:
    return f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{RELATION}/part" Target="{t}"/>' for i, t in enumerate(targets, 1)) + "</Relationships>"


def packed(kind: str, text: str) -> bytes:
    """A file that holds the lines of a text: as paragraphs, as rows of cells parted by tabs, or as paragraphs of one slide."""
    rows = text.split("\n")
    if kind == "docx":
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_written(x)}</w:t></w:r></w:p>' for x in rows)
        parts = {"word/document.xml": f'{HEAD}<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'}
    elif kind == "pptx":
        body = "".join(f"<a:p><a:r><a:t>{_written(x)}</a:t></a:r></a:p>" for x in rows)
        parts = {
            "ppt/presentation.xml": f'{HEAD}<p:presentation xmlns:p="p" xmlns:r="{RELATION}"><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": _relations("slides/slide1.xml"),
            "ppt/slides/slide1.xml": f'{HEAD}<p:sld xmlns:p="p" xmlns:a="a"><p:txBody>{body}</p:txBody></p:sld>',
        }
    else:
        cell = lambda x: f'<c t="inlineStr"><is><t xml:space="preserve">{_written(x)}</t></is></c>'
        body = "".join(f"<row>{''.join(map(cell, x.split(chr(9))))}</row>" for x in rows)
        parts = {
            "xl/workbook.xml": f'{HEAD}<workbook xmlns:r="{RELATION}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _relations("worksheets/sheet1.xml"),
            "xl/worksheets/sheet1.xml": f"{HEAD}<worksheet><sheetData>{body}</sheetData></worksheet>",
        }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def write(texts: DataFrame, root: str) -> int:
    """Writes texts (path, whose suffix is the kind, and text) as files below a folder, and how many; a path that is written twice holds one of them whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        folder = None
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = store.at(path)
                if posixpath.dirname(target) != folder:
                    folder = posixpath.dirname(target)
                    store.fs.create_dir(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"  # hidden until it is whole
                with store.fs.open_output_stream(part) as out:
                    out.write(packed(path.rsplit(".", 1)[-1].lower(), text or ""))
                store.fs.move(part, target)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return texts.select("path", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
