"""Word-processing documents as DataFrames.

``spark.read.format("docx")`` (after :func:`register`) reads ``path`` (file, folder or glob), one partition
for each file.  Option ``mode`` is ``paragraphs`` (default), ``tables``, ``text``, ``images`` or ``blocks``; ``headersAndFooters``
(true) adds those parts; ``password`` and ``maxPartBytes`` as for workbooks.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.codes import ANCHORS, CONTENT_TYPES, EMU_PER_POINT, PARAGRAPH_STYLES
from .images import sniff
from .package import MAX_PART_BYTES, Package, local, resolve

SCHEMAS = {
    "paragraphs": "path string, host string, ord int, style_id string, text string",
    "tables": "path string, host string, ord int, rows array<array<string>>",
    "text": "path string, text string",
    "images": "path string, host string, ord int, name string, content_type string, content binary, width_pt double, height_pt double, alt string, placement string, anchor_h string, anchor_v string, table int, row int, col int, anchor_text string",
    "blocks": "path string, ord int, kind string, style string, list string, runs array<struct<text:string,bold:boolean,italic:boolean,underline:boolean,url:string,field:string>>, rows array<array<string>>",
}


def attribute(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def child(e, name: str):
    return next((x for x in e if local(x.tag) == name), None)


def text_of(e) -> str:
    """The text of a paragraph or run: breaks and tabs as characters."""
    out = []
    for x in e.iter():
        tag = local(x.tag)
        if tag == "t":
            out.append(x.text or "")
        elif tag in ("br", "cr"):
            out.append("\n")
        elif tag == "tab" and not x.attrib:
            out.append("\t")
    return "".join(out)


class DocumentReader:
    """A document's body and its header and footer parts."""

    def __init__(self, data: bytes, *, password: str | None = None, max_part_bytes: int | None = MAX_PART_BYTES, headers_and_footers: bool = True):
        if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            from .encryption import decrypt

            data = decrypt(data, password)
        self.package = Package(data, max_part_bytes)
        main = self.package.main()
        self.parts = [("body", main)]
        if headers_and_footers:
            for host in ("header", "footer"):
                self.parts += [(host, p) for p in sorted(set(self.package.related(main, host))) if p in self.package.names]
        self._roots: dict[str, ElementTree.Element] = {}

    def root(self, part: str):
        if part not in self._roots:
            root = ElementTree.fromstring(self.package.read(part))
            self._roots[part] = child(root, "body") if child(root, "body") is not None else root
        return self._roots[part]

    def _blocks(self, e) -> Iterator:
        """Paragraphs and tables in order, content controls and the like unwrapped."""
        for x in e:
            tag = local(x.tag)
            if tag in ("p", "tbl"):
                yield x
            elif tag in ("sdt", "sdtContent", "customXml", "ins", "smartTag"):
                yield from self._blocks(x)

    def paragraphs(self) -> Iterator[tuple[str, str | None, str]]:
        """(host, style id, text) of each paragraph outside tables."""
        for host, part in self.parts:
            for x in self._blocks(self.root(part)):
                if local(x.tag) == "p":
                    yield host, style_of(x), text_of(x)

    def tables(self) -> Iterator[tuple[str, list[list[str]]]]:
        """(host, rows of cell texts); a table inside a cell is part of that cell's text."""
        for host, part in self.parts:
            for x in self._blocks(self.root(part)):
                if local(x.tag) == "tbl":
                    yield host, self.grid(x)

    def grid(self, table) -> list[list[str]]:
        return [[self.cell_text(c) for c in self._children(r, "tc")] for r in self._children(table, "tr")]

    def _children(self, e, name: str) -> Iterator:
        for x in e:
            if local(x.tag) == name:
                yield x
            elif local(x.tag) in ("sdt", "sdtContent", "customXml", "ins"):
                yield from self._children(x, name)

    def cell_text(self, cell) -> str:
        out = []
        for x in self._blocks(cell):
            if local(x.tag) == "p":
                out.append(text_of(x))
            else:
                out += [t for row in self.grid(x) for t in row]
        return "\n".join(out)

    def text(self) -> str:
        """Paragraphs and cells in the document's order, one a line."""
        out = []
        for _, part in self.parts:
            for x in self._blocks(self.root(part)):
                if local(x.tag) == "p":
                    out.append(text_of(x))
                else:
                    out += [t for row in self.grid(x) for t in row]
        return "\n".join(out)

    def images(self) -> Iterator[dict]:
        """Pictures with their bytes, size, placement and the text they are anchored to; those without media are left out."""
        for host, part in self.parts:
            targets = {r.id: resolve(part, r.target) for r in self.package.rels(part) if not r.external}
            before, table = "", -1
            for block in self._blocks(self.root(part)):
                if local(block.tag) == "p":
                    yield from self._pictures(block, host, targets, before, (None, None, None))
                    before = text_of(block) or before
                else:
                    table += 1
                    for i, r in enumerate(self._children(block, "tr")):
                        for j, c in enumerate(self._children(r, "tc")):
                            for p in c.iter():
                                if local(p.tag) == "p":
                                    yield from self._pictures(p, host, targets, before, (table, i, j))
                                    before = text_of(p) or before

    def _pictures(self, paragraph, host: str, targets: dict[str, str], before: str, place) -> Iterator[dict]:
        said: list[str] = []
        for x in paragraph.iter():
            tag = local(x.tag)
            if tag == "t":
                said.append(x.text or "")
            elif tag in ("inline", "anchor"):
                blip = next((y for y in x.iter() if local(y.tag) == "blip"), None)
                name = targets.get(attribute(blip, "embed") or "") if blip is not None else None
                if name is None or name not in self.package.names:
                    continue
                data = self.package.read(name)
                extent, info = child(x, "extent"), child(x, "docPr")
                side = lambda n: next((attribute(y, "relativeFrom") for y in x if local(y.tag) == n), None)
                yield {
                    "host": host,
                    "name": posixpath.basename(name),
                    "content_type": sniff(data) or CONTENT_TYPES.get(name.rpartition(".")[2].lower(), "application/octet-stream"),
                    "content": data,
                    "width_pt": int(extent.get("cx", 0)) / EMU_PER_POINT if extent is not None else 0.0,
                    "height_pt": int(extent.get("cy", 0)) / EMU_PER_POINT if extent is not None else 0.0,
                    "alt": info.get("descr") if info is not None else None,
                    "placement": "inline" if tag == "inline" else "floating",
                    "anchor_h": ANCHORS.get(side("positionH") or "") if tag == "anchor" else None,
                    "anchor_v": ANCHORS.get(side("positionV") or "") if tag == "anchor" else None,
                    "table": place[0],
                    "row": place[1],
                    "col": place[2],
                    "anchor_text": "".join(said) or before,
                }

    def blocks(self) -> Iterator[dict]:
        """The editable model of the body: paragraphs with runs, and tables with texts."""
        main = self.parts[0][1]
        urls = {r.id: r.target for r in self.package.rels(main) if r.external}
        targets = {r.id: resolve(main, r.target) for r in self.package.rels(main) if not r.external}
        for x in self._blocks(self.root(main)):
            if local(x.tag) == "tbl":
                yield {"kind": "table", "style": None, "list": None, "runs": None, "rows": self.grid(x), "pictures": 0}
                continue
            runs, url = [], None

            def visit(e, url, field):
                for r in e:
                    tag = local(r.tag)
                    if tag == "hyperlink":
                        visit(r, urls.get(attribute(r, "id") or ""), field)
                    elif tag == "fldSimple":
                        visit(r, url, (attribute(r, "instr") or "").strip().split(" ")[0] or None)
                    elif tag in ("ins", "smartTag", "sdt", "sdtContent"):
                        visit(r, url, field)
                    elif tag == "r" and text_of(r):
                        p = child(r, "rPr")
                        on = lambda n: p is not None and child(p, n) is not None and attribute(child(p, n), "val") not in ("0", "false", "none")
                        runs.append({"text": text_of(r), "bold": on("b"), "italic": on("i"), "underline": on("u"), "url": url, "field": field})

            visit(x, url, None)
            p = child(x, "pPr")
            number = child(child(p, "numPr"), "numId") if p is not None and child(p, "numPr") is not None else None
            yield {"kind": "paragraph", "style": PARAGRAPH_STYLES.get(style_of(x) or "", "Normal"), "list": None if number is None else "number" if attribute(number, "val") == "2" else "bullet", "runs": runs, "rows": None, "pictures": sum(1 for _ in self._pictures(x, "body", targets, "", (None, None, None)))}


def style_of(paragraph) -> str | None:
    p = child(paragraph, "pPr")
    s = child(p, "pStyle") if p is not None else None
    return attribute(s, "val") if s is not None else None


def rows_of(path: str, data: bytes, mode: str, options: dict) -> Iterator[tuple]:
    cap = options.get("maxpartbytes")
    doc = DocumentReader(data, password=options.get("password"), max_part_bytes=int(cap) if cap else MAX_PART_BYTES, headers_and_footers=options.get("headersandfooters", "true").lower() == "true")
    if mode == "text":
        yield path, doc.text()
    elif mode == "paragraphs":
        yield from ((path, h, i, s, t) for i, (h, s, t) in enumerate(doc.paragraphs()))
    elif mode == "tables":
        yield from ((path, h, i, g) for i, (h, g) in enumerate(doc.tables()))
    elif mode == "images":
        names = [c.split()[0] for c in SCHEMAS["images"].split(", ")[3:]]
        yield from ((path, x["host"], i, *(x[n] for n in names)) for i, x in enumerate(doc.images()))
    elif mode == "blocks":
        for i, b in enumerate(doc.blocks()):
            runs = None if b["runs"] is None else [tuple(r[k] for k in ("text", "bold", "italic", "underline", "url", "field")) for r in b["runs"]]
            yield path, i, b["kind"], b["style"], b["list"], runs, b["rows"]
    else:
        raise ValueError(f"no mode {mode!r}")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class DocxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self):
        import glob
        import os

        path = self.options["path"].removeprefix("file://")
        if os.path.isdir(path):
            return [_File(os.path.join(d, f)) for d, _, fs in sorted(os.walk(path)) for f in sorted(fs) if f.lower().endswith(".docx") and not f.startswith((".", "~"))]
        return [_File(p) for p in sorted(glob.glob(path)) or [path]]

    def read(self, partition: _File):
        with open(partition.path, "rb") as f:
            yield from rows_of(partition.path, f.read(), self.options.get("mode", "paragraphs"), self.options)


class DocxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        mode = {k.lower(): v for k, v in self.options.items()}.get("mode", "paragraphs")
        if mode not in SCHEMAS:
            raise ValueError(f"no mode {mode!r}")
        return SCHEMAS[mode]

    def reader(self, schema) -> DocxReader:
        return DocxReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxDataSource)


def text_of_files(files: DataFrame, **options) -> DataFrame:
    """(path, text) of binaryFile rows, on any file system that Spark reads."""
    options = {k.lower(): v for k, v in options.items()}

    def run(batches):
        for batch in batches:
            pairs = [next(rows_of(p, c, "text", options)) for p, c in zip(batch["path"].to_pylist(), batch["content"].to_pylist()) if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, SCHEMAS["text"])
