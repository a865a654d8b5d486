"""Documents written from blocks, and templates filled with values and pictures."""

from __future__ import annotations

import io
import os
import posixpath
import re
import zipfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import CONTENT_TYPES, password_hash
from .images import emu, inspect, size_in_points
from .package import OFFICE, PackageWriter, escape, local, quoteattr

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_NS = f'xmlns:w="{W}" xmlns:r="{OFFICE}" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml."
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


@dataclass(frozen=True)
class Picture:
    """An image with its size in points; without one, the file's own size at its resolution."""

    data: bytes
    width: float | None = None
    height: float | None = None
    alt: str | None = None
    floating: tuple[float, float] | None = None

    def size(self) -> tuple[float, float]:
        w, h = size_in_points(self.data)
        if self.width and self.height:
            return self.width, self.height
        if self.width:
            return self.width, h * self.width / w if w else self.width
        if self.height:
            return w * self.height / h if h else self.height, self.height
        return w or 72.0, h or 72.0


@dataclass(frozen=True)
class Run:
    text: str = ""
    bold: bool = False
    italic: bool = False
    underline: bool = False
    size: float | None = None
    font: str | None = None
    color: str | None = None
    url: str | None = None
    field: str | None = None
    picture: Picture | None = None


@dataclass
class Paragraph:
    runs: list[Run] = field(default_factory=list)
    style: str = "Normal"
    list: str | None = None
    align: str | None = None
    page_break: bool = False

    def text(self, text: str, **format) -> Paragraph:
        self.runs.append(Run(text, **format))
        return self

    def hyperlink(self, text: str, url: str, **format) -> Paragraph:
        return self.text(text, url=url, **format)

    def page_number(self) -> Paragraph:
        self.runs.append(Run(field="PAGE"))
        return self

    def image(self, picture: Picture) -> Paragraph:
        self.runs.append(Run(picture=picture))
        return self


@dataclass
class Table:
    columns: int
    rows: list[Sequence] = field(default_factory=list)
    header: bool = False
    borders: bool = True

    def header_row(self, *cells: str) -> Table:
        self.header = True
        self.rows.insert(0, cells)
        return self

    def add_row(self, *cells) -> Table:
        """Cells are texts, paragraphs or (cell, span); missing ones are empty."""
        self.rows.append(cells)
        return self


@dataclass
class PageSetup:
    width: float = 595.3
    height: float = 841.9
    left: float = 72
    top: float = 72
    right: float = 72
    bottom: float = 72
    landscape: bool = False


class Document:
    """A document built block by block."""

    def __init__(self):
        self.blocks: list[Paragraph | Table] = []
        self.setup = PageSetup()
        self.headers: dict[str, list[Paragraph]] = {}
        self.footers: dict[str, list[Paragraph]] = {}
        self.protection: tuple[str | None, str] | None = None

    def add_paragraph(self, text: str = "", style: str = "Normal", **format) -> Paragraph:
        p = Paragraph(style=style)
        if text:
            p.text(text, **format)
        self.blocks.append(p)
        return p

    def add_heading(self, text: str, level: int = 1) -> Paragraph:
        if level not in (1, 2, 3):
            raise ValueError("a heading's level is 1, 2 or 3")
        return self.add_paragraph(text, f"Heading{level}")

    def add_bullet(self, text: str) -> Paragraph:
        p = self.add_paragraph(text, "ListParagraph")
        p.list = "bullet"
        return p

    def add_numbered(self, text: str) -> Paragraph:
        p = self.add_paragraph(text, "ListParagraph")
        p.list = "number"
        return p

    def add_table(self, columns: int) -> Table:
        t = Table(columns)
        self.blocks.append(t)
        return t

    def add_page_break(self) -> None:
        self.blocks.append(Paragraph(page_break=True))

    def add_image(self, picture: Picture) -> Paragraph:
        return self.add_paragraph().image(picture)

    def header(self, text: str, kind: str = "default") -> Paragraph:
        return self._margin(self.headers, text, kind)

    def footer(self, text: str, kind: str = "default") -> Paragraph:
        return self._margin(self.footers, text, kind)

    def _margin(self, where: dict, text: str, kind: str) -> Paragraph:
        if kind not in ("default", "first"):
            raise ValueError("a header is the default or the first page's")
        p = Paragraph([Run(text)] if text else [])
        where.setdefault(kind, []).append(p)
        return p

    def protect(self, password: str | None = None, mode: str = "readOnly") -> None:
        self.protection = password, mode

    def text(self) -> str:
        """The body's text, without headers and footers, one paragraph or cell a line."""
        out = []
        for b in self.blocks:
            if isinstance(b, Paragraph):
                out.append("".join(r.text for r in b.runs))
            else:
                out += [_plain(c) for row in b.rows for c in _cells(row, b.columns)]
        return "\n".join(out)

    def to_bytes(self, password: str | None = None) -> bytes:
        data = _Serializer(self).run()
        if password:
            from .encryption import encrypt

            data = encrypt(data, password)
        return data

    def save(self, path: str, password: str | None = None) -> None:
        data = self.to_bytes(password)
        with open(path + ".tmp", "wb") as f:
            f.write(data)
        os.replace(path + ".tmp", path)

    @classmethod
    def load(cls, data: bytes, password: str | None = None) -> Document:
        """The editable model of a document: text, formats, lists and tables of its body."""
        from .docx import DocumentReader

        doc, reader = cls(), DocumentReader(data, password=password, headers_and_footers=False)
        pictures = [x for x in reader.images() if x["table"] is None]
        for b in reader.blocks():
            if b["kind"] == "table":
                doc.blocks.append(Table(max((len(r) for r in b["rows"]), default=0), [tuple(r) for r in b["rows"]]))
            else:
                p = Paragraph([Run(**r) for r in b["runs"]], b["style"], b["list"])
                for x in pictures[: b["pictures"]]:
                    p.image(Picture(x["content"], x["width_pt"] or None, x["height_pt"] or None, x["alt"]))
                del pictures[: b["pictures"]]
                doc.blocks.append(p)
        return doc


def _plain(cell) -> str:
    cell = cell[0] if isinstance(cell, tuple) else cell
    return "".join(r.text for r in cell.runs) if isinstance(cell, Paragraph) else str(cell)


def _cells(row: Sequence, columns: int) -> list:
    """A row's cells, with empty ones up to the table's width."""
    used = sum(c[1] if isinstance(c, tuple) else 1 for c in row)
    return [*row, *[""] * max(0, columns - used)]


class _Serializer:
    def __init__(self, doc: Document):
        self.doc, self.buffer = doc, io.BytesIO()
        self.package = PackageWriter(self.buffer)
        self.media: dict[bytes, str] = {}
        self.ids = 0

    def run(self) -> bytes:
        d, main = self.doc, "word/document.xml"
        body = "".join(self.block(b, main) for b in d.blocks)
        refs, title = "", ""
        for kind, parts, tag in (("header", d.headers, "hdr"), ("footer", d.footers, "ftr")):
            for which, ps in parts.items():
                name = f"{kind}{which.capitalize()}.xml"
                part = f"word/{name}"
                self.package.add(part, f"{_TYPE}{kind}+xml", f"{_XML}<w:{tag} {_NS}>" + "".join(self.paragraph(p, part) for p in ps) + f"</w:{tag}>")
                refs += f'<w:{kind}Reference w:type="{which}" r:id="{self.package.relate(main, kind, name)}"/>'
                title = "<w:titlePg/>" if which == "first" or title else ""
        s, tw = d.setup, lambda x: round(x * 20)
        w, h = (s.height, s.width) if s.landscape else (s.width, s.height)
        section = f'<w:sectPr>{refs}<w:pgSz w:w="{tw(w)}" w:h="{tw(h)}"' + (' w:orient="landscape"' if s.landscape else "") + f'/><w:pgMar w:top="{tw(s.top)}" w:right="{tw(s.right)}" w:bottom="{tw(s.bottom)}" w:left="{tw(s.left)}" w:header="720" w:footer="720" w:gutter="0"/>{title}</w:sectPr>'
        self.package.add(main, _TYPE + "document.main+xml", f"{_XML}<w:document {_NS}><w:body>{body}{section}</w:body></w:document>")
        self.package.relate("", "officeDocument", main)
        heading = lambda n, size: f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:basedOn w:val="Normal"/><w:pPr><w:outlineLvl w:val="{n - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{size}"/></w:rPr></w:style>'
        simple = lambda i, n, x: f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/><w:basedOn w:val="Normal"/>{x}</w:style>'
        styles = '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>' + heading(1, 32) + heading(2, 28) + heading(3, 24) + simple("Title", "Title", '<w:rPr><w:sz w:val="56"/></w:rPr>') + simple("Quote", "Quote", "<w:rPr><w:i/></w:rPr>") + simple("ListParagraph", "List Paragraph", '<w:pPr><w:ind w:left="720"/></w:pPr>')
        self.package.add("word/styles.xml", _TYPE + "styles+xml", f"{_XML}<w:styles {_NS}>{styles}</w:styles>")
        self.package.relate(main, "styles", "styles.xml")
        level = lambda i, fmt, text: f'<w:abstractNum w:abstractNumId="{i}"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text}"/></w:lvl></w:abstractNum>'
        self.package.add("word/numbering.xml", _TYPE + "numbering+xml", f'{_XML}<w:numbering {_NS}>{level(0, "bullet", "•")}{level(1, "decimal", "%1.")}<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>')
        self.package.relate(main, "numbering", "numbering.xml")
        if d.protection is not None:
            password, mode = d.protection
            h = password_hash(password) if password else {}
            names = {"algorithmName": "cryptAlgorithmSid", "hashValue": "hash", "saltValue": "salt", "spinCount": "cryptSpinCount"}
            extra = "".join(f' w:{names[k]}="{14 if k == "algorithmName" else v}"' for k, v in h.items())
            if h:
                extra = ' w:cryptProviderType="rsaAES" w:cryptAlgorithmClass="hash" w:cryptAlgorithmType="typeAny"' + extra
            self.package.add("word/settings.xml", _TYPE + "settings+xml", f'{_XML}<w:settings {_NS}><w:documentProtection w:edit={quoteattr(mode)} w:enforcement="1"{extra}/></w:settings>')
            self.package.relate(main, "settings", "settings.xml")
        self.package.close()
        return self.buffer.getvalue()

    def block(self, b, part: str) -> str:
        return self.paragraph(b, part) if isinstance(b, Paragraph) else self.table(b, part)

    def table(self, t: Table, part: str) -> str:
        edge = "".join(f'<w:{s} w:val="single" w:sz="4" w:space="0" w:color="auto"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
        out = f"<w:tbl><w:tblPr><w:tblW w:w=\"0\" w:type=\"auto\"/>{f'<w:tblBorders>{edge}</w:tblBorders>' if t.borders else ''}</w:tblPr><w:tblGrid>" + "<w:gridCol/>" * t.columns + "</w:tblGrid>"
        for i, row in enumerate(t.rows):
            out += "<w:tr>" + ("<w:trPr><w:tblHeader/></w:trPr>" if t.header and i == 0 else "")
            for cell in _cells(row, t.columns):
                cell, span = cell if isinstance(cell, tuple) else (cell, 1)
                p = cell if isinstance(cell, Paragraph) else Paragraph([Run(str(cell), bold=t.header and i == 0)] if cell != "" else [])
                out += "<w:tc><w:tcPr>" + (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + f"</w:tcPr>{self.paragraph(p, part)}</w:tc>"
            out += "</w:tr>"
        return out + "</w:tbl>"

    def paragraph(self, p: Paragraph, part: str) -> str:
        if p.page_break:
            return '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
        pr = (f"<w:pStyle w:val={quoteattr(p.style)}/>" if p.style != "Normal" else "") + (f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{2 if p.list == "number" else 1}"/></w:numPr>' if p.list else "") + (f"<w:jc w:val={quoteattr(p.align)}/>" if p.align else "")
        return "<w:p>" + (f"<w:pPr>{pr}</w:pPr>" if pr else "") + "".join(self.inline(r, part) for r in p.runs) + "</w:p>"

    def inline(self, r: Run, part: str) -> str:
        pr = (f'<w:rFonts w:ascii={quoteattr(r.font)} w:hAnsi={quoteattr(r.font)}/>' if r.font else "") + "<w:b/>" * r.bold + "<w:i/>" * r.italic + (f'<w:color w:val="{r.color.lstrip("#")}"/>' if r.color else "") + (f'<w:sz w:val="{round(r.size * 2)}"/>' if r.size else "") + '<w:u w:val="single"/>' * r.underline
        pr = f"<w:rPr>{pr}</w:rPr>" if pr else ""
        if r.picture:
            return f"<w:r>{self.picture(r.picture, part)}</w:r>"
        if r.field:
            return f'<w:fldSimple w:instr=" {escape(r.field)} "><w:r>{pr}<w:t>{escape(r.text or "1")}</w:t></w:r></w:fldSimple>'
        run = f"<w:r>{pr}{text_xml(r.text)}</w:r>"
        return f'<w:hyperlink r:id="{self.package.relate(part, "hyperlink", r.url, external=True)}">{run}</w:hyperlink>' if r.url else run

    def picture(self, p: Picture, part: str) -> str:
        kind = inspect(p.data)[0] or "image/png"
        if p.data not in self.media:
            ext = next(e for e, t in CONTENT_TYPES.items() if t == kind)
            name = f"media/image{len(self.media) + 1}.{ext}"
            self.package.add(f"word/{name}", kind, p.data)
            self.media[p.data] = name
        self.ids += 1
        return drawing(self.package.relate(part, "image", self.media[p.data]), self.ids, p)


def text_xml(text: str) -> str:
    """Text as runs' content: line ends and tabs as elements."""
    out = []
    for i, line in enumerate(_BAD.sub("", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")):
        if i:
            out.append("<w:br/>")
        for j, piece in enumerate(line.split("\t")):
            if j:
                out.append("<w:tab/>")
            if piece:
                out.append(f'<w:t xml:space="preserve">{escape(piece)}</w:t>')
    return "".join(out)


def drawing(rel: str, number: int, p: Picture) -> str:
    w, h = p.size()
    cx, cy = emu(w), emu(h)
    alt = f" descr={quoteattr(p.alt)}" if p.alt else ""
    graphic = f'<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic><pic:nvPicPr><pic:cNvPr id="{number}" name="Picture {number}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{rel}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic>'
    tail = f'<wp:extent cx="{cx}" cy="{cy}"/>\0<wp:docPr id="{number}" name="Picture {number}"{alt}/>{graphic}'
    if p.floating is None:
        return f'<w:drawing><wp:inline distT="0" distB="0" distL="0" distR="0">{tail.replace(chr(0), "")}</wp:inline></w:drawing>'
    x, y = (emu(v) for v in p.floating)
    return f'<w:drawing><wp:anchor distT="0" distB="0" distL="0" distR="0" simplePos="0" relativeHeight="{number}" behindDoc="0" locked="0" layoutInCell="1" allowOverlap="1"><wp:simplePos x="0" y="0"/><wp:positionH relativeFrom="page"><wp:posOffset>{x}</wp:posOffset></wp:positionH><wp:positionV relativeFrom="page"><wp:posOffset>{y}</wp:posOffset></wp:positionV>{tail.replace(chr(0), '<wp:wrapSquare wrapText="bothSides"/>')}</wp:anchor></w:drawing>'


def replace_all(text: str, values: Mapping[str, str]) -> str:
    """Each {{Key}} in the mapping's order, so a value's own keys that come later are filled too."""
    for k, v in values.items():
        text = text.replace("{{" + k + "}}", v if v is not None else "")
    return text


_SCOPE = re.compile(r"word/(document|footnotes|endnotes|header[^/]*|footer[^/]*)\.xml$")


def fill_template(template: bytes, values: Mapping[str, str], pictures: Mapping[str, Picture] | None = None, *, password: str | None = None, new_password: str | None = None) -> bytes:
    """A template with its placeholders replaced, also where one is spread over several runs.

    {{Key}} of a picture becomes the picture; a picture in the template whose alternative text is {{Key}} (or Key)
    gets the new image in its own place and size.
    """
    from .encryption import decrypt, encrypt, is_encrypted

    data = decrypt(template, password) if is_encrypted(template) else template
    pictures, out = pictures or {}, io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = {n: z.read(n) for n in z.namelist()}
    numbers = [int(m[1]) for n in entries if (m := re.search(r"media/\D*(\d+)\.\w+$", n))]
    next_media = max(numbers, default=0) + 1
    extensions: set[str] = set()
    for name in [n for n in entries if _SCOPE.match(n)]:
        for prefix, uri in re.findall(rb'xmlns:(\w+)="([^"]+)"', entries[name]):
            if not re.fullmatch(rb"ns\d+", prefix):
                ElementTree.register_namespace(prefix.decode(), uri.decode())
        root = ElementTree.fromstring(entries[name])
        rels_name = posixpath.join("word/_rels", posixpath.basename(name) + ".rels")
        rels = entries.get(rels_name, b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"></Relationships>').decode()
        added: list[str] = []

        def relate(p: Picture) -> str:
            nonlocal next_media
            kind = inspect(p.data)[0] or "image/png"
            ext = next(e for e, t in CONTENT_TYPES.items() if t == kind)
            media = f"media/image{next_media}.{ext}"
            next_media += 1
            entries[f"word/{media}"] = p.data
            extensions.add(ext)
            n = 1
            while f'"rIdPic{n}"' in rels or any(f'"rIdPic{n}"' in a for a in added):
                n += 1
            added.append(f'<Relationship Id="rIdPic{n}" Type="{OFFICE}/image" Target="{media}"/>')
            return f"rIdPic{n}"

        for d in [x for x in root.iter() if local(x.tag) in ("inline", "anchor")]:
            alt = next((x.get("descr") or "" for x in d if local(x.tag) == "docPr"), "").strip()
            key = alt[2:-2] if alt.startswith("{{") and alt.endswith("}}") else alt
            blip = next((x for x in d.iter() if local(x.tag) == "blip"), None)
            if key in pictures and blip is not None:
                blip.set(f"{{{OFFICE}}}embed", relate(pictures[key]))
        for p in [x for x in root.iter() if local(x.tag) == "p"]:
            _fill_paragraph(p, values, pictures, relate)
        entries[name] = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
        if added:
            entries[rels_name] = (rels.replace("</Relationships>", "".join(added) + "</Relationships>") if "</Relationships>" in rels else re.sub(r"<Relationships([^>]*)/>", lambda m: f"<Relationships{m[1]}>" + "".join(added) + "</Relationships>", rels)).encode()
    types = entries["[Content_Types].xml"].decode()
    for ext in sorted(extensions):
        if f'Extension="{ext}"' not in types:
            types = re.sub(r"(<Types[^>]*>)", lambda m: f'{m[1]}<Default Extension="{ext}" ContentType="{CONTENT_TYPES[ext]}"/>', types, count=1)
    entries["[Content_Types].xml"] = types.encode()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, body in entries.items():
            z.writestr(n, body)
    return encrypt(out.getvalue(), new_password) if new_password else out.getvalue()


def _fill_paragraph(p, values: Mapping[str, str], pictures: Mapping[str, Picture], relate) -> None:
    """Fills text by text where placeholders are whole; else over all of the paragraph's texts, which then stand in the first run."""
    own = [(r, t) for r in p.iter() if local(r.tag) == "r" for t in r if local(t.tag) == "t"]
    whole = "".join(t.text or "" for _, t in own)
    if "{{" not in whole:
        return
    if replace_all(whole, values) != "".join(replace_all(t.text or "", values) for _, t in own) or any("{{" + k + "}}" in whole and not any("{{" + k + "}}" in (t.text or "") for _, t in own) for k in pictures):
        own[0][1].text = whole
        for _, t in own[1:]:
            t.text = ""
    parents = {c: e for e in p.iter() for c in e}
    for r, t in own:
        text = replace_all(t.text or "", values)
        keys = [k for k in pictures if "{{" + k + "}}" in text]
        pieces = re.split("(" + "|".join(re.escape("{{" + k + "}}") for k in keys) + ")", text) if keys else [text]
        new = []
        for piece in pieces:
            if piece[2:-2] in keys and piece.startswith("{{"):
                new += list(ElementTree.fromstring(f"<w:r {_NS}>{drawing(relate(pictures[piece[2:-2]]), 1000 + len(new), pictures[piece[2:-2]])}</w:r>"))
            elif piece:
                new += list(ElementTree.fromstring(f"<w:r {_NS}>{text_xml(piece)}</w:r>"))
        parent = parents[t]
        at = list(parent).index(t)
        parent.remove(t)
        for k, e in enumerate(new):
            parent.insert(at + k, e)


def fill_each(params: DataFrame, template: bytes, *, out: str = "document") -> DataFrame:
    """Mail merge: params with a document for each row, whose columns are the placeholders' values."""
    handle = params.sparkSession.sparkContext.broadcast(template)  # one file, of the caller's choosing

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([fill_template(handle.value, {n: "" if v is None else str(v) for n, v in r.items()}) for r in rows.to_pylist()], pa.binary())

    return params.withColumn(out, F.arrow_udf(run, "binary")(F.struct(*[params[n] for n in params.columns])))


def save_images(images: DataFrame, folder: str) -> None:
    """Writes pictures (name, content) to a mounted folder; of equal names all but the first get _1, _2 ..."""
    from ..operators.cells import suffix_collisions

    os.makedirs(folder, exist_ok=True)

    def put(rows) -> None:
        for r in rows:
            with open(os.path.join(folder, os.path.basename(r.file_name)), "wb") as f:
                f.write(r.content)

    suffix_collisions(images, "name", "ord").select("file_name", "content").foreachPartition(put)
