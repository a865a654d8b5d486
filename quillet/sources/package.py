"""Open-packaging containers: parts, content types and relationships of a zip, under caps."""

from __future__ import annotations

import io
import posixpath
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

CONTENT_TYPES = "[Content_Types].xml"
NS_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
NS_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

#: Bytes that a part may have once decompressed.
MAX_PART_BYTES = 512 << 20


class LimitError(ValueError):
    """Something is larger than its cap."""


def local(tag: str) -> str:
    """A tag without its namespace."""
    return tag.rpartition("}")[2]


def read_capped(stream, limit: int | None, what: str) -> bytes:
    """All of a stream, or an error once it has more than `limit` bytes, whatever it declared."""
    if limit is None:
        return stream.read()
    data = stream.read(limit + 1)
    if len(data) > limit:
        raise LimitError(f"{what} has more than {limit} bytes")
    return data


@dataclass(frozen=True)
class Relationship:
    id: str
    kind: str
    target: str
    external: bool = False


def rels_name(source: str) -> str:
    """The entry that holds a part's relationships; '' is the package."""
    folder, name = posixpath.split(source)
    return posixpath.join(folder, "_rels", name + ".rels")


def resolve(source: str, target: str) -> str:
    """A relationship's target as an entry name."""
    if target.startswith("/"):
        return posixpath.normpath(target).lstrip("/")
    return posixpath.normpath(posixpath.join(posixpath.dirname(source), target)).lstrip("/")


class Package:
    """Reads a package."""

    def __init__(self, data: bytes, max_part_bytes: int | None = MAX_PART_BYTES):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.limit = max_part_bytes
        self.names = set(self.zip.namelist())
        defaults, self.overrides = {}, {}
        if CONTENT_TYPES in self.names:
            for e in ElementTree.fromstring(self.read(CONTENT_TYPES)):
                if local(e.tag) == "Default":
                    defaults[e.get("Extension", "").lower()] = e.get("ContentType", "")
                elif local(e.tag) == "Override":
                    self.overrides[e.get("PartName", "").lstrip("/")] = e.get("ContentType", "")
        self.defaults = defaults

    def read(self, name: str) -> bytes:
        with self.zip.open(name) as f:
            return read_capped(f, self.limit, name)

    def content_type(self, name: str) -> str | None:
        return self.overrides.get(name) or self.defaults.get(name.rpartition(".")[2].lower())

    def parts(self) -> list[tuple[str, str]]:
        """(name, content type) of the entries that are parts."""
        out = [(n, self.content_type(n)) for n in self.zip.namelist() if n != CONTENT_TYPES and not n.endswith((".rels", "/"))]
        return [(n, t) for n, t in out if t]

    def rels(self, source: str = "") -> list[Relationship]:
        name = rels_name(source)
        if name not in self.names:
            return []
        return [Relationship(e.get("Id", ""), e.get("Type", ""), e.get("Target", ""), e.get("TargetMode") == "External") for e in ElementTree.fromstring(self.read(name))]

    def related(self, source: str, kind: str) -> list[str]:
        """Entry names of the parts that a part is related to by a kind, given by the type's last word."""
        return [resolve(source, r.target) for r in self.rels(source) if not r.external and r.kind.rpartition("/")[2] == kind]

    def main(self) -> str:
        found = self.related("", "officeDocument")
        if not found or found[0] not in self.names:
            raise ValueError("the package has no main document")
        return found[0]


class PackageWriter:
    """Writes a package; relationships and content types go in at the end."""

    def __init__(self, target):
        self.zip = zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=6)
        self.types: dict[str, str] = {}
        self.relations: dict[str, list[Relationship]] = {}

    def add(self, name: str, content_type: str, data: bytes | str) -> None:
        if name in self.types:
            raise ValueError(f"part {name} is there already")
        self.types[name] = content_type
        self.zip.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data.encode() if isinstance(data, str) else data, zipfile.ZIP_DEFLATED)

    def open(self, name: str, content_type: str):
        """A stream for a part that is written piece by piece; close it before the next part."""
        if name in self.types:
            raise ValueError(f"part {name} is there already")
        self.types[name] = content_type
        info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        info.compress_type = zipfile.ZIP_DEFLATED
        return self.zip.open(info, "w", force_zip64=True)

    def relate(self, source: str, kind: str, target: str, *, external: bool = False, id: str | None = None) -> str:
        rels = self.relations.setdefault(source, [])
        id = id or f"rId{len(rels) + 1}"
        if any(r.id == id for r in rels):
            raise ValueError(f"relationship {id} of {source or 'the package'} is there already")
        rels.append(Relationship(id, kind if "/" in kind else f"{OFFICE}/{kind}", target, external))
        return id

    def close(self) -> None:
        for source, rels in self.relations.items():
            body = "".join(f"<Relationship Id={quoteattr(r.id)} Type={quoteattr(r.kind)} Target={quoteattr(r.target)}" + (' TargetMode="External"' if r.external else "") + "/>" for r in rels)
            self.zip.writestr(rels_name(source), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="{NS_RELS}">{body}</Relationships>')
        defaults = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml"}
        body = "".join(f'<Default Extension="{k}" ContentType="{v}"/>' for k, v in defaults.items())
        body += "".join(f"<Override PartName={quoteattr('/' + n)} ContentType={quoteattr(t)}/>" for n, t in self.types.items())
        self.zip.writestr(CONTENT_TYPES, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="{NS_TYPES}">{body}</Types>')
        self.zip.close()


__all__ = ["LimitError", "MAX_PART_BYTES", "OFFICE", "Package", "PackageWriter", "Relationship", "escape", "local", "quoteattr", "read_capped", "resolve"]
