"""Images, units, page geometry and code maps."""

from __future__ import annotations

import base64
import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["ALIGNMENTS", "ANCHORS", "CONTENT_TYPES", "EMU_PER_POINT", "ENUMS", "MARGINS", "PAPERS", "PARAGRAPH_STYLES", "alignments", "content_type", "emu_to_points", "enum_name", "extension_for", "inches_to_points", "margins", "mm_to_points", "papers", "paragraph_style", "password_hash", "pixels_to_points", "points_to_emu", "points_to_twips", "rotated", "scale_to_height", "scale_to_width"]

EMU_PER_POINT = 12_700

CONTENT_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/x-emf", "wmf": "image/x-wmf"}
PARAGRAPH_STYLES = {"Title": "Title", "Heading1": "Heading1", "Heading2": "Heading2", "Heading3": "Heading3", "Quote": "Quote", "ListParagraph": "ListParagraph"}
ANCHORS = {"page": "Page", "margin": "Margin", "column": "Column", "paragraph": "Paragraph", "line": "Line", "character": "Character"}

#: Widths and heights in millimetres.
PAPERS = {"A0": (841, 1189), "A1": (594, 841), "A2": (420, 594), "A3": (297, 420), "A4": (210, 297), "A5": (148, 210), "A6": (105, 148), "B4": (250, 353), "B5": (176, 250), "Letter": (215.9, 279.4), "Legal": (215.9, 355.6), "Tabloid": (279.4, 431.8), "Executive": (184.15, 266.7)}
#: Left, top, right and bottom in inches.
MARGINS = {"None": (0, 0, 0, 0), "Normal": (1, 1, 1, 1), "Narrow": (0.5, 0.5, 0.5, 0.5), "Wide": (2, 1, 2, 1)}

#: Presets of a page's content alignment: horizontal and vertical, 0 at the left and top, 1 in the middle, 2 at the right and bottom.
ALIGNMENTS = {f"{v}{h}": (i, j) for j, v in enumerate(("Top", "Middle", "Bottom")) for i, h in enumerate(("Left", "Center", "Right"))}
#: Codes of print settings, in order from 0.
ENUMS = {"duplex": ("Simplex", "LongEdge", "ShortEdge"), "color": ("Color", "Monochrome"), "orientation": ("Portrait", "Landscape"), "scale": ("Fit", "Actual", "Custom")}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_type(data: str | Column, extension: str | Column | None = None) -> Column:
    """An image's type by its first bytes, else by its extension, else application/octet-stream."""
    head = F.hex(F.substring(_c(data), 1, 44))
    at = lambda *s: F.when(F.coalesce(F.greatest(*(head.startswith(x) for x in s)) if len(s) > 1 else head.startswith(s[0]), F.lit(False)), F.lit(True))
    by_bytes = F.coalesce(
        F.when(at("89504E470D0A1A0A"), "image/png"),
        F.when(at("FFD8FF"), "image/jpeg"),
        F.when(at("47494638"), "image/gif"),
        F.when(at("424D"), "image/bmp"),
        F.when(at("49492A00", "4D4D002A"), "image/tiff"),
        F.when(at("01000000") & (F.substring(head, 81, 8) == "20454D46"), "image/x-emf"),
        F.when(at("D7CDC69A", "01000900"), "image/x-wmf"),
    )
    by_name = F.lit(None).cast("string")
    if extension is not None:
        pairs = [F.lit(x) for kv in CONTENT_TYPES.items() for x in kv]
        by_name = F.try_element_at(F.create_map(*pairs), F.lower(F.ltrim(_c(extension), F.lit("."))))
    return F.coalesce(by_bytes, by_name, F.lit("application/octet-stream"))


def extension_for(kind: str | Column) -> Column:
    """The extension of an image type; bin for others."""
    first: dict[str, str] = {}
    for e, t in CONTENT_TYPES.items():
        first.setdefault(t, e)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), _c(kind)), F.lit("bin"))


def paragraph_style(style_id: str | Column) -> Column:
    """A style id's kind; Normal for others and null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PARAGRAPH_STYLES.items() for x in kv]), F.coalesce(_c(style_id), F.lit(""))), F.lit("Normal"))


def emu_to_points(x: str | Column) -> Column:
    return _c(x) / F.lit(EMU_PER_POINT)


def points_to_emu(x: str | Column) -> Column:
    return F.round(_c(x) * F.lit(EMU_PER_POINT)).cast("long")


def pixels_to_points(x: str | Column, dpi: str | Column) -> Column:
    return _c(x) / _c(dpi) * 72


def points_to_twips(x: str | Column) -> Column:
    return F.round(_c(x) * 20).cast("int")


def mm_to_points(x: str | Column) -> Column:
    return _c(x) / F.lit(25.4) * 72


def inches_to_points(x: str | Column) -> Column:
    return _c(x) * 72


def scale_to_width(width: str | Column, height: str | Column, new_width: str | Column | float) -> Column:
    """(width, height) with the new width and the same proportions."""
    new = F.lit(new_width).cast("double") if isinstance(new_width, (int, float)) else _c(new_width)
    return F.struct(new.alias("width"), (_c(height) * new / _c(width)).alias("height"))


def scale_to_height(width: str | Column, height: str | Column, new_height: str | Column | float) -> Column:
    new = F.lit(new_height).cast("double") if isinstance(new_height, (int, float)) else _c(new_height)
    return F.struct((_c(width) * new / _c(height)).alias("width"), new.alias("height"))


def papers(spark: SparkSession) -> DataFrame:
    """(name, width_pt, height_pt) of paper sizes, upright."""
    return spark.createDataFrame([(k, float(w), float(h)) for k, (w, h) in PAPERS.items()], "name string, w double, h double").select("name", mm_to_points("w").alias("width_pt"), mm_to_points("h").alias("height_pt"))


def alignments(spark: SparkSession) -> DataFrame:
    """(name, horizontal, vertical) of alignment presets."""
    return spark.createDataFrame([(k, *v) for k, v in ALIGNMENTS.items()], "name string, horizontal int, vertical int")


def enum_name(kind: str, code: str | Column) -> Column:
    """The name of a print setting's code; null for others."""
    return F.try_element_at(F.array(*[F.lit(x) for x in ENUMS[kind]]), F.when(_c(code) >= 0, _c(code) + 1).cast("int"))


def rotated(width: str | Column, height: str | Column) -> Column:
    """A paper's size turned by a quarter."""
    return F.struct(_c(height).alias("width"), _c(width).alias("height"))


def margins(spark: SparkSession) -> DataFrame:
    """(name, left_pt, top_pt, right_pt, bottom_pt) of margin presets."""
    return spark.createDataFrame([(k, *(72.0 * x for x in v)) for k, v in MARGINS.items()], "name string, left_pt double, top_pt double, right_pt double, bottom_pt double")


def password_hash(password: str, salt: bytes | None = None, spins: int = 100_000) -> dict[str, str | int]:
    """What a protected sheet or document stores of a password: iterated SHA-512, the round number after the hash."""
    salt = os.urandom(16) if salt is None else salt
    h = hashlib.sha512(salt + password.encode("utf-16-le")).digest()
    for i in range(spins):
        h = hashlib.sha512(h + i.to_bytes(4, "little")).digest()
    return {"algorithmName": "SHA-512", "hashValue": base64.b64encode(h).decode(), "saltValue": base64.b64encode(salt).decode(), "spinCount": spins}
